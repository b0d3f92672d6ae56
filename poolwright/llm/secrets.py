"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest is trained from labelled findings by MLlib and then written out as one Column expression, so scanning is a
projection of the text column: no shuffle, no Python, and a finding is scored where it stands. What its features know of
language, letter transitions and common words, is counted over all texts before, by one aggregate by word.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.llm.common import discard, stored

#: A name that holds one of the words, whatever stands around it (DB_PASSWORD, client_secret, userPassword2); an author, a secretary and a tokenizer are none.
_NAMED = r"[A-Za-z0-9_.-]*(?i:password|passwd|passphrase|pwd|(?<![a-z])pass(?![a-z])|secret(?!ar(?:y|i))|token(?!i[sz])|api[_-]?key|access[_-]?key|auth(?!or(?!i[sz])))[A-Za-z0-9_.-]*"
_SIGN = r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
_ALONE = r"(?<![A-Za-z0-9+/_-])"
_BEGIN, _END = (rf"-----{x} [A-Z ]{{0,30}}PRIVATE KEY(?: BLOCK)?-----" for x in ("BEGIN", "END"))
#: Candidate patterns by kind, tried in this order. The value of an assignment is what follows its sign and quote, that of a URL
#: the password in it. A private key goes to its END line, or, where another BEGIN or END comes first or none at all, as far
#: as lines of its letters follow. Groups repeat possessively, which Java runs as a loop, so texts of any length end in linear
#: time and without deep recursion.
PATTERNS = {
    "private_key": _BEGIN + rf"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+{_END}|(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]{{16,}}+)*+)",
    "url": r"://[^\s:/@\"'<>]++:[^\s/@\"'<>]{3,}+(?=@[A-Za-z0-9])",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "github": r"gh[pousr]_[A-Za-z0-9]{30,}",
    "slack": r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "service": r"sk[-_][A-Za-z0-9_-]{16,}",
    "assigned": r"(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]++[\"']?[ \t]{0,3}[:=])" + _NAMED + _SIGN + r"(?!-----BEGIN)[^\s\"',;]{6,}",
    "opaque": r"[A-Za-z0-9+/_-]{32,}={0,2}",
}
_SOLID = "|".join(PATTERNS[k] for k in ("aws_key", "github", "slack", "jwt", "service"))
CANDIDATE = f"{PATTERNS['private_key']}|{PATTERNS['url']}|(?<![A-Za-z0-9_])(?:{_ALONE}(?:{_SOLID})|{PATTERNS['assigned']}|{_ALONE}{PATTERNS['opaque']})"
_PREFIX, _URL_PREFIX = "^" + _NAMED + _SIGN, r"^://[^:]*:"
#: Words whose letters count as covered by the dictionary: what placeholders, identifiers and paths are made of.
DICTIONARY = (
    "the and for you your this that with from have here not value name user admin root login account example sample dummy fake test demo default change "
    "changeme placeholder password passwd secret token key api access auth client server service config setting string null none true false empty local "
    "host path file home usr lib bin etc var opt src main index python java node module package class function method return public private static "
    "hash commit sha checksum digest version release branch master build data table column http https www com org net html json xml yaml enter insert replace"
).split()
HINTS = ("password", "passwd", "secret", "token", "key", "credential", "credentials", "auth", "bearer", "login", "access")
DOUBTS = ("example", "sample", "dummy", "fake", "placeholder", "test", "your", "commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "id", "revision", "etag", "integrity")
PATH_DOUBTS = r"(?i)(^|[/_.-])(tests?|examples?|samples?|fixtures?|docs?|mocks?|demo)([/_.-]|$)"
#: The dictionary learned from texts: the COMMON most frequent words of 3 to 20 letters that occur at least OFTEN times. The
#: words of DICTIONARY count as OFTEN occurrences more each.
COMMON, OFTEN = 1000, 10
_UNIFORM = math.log2(26)
FEATURES = ("length", "turns", "digits", "capitals", "distinct", "dictionary", "known", "surprise", "path_like", "path_doubt", "doubt_near", "hint_near", "named_kind", "repeats")
TREES, DEPTH, SEED, MAX_FINDINGS, THRESHOLD = 20, 6, 7, 20_000, 0.5
MARK = "[SECRET]"


def _share(n: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))


def _in(words: tuple[str, ...], *texts: Column) -> Column:
    """Is one of the words among those of the texts."""
    found = F.split(F.lower(F.concat_ws(" ", *texts)), r"[^A-Za-z0-9]+")
    return F.arrays_overlap(found, F.array(*map(F.lit, words))).cast("double")


class Letters(NamedTuple):
    """What the features know of language: common words, and the bits that a letter costs after another (26 rows of 26)."""

    words: tuple[str, ...]
    bits: tuple[float, ...]


def letters(pairs: dict[str, int], words: tuple[str, ...] = ()) -> Letters:
    """Of counted pairs of letters and common words; DICTIONARY is added to both, and each pair is counted once more."""
    n = [1] * 676
    place = lambda x: (ord(x[0]) - 97) * 26 + ord(x[1]) - 97
    for pair, count in [*pairs.items(), *((w[i : i + 2], OFTEN) for w in DICTIONARY for i in range(len(w) - 1))]:
        n[place(pair)] += count
    rows = [sum(n[i : i + 26]) for i in range(0, 676, 26)]
    return Letters(tuple(dict.fromkeys([*DICTIONARY, *words])), tuple(round(math.log2(rows[i // 26] / x), 4) for i, x in enumerate(n)))


PLAIN = letters({})


def learn(docs: DataFrame) -> Letters:
    """Letters of all texts of `docs`. Case is folded and whatever is no letter a to z parts words. What reaches the driver is
    COMMON words and at most 676 pairs. Null and empty texts have no words; no other column is read."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w") > 1)
    counts = stored(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    common = counts.where(F.length("w").between(3, 20) & (F.col("n") >= OFTEN)).orderBy(F.desc("n"), "w").limit(COMMON)
    pairs = counts.select(F.explode(F.regexp_extract_all("w", F.lit("(?=([a-z][a-z]))"), 1)).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    out = letters({r.pair: r.n for r in pairs.collect()}, tuple(r.w for r in common.collect()))
    discard(counts)
    return out


def _language(value: Column, known: Letters) -> list[Column]:
    """The share of a candidate that common words cover, and the mean bits of its letters after letters."""
    table = F.expr("array(" + ",".join(f"{x!r}D" for x in known.bits) + ")")
    parts = F.regexp_extract_all(F.lower(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")), F.lit("[a-z]{3,}"), 0)
    covered = F.aggregate(F.filter(parts, lambda w: w.isin(*known.words)), F.lit(0), lambda a, w: a + F.char_length(w))
    pairs = F.regexp_extract_all(F.lower(value), F.lit("(?=([a-z][a-z]))"), 1)
    bits = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.get(table, (F.ascii(p) - 97) * 26 + F.ascii(F.substring(p, 2, 1)) - 97))
    return [_share(covered, F.char_length(value)), F.coalesce(F.try_divide(bits, F.size(pairs).cast("double")), F.lit(_UNIFORM))]


def features(value: Column, before: Column, after: Column, path: Column, kind: Column, known: Letters = PLAIN) -> Column:
    """FEATURES of a candidate as array<double>."""
    low, n = F.lower(value), F.char_length(value)
    covered = F.aggregate(F.filter(F.array(*map(F.lit, DICTIONARY)), lambda w: F.contains(low, w)), F.lit(0), lambda a, w: a + F.char_length(w))
    return F.array(
        n.cast("double"),
        _share(F.regexp_count(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1, n),
        _share(F.regexp_count(value, F.lit("[0-9]")), n),
        _share(F.regexp_count(value, F.lit("[A-Z]")), n),
        _share(F.size(F.array_distinct(F.split(value, ""))), n),
        F.least(F.lit(1.0), _share(covered, n)),
        *_language(value, known),
        value.rlike(r"^[.~]?/|/[a-z]+/|\.[a-z]{2,4}$").cast("double"),
        F.coalesce(path, F.lit("")).rlike(PATH_DOUBTS).cast("double"),
        _in(DOUBTS, before, after),
        _in(HINTS, before, after),
        (~kind.isin("assigned", "opaque", "url")).cast("double"),
        F.regexp_count(value, F.lit(r"(.)\1")).cast("double"),
    )


def sample_findings(spark: SparkSession, n: int = 3000, words: tuple[str, ...] = tuple(DICTIONARY)) -> DataFrame:
    """Labelled findings (value, before, after, path, kind, is_secret) made by rule: keys and hexadecimal or mixed secrets
    against placeholders, identifiers of `words`, paths, checksums and runs. Takes the place of a reviewed table where there is none."""
    listed = F.expr("array(" + ",".join(f"'{w}'" for w in words) + ")")
    ids = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hex"))
    pick = lambda k, words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    part = lambda k, lo, hi: F.substr("hex", F.lit(k), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(hi - lo + 1)) + lo).cast("int"))
    mixed = F.regexp_replace(F.base64(F.unhex("hex")), "[+/=]", "")
    word = lambda k: F.get(listed, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))).cast("int"))
    true = [
        (F.concat(F.lit("AKIA"), F.substr(F.upper(F.translate(mixed, "ghjk", "QRST")), F.lit(1), F.lit(16))), "aws_key"),
        (part(1, 10, 20), "assigned"),
        (part(3, 24, 50), "assigned"),
        (F.substr(mixed, F.lit(1), F.lit(16)), "assigned"),
        (F.substr(mixed, F.lit(2), F.lit(40)), "opaque"),
        (F.concat(F.lit("ghp_"), F.substr(mixed, F.lit(1), F.lit(36))), "github"),
        (F.concat(F.lit("sk-"), F.substr(mixed, F.lit(4), F.lit(32))), "service"),
        (F.concat(word(5), F.substr(mixed, F.lit(3), F.lit(6)), F.lit("!")), "assigned"),
        (F.substr(mixed, F.lit(5), (F.pmod("id", F.lit(14)) + 6).cast("int")), "url"),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.repeat(F.concat(mixed, F.lit("\n")), (F.pmod("id", F.lit(40)) + 2).cast("int")), F.lit("-----END RSA PRIVATE KEY-----")), "private_key"),
    ]
    false = [
        (F.concat(word(1), word(2)), "assigned"),
        (F.concat_ws("_", word(1), word(2), word(3)), "assigned"),
        (pick(10, ["password", "pass", "secret", "user", "xxxx", "changeme", "example", "name"]), "url"),
        (F.concat_ws("-", F.lit("your"), word(2), word(3), F.lit("here")), "assigned"),
        (F.concat(F.lit("/usr/lib/"), word(1), F.lit("/"), word(2), F.lit("/"), word(3), F.lit("/"), word(4)), "opaque"),
        (F.repeat(pick(6, ["x", "0", "a", "xX", "12", "ab"]), 20), "opaque"),
        (part(2, 40, 40), "opaque"),  # a checksum beside a word that says so
        (F.concat_ws("_", word(1), word(2), word(3), word(4), word(5), word(6), word(7)), "opaque"),
        (F.concat(word(3), pick(9, ["1", "12", "123", "1234", "2024"])), "assigned"),
        (F.lit("-----BEGIN RSA PRIVATE KEY-----"), "private_key"),
    ]
    row = F.pmod(F.xxhash64("id", F.lit("row")), F.lit(len(true) + len(false))).cast("int")
    kinds = F.array(*[F.struct(v.alias("value"), F.lit(k).alias("kind"), F.lit(s).alias("is_secret")) for rows, s in ((true, 1), (false, 0)) for v, k in rows])
    checksum = row == len(true) + 6
    return ids.select(
        F.get(kinds, row).alias("f"),
        F.when(checksum, pick(11, DOUBTS[7:])).when(F.get(kinds, row)["is_secret"] == 1, pick(12, [*HINTS, "is", "with", "of", "for", "this"])).otherwise(pick(13, [*HINTS, *DOUBTS, "is", "with", "of", "for", "this"])).alias("before"),
        pick(14, ["and", "then", "for", "in", "the", "is", "export", "import", "end", ""]).alias("after"),
        F.when(F.get(kinds, row)["is_secret"] == 1, pick(15, ["src/main", "app/settings.py", "deploy.yaml", "src1"])).otherwise(pick(16, ["src/main", "tests/unit", "docs/example.md", "app/settings.py", "src1"])).alias("path"),
    ).select("f.value", "before", "after", "path", "f.kind", "f.is_secret")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, most: int = MAX_FINDINGS, known: Letters = PLAIN):
    """The forest of labelled findings; fitted on at most `most` of them, those with the least hash."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    texts = [F.coalesce(c, F.lit("")) for c in ("value", "before", "after", "path")]
    rows = findings.where("is_secret is not null").select(features(*texts, F.coalesce("kind", F.lit("opaque")), known).alias("f"), F.col("is_secret").cast("double").alias("label"), F.xxhash64("value", "before", "after").alias("h"))
    rows = stored(rows.orderBy("h").limit(most), "findings")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows.select(array_to_vector("f").alias("features"), "label"))


def forest_rules(model) -> list:
    """The trees of a fitted forest as nested (feature, limit, below, above) with 0.0 or 1.0 at the leaves."""
    lines = [x.strip() for x in model.toDebugString.splitlines() if re.match(r"\s+(Tree|If|Else|Predict)", x)]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, limit = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
        below = node()
        at += 1  # the Else line
        return int(feature), float(limit), below, node()

    out = []
    while at < len(lines):
        at += 1  # the Tree line
        out.append(node())
    return out


def votes(rules: list, f: Column) -> Column:
    """The share of trees that call a candidate with features `f` a secret."""

    def walk(node) -> Column:
        return F.lit(node) if isinstance(node, float) else F.when(f[node[0]] <= F.lit(node[1]), walk(node[2])).otherwise(walk(node[3]))

    total = F.lit(0.0)
    for tree in rules:
        total = total + walk(tree)
    return total / F.lit(float(len(rules)))


def default_forest(spark: SparkSession, known: Letters = PLAIN) -> list:
    return forest_rules(train(sample_findings(spark, words=known.words), known=known))


def _ready(docs: DataFrame, rules: list | None, known: Letters | None) -> tuple[list, Letters]:
    """A forest goes with the letters that it was trained with; without one, letters are learned from `docs`."""
    known = known or (learn(docs) if rules is None else PLAIN)
    return (default_forest(docs.sparkSession, known) if rules is None else rules), known


def running_sums(numbers: Column, step: int = 256) -> Column:
    """The sums of an array's first one, two, ... numbers: sums of whole runs of `step`, then the rest of one's own run."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)
    runs = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / step).cast("int")), lambda k: total(F.slice(x, k * step + 1, F.lit(step))))
    before = lambda x: F.aggregate(runs(x), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    both = lambda s: F.transform(s["n"], lambda _, i: F.get(s["b"], F.floor(i / step).cast("int")) + total(F.slice(s["n"], i - i % step + 1, i % step + 1)))
    with_runs = F.transform(F.array(numbers), lambda x: F.struct(x.alias("n"), before(x).alias("b")))
    return F.get(F.transform(with_runs, both), 0)


def with_findings(docs: DataFrame, rules: list, path: str | None = None, known: Letters = PLAIN) -> DataFrame:
    """`docs` as a struct `row`, so that no column of theirs meets another, with `_pieces` (the text between candidates),
    `_hits` (what is between the pieces) and `_found`: an array of kind, start, end (code points of the value), score; all
    are null where a text has no candidate."""
    text, where = F.col("row.text"), F.col(f"row.`{path}`").cast("string") if path else F.lit("")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = out.withColumn("_hits", F.regexp_extract_all(text, F.lit(CANDIDATE), 0)).withColumn("_hits", F.when(F.size("_hits") > 0, F.col("_hits")))
    out = out.withColumn("_pieces", F.when(F.col("_hits").isNotNull(), F.split(text, CANDIDATE, -1)))
    kind = lambda m: F.coalesce(*[F.when(m.rlike(f"^(?:{p})"), F.lit(k)) for k, p in (PATTERNS | {"url": "://"}).items()])
    n = F.size("_hits")
    around = F.arrays_zip(F.col("_hits").alias("hit"), F.slice("_pieces", F.lit(1), n).alias("piece"), F.slice("_pieces", F.lit(2), n).alias("next"))  # what lambdas use comes in by the array: a column named inside one would be computed for each element
    ends = running_sums(F.transform(around, lambda x: F.char_length(x["piece"]) + F.char_length(x["hit"])))
    value = lambda m, k: F.when(k == "assigned", F.regexp_replace(m, _PREFIX, "")).when(k == "url", F.regexp_replace(m, _URL_PREFIX, "")).otherwise(m)
    kinds = F.transform(around, lambda x: F.struct(x["hit"].alias("hit"), x["piece"].alias("piece"), x["next"].alias("next"), kind(x["hit"]).alias("kind")))
    seen = F.transform(
        kinds,
        lambda x: F.struct(
            x["kind"].alias("kind"),
            value(x["hit"], x["kind"]).alias("value"),
            F.concat_ws(" ", F.regexp_extract(F.substring(x["piece"], -64, 64), r"(\S+)\s*$", 1), F.when(x["kind"] == "assigned", F.regexp_replace(F.regexp_extract(x["hit"], "^[A-Za-z0-9_.-]+", 0), "([a-z0-9])([A-Z])", "$1 $2"))).alias("before"),
            F.regexp_extract(F.substring(x["next"], 1, 64), r"^[\"',;]?\s*(\S+)", 1).alias("after"),
        ),
    )
    out = out.withColumn("_seen", F.when(F.col("_hits").isNotNull(), seen)).withColumn("_ends", F.when(F.col("_hits").isNotNull(), ends))
    out = out.withColumn("_f", F.when(F.col("_seen").isNotNull(), F.transform("_seen", lambda s: features(s["value"], s["before"], s["after"], where, s["kind"], known))))
    out = out.withColumn("_score", F.when(F.col("_f").isNotNull(), F.transform("_f", lambda f: votes(rules, f))))
    all_of = F.arrays_zip(F.col("_seen").alias("s"), F.col("_ends").alias("e"), F.col("_score").alias("v"))
    found = F.transform(all_of, lambda x: F.struct(x["s"]["kind"].alias("kind"), (x["e"] - F.char_length(x["s"]["value"])).alias("start"), x["e"].alias("end"), x["v"].alias("score")))
    return out.withColumn("_found", F.when(F.col("_seen").isNotNull(), found)).drop("_seen", "_ends", "_f", "_score")


def scan(docs: DataFrame, rules: list | None = None, path: str | None = None, threshold: float = THRESHOLD, known: Letters | None = None) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, findings) for each row of `docs`; findings has kind, start, end (code points, end
    exclusive), score and is_secret of every candidate in order.

    Null and empty texts have none. A null doc_id is carried, repeated rows give repeated rows, an empty table none; no
    column but doc_id, text and `path` is read.
    """
    rules, known = _ready(docs, rules, known)
    columns = ["doc_id", "text", *([path] if path else [])]
    full = F.transform("_found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"), (x["score"] >= threshold).alias("is_secret")))
    own = with_findings(docs.select(*dict.fromkeys(columns)), rules, path, known).select("row.doc_id", F.coalesce(full, F.array().cast("array<struct<kind:string,start:int,end:int,score:double,is_secret:boolean>>")).alias("findings"))
    return own.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(F.filter("findings", lambda x: x["is_secret"])).cast("long").alias("n_secrets"), "findings")


def redact(docs: DataFrame, rules: list | None = None, path: str | None = None, threshold: float = THRESHOLD, known: Letters | None = None) -> DataFrame:
    """`docs`, all columns, with the value of each secret replaced by MARK; n_chars, where there is such a column, follows.

    Null and empty texts stay as they are. Rows are independent: repeated rows and null doc_ids are carried, an empty table
    gives none; columns may have any name.
    """
    rules, known = _ready(docs, rules, known)
    own = with_findings(docs, rules, path, known)
    each = F.arrays_zip(F.col("_hits").alias("hit"), F.slice("_pieces", F.lit(1), F.size("_hits")).alias("piece"), F.col("_found").alias("f"))
    parts = F.transform(each, lambda x: F.concat(x["piece"], F.when(x["f"]["score"] >= threshold, F.concat(F.substring(x["hit"], F.lit(1), F.char_length(x["hit"]) - x["f"]["end"] + x["f"]["start"]), F.lit(MARK))).otherwise(x["hit"])))
    text = F.when(F.col("_hits").isNull(), F.col("row.text")).otherwise(F.concat(F.array_join(parts, ""), F.element_at("_pieces", -1)))
    new = {"text": F.col("_text")} | ({"n_chars": F.char_length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return own.select("row", text.alias("_text")).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    line = F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"), F.format_string("%.2f", x["score"])))
    return scan(docs, path="source").select("doc_id", "n_candidates", "n_secrets", F.array_join(line, ",").alias("findings"))
