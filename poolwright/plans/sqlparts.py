"""SQL of the oracles: the same facts as the Column functions, written for DuckDB and for the derived pools."""

import re

from poolwright.functions import hygiene as _hygiene
from poolwright.functions import motif as _motif
from poolwright.plans.adapters import slots_sql

_NUMBER = r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?(?:e[-+]?\d+)?"


def phrases(parts: tuple[str, ...]) -> str:
    """A pattern that matches any of the phrases, quoted for SQL; that the phrases stand in one place keeps both sides equal."""
    return "|".join(re.escape(p).replace(r"\ ", " ").replace("'", "''") for p in parts)


_LEAKS, _STARTS = phrases(_hygiene.LEAKS["selector"]), phrases(_hygiene.SCAFFOLD_STARTS)


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(trim({x})), '^final answer:\s*', ''))"


def canon(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(replace({x}, ',', ''), '^\+', ''), '(\.\d*[1-9])0+$', '\1'), '\.0*$', '')"


def num(x: str) -> str:
    last = f"regexp_extract_all({norm(x)}, '{_NUMBER}')[-1]"
    return canon(last)


def tail(x: str) -> str:
    n = norm(x)
    forms = [rf"^(?:final answer|answer)\s*[:\-]?\s*({_NUMBER})\s*[.!?]*$", rf"^(?:the\s+)?answer\s+is\s+({_NUMBER})\s*[.!?]*$", rf"^\(?({_NUMBER})\)?[.!?]*$", rf"^.*=\s*({_NUMBER})\s*[.!?]*$"]
    return "coalesce(" + ", ".join(canon(f"nullif(regexp_extract({n}, '{p}', 1), '')") for p in forms) + ")"


def choice(x: str) -> str:
    label = r"(?i)(?:final answer|answer|option|choice)\s*[:\-]?\s*\(?([A-J])\)?"
    return rf"""coalesce(upper(regexp_extract_all({x}, '{label}', 1)[-1]), nullif(upper(regexp_extract({norm(x)}, '^\(?([a-j])\)?[.)]?$', 1)), ''),
 case when len(regexp_extract_all(upper({x}), '\b([A-J])\b', 1)) = 1 then regexp_extract_all(upper({x}), '\b([A-J])\b', 1)[1] end)"""


def ok(x: str, gold: str, kind: str = "num") -> str:
    same = f"{norm(x)} = {norm(gold)}"
    return f"coalesce({same} or {choice(x)} = {choice(gold)}, false)" if kind == "choice" else f"coalesce({same} or {num(x)} = {num(gold)}, false)"


def leak(x: str) -> str:
    return f"regexp_matches(lower(trim({x})), '{_LEAKS}')"


def scaffold(x: str) -> str:
    return f"regexp_matches(lower(trim({x})), '^(?:{_STARTS})')"


def words(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


def wrapper(x: str) -> str:
    return f"len(regexp_extract_all(lower({x}), 'final answer:')) > 1"


def malformed(x: str, kind: str = "num") -> str:
    parsed = choice(x) if kind == "choice" else num(x)
    return rf"""({x} = '' or lower({x}) in ('correct', 'incorrect', 'true', 'false', 'none', 'n/a') or {wrapper(x)} or {leak(x)} or regexp_matches({x}, '([:\-=(\[{{,]| or| and| the)$')
 or regexp_matches({x}, '\[[^\]]*$|\([^)]*$|\{{[^}}]*$') or ({parsed} is null and {words(x)} <= 2))"""


def slots(kind: str = "num", name: str = "slots") -> str:
    return f"{name} as ({slots_sql(kind)}), {name}_ok as (select *, {ok('candidate', 'gold_answer', kind)} ok from {name})"


def flags(kind: str = "num", name: str = "slots", out: str = "flags") -> str:
    best = lambda c, m: f"first({c} order by {m} desc, slot)"
    return f"""{slots(kind, name)}, {out} as (select example_id, any_value(problem) problem, any_value(gold_answer) gold_answer, any_value(answer_mode) answer_mode, count(*) n_candidates, bool_or(ok) oracle, min(case when ok then slot + 1 end) first_correct_position,
 first(ok order by slot) first_ok, {best('ok', 'base_margin')} base_ok, {best('ok', 'margin')} verifier_ok, first(candidate order by slot) first_text, {best('candidate', 'base_margin')} base_text, {best('candidate', 'margin')} verifier_text,
 {best('slot', 'margin')} verifier_slot from {name}_ok group by example_id)"""


def scored(kind: str = "num") -> str:
    """Slots with what the selector rules read."""
    parsed = choice("candidate") if kind == "choice" else num("candidate")
    key = f"coalesce('parsed::' || {parsed}, 'text::' || {norm('candidate')})"
    return f"""{slots(kind)}, facts as (select *, {parsed} parsed, {leak('candidate')} leak, {scaffold('candidate')} scaffold, {malformed('candidate', kind)} malformed, {key} k,
 row_number() over (partition by example_id order by margin desc, slot) - 1 rank from slots_ok), scored as (select *, (parsed is null)::int + leak::int + scaffold::int + malformed::int dirty,
 row_number() over (partition by example_id, k order by slot) - 1 dup_rank, count(*) over (partition by example_id, k) group_size from facts)"""


def quality(x: str) -> str:
    """The quality label of a candidate of the derived pools (one line, single spaces)."""
    low, n = f"lower({x})", words(x)
    ends = "then|so|because|which|that|the|a|an|of|to|for|from|is|are|was|were|be|by|with"
    i = lambda c: f"({c})::int"
    f = " + ".join([i(f"length({x}) < 18"), i(f"{n} <= 4"), i(f"regexp_matches({low}, '(?:{ends})$')")])
    p = " + ".join([i(rf"regexp_matches({low}, '\b(step\s*\d+|then|so)\b')"), i(rf"regexp_matches({low}, '-?\d+(?:\.\d+)?')"), i(f"{n} >= 12")])
    c = " + ".join([i(rf"regexp_matches({low}, '\bfinal answer:\b')"), i(f"regexp_matches({x}, '[.!?]$')"), i(rf"regexp_matches({low}, '\btherefore\b|\bso the answer\b')"), i(f"{n} >= 20")])
    return f"case when {x} = '' then 'fragment' when ({c}) >= 2 and ({c}) >= ({p}) then 'complete_attempt' when ({f}) >= 2 and ({f}) >= ({p}) then 'fragment' else 'partial_solution' end"


def _list(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"case when {c} then '{n}' end" for c, n in pairs) + "], lambda x: x is not null)"


def _motif_lists(p: str, c: str) -> list[str]:
    """The cue list of each motif in order of priority; p, c: collapsed lower-case problem and candidate (may be '')."""
    both, has = f"({p} || chr(10) || {c})", lambda x, r: f"regexp_matches({x}, '{r}')"
    said = {m: [(has(both, _motif._FORMS.get(w, rf"\b{w}\b")), w.replace(" ", "_")) for w in ws] for m, ws in _motif.CUES.items()}
    said |= {m: [(has(c, r), n) for n, r in cues.items()] for m, cues in _motif.CANDIDATE_CUES.items()}
    said["count_aggregation"].append((f"len(regexp_extract_all({c}, 'step')) >= 2", "candidate:multi_step"))
    units = [u for g in _motif.UNITS.values() for u in g]
    joined = f"({p} || ' ' || {c})"
    kinds = " + ".join("(" + has(joined, rf"\b(?:{'|'.join(g)})\b") + ")::int" for g in _motif.UNITS.values())
    found = rf"len(list_distinct(regexp_extract_all({joined}, '\b(?:{'|'.join(units)})\b')))"
    said["unit_conversion"] = [(f"({kinds}) >= 2 or {found} >= 2 and " + has(joined, r"\bconvert\b|\bcontains\b|\bper\b|\beach\b"), "unit_groups>=2")]
    said["arithmetic_finish"] = [(rf"len(regexp_extract_all({c}, '-?\d+(?:\.\d+)?')) >= 2 and regexp_matches({c}, '[+\-*/=]') or regexp_matches({c}, '\bsubtract\b|\badd\b|\bmultiply\b|\bdivide\b')", "candidate:arithmetic_ops"), (f"contains({c}, 'final answer:')", "candidate:final_answer")]
    return [_list(said[m]) for m in _motif.PRIORITY]


def _motif_columns(p: str, c: str, name: str) -> str:
    lists = ", ".join(f"{x} l{i}_{name}" for i, x in enumerate(_motif_lists(p, c)))
    return lists


def _best(name: str) -> str:
    return "greatest(" + ", ".join(f"len(l{i}_{name}) * 10 + {i}" for i in range(len(_motif.PRIORITY))) + ")"


def tags(kind: str = "num") -> str:
    """Slots and motif tags of the derived pools: tags has what tag_pool() gives, and the columns of a slot."""
    names = "[" + ", ".join(f"'{m}'" for m in _motif.PRIORITY) + "]"
    x, low = "candidate", "lower(candidate)"
    ends = "(?:" + "|".join(_motif.DANGLING) + ")$"
    n = words(x)
    f = _list([(f"length({x}) < 18", "short_chars"), (f"{n} <= 4", "short_words"), (f"regexp_matches({low}, '{ends}')", "dangling_suffix")])
    p = _list([(rf"regexp_matches({low}, '\b(step\s*\d+|then|so)\b')", "reasoning_marker"), (rf"regexp_matches({low}, '-?\d+(?:\.\d+)?')", "contains_number"), (f"{n} >= 12", "long_enough")])
    c = _list([(rf"regexp_matches({low}, '\bfinal answer:\b')", "final_answer"), (f"regexp_matches({x}, '[.!?]$')", "terminal_punctuation"), (rf"regexp_matches({low}, '\btherefore\b|\bso the answer\b')", "final_conclusion"), (f"{n} >= 20", "substantial_length")])
    label = lambda s: f"case when b_{s} < 10 then 'other_or_unclear' else {names}[b_{s} % 10 + 1] end"
    chosen = "[" + ", ".join(f"l{i}_m" for i in range(len(_motif.PRIORITY))) + "]"
    return f"""{slots(kind)}, tag0 as (select *, slot candidate_index, candidate candidate_text, {_motif_columns('lower(problem)', low, 'm')}, {_motif_columns('lower(problem)', "''", 'pm')}, {f} qf, {p} qp, {c} qc, {n} tokens_all from slots_ok),
 tag1 as (select *, {_best('m')} b_m, {_best('pm')} b_pm, case when {x} = '' then 'fragment' when len(qc) >= 2 and len(qc) >= len(qp) then 'complete_attempt' when len(qf) >= 2 and len(qf) >= len(qp) then 'fragment' else 'partial_solution' end quality_label from tag0),
 tags as (select *, ok candidate_is_correct, {label('m')} motif_label, {label('pm')} problem_motif_label, case when b_m < 10 then [] else list_sort({chosen}[b_m % 10 + 1]) end motif_cues, case when b_m < 10 then 0.2 else least(0.95, 0.35 + 0.12 * (b_m // 10)) end motif_confidence,
 list_sort(case quality_label when 'complete_attempt' then qc when 'fragment' then qf else case when len(qp) = 0 then ['default_partial'] else qp end end) quality_cues, case quality_label when 'complete_attempt' then least(0.95, 0.45 + 0.12 * len(qc)) when 'fragment' then least(0.95, 0.45 + 0.12 * len(qf)) else least(0.9, 0.4 + 0.1 * greatest(len(qp), 1)) end quality_confidence from tag1)"""


def slot_features(source: str) -> str:
    """feat: what the removal policies read of the slots 1 to 3 of numeric pools; smaller goes first."""
    i = lambda c: f"({c})::int::double"
    wrapped = "contains(lower(candidate), 'final answer:')"
    return f"""fact as (select *, {num('candidate')} is null invalid_, {leak('candidate')} leak_, {scaffold('candidate')} scaffold_, motif_label = problem_motif_label same_, {wrapped} wrapped_, coalesce(margin, 0.0) support, least(tokens_all, 40)::double tokens from {source} where slot between 1 and 3),
 feat as (select *, case quality_label when 'fragment' then 0.0 when 'partial_solution' then 1.0 else 2.0 end quality, case quality_label when 'partial_solution' then 0.0 when 'fragment' then 1.0 else 2.0 end partials, {i('not invalid_')} invalid, {i('not leak_')} leak, {i('not scaffold_')} scaffold, {i('wrapped_')} wrapper, {i('same_')} motif,
 4 * {i('not invalid_')} + 2 * {i('wrapped_')} + least(tokens, 12.0) / 12.0 - 2 * {i('leak_')} - 1.5 * {i('scaffold_')} closure, {i('margin is null')} missing, -(4.0 * {i('invalid_')} + 3.0 * {i('leak_')} + 2.0 * {i('scaffold_')} + 1.5 * {i('not wrapped_')}) risk,
 case quality_label when 'complete_attempt' then 3.0::double when 'partial_solution' then 2.5::double else 1.5::double end + 0.75::double * {i('same_')} + 0.5::double * {i('wrapped_')} + 0.5::double * greatest(support, 0.0) salvage, {i(f"not invalid_ and tokens <= 6 and not leak_")} short from fact)"""


def key(x: str) -> str:
    """What makes two candidates of a numeric pool the same."""
    return f"coalesce('num:' || {num(x)}, 'text:' || {norm(x)})"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _lines(x: str, v: str = "l") -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '\r\n|[\n\v\f\r]'), lambda {v}: {_strip(v)}), lambda {v}: {v} <> '')"


def _said(x: str) -> str:
    """The lines of a text without openings and instructions, joined again."""
    openings = "|".join(_hygiene.SCAFFOLD_PREFIXES).replace("'", "''")
    bare = rf"list_transform({_lines(x)}, lambda l: {_strip(rf"regexp_replace(l, '(?i)^(?:\s*(?:{openings}))+', '')")})"
    answers = "|".join(_hygiene._ANSWER_LINES)
    return f"array_to_string(list_filter({bare}, lambda l: l <> '' and (regexp_matches(lower(l), '^(?:{answers})') or not regexp_matches(lower(l), '{_LEAKS}'))), chr(10))"


def normalized(kind: str) -> str:
    """norm_<kind>: each slot of a pool with its candidate as one answer line, and what was done to it."""
    label, token = r"(?i)^(?:final answer|answer)\s*[:\-]\s*", (lambda x: choice(x)) if kind == "choice" else (lambda x: num(x))
    k = kind
    return rf"""{slots(k, f'slots_{k}')}, n0_{k} as (select example_id, slot, {_strip('candidate')} old_ from slots_{k}),
 n1_{k} as (select *, {_said(_strip(r"regexp_replace(old_, '(?is)\n(?:human|user|assistant|problem)\b[,:]?.*$', '')"))} s from n0_{k}),
 n2_{k} as (select *, instr(lower(s), 'final answer:') at_ from n1_{k}),
 n3_{k} as (select *, {_said("substr(s, 1, greatest(at_ - 1, 0))")} before_, regexp_replace(coalesce({_lines("substr(s, at_ + 13)")}[1], ''), '(?i)^(?:final answer\s*:\s*)+', '') said_ from n2_{k}),
 n4_{k} as (select *, case when at_ = 0 then s when said_ <> '' and before_ <> '' then before_ || chr(10) || 'Final answer: ' || said_ when said_ <> '' then 'Final answer: ' || said_ else s end clean_ from n3_{k}),
 n5_{k} as (select *, coalesce(nullif(clean_, ''), old_) work_, {_lines("coalesce(nullif(clean_, ''), old_)")} rows_ from n4_{k}),
 n6_{k} as (select *, list_filter(range(1, len(rows_) + 1), lambda i: regexp_matches(rows_[i], '{label}'))[-1] last_ from n5_{k}),
 n7_{k} as (select *, coalesce(nullif({_strip(f"regexp_replace(rows_[last_], '{label}', '')")}, ''), nullif(rows_[last_ + 1], ''), regexp_extract_all(work_, '\\boxed\{{([^}}]+)\}}', 1)[-1],
  nullif({_strip(r"regexp_extract(work_, '(?i)the answer is\s*:?\s*([^\n.]+)', 1)")}, ''), rows_[-1], '') pred_ from n6_{k}),
 n8_{k} as (select *, coalesce({token('pred_')}, {token('work_')}) token_ from n7_{k}),
 norm_{k} as (select '{k}' kind, example_id, slot, coalesce('Final answer: ' || token_, work_) candidate,
  case when token_ is null and work_ = old_ then 'unchanged' when token_ is null then 'sanitized_only' when 'Final answer: ' || token_ = old_ then 'unchanged' else 'rewritten' end action from n8_{k})"""
