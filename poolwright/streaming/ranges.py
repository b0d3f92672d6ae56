"""Long runs over a table in ranges of a key, which stop and go on without losing or repeating a row.

A run owns a folder. `plan` holds the ranges, so a run that goes on cuts the table where the first one did. Each range is
read through a filter on the key, which reaches the scan, and its result is written to a folder of its own under `data`, one
for each attempt. It is then audited, and counts from the moment its entry stands in `log`: an entry appears whole or not at
all, and never twice. Whatever was written without an entry, by a run that was killed or by a second run on the same ranges,
is not part of the result, and the next run clears it away and does the range again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Keys looked at to cut a table into ranges; they decide how even ranges are, not what is in them.
SAMPLE = 10_000
_ENTRY = "part int, attempt string, rows_in long, rows_out long"


class Failed(Exception):
    """A range whose result did not pass its audit."""


class Folder:
    """The files of a run in whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, name: str) -> list[str]:
        at = self._path(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())

    def create(self, name: str, text: str) -> bool:
        """Writes a small file that appears whole; false, with nothing changed, if there is one of that name already."""
        draft, target = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(name)
        out = self.fs.create(draft, False)
        out.write(text.encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(target.getParent())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, options)
            return True
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def cut(rows: DataFrame, by: str, ranges: int, sample: int = SAMPLE) -> list:
    """At most `ranges` - 1 keys, in order, that cut the table into parts of about the same number of keys: quantiles of the
    `sample` distinct keys of least hash."""
    some = rows.select(by).where(F.col(by).isNotNull()).distinct().orderBy(F.xxhash64(by), by).limit(sample).orderBy(by)
    keys = [r[0] for r in some.collect()]
    at = sorted({len(keys) * i // ranges for i in range(1, ranges)} - {0})
    return [keys[i] for i in at]


def within(by: str, bounds: list, part: int) -> Column:
    """The rows of a range: from a bound on, up to the next; those without a key go with the first."""
    key, out = F.col(by), F.lit(True)
    if part:
        out = key >= F.lit(bounds[part - 1])
    if part < len(bounds):
        out = out & (key < F.lit(bounds[part]))
    return out | key.isNull() if part == 0 else out


class Run:
    """A run of `work` over `rows` in `ranges` parts of the key `by`.

    `work` is applied to the rows of one range at a time, so it must not look across ranges unless `by` keeps together what
    it looks at. `required` are columns of the result that may not be null. `on_step(part, step)` is called after a range
    was written ("data") and after it was entered ("log"); what it raises stops the run.
    """

    def __init__(self, rows: DataFrame, by: str, work: Callable[[DataFrame], DataFrame], folder: str, ranges: int = 16, required: tuple[str, ...] = (), on_step: Callable[[int, str], None] = lambda part, step: None):
        self.rows, self.by, self.work, self.required, self.on_step = rows, by, work, required, on_step
        self.folder = Folder(rows.sparkSession, folder)
        kind = rows.schema[by].dataType.simpleString()
        plan = self.folder.read("plan")
        if plan is None:
            self.folder.create("plan", json.dumps({"by": by, "bounds": [str(x) for x in cut(rows, by, ranges)]}))
            plan = self.folder.read("plan")  # that of another run, if it was first
        plan = json.loads(plan)
        if plan["by"] != by:
            raise ValueError(f"the folder holds a run by {plan['by']}, not by {by}")
        self.bounds = [F.lit(x).cast(kind) for x in plan["bounds"]]

    def entries(self) -> dict[int, Row]:
        """The log: one entry for each finished range."""
        names = self.folder.names("log")
        if not names:
            return {}
        found = self.rows.sparkSession.read.schema(_ENTRY).json([f"{self.folder.path}/log/{n}" for n in names]).collect()
        return {r.part: r for r in found}

    def pending(self) -> list[int]:
        done = self.entries()
        return [k for k in range(len(self.bounds) + 1) if k not in done]

    def clear(self) -> int:
        """Removes what was written and never entered; returns how many attempts that were."""
        kept = {r.attempt for r in self.entries().values()}
        lost = [n for n in self.folder.names("data") if n not in kept]
        for name in lost:
            self.folder.remove(f"data/{name}")
        return len(lost)

    def do(self, part: int) -> bool:
        """Writes, audits and enters a range; false if another run was first."""
        attempt = f"{part:06d}-{uuid.uuid4().hex}"
        path = f"{self.folder.path}/data/{attempt}"
        own = self.rows.where(within(self.by, self.bounds, part))
        self.work(own).write.parquet(path)
        self.on_step(part, "data")
        spark = self.rows.sparkSession
        nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in self.required]
        seen = spark.read.parquet(path).agg(F.count("*").alias("_rows"), *nulls).first()
        if bad := [c for c in self.required if seen[c]]:
            raise Failed(f"range {part}: nulls in {', '.join(bad)}")
        entered = self.folder.create(f"log/{part:06d}.json", json.dumps({"part": part, "attempt": attempt, "rows_in": own.count(), "rows_out": seen["_rows"]}))
        if not entered:
            self.folder.remove(f"data/{attempt}")
        self.on_step(part, "log")
        return entered

    def go(self, most: int | None = None) -> list[int]:
        """Does what is pending, `most` ranges at most; returns what it entered."""
        self.clear()
        return [k for k in self.pending()[:most] if self.do(k)]

    def result(self) -> DataFrame:
        """The rows of all finished ranges."""
        paths = [f"{self.folder.path}/data/{r.attempt}" for _, r in sorted(self.entries().items())]
        if not paths:
            return self.work(self.rows.limit(0))
        return self.rows.sparkSession.read.parquet(*paths)

    def progress(self) -> DataFrame:
        """(part, attempt, rows_in, rows_out) of the finished ranges."""
        if not self.folder.names("log"):
            return self.rows.sparkSession.createDataFrame([], _ENTRY)
        return self.rows.sparkSession.read.schema(_ENTRY).json(f"{self.folder.path}/log")
