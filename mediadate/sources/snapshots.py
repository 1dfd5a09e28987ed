"""Tables that are replaced as a whole, as numbered Parquet folders."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotTable:
    """A table whose every version is a Parquet folder ``v=<number>`` below one root.

    A reader takes the highest version with a ``_SUCCESS`` mark. A version is written from the one
    before without touching it, so a lost job leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def version(self) -> int:
        """Highest finished version, 0 when there is none."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        marks = files.globStatus(jvm.org.apache.hadoop.fs.Path(self.root + "/v=*/_SUCCESS")) or []
        return max((int(mark.getPath().getParent().getName()[2:]) for mark in marks), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, the newest by default; columns it lacks are null."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v={version}")

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        """Write the next version and return its number."""
        version = self.version() + 1 if version is None else version
        empty = self.spark.createDataFrame([], self.schema)
        aligned = empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns)
        aligned.write.mode("overwrite").parquet(f"{self.root}/v={version}")
        return version


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the finished folders that a pattern matches."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    marks = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return [mark.getPath().getParent().getName() for mark in marks]


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Part(NamedTuple):
    """The batches from first to last; level 0 is one batch, each merge of parts is a level more."""

    first: int
    last: int
    level: int

    @property
    def folder(self) -> str:
        return f"batch={self.first}" if self.level == 0 else f"merged={self.level}-{self.first}-{self.last}"

    @classmethod
    def named(cls, folder: str) -> Part:
        kind, numbers = folder.split("=")
        if kind == "batch":
            return cls(int(numbers), int(numbers), 0)
        level, first, last = map(int, numbers.split("-"))
        return cls(first, last, level)


def covering(parts: Iterable[Part]) -> list[Part]:
    """The widest parts, in order; a part inside another one is what that one was merged from."""
    chosen: list[Part] = []
    for part in sorted(parts, key=lambda p: (p.first, -p.last, -p.level)):
        if not chosen or part.first > chosen[-1].last:
            chosen.append(part)
    return chosen


def due_merge(parts: Iterable[Part], fan: int) -> list[Part]:
    """The newest parts of one level, if there are ``fan`` of them; a table of n batches reads at most fan * log(n) parts."""
    run: list[Part] = []
    for part in reversed(covering(parts)):
        if run and part.level != run[0].level:
            break
        run.insert(0, part)
    return run if len(run) >= fan else []


class AppendTable:
    """A table that only grows: one Parquet folder ``batch=<number>`` per batch, merged as they become many.

    ``fan`` neighboring parts of a level are merged into one of the next, so that a row is rewritten
    once a level. Merged parts are deleted one merge later, when readers that listed them have gone.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, fan: int | None = 16):
        self.spark, self.root, self.schema, self.fan = spark, root.rstrip("/"), schema, fan

    def parts(self) -> list[Part]:
        """All finished parts, also those that were merged and not deleted yet."""
        return [Part.named(name) for pattern in ("batch=*", "merged=*") for name in _folders(self.spark, f"{self.root}/{pattern}")]

    def batches(self) -> list[int]:
        return [number for part in covering(self.parts()) for number in range(part.first, part.last + 1)]

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of all finished batches, or of those before a number."""
        return self._rows(covering(part for part in self.parts() if before is None or part.last < before))

    def _rows(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{part.folder}" for part in parts))

    def highest(self, column: str) -> int:
        """The largest value of a column that never falls from batch to batch, 0 without rows; reads the newest part with rows."""
        for part in reversed(covering(self.parts())):
            top = self._rows([part]).agg(F.max(column)).first()[0]
            if top is not None:
                return top
        return 0

    def write(self, rows: DataFrame, batch: int) -> None:
        empty = self.spark.createDataFrame([], self.schema)
        aligned = empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns)
        aligned.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
        self.merge()

    def merge(self) -> None:
        """Merge while a level is full; what earlier merges replaced is deleted first."""
        while self.fan and (run := due_merge(parts := self.parts(), self.fan)):
            kept = set(covering(parts))
            for part in parts:
                if part not in kept:
                    _delete(self.spark, f"{self.root}/{part.folder}")
            whole = Part(run[0].first, run[-1].last, run[0].level + 1)
            self._rows(run).write.mode("overwrite").parquet(f"{self.root}/{whole.folder}")


class BucketTable:
    """A keyed table in buckets of its key; a new version rewrites the buckets it touches.

    The rows of a version lie in ``data/v=<number>/bucket=<number>``, and ``map`` names for every
    version which folder holds each bucket. A version counts when its map is finished.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "id", buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        self.map = SnapshotTable(spark, f"{self.root}/map", "bucket int, version long")

    def version(self) -> int:
        return self.map.version()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def folders(self, wanted: set[int] | None = None) -> list[str]:
        """Where the buckets lie, or some of them: at most one folder a bucket."""
        rows = self.map.read().collect()
        return [f"{self.root}/data/v={row['version']}/bucket={row['bucket']}" for row in rows if wanted is None or row["bucket"] in wanted]

    def read(self, wanted: set[int] | None = None) -> DataFrame:
        folders = self.folders(wanted)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, version: int | None = None, touched: set[int] | None = None) -> int:
        """Write all rows, or the rows of the touched buckets, as the next version; its number."""
        version = self.version() + 1 if version is None else version
        empty = self.spark.createDataFrame([], self.schema)
        aligned = empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns).withColumn("bucket", self.bucket())
        place = f"{self.root}/data/v={version}"
        aligned.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        written = {int(name[7:]) for name in self._bucket_names(place)}
        held = {row["bucket"]: row["version"] for row in self.map.read().collect() if touched is not None and row["bucket"] not in touched}
        held |= dict.fromkeys(written, version)
        self.map.write(self.spark.createDataFrame(sorted(held.items()), "bucket int, version long").coalesce(1), version)
        return version

    def _bucket_names(self, place: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{place}/bucket=*")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return [status.getPath().getName() for status in found]


class ChangeTable:
    """A keyed table as a base in buckets and the rows that batches changed, merged when it is read.

    A batch writes its changed rows only. ``fold`` brings everything so far into the base and rewrites
    no bucket without a change; base version ``b + 2`` holds the batches up to ``b``, so a reader takes
    the later ones besides it. Every ``fold_after`` batches a write folds, so that a reader opens at
    most one folder a bucket and ``fold_after`` more. Folded batches are deleted one fold later.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "id", buckets: int = 64, fold_after: int = 32):
        self.base = BucketTable(spark, root, schema, key, buckets)
        self.changes = AppendTable(spark, f"{root.rstrip('/')}/changes", f"{schema}, batch long", fan=None)
        self.key, self.fold_after = key, fold_after

    def last_batch(self) -> int:
        """Number of the last finished batch, -1 before the first."""
        return max([self.base.version() - 2, -1, *self.changes.batches()])

    def _pending(self, before: int | None = None) -> DataFrame:
        version = self.base.version()
        parts = [part for part in covering(self.changes.parts()) if part.first > version - 2 and (before is None or part.last < before)]
        return self.changes._rows(parts)

    def _merged(self, rows: DataFrame, changed: DataFrame) -> DataFrame:
        latest = changed.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("_row")).select("_row.*")
        return rows.join(latest.select(self.key), self.key, "left_anti").select(*rows.columns).unionByName(latest)

    def read(self, before: int | None = None) -> DataFrame:
        """The rows after all batches, or after those before a number; the latest change of a key counts."""
        return self._merged(self.base.read(), self._pending(before))

    def write(self, changed: DataFrame, batch: int) -> None:
        self.changes.write(changed.withColumn("batch", F.lit(batch).cast("long")), batch)
        if batch + 2 - self.base.version() > self.fold_after:
            self.fold()

    def fold(self) -> int:
        """Bring everything so far into the base, bucket by bucket; the version's number."""
        version, last = self.base.version(), self.last_batch()
        changed = self._pending()
        touched = {row[0] for row in changed.select(self.base.bucket()).distinct().collect()}
        folded = self.base.write(self._merged(self.base.read(touched), changed), last + 2, touched)
        for part in self.changes.parts():
            if part.last <= version - 2:
                _delete(self.changes.spark, f"{self.changes.root}/{part.folder}")
        return folded


def written_once(spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table in a folder; it is built and written if it is not finished yet."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def write_report(sections: dict[str, DataFrame], folder: str) -> None:
    """Write each section of a report as JSON lines below one folder."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
