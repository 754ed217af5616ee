"""Keyed stores that streams write and batches read: upserts, deletions and whole replacement, safe under replay.

A store is a folder of immutable parts, each named by the micro-batch that made
it: ``delta-n`` holds the last write of each key of batch n, ``base-n`` the whole
store after batch n.  A part counts once Spark has finished it (``_SUCCESS``).
Batch numbers are the keys of idempotence: a batch whose part stands is not
written again, and one that failed half way is written over, so replays change
nothing.  A write costs what its batch holds; every ``compact_after`` deltas one
job folds them into the next base.  The base before that and its deltas stay
until the following fold, so readers that began earlier still find their files.

Within and between batches the write with the greatest ``order`` wins, of equal
ones that of the later batch.  A null value deletes its key; its row stays, so
that an older write that comes late doesn't bring the key back.  One writer a store at a time, as with any
streaming query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.sources.tables import finished


@dataclass(frozen=True)
class Part:
    kind: str
    batch: int
    path: str


class KeyedStore:
    """(key, value) rows under ``folder``; the schema is that of the keys, the value column and the order columns."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: tuple[str, ...], order: tuple[str, ...], value: str = "value", compact_after: int = 8):
        self.spark, self.folder, self.keys, self.order, self.value, self.compact_after = spark, folder.rstrip("/"), keys, order, value, compact_after
        self.schema = T.StructType.fromDDL(schema)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def parts(self) -> list[Part]:
        """The finished parts, by batch; one listing, as long as the parts since the last folds."""
        root, files = self._path("")
        if not files.exists(root):
            return []
        found = []
        for status in files.listStatus(root):
            kind, _, number = status.getPath().getName().partition("-")
            if kind in ("delta", "base", "whole") and finished(self.spark, f"{self.folder}/{kind}-{number}"):
                found.append(Part(kind, int(number), f"{self.folder}/{kind}-{number}"))
        return sorted(found, key=lambda p: (p.batch, p.kind))

    def _live(self, parts: list[Part], upto: int | None = None) -> list[Part]:
        """The last base or replacement and the deltas after it."""
        parts = [p for p in parts if upto is None or p.batch <= upto]
        start = max((p.batch for p in parts if p.kind in ("base", "whole")), default=None)
        if start is None:
            return parts
        first = next(p for k in ("base", "whole") for p in parts if p.kind == k and p.batch == start)
        return [first, *(p for p in parts if p.kind == "delta" and p.batch > start)]

    def _rows(self, parts: list[Part]) -> DataFrame:
        """All rows of the parts with their batch; tombstones too."""
        columns = T.StructType([*self.schema.fields, T.StructField("_batch", T.LongType())])
        if not parts:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*(p.path for p in parts))

    def _last(self, rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """One row a key: aggregated before the shuffle, so a hot key is one row a task there."""
        rest = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
        return last.select(*self.keys, *(F.col(f"_r.{c}").alias(c) for c in rest))

    def read(self) -> DataFrame:
        """The live keys; an empty store has no rows."""
        last = self._last(self._rows(self._live(self.parts())), (*self.order, "_batch"))
        return last.where(F.col(self.value).isNotNull()).select(*self.schema.names)

    def _columns(self, rows: DataFrame, batch: int) -> DataFrame:
        known = rows.select(*self.schema.names)
        for k in self.keys:
            known = known.where(F.col(k).isNotNull())
        return known.withColumn("_batch", F.lit(batch).cast("long"))

    def merge(self, rows: DataFrame, batch: int) -> bool:
        """Upserts one micro-batch; False where it was merged before.  Rows with a null key are left out."""
        parts = self.parts()
        if any(p.batch >= batch for p in parts):
            return False
        self._last(self._columns(rows, batch), self.order).write.mode("overwrite").parquet(f"{self.folder}/delta-{batch}")
        if sum(p.kind == "delta" for p in self._live(parts)) + 1 >= self.compact_after:
            self.compact()
        return True

    def replace(self, rows: DataFrame, batch: int) -> bool:
        """Puts one micro-batch in place of all that is stored; False where that was done before."""
        parts = self.parts()
        if any(p.batch >= batch for p in parts):
            return False
        self._last(self._columns(rows, batch), self.order).write.mode("overwrite").parquet(f"{self.folder}/whole-{batch}")
        self._drop(parts, batch)
        return True

    def compact(self) -> None:
        """Folds the deltas into a base named by the last batch, and drops what the base before it had replaced."""
        parts = self.parts()
        live = self._live(parts)
        if not any(p.kind == "delta" for p in live):
            return
        last = self._last(self._rows(live), (*self.order, "_batch"))
        last.write.mode("overwrite").parquet(f"{self.folder}/base-{live[-1].batch}")
        self._drop(parts, live[0].batch if live[0].kind != "delta" else 0)

    def _drop(self, parts: list[Part], before: int) -> None:
        """Deletes parts that no view from the base or replacement before ``before`` on needs."""
        keep = self._live(parts, before - 1)
        oldest = min((p.batch for p in keep), default=0)
        for p in parts:
            if p.batch < oldest:
                path, files = self._path(f"{p.kind}-{p.batch}")
                files.delete(path, True)

    def sink(self, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, whole: bool = False) -> Callable[[DataFrame, int], None]:
        """The function for ``foreachBatch``."""

        def write(batch: DataFrame, number: int) -> None:
            rows = prepare(batch)
            if whole:
                self.replace(rows, number)
            else:
                self.merge(rows, number)

        return write
