"""Sharding by size-tiered compaction with atomically committed manifests.

A shard set is a folder of immutable Parquet files and ``manifest-NNNNNNNN.json``
versions; a reader opens the newest version and reads just the files it names.

* :func:`append` writes arrivals as small shards (a file a task, no shuffle).
* :func:`compact` groups shards by size tier (powers of ``FANOUT`` under the
  target) and rewrites each full run of similarly sized shards into files of
  about the target size.  The run's read tasks are coalesced into as many as the
  result has files, so merging needs no shuffle either.
* A version is committed by renaming a finished temporary file without overwriting
  (atomic where the file system's rename is, as HDFS's) to a name that must not exist; of two writers one gets the version and the other tries again
  on the newer one.  Files of a failed attempt are never named, so a lost
  executor or driver leaves the last version whole.

The manifest holds a row for a file, never for a document, so it is small
(names, sizes, counts); document data never passes the driver.

Defined results: an empty table appends no rows and commits a version without
new files; nulls, long texts and repeated rows are kept as they are; all columns
are kept, but those whose names differ only in case or repeat must be renamed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import small

TARGET_BYTES = 128 << 20
FANOUT = 4


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    tier: int
    born: int


class ShardSet:
    """One folder of shards, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.folder, self.target, self.fanout = spark, folder.rstrip("/"), target, fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def tier(self, size: int) -> int:
        """0 for the smallest; a run's tier is the power of the fan-out it has reached."""
        t, edge = 0, self.target / self.fanout**4
        while size > edge and edge < self.target:
            t, edge = t + 1, edge * self.fanout
        return t

    def versions(self) -> list[int]:
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))
        return sorted(int(n[9:17]) for n in found if n.startswith("manifest-") and n.endswith(".json"))

    def shards(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """The newest (or a given) version and its shards."""
        known = self.versions()
        if not known:
            return 0, []
        v = version if version is not None else known[-1]
        stream = self._fs.open(self._path(f"{self.folder}/manifest-{v:08d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return v, [Shard(**s) for s in json.loads(text)["shards"]]

    def _commit(self, version: int, shards: list[Shard]) -> bool:
        """True if this writer got the version."""
        temp = self._path(f"{self.folder}/.manifest-{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        name = self._path(f"{self.folder}/manifest-{version:08d}.json")
        sc = self.spark.sparkContext
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri() if name.toUri().getScheme() else self._fs.getUri(), sc._jsc.hadoopConfiguration())
        never = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no option: an existing name stays
        try:
            files.rename(temp, name, never)
        except Py4JJavaError:
            self._fs.delete(temp, False)
            if self._fs.exists(name):
                return False
            raise
        return True

    def _change(self, gone: set[str], new: list[Shard]) -> int:
        """Commit the newest version without ``gone`` and with ``new``."""
        while True:
            v, now = self.shards()
            if gone - {s.path for s in now}:
                raise RuntimeError("shards to be replaced are no longer in the newest version")
            if self._commit(v + 1, [s for s in now if s.path not in gone] + new):
                return v + 1

    def _write(self, df: DataFrame, born: int) -> list[Shard]:
        part = f"{self.folder}/data-{uuid.uuid4().hex}"
        df.write.parquet(part)
        files = ((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(part)))
        return [Shard(f"{part.rsplit('/', 1)[1]}/{n}", size, self.tier(size), born) for n, size in sorted(files) if n.endswith(".parquet")]

    def append(self, df: DataFrame) -> int:
        """Arrivals as small shards; returns the committed version."""
        return self._change(set(), self._write(df, self.shards()[0] + 1))

    def _read(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder}/{s.path}" for s in shards))

    def compact(self) -> int:
        """Merge full runs of similarly sized shards until no tier has one; the last version."""
        packed: set[int] = set()  # tiers that whole files can't pack further
        while True:
            v, now = self.shards()
            runs: dict[int, list[Shard]] = {}
            for s in sorted(now, key=lambda s: (s.born, s.path)):
                if s.bytes < self.target / 2:
                    runs.setdefault(s.tier, []).append(s)
            full = {t: run for t, run in runs.items() if len(run) >= self.fanout and t not in packed}
            if not full:
                return v
            tier = min(full)
            run = full[tier]
            files = max(1, -(-sum(s.bytes for s in run) // self.target))
            merged = self._write(self._read(run).coalesce(files), v + 1)
            if len(merged) >= len(run):
                self._fs.delete(self._path(f"{self.folder}/{merged[0].path}").getParent(), True)
                packed.add(tier)
                continue
            self._change({s.path for s in run}, merged)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.shards(version)[1])

    def expire(self, keep: int = 1) -> None:
        """Delete all but the newest versions, and files that none of the kept ones names."""
        known = self.versions()
        named = {s.path for v in known[-keep:] for s in self.shards(v)[1]}
        gone = {s.path for v in known[:-keep] for s in self.shards(v)[1]} - named
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/manifest-{v:08d}.json"), False)
        for path in gone:
            self._fs.delete(self._path(f"{self.folder}/{path}"), False)


def placed(shards: ShardSet) -> DataFrame:
    """Each document's row id, shard and digest, read back from the newest version."""
    v, now = shards.shards()
    tiers = small(shards.spark.createDataFrame([(s.path, s.tier) for s in now], "shard string, tier int"))
    df = shards.read()
    path = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns if c != "doc_id"]
    return df.select("doc_id", path.alias("shard"), F.xxhash64(*cells).alias("row_hash"), F.lit(v).alias("version")).join(tiers, "shard", "left").select("doc_id", "shard", "row_hash", "version", "tier")
