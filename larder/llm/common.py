"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in all the word-based operators.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a dataset folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where a session on one machine names none (tests) a temporary folder is
    chosen and recorded in the session for later calls; on a cluster executors
    would not see each other's files there, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage, so that a lost executor costs no recomputation of
    what stands before, and keeps an expensive stage from running twice.
    """
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same with its folder, for callers that :func:`remove` it after use."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 8 << 20


def arrow_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for a worker; a smaller setting stays as it is."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("bB")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(v)`` where ``value`` is evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows of 8-byte ids that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 300_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df
