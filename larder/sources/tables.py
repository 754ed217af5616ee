"""Readers and writers: delimited files, line files, vectors, summaries, staged tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VENUE_COLUMNS = ("id", "name", "category", "score", "ratings", "price_range", "full_address", "zip_code", "lat", "lng")
MENU_COLUMNS = ("restaurant_id", "category", "name", "description", "price")
SAMPLE = "instruction string, input string, output string"


def strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns) -> DataFrame:
    """All values as text, quotes doubled inside quotes, line breaks allowed there; adds ``row_seq``.

    Such a file can't be split, so a file is one task and its rows keep their
    order; of several files, the partition counts before the row.
    """
    rows = spark.read.csv(path, schema=strings(columns), header=True, multiLine=True, escape='"', encoding="UTF-8")
    return rows.withColumn("row_seq", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Any bad line fails the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_samples(spark: SparkSession, path: str, schema=SAMPLE) -> DataFrame:
    """Blank lines are skipped; an empty set is an error."""
    rows = read_jsonl(spark, path, schema)
    if rows.isEmpty():
        raise ValueError(f"no samples in {path}")
    return rows


def read_tolerant(spark: SparkSession, path: str, schema=SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(good rows, one row with ``invalid_json``): blank lines are skipped, malformed ones counted and left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select(F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x")).select("x.*")
    return parsed.where("_bad is null").drop("_bad"), parsed.agg(F.count_if(F.col("_bad").isNotNull()).alias("invalid_json"))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; an empty table is an error."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; nulls are written too."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def summary_json(row: DataFrame, **more) -> str:
    """The single row of a summary as indented JSON."""
    return json.dumps(row.first().asDict(recursive=True) | more, ensure_ascii=False, indent=2)


def write_observed(df: DataFrame, counters: dict[str, Column], write: Callable[[DataFrame], None]) -> dict:
    """Writes ``df`` and gives the counters of the rows that went by, from the same job."""
    seen = Observation()
    write(df.observe(seen, *(c.alias(n) for n, c in counters.items())))
    return seen.get


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """A report as one indented JSON file in a folder."""
    text = json.dumps(report, ensure_ascii=False, indent=4)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def write_database(folder: str, **tables: DataFrame) -> None:
    """Drops and writes each table; venue tables are laid out by id so that lookups skip files."""
    for name, df in tables.items():
        key = "restaurant_id" if "restaurant_id" in df.columns else "id"
        df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_vectors(df: DataFrame, path: str) -> None:
    df.select("doc_ord", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_ord long, embedding array<float>").parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether Spark wrote the path and finished."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def vectors_exist(spark: SparkSession, path: str) -> bool:
    """Whether vectors were written to the path and their write was finished."""
    return finished(spark, path)


def places(spark: SparkSession, path: str) -> DataFrame:
    """External place records from JSON files of the service's answers; a missing list has no places."""
    place = "struct<id: string, displayName: struct<text: string>, formattedAddress: string, primaryType: string>"
    answers = spark.read.schema(f"places array<{place}>").json(path, multiLine=True)
    return answers.select(F.explode("places").alias("p")).select("p.*")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session on one machine that names none (tests) gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/table-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the cluster's shared folder and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
