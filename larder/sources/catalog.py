"""Catalog tables bucketed and sorted by id, so that lookups join them without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; tables that are joined need the same number, and a bucket is a task's share of a join.
BUCKETS = 64


def write_bucketed(df: DataFrame, name: str, folder: str, key: str = "id", buckets: int = BUCKETS) -> str:
    """Drops and writes a table of the catalog, one sorted file a bucket; gives its name.

    Rows are shuffled once, here.  ``key`` should tell rows apart: rows of one key
    share a bucket.  Rows without a key are kept in one bucket.
    """
    spark = df.sparkSession
    spark.sql(f"drop table if exists `{name}`")
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", f"{folder}/{name}").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return name


def lookup(spark: SparkSession, ids: str, sources: Sequence[str], columns: Sequence[str], key: str = "id") -> DataFrame:
    """(key, columns): each id of table ``ids`` with its row in the first of the ``sources`` that has it.

    All are tables of :func:`write_bucketed` with the same buckets; sources hold
    each key once.  Ids in none, and null ids, drop out; repeated ids are
    repeated rows; an empty source is never the first; a column that a source
    lacks is null there.  No side is shuffled or broadcast: buckets meet in
    merge joins.
    """
    out = spark.table(ids).select(key)
    first = None
    for i, name in enumerate(sources):
        source = spark.table(name)
        row = F.struct(*((F.col(c) if c in source.columns else F.lit(None)).alias(c) for c in columns)).alias(f"_row{i}")
        out = out.hint("merge").join(source.select(key, row).hint("merge"), key, "left")
        # a struct of the joined side is null only where no row was found
        first = F.col(f"_row{i}") if first is None else F.coalesce(first, F.col(f"_row{i}"))
    found = out.select(key, first.alias("_row")).where(F.col("_row").isNotNull())
    return found.select(key, *(F.col(f"_row.{c}").alias(c) for c in columns))
