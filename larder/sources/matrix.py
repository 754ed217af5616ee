"""Binary matrix files (one array of rows, as numpy saves them), read by ranges of rows.

The header is read from the file's first bytes on the driver.  The body is read
by Hadoop in splits of fixed-length records, each with its place in the file, so
a large file is many tasks and no file is one value; places say which row and
component a record holds.  A task joins the records of its split to rows, and
only the rows that a split's edge cuts, two a split at most, are put together
across tasks.
"""

from __future__ import annotations

import ast
import math
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.tables import staged

#: Bytes of a record, about: a divisor of the header's and the rows' lengths.
RECORD = 1 << 12


class Header(NamedTuple):
    offset: int
    dtype: str
    rows: int
    columns: int


def header(spark: SparkSession, path: str) -> Header:
    """What the first bytes say; other files than two-dimensional arrays of numbers in row order are an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        first = bytes(stream.readNBytes(1 << 12))
    finally:
        stream.close()
    if first[:6] != b"\x93NUMPY":
        raise ValueError(f"{path} is no matrix file")
    size, start = (struct.unpack("<H", first[8:10])[0], 10) if first[6] == 1 else (struct.unpack("<I", first[8:12])[0], 12)
    facts = ast.literal_eval(first[start : start + size].decode("latin1"))
    shape = facts["shape"]
    if facts["fortran_order"] or len(shape) != 2 or np.dtype(facts["descr"]).kind not in "fiu":
        raise ValueError(f"{path} holds {facts}, not rows of numbers")
    return Header(start + size, facts["descr"], *shape)


def record_bytes(h: Header) -> int:
    """A divisor of the header and of a row, so that records never straddle a row."""
    row = h.columns * np.dtype(h.dtype).itemsize
    common = math.gcd(h.offset, row)
    return max(d for d in range(1, min(common, RECORD) + 1) if common % d == 0 and d % np.dtype(h.dtype).itemsize == 0)


def read_matrix(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(doc_ord, embedding array<float>): the row's number and its values; a matrix without rows has none."""
    h = header(spark, path)
    if not h.rows or not h.columns:
        return spark.createDataFrame([], "doc_ord long, embedding array<float>")
    row, item, record = h.columns * np.dtype(h.dtype).itemsize, np.dtype(h.dtype).itemsize, record_bytes(h)
    conf = {"fixedlengthinputformat.record.length": str(record)}
    if split_bytes:
        conf["mapreduce.input.fileinputformat.split.maxsize"] = str(split_bytes)
    records = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)

    def rows(part: Iterator) -> Iterator[tuple[int, int, list[float]]]:
        number, first, held = -1, 0, []
        for place, data in part:
            at = place - h.offset
            if at < 0:
                continue
            if at // row != number:
                if held:
                    yield number, first, np.frombuffer(b"".join(held), dtype=h.dtype).astype(np.float32).tolist()
                number, first, held = at // row, at % row // item, []
            held.append(bytes(data))
        if held:
            yield number, first, np.frombuffer(b"".join(held), dtype=h.dtype).astype(np.float32).tolist()

    pieces = staged(spark.createDataFrame(records.mapPartitions(rows), "doc_ord long, first int, v array<float>"), "matrix")
    whole = pieces.where(F.size("v") == h.columns).select("doc_ord", F.col("v").alias("embedding"))
    cut = pieces.where(F.size("v") < h.columns).groupBy("doc_ord").agg(F.array_sort(F.collect_list(F.struct("first", "v"))).alias("p"))
    return whole.unionByName(cut.select("doc_ord", F.flatten(F.transform("p", lambda x: x["v"])).alias("embedding")))
