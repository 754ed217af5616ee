"""Repeated passages by sparse suffix arrays, with exact extension to both sides.

1. One pass over all texts retains the suffixes at minimiser positions and keys
   each by its first ``REACH`` words; any passage of ``LEAST`` equal words holds
   a common retained suffix at least that far from its end.
2. The suffixes are sorted across the cluster and neighbours compared
   (:func:`larder.llm.suffixes.repeated`).  Equal texts are one text here.
3. Matches are extended: around every matched suffix, each run of ``LEAST`` words
   that could hold it is sorted and compared in the same way, which decides
   exactly which words stand in a passage of at least ``LEAST`` words that
   another text has too.  Work grows with the repeated words, never with pairs.

Words are lower-cased and split at ASCII white space; a passage is equal where
the words' 64-bit hashes are; a text is known by two 64-bit hashes.  Defined
results: texts of fewer than ``LEAST`` words (null and empty too) have no spans;
equal texts, repeated rows among them, are one whole span each; a null doc_id is
reported as null; an id that names several texts has the rows of each; extra
columns are ignored by :func:`passages` and kept by :func:`deduplicated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm import words
from larder.llm.common import arrow_batches, small, staged, text_of
from larder.llm.near_dedup import keyed
from larder.llm.suffixes import repeated, retained, run_hashes

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Words of the shortest reported passage.
LEAST = 50
GRAM = 8
#: Grams in a minimiser's run; a retained suffix is found every 16 words, about.
WINDOW = 31
#: Words of a suffix's key: what any passage has left after its first retained suffix.
REACH = LEAST - WINDOW + 1

SUFFIX = pa.schema([("key", pa.int64()), ("who", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("words", pa.int64())])


def suffixes(texts: DataFrame) -> DataFrame:
    """A row for each retained suffix, and one with ``words`` (pos -1) for each text long enough; who and doc are the text's two hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.parts(batches):
            tokens, n = words.hashed(part.column("text").to_pylist())
            each = np.split(tokens, np.cumsum(n))[:-1]
            far = np.flatnonzero(n >= LEAST)
            if not len(far):
                continue
            stream, place, key = retained([each[i] for i in far], GRAM, WINDOW, REACH)
            who, doc = part.column("t").to_numpy()[far], part.column("u").to_numpy()[far]
            yield words.batch(SUFFIX, key=np.zeros(len(far), dtype=np.int64), who=who, doc=doc, pos=np.full(len(far), -1), doc_id=part.column("doc_id").take(pa.array(far)), words=n[far])
            yield words.batch(SUFFIX, key=key.view(np.int64), who=who[stream], doc=doc[stream], pos=place, doc_id=pa.nulls(len(key), pa.int64()), words=pa.nulls(len(key), pa.int64()))

    return arrow_batches(texts).mapInArrow(scan, "key long, who long, doc long, pos long, doc_id long, words long")


RUN = pa.schema([("key", pa.int64()), ("who", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64())])


def runs_around(texts: DataFrame) -> DataFrame:
    """(key, who, doc, pos) of each run of LEAST words that holds a matched suffix; ``at`` has the suffixes' places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.parts(batches, rows=64):
            for who, doc, text, at in zip(part.column("who").to_pylist(), part.column("doc").to_pylist(), part.column("text"), part.column("at"), strict=True):
                keys = run_hashes(words.hashed([text.as_py()])[0], LEAST)
                if not len(keys):
                    continue
                step = np.zeros(len(keys) + 1, dtype=np.int64)
                at = at.values.to_numpy()
                np.add.at(step, np.maximum(at - WINDOW + 1, 0), 1)
                np.add.at(step, np.minimum(at + 1, len(keys)), -1)
                pos = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                yield words.batch(RUN, key=keys[pos].view(np.int64), who=np.full(len(pos), who), doc=np.full(len(pos), doc), pos=pos)

    return arrow_batches(texts).mapInArrow(scan, "key long, who long, doc long, pos long")


def merged(runs: DataFrame) -> DataFrame:
    """(who, doc, start_word, end_word, first): runs that overlap or touch, apart by whether their text is the first that has them."""
    one = runs.groupBy("who", "doc", (F.col("first") == F.col("who")).alias("first")).agg(F.array_sort(F.collect_set("pos")).alias("at"))

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for who, doc, first, at in zip(frame["who"], frame["doc"], frame["first"], frame["at"], strict=True):
                at = np.asarray(at)
                new = np.flatnonzero(np.concatenate([[True], np.diff(at) > LEAST]))
                last = np.concatenate([new[1:] - 1, [len(at) - 1]])
                yield pd.DataFrame({"who": who, "doc": doc, "start_word": at[new], "end_word": at[last] + LEAST, "first": first})

    return one.mapInPandas(join, "who long, doc long, start_word long, end_word long, first boolean")


def searched(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans of each different text, and the rows (who, doc, doc_id, words) of all texts long enough."""
    texts = keyed(docs)
    found = staged(suffixes(texts), "suffixes")
    matched = repeated(found.where("words is null").select("key", "who", "doc", "pos"), "matches")
    at = staged(matched.groupBy("who", "doc").agg(F.collect_set("pos").alias("at")), "places")
    one = texts.withColumnsRenamed({"t": "who", "u": "doc"}).join(small(at.select("who", "doc")), ["who", "doc"], "left_semi")
    one = one.groupBy("who", "doc").agg(F.first("text").alias("text")).join(at, ["who", "doc"])
    runs = staged(runs_around(one.select("who", "doc", "text", "at")), "runs")
    return merged(repeated(runs, "passages")), found.where("words is not null").select("who", "doc", "doc_id", "words")


def passages(docs: DataFrame) -> DataFrame:
    """Every repeated passage: doc_id, start_word, end_word (exclusive), kind, first.

    ``kind`` is "copy" for a text that other rows have as a whole, else "span".
    ``first`` marks the one occurrence that stays where later ones are removed.
    Of equal texts only the one with the least doc_id has "span" rows as well.
    """
    spans, whole = searched(docs)
    same = whole.groupBy("who", "doc").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    copies = whole.join(same.where("n > 1"), ["who", "doc"]).select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("words").alias("end_word"), F.lit("copy").alias("kind"), F.expr("doc_id <=> least").alias("first"))
    return copies.union(spans.join(same, ["who", "doc"]).select(F.col("least").alias("doc_id"), "start_word", "end_word", F.lit("span"), "first"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without later occurrences: later copies leave as rows, later spans are cut from the text.

    Texts are told apart by their hashes, so rows that share an id keep their own
    words; of rows that repeat an id and its text one stays.
    """
    spans, whole = searched(docs)
    cuts = spans.where("not first").groupBy("who", "doc").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts"))
    rows = whole.groupBy("who", "doc", "doc_id").agg(F.count("*").alias("n"))
    same = rows.groupBy("who", "doc").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    marks = staged(same.join(cuts, ["who", "doc"], "full").select(F.col("who").alias("t"), F.col("doc").alias("u"), F.col("n").isNotNull().alias("several"), "least", "cuts"), "marks")
    text = text_of(docs)
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u"))
    both = carried.join(small(marks), ["t", "u"], "left")
    alone = both.where("several is null or not several")
    order = Window.partitionBy("t", "u", "doc_id").orderBy(F.lit(1))
    once = both.where("several and doc_id <=> least").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, s) if s is not None and len(s) else t for t, s in zip(texts, spans, strict=True)])

    left = arrow_batches(alone.union(once))
    name = next(c for c in docs.columns if c.lower() == "text")
    changed = F.when(F.col("cuts").isNull(), F.col("row").getField(name)).otherwise(cut("text", "cuts"))
    return left.select("row", changed.alias("text")).select(F.col("row").withField(name, F.col("text")).alias("row")).select("row.*")


def without(text: str, spans) -> str:
    """``text`` without the words of the spans; what stands between words stays."""
    words = [m.span() for m in _WORDS.finditer(text)]
    out, at = [], 0
    for s in spans:
        a, b = (s["start_word"], s["end_word"]) if isinstance(s, dict) else s
        if words[b - 1][1] > at:
            out.append(text[at : max(at, words[a][0])])
            at = words[b - 1][1]
    return "".join(out) + text[at:]
