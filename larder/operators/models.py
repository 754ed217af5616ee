"""Models over whole tables: texts become vectors and chats become answers, in Arrow batches.

A model is loaded once for each Python worker and held there.  It is called with
batches of bounded rows and characters.  Where a call fails, its batch is halved
until the rows that fail stand alone; those come out as rows with the failure's
text, all others with their result, so one bad text costs no job.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larder.operators import documents, vectors
from larder.sources.tables import staged

#: Rows and characters of one call; a longer text is a call of its own.
CALL_ROWS, CALL_CHARS = 256, 1 << 18
#: Models that a worker holds at once.
MOST_HELD = 2
#: Whole-number ids that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
NONE_FOUND = "No suitable restaurant was found."

_HELD: OrderedDict[str, Callable] = OrderedDict()


@dataclass(frozen=True)
class Model:
    """How a worker gets a model: ``load`` is called once a worker for each ``name``."""

    name: str
    load: Callable[[], Callable[[list], Sequence]]

    def get(self) -> Callable[[list], Sequence]:
        if self.name not in _HELD:
            while len(_HELD) >= MOST_HELD:
                _HELD.popitem(last=False)
            _HELD[self.name] = self.load()
        return _HELD[self.name]


def tried(call: Callable[[list], Sequence], inputs: list) -> list[tuple[Any, str | None]]:
    """(result, None) or (None, failure) for each input."""
    try:
        out = list(call(inputs))
        if len(out) != len(inputs):
            raise ValueError(f"{len(out)} results for {len(inputs)} inputs")
        return [(x, None) for x in out]
    except Exception as e:
        if len(inputs) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    half = len(inputs) // 2
    return tried(call, inputs[:half]) + tried(call, inputs[half:])


def calls(sizes: list[int], rows: int, chars: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the parts of a batch."""
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo >= rows or held + n > chars):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def unit(vector: Sequence[float]) -> list[float]:
    """The vector at length one, in single precision; one of zeros stays."""
    v = np.asarray(vector, dtype=np.float64).ravel()
    if not np.isfinite(v).all():
        raise ValueError("the vector is not finite")
    return (v / max(float(np.sqrt((v * v).sum())), 1e-12)).astype(np.float32).tolist()


def applied(rows: DataFrame, model: Model, given: str, result: T.StructField, finish: Callable[[Any], Any], size: Callable[[Any], int], call_rows: int, call_chars: int) -> DataFrame:
    """``rows`` without ``given``, with the model's result for it and ``failure``."""
    kept = [f for f in rows.schema.fields if f.name != given]
    schema = T.StructType([*kept, result, T.StructField("failure", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            inputs = batch.column(given).to_pylist()
            for lo, hi in calls([size(x) for x in inputs], call_rows, call_chars):
                out: list[tuple[Any, str | None]] = [(None, "no input")] * (hi - lo)
                there = [i for i in range(lo, hi) if inputs[i] is not None]
                made = tried(lambda xs: [finish(x) for x in model.get()(xs)], [inputs[i] for i in there]) if there else []
                for i, r in zip(there, made, strict=True):
                    out[i - lo] = r
                part = batch.slice(lo, hi - lo)
                columns = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r for r, _ in out], arrow.field(result.name).type), pa.array([e for _, e in out], pa.string())], names=arrow.names)

    return rows.mapInArrow(run, schema)


def embedded(rows: DataFrame, model: Model, text: str = "text", call_rows: int = CALL_ROWS, call_chars: int = CALL_CHARS) -> DataFrame:
    """``rows`` with ``embedding`` (length one) in place of the text, and ``failure``, null where there is none.

    Select the keys first: all other columns pass through the workers.  A null
    text is a failure; an empty one is the model's affair.
    """
    vector = T.StructField("embedding", T.ArrayType(T.FloatType()))
    return applied(rows, model, text, vector, unit, lambda x: len(x or ""), call_rows, call_chars)


def answered(rows: DataFrame, model: Model, system: Column, prompt: str = "prompt", call_rows: int = 16, call_chars: int = CALL_CHARS) -> DataFrame:
    """``rows`` with ``response`` in place of the prompt, and ``failure``.

    The model is called with chats, each a list of role and content.
    """
    chats = rows.withColumn(prompt, F.when(F.col(prompt).isNotNull(), documents.messages(system, F.col(prompt))))
    return applied(chats, model, prompt, T.StructField("response", T.StringType()), str, lambda c: sum(len(m["content"] or "") for m in c or ()), call_rows, call_chars)


FACTS = ("restaurant_name", "category", "average_calories", "average_protein", "average_fiber", "fitness_score")


def recommended_each(queries: DataFrame, docs: DataFrame, embed: Model, generate: Model, system: Column, k: int = 5) -> DataFrame:
    """The answer for every row of ``queries`` (query_id long, query) from ``docs`` (doc_ord long, text, and the facts).

    Columns: query_id, retrieved_count, results (rank, doc_ord, similarity_score),
    generated_answer, failure.  Ids of queries are unique.  Vectors and responses
    are written once, as calls are dear and need not repeat; a text whose
    embedding fails is no result.  A failed query has no answer.
    """
    known = staged(embedded(docs.select("doc_ord", "text"), embed), "vectors").where("failure is null")
    asked = staged(embedded(queries.select(F.col("query_id").alias("doc_ord"), "query"), embed, "query"), "queries")
    best = vectors.top_k_each(known, asked.where("failure is null"), k)
    # staged, so that the documents' ids can be counted: few of them are broadcast, and texts that no query found aren't shuffled
    results = staged(best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_ord", "similarity_score"))).alias("results")), "results")
    results = results.withColumn("doc_ord", F.col("results")[0]["doc_ord"])
    wanted = results.select("doc_ord").distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    first = results.join(docs.join(wanted, "doc_ord", "left_semi"), "doc_ord").drop("doc_ord")
    found = {f: F.col(f) for f in FACTS}
    prompts = queries.select("query_id", "query").join(first, "query_id").withColumn("prompt", documents.prompt(F.col("query"), found, F.col("text")))
    replies = staged(answered(prompts.select("query_id", "results", *FACTS, "prompt"), generate, system), "responses")
    cleaned = replies.withColumn("response", documents.clean_response(F.col("response")))
    said = cleaned.select("query_id", "results", F.col("failure").alias("unsaid"), documents.safe_answer(found, F.col("response")).alias("said"))
    failed = asked.select(F.col("doc_ord").alias("query_id"), F.col("failure").alias("refused"))
    failure = F.coalesce("refused", "unsaid")
    return failed.join(said, "query_id", "left").select(
        "query_id", F.coalesce(F.size("results"), F.lit(0)).alias("retrieved_count"), F.coalesce("results", F.array().cast("array<struct<rank: int, doc_ord: bigint, similarity_score: double>>")).alias("results"),
        F.when(failure.isNull(), F.coalesce("said", F.lit(NONE_FOUND))).alias("generated_answer"), failure.alias("failure"),
    )
