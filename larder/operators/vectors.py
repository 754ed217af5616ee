"""Exact inner-product retrieval over vectors with an explicit document key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators import documents, tiles


def inner_product(vector: Column, query: Sequence[float]) -> Column:
    """In double precision, left to right."""
    pairs = F.zip_with(vector, F.array(*(F.lit(float(x)) for x in query)), lambda a, b: a.cast("double") * b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 5, key: str = "doc_ord", vector: str = "embedding") -> DataFrame:
    """The k best rows with rank and score; fewer where there are fewer.  Each task keeps k rows, so nothing is sorted as a whole."""
    best = vectors.select(key, inner_product(F.col(vector), query).alias("similarity_score")).orderBy(F.desc("similarity_score"), key).limit(k)
    listed = best.agg(F.collect_list(F.struct(-F.col("similarity_score"), key)).alias("all")).select(F.posexplode(F.array_sort("all")).alias("at", "x"))
    return listed.select((F.col("at") + 1).alias("rank"), F.col(f"x.{key}").alias(key), (-F.col("x.col1")).alias("similarity_score"))


#: Components of a tile's queries, and its most rows; cells of one product in work.
QUERY_CELLS, TILE_ROWS, PRODUCT_CELLS = 1 << 21, 1 << 17, 1 << 21


class Best:
    """The k best rows of each query among all vectors of one length that were offered.

    A matrix product finds the few rows that can be among the best within the
    product's rounding; their scores are then added left to right in double
    precision, so results don't depend on blocks or on the library's order of
    additions.  Of equal vectors in one block only those with the k least keys
    are looked at, as they tie with all others.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.columns = np.ascontiguousarray(queries.T)
        self.rounding = 4 * queries.shape[1] * np.finfo(float).eps * np.linalg.norm(queries, axis=1)
        self.scores = np.full((len(ids), k), -np.inf)
        self.keys = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.held = np.zeros(len(ids), dtype=np.int64)

    def offer(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        step = max(64, PRODUCT_CELLS // max(1, len(self.ids)))
        for lo in range(0, len(keys), step):
            self._block(keys[lo : lo + step], vectors[lo : lo + step])

    def _block(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        equal = np.unique(np.ascontiguousarray(vectors).view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_inverse=True)[1]
        if equal.max() + 1 < len(keys):
            order = np.lexsort((keys, equal))
            group = equal[order]
            place = np.arange(len(order)) - np.searchsorted(group, group)
            order = order[place < self.k]
            keys, vectors = keys[order], vectors[order]
        products = self.queries @ vectors.T
        slack = self.rounding * np.linalg.norm(vectors, axis=1).max()
        wanted = products >= (self.scores[:, -1] - 2 * slack)[:, None]
        if products.shape[1] > self.k and np.count_nonzero(wanted) > 4 * self.k * len(self.ids):
            floor = np.partition(products, -self.k, axis=1)[:, -self.k]
            wanted &= products >= (floor - 4 * slack)[:, None]
        owner, row = np.nonzero(wanted)
        columns = np.ascontiguousarray(vectors.T)
        for lo in range(0, len(owner), PRODUCT_CELLS):
            self._merge(owner[lo : lo + PRODUCT_CELLS], keys, row[lo : lo + PRODUCT_CELLS], columns)

    def _merge(self, owner: np.ndarray, keys: np.ndarray, row: np.ndarray, columns: np.ndarray) -> None:
        scores = np.zeros(len(owner))
        for q, v in zip(self.columns, columns, strict=True):
            scores += q[owner] * v[row]
        who = np.unique(owner)
        old_owner, old = np.nonzero(np.arange(self.k) < self.held[who, None])
        owner = np.concatenate([who[old_owner], owner])
        scores = np.concatenate([self.scores[who[old_owner], old], scores])
        found = np.concatenate([self.keys[who[old_owner], old], keys[row]])
        order = np.lexsort((found, -scores, owner))
        owner = owner[order]
        place = np.arange(len(order)) - np.searchsorted(owner, owner)
        top = place < self.k
        owner, place, order = owner[top], place[top], order[top]
        self.scores[owner, place], self.keys[owner, place] = scores[order], found[order]
        self.held[who] = np.bincount(np.searchsorted(who, owner), minlength=len(who))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, place = np.nonzero(np.arange(self.k) < self.held[:, None])
        return self.ids[owner], self.keys[owner, place], self.scores[owner, place]


def _by_length(keys: np.ndarray, lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, keys, matrix) of the lists of each length; those with a null or non-finite component are left out."""
    sizes = np.asarray(pc.list_value_length(lists))
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    at = np.cumsum(sizes) - sizes
    for n in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == n)
        matrix = flat.reshape(-1, n) if n and len(of) == len(sizes) else flat[at[of, None] + np.arange(n)]
        good = np.isfinite(matrix).all(axis=1)
        if n and good.any():
            yield n, keys[of[good]], matrix[good]


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "doc_ord", vector: str = "embedding") -> DataFrame:
    """The k best rows for each row of ``queries`` (same columns): query_id, rank, key and score; ties go to the smaller key.

    Both sides may be large: they meet in :mod:`tiles`, a tile's queries are held
    as one matrix and its vectors pass by in batches, and what leaves a tile is k
    rows a query.  Keys are whole numbers.  Rows without a vector, with a null or
    non-finite component, or of another length than the query's have no score; a
    repeated row counts each time, a repeated query id once (its least vector).
    """
    wide = any(d.schema[vector].dataType.elementType.typeName() != "float" for d in (vectors, queries))
    cast = F.col(vector).cast("array<double>" if wide else "array<float>").alias("v")
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), cast)
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), cast).groupBy("k").agg(F.min("v").alias("v"))
    many = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    g = tiles.grid(many["n"], rows.count(), max(1, QUERY_CELLS // max(1, many["d"])), TILE_ROWS, tiles.cores(vectors))
    both = tiles.query_tiles(asked, ["k"], g).withColumn("_row", F.lit(False)).unionByName(tiles.row_tiles(rows, ["k", "v"], g).withColumn("_row", F.lit(True)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, waiting, best = None, {}, {}

        def found() -> Iterator[pa.RecordBatch]:
            for b in best.values():
                ids, keys, scores = b.rows()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(scores)], names=["query_id", key, "similarity_score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = np.asarray(batch.column("_tile")).astype(np.int64) * 2 + np.asarray(batch.column("_row").to_numpy(zero_copy_only=False))
            edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if tile != kind[lo] // 2:
                    yield from found()
                    tile, waiting, best = kind[lo] // 2, {}, {}
                part = batch.slice(lo, hi - lo)
                for n, keys, matrix in _by_length(np.asarray(part.column("k")), part.column("v")):
                    if kind[lo] % 2 == 0:
                        waiting.setdefault(n, []).append((keys, matrix))
                        continue
                    if n in waiting:
                        of = waiting.pop(n)
                        best[n] = Best(np.concatenate([q for q, _ in of]), np.concatenate([m for _, m in of]), k)
                    if n in best:
                        best[n].offer(keys, matrix)
        yield from found()

    # a tile's queries come before its rows
    met = tiles.gathered(both, g).sortWithinPartitions("_tile", "_row")
    out = met.mapInArrow(search, f"query_id long, `{key}` long, similarity_score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity_score"), key))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", key, "similarity_score")


def shape(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.agg(F.count("*").alias("n_docs"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dim"))


def retrieved(best: DataFrame, docs: DataFrame, venue_tables: Sequence[DataFrame], key: str = "doc_ord") -> DataFrame:
    """Ranked results with their documents and the venue row of the first table that has it."""
    out = best.join(docs, key)
    found = []
    for i, table in enumerate(venue_tables):
        row = table.select(F.col("id").alias(f"_id{i}"), F.struct(*table.columns).alias(f"_row{i}"))
        out = out.join(row, F.col("restaurant_id") == F.col(f"_id{i}"), "left")
        found.append(F.col(f"_row{i}"))
    record = F.coalesce(*found) if found else F.lit(None)
    return out.withColumn("database_record", record).drop(*(f"_{x}{i}" for i in range(len(found)) for x in ("id", "row")))


def recommend(docs: DataFrame, vectors: DataFrame, embed: Callable[[str], Sequence[float]], query: str, generate: Callable[[str], str], k: int = 5, venue_tables: Sequence[DataFrame] = ()) -> dict:
    """Answer for one query: at most k rows reach the driver.

    ``embed`` and ``generate`` are the models, given as functions.
    """
    rows = [r.asDict(recursive=True) for r in retrieved(top_k(vectors, embed(query), k), docs, venue_tables).orderBy("rank").collect()]
    if not rows:
        return {"query": query, "retrieved_count": 0, "retrieved_results": [], "generated_answer": "No suitable restaurant was found."}
    spark = docs.sparkSession
    best = {f: F.lit(rows[0].get(f)) for f in ("restaurant_name", "category", "average_calories", "average_protein", "average_fiber", "fitness_score")}
    asked = spark.range(1).select(documents.prompt(F.lit(query), best, F.lit(rows[0].get("text"))).alias("p")).first()["p"]
    answer = spark.range(1).select(documents.safe_answer(best, documents.clean_response(F.lit(generate(asked)))).alias("a")).first()["a"]
    return {"query": query, "retrieved_count": len(rows), "retrieved_results": rows, "generated_answer": answer}
