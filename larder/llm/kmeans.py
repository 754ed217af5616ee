"""Lloyd's centroid clustering of whole-number vectors, with Elkan's bounds.

A round is one pass of Spark over the vectors, whose rows carry what Elkan's
method remembers: the cluster, an upper bound of the distance to its centroid
and a lower bound of the distance to every centroid.  The k centroids are all
that leaves the driver (k x dimension numbers), and their sums all that comes
back, aggregated in each task before the shuffle.  A pass writes its rows to the
shared folder, so a lost executor costs one pass over some rows; the folder
before is removed when its successor stands.

Distances are exact whole numbers.  Bounds are whole numbers too, in units of
1/``UNIT``: upper ones are rounded up, lower ones down, and so are the centroids'
movements and distances.  A centroid is skipped only if a bound proves that it is
farther than the vector's own one, strictly, so ties still go to the smaller
number.

Defined results: vectors that are null, of another length, or with a null or
non-finite component are left out; repeated rows and rows without id count each,
the latter come last in the choice of the first centroids; with fewer vectors
than ``k`` there are fewer centroids, with none (or an empty table) no rows;
other columns are ignored.  A component whose size reaches 2**27 after scaling
fails the job, as its distances don't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import remove, staged_at

#: Steps of a bound between two whole distances.
UNIT = 16
#: Least size of a component that can overflow a distance of 64 bits.
TOO_LARGE = 1 << 27
_BOUND = np.iinfo(np.int32).max

STATE = "vec_id long, v array<int>, cluster int, upper long, lower array<int>, distance long, computed int"


def whole(vectors: DataFrame, dim: int, scale: int, column: str = "embedding") -> DataFrame:
    """vec_id and v = floor(scale * x) of the vectors that are kept; native expressions only."""
    x = F.col(column).cast("array<double>")
    # null elements and NaN fail the comparison; infinities are out of its range
    good = (F.size(x) == dim) & F.forall(x, lambda e: F.coalesce((e > float("-inf")) & (e < float("inf")), F.lit(False)))
    kept = vectors.where(F.col(column).isNotNull()).where(good)
    small = F.forall(x, lambda e: F.abs(e * scale) < TOO_LARGE)
    v = F.when(small, F.transform(x, lambda e: F.floor(e * scale).cast("int"))).otherwise(F.raise_error(F.lit("a component is too large for distances of 64 bits")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the least hash of salt and id, in that order; k rows reach the driver."""
    keyed = vectors.select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    rows = keyed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def root_up(squares: np.ndarray) -> np.ndarray:
    """Distances in units of 1/UNIT, never too small."""
    return np.ceil(np.sqrt(squares.astype(np.float64)) * UNIT * (1 + 1e-12)).astype(np.int64)


def root_down(squares: np.ndarray) -> np.ndarray:
    """Distances in units of 1/UNIT, never too large."""
    return np.floor(np.sqrt(squares.astype(np.float64)) * UNIT * (1 - 1e-12)).astype(np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def first_assignment(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cluster, upper and lower bounds, and squared distance, with every distance computed."""
    all_squares = np.stack([squared(v, c) for c in centroids], axis=1)
    own = all_squares.argmin(axis=1)  # the first of equal ones
    best = all_squares[np.arange(len(v)), own]
    return own, root_up(best), root_down(all_squares), best, np.full(len(v), len(centroids))


def reassigned(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same after the centroids moved by at most ``moved``; distances that the bounds settle are not computed."""
    k, rows = len(centroids), np.arange(len(v))
    between = root_down(np.stack([squared(centroids, c) for c in centroids], axis=1))
    np.fill_diagonal(between, 0)
    lower = np.maximum(lower - moved, 0)
    upper = upper + moved[own]
    # the distance to the own centroid is an output, so the upper bound is always made tight first
    best = squared(v, centroids[own])
    upper, own = np.minimum(upper, root_up(best)), own.copy()
    lower[rows, own] = root_down(best)
    computed = np.ones(len(v), dtype=np.int64)
    nearest = np.where(np.eye(k, dtype=bool), np.iinfo(np.int64).max, between).min(axis=1)
    doubtful = np.flatnonzero(nearest[own] <= 2 * upper)
    start = own.copy()
    for c in range(k):
        at = doubtful[(start[doubtful] != c) & (lower[doubtful, c] <= upper[doubtful]) & (between[own[doubtful], c] <= 2 * upper[doubtful])]
        if not len(at):
            continue
        d = squared(v[at], centroids[c])
        computed[at] += 1
        lower[at, c] = root_down(d)
        nearer = (d < best[at]) | ((d == best[at]) & (c < own[at]))
        to = at[nearer]
        own[to], best[to] = c, d[nearer]
        upper[to] = root_up(d[nearer])
    return own, upper, lower, best, computed


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.astype(np.int32).ravel()))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def one_pass(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """Every row with its state against ``centroids``; ``moved`` is None in the first pass."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = _matrix(b.column("v"), n)
            if moved is None:
                own, upper, lower, best, computed = first_assignment(v, centroids)
            else:
                held = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), b.column("upper").to_numpy(zero_copy_only=False), _matrix(b.column("lower"), n)
                own, upper, lower, best, computed = reassigned(v, *held, centroids, moved)
            columns = [b.column("vec_id"), b.column("v"), pa.array(own.astype(np.int32)), pa.array(upper), _lists(np.minimum(lower, _BOUND)), pa.array(best), pa.array(computed.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in STATE.split(", ")])

    return rows.mapInArrow(assign, STATE)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at floor(sum / count) of its vectors; those without vectors stay.  k rows reach the driver."""
    dim = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dim)))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:", column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance and bounds of every kept vector, the final centroids)."""
    spark = vectors.sparkSession
    kept = whole(vectors, dim, scale, column)
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], STATE), np.zeros((0, dim), dtype=np.int64)
    state, path = staged_at(one_pass(kept, centroids, None), "clusters")
    for _ in range(rounds):
        now = moved_centroids(state, centroids)
        moved = root_up(((now - centroids) ** 2).sum(axis=1))
        state, later = staged_at(one_pass(state, now, moved), "clusters")
        remove(spark, path)
        centroids, path = now, later
    return state, centroids


def assignments(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:", column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    state, centroids = clustered(vectors, k, rounds, dim, scale, salt, column)
    sums = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, d, sum(sums.values()), digest[c]) for c, d in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """The same by plain assignment of every vector to every centroid, for DuckDB."""
    head = f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {dim}),
flat AS MATERIALIZED (SELECT r, unnest(range({dim})) AS i, unnest(v) AS x FROM kept),
chosen AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('{salt}' || vec_id) AS h, v FROM kept) ORDER BY h NULLS LAST, v LIMIT {k}),
c0 AS MATERIALIZED (SELECT c, unnest(range({dim})) AS i, unnest(v) AS x FROM chosen)"""
    steps = ""
    for t in range(rounds + 1):
        steps += f""",
d{t} AS MATERIALIZED (SELECT r, c, sum((f.x - g.x) * (f.x - g.x)) AS d FROM flat f JOIN c{t} g USING (i) GROUP BY r, c),
a{t} AS MATERIALIZED (SELECT r, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        if t < rounds:
            steps += f""",
m{t} AS (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM flat JOIN a{t} USING (r) GROUP BY c, i),
c{t + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.x, o.x)::BIGINT AS x FROM c{t} o LEFT JOIN m{t} m USING (c, i))"""
    return f"""{head}{steps},
digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS s FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, s AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN digests USING (c)"""


ORACLE = oracle()
