"""Tiled search and ranking where both sides have several blocks, against plain loops."""

import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions.nutrition import Profile
from larder.operators import ranking, tiles, vectors
from larder.plans import views

SMALL = "/root/testdata/sf0.001"


def slow(rows, asked, k):
    out = []
    for q, w in asked.items():
        scored = [(-reduce(lambda s, x: s + x[0] * x[1], zip(v, w, strict=True), 0.0), i) for i, v in rows if v is not None and len(v) == len(w) and all(x is not None and np.isfinite(x) for x in v)]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells,rows,product", [(1 << 21, 1 << 17, 1 << 21), (4 * 7, 23, 64), (4, 5, 1)])
def test_top_k_in_tiles(spark, monkeypatch, cells, rows, product):
    for name, value in (("QUERY_CELLS", cells), ("TILE_ROWS", rows), ("PRODUCT_CELLS", product)):
        monkeypatch.setattr(vectors, name, value)
    r = random.Random(rows)
    held = [(i % 300, [float(r.randrange(-2, 3)) for _ in range(4)]) for i in range(400)]  # many ties, repeated ids
    held += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(1000, 1400)]  # one vector for half of the rows
    odd = [(500, None), (501, [1.0]), (502, [None, 1.0, 1.0, 1.0]), (503, [float("nan")] * 4), (504, [float("inf"), 0.0, 0.0, 0.0]), (505, [])]
    df = spark.createDataFrame(held + odd, "doc_ord long, embedding array<float>").withColumn("_tile", F.lit("clash")).repartition(5)
    asked = {i: [float(r.randrange(-2, 3)) for _ in range(4)] for i in range(25)} | {90: [1.0], 91: [0.0] * 4}
    q = spark.createDataFrame([*asked.items(), (0, asked[0]), (99, None)], "doc_ord long, embedding array<float>")
    got = sorted(tuple(x) for x in vectors.top_k_each(df, q, 6).collect())
    assert got == slow(held + odd, asked, 6)
    assert vectors.top_k_each(df.where("false"), q, 6).count() == vectors.top_k_each(df, q.where("false"), 6).count() == 0


def test_scores_are_added_left_to_right(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(48)]) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_ord long, embedding array<double>")
    got = sorted(tuple(x) for x in vectors.top_k_each(df, df.where("doc_ord < 40"), 9).collect())
    assert got == slow(rows, dict(rows[:40]), 9)


def test_plan_has_one_scan_a_side_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_CELLS", 64)
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").withColumnRenamed("vec_id", "doc_ord")
    plans = [vectors.top_k_each(e, e.where(f"doc_ord < {n}"), 5)._jdf.queryExecution().executedPlan().toString() for n in (2, 90)]
    assert plans[0].count("FileScan") == plans[1].count("FileScan") == 2 * (1 + plans[0].count("Initial Plan"))
    assert "Broadcast" not in plans[1] and len(plans[0].splitlines()) == len(plans[1].splitlines())


def test_grid_bounds_tiles_and_uses_all_cores():
    assert tiles.grid(0, 0, 10, 10, 8) == (1, 1)
    assert tiles.grid(50, 100_000, 1000, 100_000, 8) == (1, 16)
    g = tiles.grid(5_000_000, 1_000_000_000, 32_768, 131_072, 4000)
    assert g.a * 32_768 >= 5_000_000 and g.b * 131_072 >= 1_000_000_000


def test_ranking_in_tiles(spark, monkeypatch):
    venues = views.nested(spark, SMALL)
    people, profile = views.customer_profiles(spark, SMALL)
    people = people.where("c_custkey < 12")
    whole = sorted(tuple(r) for r in ranking.ranked_each(venues, people, profile, "c_custkey").collect())
    monkeypatch.setattr(ranking, "TILE_PEOPLE", 4)
    monkeypatch.setattr(ranking, "TILE_VENUES", 3)
    assert sorted(tuple(r) for r in ranking.ranked_each(venues, people, profile, "c_custkey").collect()) == whole
    one = people.where("c_custkey = 7").first()
    mine = Profile(height=one["height"], weight=one["weight"], age=one["age"], gender=one["gender"], activity=one["activity"], goal=one["goal"], meal_type=one["meal_type"], favourites=tuple(one["favourites"]))
    best = [(r["id"], r["match_score"]) for r in ranking.ranked(venues, mine).limit(3).collect()]
    assert [(i, s) for k, _, i, s in whole if k == 7] == best
