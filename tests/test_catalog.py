"""Bucketed lookups, the sample venues' golden rankings, and numbers of three decimals."""

import random
import tempfile
import uuid
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from larder.functions import text
from larder.functions.nutrition import Profile
from larder.operators import ranking, state
from larder.sources import catalog, literals


def test_bucketed_lookup_has_no_exchange_and_equals_the_plain_one(spark):
    folder, mark = "file://" + tempfile.mkdtemp(prefix="spark-"), uuid.uuid4().hex
    one = spark.range(0, 400, 2).select(F.col("id").cast("string"), F.concat(F.lit("one"), "id").alias("name"), F.lit("x").alias("more"))
    two = spark.range(0, 600, 3).select(F.col("id").cast("string"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("two"), "id")).alias("name"))
    ids = spark.range(0, 700, 5).select(F.col("id").cast("string")).union(spark.sql("select cast(null as string)"))
    none = one.where("false")
    at = {k: catalog.write_bucketed(df, f"{k}_{mark}", folder, buckets=4) for k, df in {"one": one, "two": two, "ids": ids, "none": none}.items()}
    got = catalog.lookup(spark, at["ids"], [at["none"], at["one"], at["two"]], ["name", "more"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = state.lookup([one, two], ids)
    assert sorted(map(tuple, got.select("id", "name", "more").collect()), key=str) == sorted(map(tuple, want.select("id", "name", "more").collect()), key=str)
    assert got.where("id % 3 = 0 and id % 2 = 1 and name is null").count() > 0  # a row whose columns are null is found
    assert catalog.lookup(spark, at["none"], [at["one"]], ["name"]).count() == 0
    again = catalog.write_bucketed(two, at["one"], folder, buckets=4)
    assert spark.table(again).count() == two.count()


# For each person and venue the two best items, with their parts, the health score and the match score.
GOLDEN = [
    ("gain-muscle", "healthy", "healthy-bowl", [("chicken-protein-bowl", 29, 25, 10, 9), ("salmon-green-bowl", 30, 24, 12, 6)], 84, 83),
    ("gain-muscle", "healthy", "tokyo-sushi", [("tuna-rice-bowl", 25, 25, 12, 9), ("salmon-sushi-set", 24, 23, 12, 8)], 58, 61),
    ("gain-muscle", "healthy", "burger-house", [("grilled-chicken-burger", 29, 26, 13, 7), ("double-cheese-burger", 22, 30, 19, 4)], 43, 46),
    ("lose-fat", "healthy", "healthy-bowl", [("chicken-protein-bowl", 35, 28, 14, 9), ("salmon-green-bowl", 33, 26, 16, 8)], 84, 89),
    ("lose-fat", "healthy", "tokyo-sushi", [("tuna-rice-bowl", 29, 24, 15, 8), ("salmon-sushi-set", 28, 22, 16, 8)], 58, 64),
    ("lose-fat", "healthy", "burger-house", [("grilled-chicken-burger", 34, 24, 17, 9), ("classic-beef-burger", 21, 21, 18, 7)], 43, 46),
    ("maintain", "normal", "healthy-bowl", [("salmon-green-bowl", 35, 25, 14, 8), ("chicken-protein-bowl", 33, 24, 12, 9)], 84, 80),
    ("maintain", "normal", "tokyo-sushi", [("salmon-sushi-set", 28, 25, 14, 9), ("tuna-rice-bowl", 29, 25, 13, 8)], 58, 79),
    ("maintain", "normal", "burger-house", [("grilled-chicken-burger", 33, 26, 14, 9), ("classic-beef-burger", 25, 26, 19, 7)], 43, 56),
]


@pytest.mark.parametrize(("goal", "meal"), [("gain-muscle", "healthy"), ("lose-fat", "healthy"), ("maintain", "normal")])
def test_sample_venues_rank_as_stated(spark, goal, meal):
    rows = {r["id"]: r for r in ranking.matched(literals.sample_venues(spark), Profile(goal=goal, meal_type=meal)).collect()}
    for _, _, venue, items, health, match in (g for g in GOLDEN if g[:2] == (goal, meal)):
        r = rows[venue]
        parts = {x["item"]["id"]: tuple(int(x["parts"][k]) for k in ("quality", "goal", "calories", "macro")) for x in r["items"]}
        assert [(b["id"], *parts[b["id"]]) for b in r["best"]] == items
        assert (r["health"]["score"], r["match_score"]) == (health, match)


def test_three_decimals_are_those_of_the_double(spark):
    r = random.Random(3)
    values = [0.0, -0.0, 1.0005, 0.0005, 0.0015, -0.0004, 0.0625, 0.1875, -0.3125, 2.0625, 0.9995, 0.99949999999, 8191.9995, 1e-300, 123.4565]
    values += [r.uniform(-1, 1) for _ in range(3000)] + [round(r.uniform(-9, 9), 3) + 0.0005 for _ in range(3000)] + [r.randrange(-999, 999) / 16 for _ in range(500)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", text.fixed3(F.col("v")).alias("s")).collect()
    for i, s in got:
        v = values[i]
        want = str(abs(Decimal(v)).quantize(Decimal("0.001"), ROUND_HALF_UP))
        assert s == ("-" if v < 0 else "") + want, v
    odd = spark.sql("select cast(null as double) v union all select 12345.5").select(text.fixed3(F.col("v")).alias("s")).collect()
    assert {x["s"] for x in odd} == {None, "12345.500"}
