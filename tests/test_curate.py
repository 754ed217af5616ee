"""Sample generation, tokenised rows and the vector store."""

import hashlib

import pytest
from pyspark.sql import functions as F

from larder.functions import nutrition, rules, text
from larder.operators import curate, ranking, state
from larder.plans import views
from larder.sources import tables
from larder.streaming import state as streams

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "restaurant,menu,output,good",
    [("A", "B", "A B Recommended Reason:", True), ("", "B", "B Recommended Reason:", False), ("A", "", "A Recommended Reason:", False), ("A", "C", "A B Recommended Reason:", False), ("A", "B", "A B", False)],
)
def test_valid_sample(spark, restaurant, menu, output, good):
    assert spark.range(1).select(curate.valid_sample(F.lit(restaurant), F.lit(menu), F.lit(output))).first()[0] is good


@pytest.mark.parametrize("most,want", [(0, (0, 0)), (2, (2, 1)), (3, (3, 3)), (4, (3, 4)), (99, (3, 4))])
def test_generation_stops_at_valid_samples(spark, most, want):
    rows = spark.createDataFrame(list(enumerate([False, True, True, False, False, True, False])), "at int, valid boolean")
    got = [r["at"] for r in curate.generated(rows, most, "at").orderBy("at").collect()]
    assert got == [1, 2, 5][:most]
    assert tuple(curate.generation_report(rows, most, "at").first()) == want


def test_generation_of_nothing(spark):
    rows = spark.createDataFrame([], "at int, valid boolean")
    assert tuple(curate.generation_report(rows, 5, "at").first()) == (0, 0)


def test_tokenised(spark):
    pytest.importorskip("tokenizers")
    import glob

    from tokenizers import Tokenizer

    path = next(iter(sorted(glob.glob("/opt/tokenizers/*byte_bpe_50k*.json"))), None) or pytest.skip("no vocabulary here")
    texts = ["a short text", "", None, "words " * 50]
    rows = curate.tokenised(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", 16, path).orderBy("i").collect()
    plain = Tokenizer.from_file(path)
    for r, t in zip(rows, texts, strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids[:16]
        gap = 16 - len(ids)
        assert (r["input_ids"], r["attention_mask"], r["labels"]) == (ids + [0] * gap, [1] * len(ids) + [0] * gap, ids + [-100] * gap)


def test_vectors_are_read_as_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5, -1.0]), (0, [1.0, 2.0])], "doc_ord long, embedding array<float>")
    for _ in range(2):
        tables.write_vectors(rows, f"{tmp_path}/v")
    back = tables.read_vectors(spark, f"{tmp_path}/v").orderBy("doc_ord").collect()
    assert [(r[0], list(r[1])) for r in back] == [(0, [1.0, 2.0]), (1, [0.5, -1.0])]
    assert tables.vectors_exist(spark, f"{tmp_path}/v") and not tables.vectors_exist(spark, f"{tmp_path}/none")


def test_places_without_a_list(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"places": [{"id": "x"}]}')
    (tmp_path / "b.json").write_text('{"error": "denied"}')
    assert [r["id"] for r in tables.places(spark, str(tmp_path)).collect()] == ["x"]


def test_streamed_profiles_equal_batch(spark, tmp_path):
    rows = [(1, 10, 1, '{"weight":70}'), (2, 11, 1, "{broken"), (3, 12, 2, '{"weight":80}'), (4, 9, 2, None), (5, 13, 1, '{"weight":71}')]
    e = spark.createDataFrame(rows, "event_id long, us long, user_id long, payload string").select("event_id", F.timestamp_micros("us").alias("ts"), "user_id", "payload")
    e.write.parquet(f"{tmp_path}/in")
    default = F.struct(F.lit(75.0).alias("weight"))
    want = sorted((r["user_id"], r["profile"]["weight"]) for r in state.latest_profiles(e, "weight double", default).collect())
    live = streams.latest_profiles(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), "weight double", default)
    job = live.writeStream.outputMode("update").format("memory").queryName("profiles").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    job.awaitTermination()
    assert sorted((r["user_id"], r["profile"]["weight"]) for r in spark.table("profiles").collect()) == want == [(1, 71.0), (2, 80.0)]


@pytest.mark.parametrize("favourites", [[], ["Healthy", "Sushi"], [" Burger"], ["thai "], ["Unknown"], ["italian", "bar"]])
def test_favourites_as_column(spark, favourites):
    fields = spark.createDataFrame([("Salad Bar",), ("Thai",), ("Beef Burger",), ("Pasta",), (None,)], "f string")
    held = F.array(*map(F.lit, favourites)).cast("array<string>")
    r = fields.select(rules.cuisine_matches(favourites, F.col("f")).alias("a"), rules.cuisine_matches(held, F.col("f")).alias("b")).collect()
    assert all(x["a"] == x["b"] for x in r)
    assert not any(x[0] for x in fields.select(rules.cuisine_matches(F.lit(None).cast("array<string>"), F.col("f"))).collect())


def test_blocks_of_people_rank_as_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TILE_PEOPLE", 3)
    spots = views.nested(spark, SMALL)
    people, profile = views.customer_profiles(spark, SMALL)
    some = people.where("c_custkey % 20 = 0")
    got = {}
    for r in ranking.ranked_each(spots, some, profile, "c_custkey").collect():
        got.setdefault(r["c_custkey"], []).append((r["rank"], r["id"], r["match_score"]))
    rows = some.collect()
    assert len(rows) > 3 and set(got) == {r["c_custkey"] for r in rows}
    for p in rows[:3]:
        one = nutrition.Profile(p["height"], p["weight"], p["age"], p["gender"], p["activity"], p["goal"], p["meal_type"], tuple(p["favourites"]))
        best = [(r["id"], r["match_score"]) for r in ranking.ranked(spots, one).select("id", "match_score").take(3)]
        assert [(i, s) for _, i, s in sorted(got[p["c_custkey"]])] == best


def test_form_numbers(spark):
    r = spark.range(1).select(*(text.number_input(F.lit(x)) for x in ("12.5", "", "abc"))).first()
    assert r[0] == 12.5 and r[1] == r[2]


def test_choice_carries_only_columns_asked_for(spark):
    rows = [(f"m{i % 4}", f"r{i % 2}", g, t, f"input {g} {t % 2}", "x" * 50) for i in range(8) for g in ("a", "b") for t in range(3)]
    requests = spark.createDataFrame(rows, "menu_id string, restaurant_id string, goal string, template int, structured_input string, heavy string")
    some = curate.chosen_requests(requests, each=2).select("menu_id", "goal", "template")
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RepartitionByExpression") :].split("\n")[1]
    assert moved.strip(" +-").startswith("Project") and "heavy" not in moved and "structured_input" not in moved.replace("md5(cast(structured_input", "")
    want = []
    for menu in sorted({r[0] for r in rows}):
        firsts = {}
        for m, r, g, t, same, _ in sorted(set(rows)):
            if m == menu:
                firsts[r, same] = min(firsts.get((r, same), (g, t)), (g, t))
        shuffled = sorted(firsts.values(), key=lambda x: hashlib.md5(f"42|{menu}|{x[0]}|{x[1]}".encode()).hexdigest())
        want += [(menu, g, t) for g, t in shuffled[:2]]
    assert sorted(tuple(r) for r in some.collect()) == sorted(want)
