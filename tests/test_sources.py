import json

import pytest
from pyspark.sql import functions as F

from larder.operators import curate, documents, features, state, vectors
from larder.sources import tables
from larder.streaming import state as streams


def test_csv_to_features(spark, tmp_path):
    (tmp_path / "v.csv").write_text('id,name,category,score,ratings,price_range,full_address,zip_code,lat,lng\n1,"A ""x""\nB &amp; C",Salad,4.6,12.7,$,s,z,1,2\n1,Late,Salad,1,1,$,s,z,1,2\n,No,x,,,,,,,\n2, ,x,,,,,,,\n3,Empty,Pizza,abc,nan,,,,,\n')
    rows = "".join(f"1,Mains,{n},d,$5\n" for n in ["", *(f"Salad {i}" for i in range(31))])
    (tmp_path / "m.csv").write_text("restaurant_id,category,name,description,price\n" + rows + "9,Mains,Lost,d,$1\n")
    venues = features.clean_venues(tables.read_csv(spark, str(tmp_path / "v.csv"), tables.VENUE_COLUMNS))
    assert [(r["id"], r["name"], r["ratings"]) for r in venues.orderBy("id").collect()] == [("1", 'A "x" B & C', 12), ("3", "Empty", 0)]
    menus = features.clean_menus(tables.read_csv(spark, str(tmp_path / "m.csv"), tables.MENU_COLUMNS), venues)
    assert [r["name"] for r in menus.orderBy(F.col("id").cast("int")).collect()] == [f"Salad {i}" for i in range(30)]
    out = features.venue_features(venues, menus)
    assert out.count() == 1 and out.first()["menu_count"] == 30
    tables.write_database(str(tmp_path / "db"), restaurants=out, menu_items=menus)
    assert spark.read.parquet(str(tmp_path / "db/menu_items")).count() == 30
    assert json.loads(tables.summary_json(features.summary(out, menus), source="x"))["menu_items"] == 30
    doc = documents.venue_documents(out, menus).first()
    assert doc["menu_count_in_document"] == 8 and doc["text"].count("\n- Salad") == 8
    tables.write_csv(out.drop("cuisine_tags"), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        tables.write_csv(out.where("false"), str(tmp_path / "none"))


def test_line_files(spark, tmp_path):
    good = json.dumps({"instruction": "i", "input": "é", "output": "o"}, ensure_ascii=False)
    (tmp_path / "s.jsonl").write_text(f"{good}\n\n{{broken\n")
    rows, bad = tables.read_tolerant(spark, str(tmp_path / "s.jsonl"))
    assert rows.count() == 1 and bad.first()["invalid_json"] == 1
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        tables.read_jsonl(spark, str(tmp_path / "s.jsonl"), tables.SAMPLE).collect()
    tables.write_jsonl(rows.withColumn("none", F.lit(None).cast("string")), str(tmp_path / "out"))
    assert '"none":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(ValueError):
        tables.read_samples(spark, str(tmp_path / "e.jsonl"))


def test_filter_reasons(spark):
    good = lambda r: f"Recommended Restaurant:\nR\n\nRecommended Menu:\nM\n\nRecommended Reason:\n{r}"
    outs = ["nothing", "Recommended Restaurant:\n \n", "Recommended Restaurant:\nR\nRecommended Menu:\nM\nRecommended Reason:\n ", good("x" * 49), good("x" * 49), good("x" * 50), good("x" * 1200), good("x" * 1201), good("x" * 50)]
    rows = spark.createDataFrame(list(enumerate(outs)), "row_seq long, output string")
    got = [r["reject_reason"] for r in curate.judged(rows).orderBy("row_seq").collect()]
    assert got == ["missing_restaurant", "missing_restaurant", "missing_reason", "invalid_reason_length", "invalid_reason_length", None, None, "invalid_reason_length", "duplicate"]
    r = curate.filter_report(curate.judged(rows)).first()
    assert (r["total_samples"], r["valid_samples"], r["duplicate"]) == (9, 2, 1)


def test_recommend(spark):
    docs = spark.createDataFrame([(0, "a", "A", "t" * 900), (1, "b", "B", "u")], "doc_ord long, restaurant_id string, restaurant_name string, text string")
    for c in ("category", "average_calories", "average_protein", "average_fiber", "fitness_score"):
        docs = docs.withColumn(c, F.lit("1"))
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "doc_ord long, embedding array<float>")
    asked = []
    out = vectors.recommend(docs, vecs, lambda q: [0.1, 0.9], "q", lambda p: asked.append(p) or "Reason: it is light and has enough protein.", k=5)
    assert [r["restaurant_name"] for r in out["retrieved_results"]] == ["B", "A"] and out["retrieved_count"] == 2
    assert "it is light" in out["generated_answer"] and out["generated_answer"].startswith("Recommended Restaurant:\nB") and "{" not in asked[0]
    assert vectors.recommend(docs, vecs.where("false"), lambda q: [0.1, 0.9], "q", str)["retrieved_count"] == 0


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i % 3, (i * 7) % 25) for i in range(300)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, item_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(3):
        e.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last: dict[str, dict] = {"fav": {}, "hist": {}}

    def run(name, df, keep):
        q = df.writeStream.outputMode("update").foreachBatch(lambda b, _: keep(b.collect())).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()

    run("fav", streams.favourites(stream), lambda rs: last["fav"].update({(r["user_id"], r["item_id"]): r["favourite"] for r in rs}))

    def history(rs):
        for u in {r["user_id"] for r in rs}:
            last["hist"][u] = [r["item_id"] for r in sorted(rs, key=lambda r: r["pos"]) if r["user_id"] == u]

    run("hist", streams.history(stream), history)
    assert {k for k, v in last["fav"].items() if v} == {(r["user_id"], r["item_id"]) for r in state.favourites(e).collect()}
    batch: dict = {}
    for r in state.history(e).orderBy("user_id", "pos").collect():
        batch.setdefault(r["user_id"], []).append(r["item_id"])
    assert batch == last["hist"]
