"""Core queries over whole tables, on inputs that the small test tables lack."""

from pyspark.sql import functions as F

from larder.operators import vectors
from larder.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_first_wins_keeps_every_first_row(spark, tmp_path):
    rows = spark.range(12_500).select(F.col("id").alias("o_orderkey"), (F.col("id") % 6001).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    kept = QUERIES["first_wins_dedup"](spark, str(tmp_path)).collect()
    assert sorted(r["row_seq"] for r in kept) == list(range(6001))


def test_every_query_vector_is_searched(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_CELLS", 7 * 64)
    monkeypatch.setattr(vectors, "TILE_ROWS", 90)
    monkeypatch.setattr(vectors, "PRODUCT_CELLS", 50)
    every = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()}

    def best(q, k):
        scores = {i: sum(a * b for a, b in zip(v, every[q], strict=True)) for i, v in every.items()}
        return [(r, i, round(scores[i], 4)) for r, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:k], 1)]

    for name, key, k in (("ip_topk", "vec_id", 5), ("retrieve_join", "doc_ord", 20)):
        got = {}
        for r in QUERIES[name](spark, SMALL).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r[key], r["similarity_score"]))
        docs = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}
        want = {q: [x for x in best(q, k) if name == "ip_topk" or x[1] in docs] for q in every if q % 20 == 0}
        assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}


def test_retrieved_texts_are_whole(spark):
    whole = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    found = QUERIES["retrieve_join"](spark, SMALL).collect()
    assert all(r["document_text"] == whole[r["doc_ord"]] for r in found)
    assert any(len(r["document_text"]) > 800 for r in found)


def test_filtered_reasons_are_whole(spark, tmp_path):
    long = "word " * 500 + "end"
    spark.createDataFrame([(1, 0, "user", long)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = QUERIES["dataset_filter"](spark, str(tmp_path)).first()
    assert (row["reason"], row["reject_reason"]) == (long, "invalid_reason_length")
    assert QUERIES["filter_report"](spark, str(tmp_path)).first()["invalid_reason_length"] == 1
