"""Models over tables: bounds of the calls, failures as rows, and whole answers."""

import pytest
from pyspark.sql import functions as F

from larder.operators import models


def picky(load_log=None):
    def load():
        if load_log:
            with open(load_log, "a") as f:
                f.write("loaded\n")

        def encode(texts):
            assert len(texts) <= 4 and (len(texts) == 1 or sum(map(len, texts)) <= 40)
            if any("bad" in t for t in texts):
                raise RuntimeError("no such text")
            return [[float(len(t)), 0.0 if "zero" not in t else float("inf")] for t in texts]

        return encode

    return load


def test_bounded_calls_and_failures_as_rows(spark, tmp_path):
    texts = ["a" * n for n in range(1, 30)] + ["bad", None, "", "zero", "x" * 5000]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id long, text string, failure_before string").coalesce(1)
    out = models.embedded(rows, models.Model("picky", picky(str(tmp_path / "log"))), call_rows=4, call_chars=40)
    assert out.columns == ["id", "failure_before", "embedding", "failure"]
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(texts) and all(r["failure_before"] == "kept" for r in got.values())
    assert got[29]["failure"] == "RuntimeError: no such text" and got[29]["embedding"] is None
    assert got[30]["failure"] == "no input" and got[31]["embedding"] == [0.0, 0.0] and "not finite" in got[32]["failure"]
    assert all(got[i]["embedding"] == [1.0, 0.0] and got[i]["failure"] is None for i in [*range(29), 33])
    out.where("id % 2 = 0").collect()
    assert (tmp_path / "log").read_text().count("loaded") <= 2  # once a worker, not once a call
    assert models.embedded(rows.where("false"), models.Model("picky", picky())).count() == 0


def test_a_result_too_few_is_a_failure(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string").coalesce(1)
    short = models.Model("short", lambda: lambda texts: [[1.0]] if len(texts) > 1 or texts[0] == "a" else [])
    assert [(r["id"], r["failure"]) for r in models.embedded(rows, short).orderBy("id").collect()] == [(1, None), (2, "ValueError: 0 results for 1 inputs")]


def test_chats_have_a_system_and_a_user_turn(spark):
    echo = models.Model("echo", lambda: lambda chats: ["|".join(f"{m['role']}:{m['content']}" for m in c) for c in chats])
    rows = spark.createDataFrame([(1, "hello"), (2, None)], "id long, prompt string")
    got = {r["id"]: (r["response"], r["failure"]) for r in models.answered(rows, echo, F.lit("be kind")).collect()}
    assert got == {1: ("system:be kind|user:hello", None), 2: (None, "no input")}


DOCS = "doc_ord long, text string, restaurant_name string, category string, average_calories int, average_protein int, average_fiber int, fitness_score int"


def test_recommended_each(spark):
    letters = models.Model("ab", lambda: lambda texts: [[1 / (t != "broken") * t.count("a"), t.count("b")] for t in texts])
    seen = models.Model("seen", lambda: lambda chats: [f"</s>Reason: it is light and has {1 / ('mute' not in c[1]['content']):.0f} sort of protein. Recommended Restaurant: other" for c in chats])
    docs = spark.createDataFrame([(0, "aaab", "A", "x", 1, 2, 3, 4), (1, "bbbb", "B", "x", 5, 6, 7, 8), (2, None, "C", "x", 0, 0, 0, 0), (3, "abab", "D", "x", 0, 0, 0, 0)], DOCS)
    asked = spark.createDataFrame([(10, "a"), (11, "bb"), (12, None), (13, "broken"), (14, "b mute")], "query_id long, query string")
    got = {r["query_id"]: r for r in models.recommended_each(asked, docs, letters, seen, F.lit("s"), k=2).collect()}
    assert [x["doc_ord"] for x in got[10]["results"]] == [0, 3] and [x["doc_ord"] for x in got[11]["results"]] == [1, 3]
    assert got[11]["generated_answer"] == "Recommended Restaurant:\nB\n\nNutrition Summary:\n5 kcal\n6 g protein\n7 g fiber\n\nRecommended Reason:\nit is light and has 1 sort of protein."
    assert [got[i]["failure"] for i in (12, 13, 14)] == ["no input", *["ZeroDivisionError: division by zero"] * 2] and all(got[i]["generated_answer"] is None for i in (12, 13, 14))
    none = models.recommended_each(asked, docs.where("false"), letters, seen, F.lit("s")).where("query_id = 10").first()
    assert (none["retrieved_count"], none["results"], none["generated_answer"]) == (0, [], models.NONE_FOUND)


@pytest.mark.parametrize("sizes,want", [([], []), ([9, 1], [(0, 1), (1, 2)]), ([1, 1, 1], [(0, 2), (2, 3)]), ([1, 50, 1], [(0, 1), (1, 2), (2, 3)])])
def test_calls(sizes, want):
    assert list(models.calls(sizes, 2, 9)) == want
