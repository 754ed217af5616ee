"""Reports from the writing job, SQL with named parameters, the place service, and binary matrices."""

import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import curate, features, places, relational
from larder.plans import views
from larder.sources import matrix, places_api, tables

SMALL = "/root/testdata/sf0.001"


def test_filter_writes_and_counts_in_one_job(spark, tmp_path):
    rows = views.outputs(spark, SMALL)
    told = curate.write_filtered(rows, str(tmp_path / "s"), str(tmp_path / "r"), invalid_json=3)
    want = curate.filter_report(curate.judged(rows)).first().asDict()
    assert told["total_samples"] == want["total_samples"] and told["valid_samples"] == want["valid_samples"] > 0
    assert told["details"] == {"invalid_json": 3} | {f: want[f] for f in curate.FAULTS}
    assert told["invalid_samples"] == told["total_samples"] - told["valid_samples"]
    assert spark.read.json(str(tmp_path / "s")).count() == told["valid_samples"]
    assert json.loads("".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))) == told
    none = curate.write_filtered(rows.where("false"), str(tmp_path / "s0"), str(tmp_path / "r0"))
    assert none["total_samples"] == none["valid_samples"] == none["details"]["duplicate"] == 0


def test_features_are_counted_as_they_are_written(spark, tmp_path):
    menus = views.capped(spark, SMALL)
    found = features.venue_features(views.venues(spark, SMALL), menus)
    assert features.write_features(found, menus, str(tmp_path)) == features.summary(found, menus).first().asDict()
    assert spark.read.csv(str(tmp_path / "restaurants_clean"), header=True).count() == found.count()
    with pytest.raises(ValueError):
        features.write_features(found.where("false"), menus, str(tmp_path / "none"))


def test_observed_write_reads_its_source_once(spark, tmp_path):
    df = spark.read.parquet(f"{SMALL}/orders.parquet")
    plans = []
    n = tables.write_observed(df, {"n": F.count("*"), "dear": F.count_if(F.col("o_totalprice") > 1000)}, lambda d: (plans.append(d._jdf.queryExecution().executedPlan().toString()), d.write.parquet(str(tmp_path / "o"))))
    assert plans[0].count("FileScan") == 1 and n == {"n": df.count(), "dear": df.where("o_totalprice > 1000").count()}


def test_named_parameters(spark):
    menus = spark.createDataFrame([(str(i), str(i % 3), f"dish {i}" if i % 5 else None, "c", 500 + i, 20, 3, "healthy", ["t"]) for i in range(30)], "id string, restaurant_id string, name string, category string, estimated_calories int, estimated_protein int, estimated_fiber int, health_level string, tags array<string>")
    venues = spark.createDataFrame([("0", "A'; DROP", "x", 1, 2), ("1", None, "y", 3, 4), ("2", "C", "z", 5, 6)], "id string, name string, category string, health_score int, fitness_score int")
    both = {"menus": menus, "venues": venues}
    good = [i for i in range(30) if i % 5 and i % 3 != 1]
    assert sorted(int(r["menu_id"]) for r in relational.select(relational.ITEMS, both).collect()) == good
    assert [int(r["menu_id"]) for r in relational.select(relational.NUTRITIOUS, both, kcal=510, protein=20, n=4).collect()] == [i for i in good if i <= 10][:4]
    assert relational.select(relational.VENUE, {"venues": venues}, id="0' OR '1'='1").count() == 0
    assert relational.select(relational.ITEMS_OF, {"menus": menus}, id="2").count() == 10
    a, b, c = (sorted(int(r["menu_id"]) for r in relational.sampled_candidates(m, venues, 6, seed).collect()) for m, seed in ((menus, 1), (menus.repartition(7), 1), (menus, 2)))
    assert a == b != c and len(a) == 6 and set(a) < set(good)
    assert relational.sampled_candidates(menus, venues, 100).count() == len(good)
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]


@pytest.fixture
def service():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((body, self.headers["X-Goog-FieldMask"], self.headers["X-Goog-Api-Key"]))
            text, status = body["textQuery"], 200
            if text == "refused":
                status, answer = 403, {"error": "no such key"}
            elif text == "nothing":
                answer = {}
            else:
                page = int(body.get("pageToken", 0))
                answer = {"places": [{"id": f"places/{text} {page}{i}", "displayName": {"text": f"Sushi {i}"}, "primaryType": "sushi_restaurant"} for i in range(2)]}
                if text == "two pages" and page == 0:
                    answer["nextPageToken"] = "1"
            data = b"{oops" if text == "broken" else json.dumps(answer).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", asked
    server.shutdown()


def test_place_service(spark, service):
    url, asked = service
    found = places_api.search(spark, url, "k", ["one", "two pages", "nothing"])
    assert found.rdd.getNumPartitions() == 3 and found.count() == 6
    adapted = places.adapted(found).collect()
    assert {r["cuisine"] for r in adapted} == {"Japanese"} and {r["category"] for r in adapted} == {"Sushi Restaurant"}
    assert {m for _, m, _ in asked} == {"places.id,places.displayName,places.formattedAddress,places.primaryType,nextPageToken"} and {k for *_, k in asked} == {"k"}
    asked.clear()
    assert [r["id"] for r in places_api.search(spark, url, "k", ["one"], "id string").collect()] == ["places/one 00", "places/one 01"]
    assert {m for _, m, _ in asked} == {"places.id,nextPageToken"}


def test_place_service_failures(spark, service):
    url, _ = service
    with pytest.raises(Exception, match="status 403: .*no such key"):
        places_api.search(spark, url, "k", ["one", "refused"]).collect()
    rows = places_api.search(spark, url, "k", ["one", "refused", "broken"], places_api.SCHEMA + ", _query string, _status int, _error string", errors="rows").collect()
    assert sorted((r["_query"], r["_status"]) for r in rows) == sorted([("one", None), ("one", None), ("refused", 403), ("broken", 500)], key=lambda x: x[0])
    assert "no such key" in next(r["_error"] for r in rows if r["_status"] == 403)
    with pytest.raises(Exception, match="option key is missing"):
        places_api.search(spark, url, "", ["one"]).collect()


@pytest.mark.parametrize("n,d,dtype", [(700, 384, "<f4"), (500, 3, "<f4"), (300, 5, "<f8"), (40, 16, "<f4"), (0, 7, "<f4")])
def test_matrix_by_row_ranges(spark, tmp_path, n, d, dtype):
    m = np.random.default_rng(n).normal(size=(n, d)).astype(dtype)
    np.save(tmp_path / "m.npy", m)
    df = matrix.read_matrix(spark, f"file://{tmp_path}/m.npy", split_bytes=10_000)
    got = {r["doc_ord"]: r["embedding"] for r in df.collect()}
    assert got == dict(enumerate(m.astype(np.float32).tolist()))
    tables.write_vectors(df, str(tmp_path / "v"))
    assert {r["doc_ord"]: r["embedding"] for r in tables.read_vectors(spark, str(tmp_path / "v")).collect()} == got


def test_other_files_are_no_matrix(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"no matrix at all")
    np.save(tmp_path / "one.npy", np.zeros(4))
    for name in ("x", "one.npy"):
        with pytest.raises(ValueError):
            matrix.read_matrix(spark, f"file://{tmp_path}/{name}")
