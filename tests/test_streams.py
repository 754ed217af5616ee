"""Streams that are stopped, restarted and replayed give the rows of the batch operators."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from larder.operators import state
from larder.streaming import stores, users

EVENT = "user_id long, kind string, item_id long, payload string, ts string, event_id long"


def events(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(r.randrange(3), r.choice(["toggle", "view", "view", "profile"]), r.randrange(40), f"p{i}" if i % 9 else None, f"2024-01-01 00:{r.randrange(30):02d}:00", i) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "view", 1, "", "2024-01-01 00:00:00", n), (1, "view", None, "", "2024-01-01 00:00:00", n + 1), (1, "toggle", 1, "", None, n + 2), (1, "other", 1, "", "2024-01-01 00:00:00", n + 3)], EVENT).withColumn("ts", F.col("ts").cast("timestamp"))


def whole(e):
    """The state by the batch operators."""
    ok = e.where("user_id is not null and ts is not null and item_id is not null")
    kind = lambda k: ok.where(F.col("kind") == k)
    out = {("toggle", r["user_id"], r["item_id"], None, None) for r in state.favourites(kind("toggle")).collect()}
    out |= {("view", r["user_id"], r["item_id"], r["pos"], None) for r in state.history(kind("view")).collect()}
    last = kind("profile").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "payload")).alias("p")).select("user_id", "p.payload")
    return out | {("profile", r["user_id"], None, None, r["payload"]) for r in last.collect()}


def told(df):
    rows = df.collect()
    out = {(r["kind"], r["user_id"], r["item_id"], r["pos"], r["payload"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def own(spark):
    s = users.session_for(spark)
    s.conf.set("spark.sql.shuffle.partitions", "2")
    return s


@pytest.mark.parametrize("begun", [False, True])
def test_user_state_equals_batch_over_restarts(spark, own, tmp_path, begun):
    e = events(spark)
    initial = users.snapshot(e.where("event_id < 150")) if begun else None
    initial = own.createDataFrame(initial.collect(), initial.schema) if begun else None
    fed = e.where("event_id >= 150") if begun else e
    for p in range(3):
        fed.where(f"event_id % 3 = {p}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if p:
            stream = own.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            got = told(users.drained(stream, str(tmp_path / "out"), initial=initial))  # each call goes on from the checkpoint
    assert got == whole(e)


def test_user_with_more_favourites_than_one_value_holds(spark, own, tmp_path):
    r = random.Random(5)
    rows = [(r.randrange(2), "toggle", r.randrange(1600), None, f"2024-01-01 00:{r.randrange(60):02d}:00", i) for i in range(9000)]
    e = spark.createDataFrame(rows, EVENT).withColumn("ts", F.col("ts").cast("timestamp"))
    past = users.snapshot(e.where("event_id < 4000"))
    assert past.groupBy("user_id").count().agg(F.min("count")).first()[0] > users.CHUNK > users.RECENT
    for p in range(3):
        e.where(f"event_id >= 4000 and event_id % 3 = {p}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = told(users.drained(stream, str(tmp_path / "out"), initial=own.createDataFrame(past.collect(), past.schema)))
    assert got == whole(e)


class Held:
    """A state of one user that counts its calls."""

    def __init__(self):
        self.of, self.value, self.calls = {}, None, 0

    def __getattr__(self, name):
        forms = {"get": lambda: self.value, "exists": lambda: self.value is not None, "update": lambda v: setattr(self, "value", v), "put": lambda v: setattr(self, "value", v)}
        forms |= {"getValue": lambda k: self.of.get(k), "containsKey": lambda k: k in self.of, "updateValue": lambda k, v: self.of.update({k: v})}

        def call(*args):
            self.calls += 1
            return forms[name](*args)

        return call


@pytest.mark.parametrize(("recent", "ttl_ms"), [(512, None), (6, None), (512, 1000)])
def test_a_users_batch_takes_few_calls(monkeypatch, recent, ttl_ms):
    monkeypatch.setattr(users, "RECENT", recent)
    states = []
    one = lambda *_: states.append(Held()) or states[-1]
    processor = users.UserState(20, ttl_ms)
    processor.init(type("Handle", (), {"getValueState": one, "getMapState": one, "getListState": one}))
    r, want, at, most = random.Random(recent), {}, 0, 0
    for _ in range(60):
        items = [r.randrange(100) for _ in range(r.randrange(1, 30))]
        before = sum(s.calls for s in states)
        told_ = list(processor.handleInputRows((1,), iter([{"kind": "toggle", "item_id": i, "payload": None, "us": at + n, "event_id": n} for n, i in enumerate(items)]), None))
        most = max(most, sum(s.calls for s in states) - before)
        for n, i in enumerate(items):
            want[i] = (not want.get(i, (False,))[0], at + n, n)
        at += len(items)
        assert {x["item_id"]: (x["favourite"], x["us"], x["event_id"]) for x in told_} == {i: want[i] for i in items}
    if recent == 512 and not ttl_ms:
        assert most == 2


def test_state_with_time_to_live_is_forgotten(spark, own, tmp_path):
    import time

    row = lambda i, item: own.createDataFrame([(1, "toggle", item, None, "2024-01-01 00:00:00", i)], EVENT).withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(2):
        row(i, 7).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = own.readStream.schema(row(0, 7).schema).parquet(str(tmp_path / "in"))
        got = users.drained(stream, str(tmp_path / "out"), ttl_ms=1000)
        time.sleep(2.5)
    # the second toggle met no state, so the item is a favourite again
    assert told(got) == {("toggle", 1, 7, None, None)}


def store(spark, **options):
    return stores.KeyedStore(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), "id string, value string, at long", ("id",), ("at",), **options)


def model(batches):
    held = {}
    for rows in batches:
        for i, v, at in rows:
            if i is not None and (i not in held or at >= held[i][1]):
                held[i] = (v, at)
    return {i: v for i, (v, _) in held.items() if v is not None}


@pytest.mark.parametrize("compact_after", [1, 3, 100])
def test_merges_and_replays(spark, compact_after):
    r = random.Random(compact_after)
    s = store(spark, compact_after=compact_after)
    assert s.read().count() == 0
    batches, at = [], 0
    for n in range(7):
        rows = []
        for _ in range(20):
            at += 1
            rows.append((r.choice(["a", "b", "c", "d", None, f"k{n}"]), r.choice([None, f"v{at}"]), at - r.choice([0, 0, 40])))
        seen, unique = set(), []
        for x in rows:  # equal orders of one key in one batch have no defined winner
            if (x[0], x[2]) not in seen:
                unique.append(x)
                seen.add((x[0], x[2]))
        batches.append(unique)
        df = spark.createDataFrame(unique, "id string, value string, at long")
        assert s.merge(df, n)
        before = s.parts()
        assert not s.merge(df.withColumn("value", F.lit("replayed")), n) and s.parts() == before
        assert {x["id"]: x["value"] for x in s.read().collect()} == model(batches)
    assert len(s.parts()) <= 3 * (compact_after + 1)


def test_a_batch_that_died_is_written_again(spark):
    s = store(spark)
    row = lambda v, at: spark.createDataFrame([("a", v, at)], "id string, value string, at long")
    s.merge(row("one", 1), 0)
    half = f"{s.folder}/delta-1"
    row("half", 9).withColumn("_batch", F.lit(1).cast("long")).write.parquet(half)
    path, files = s._path("delta-1/_SUCCESS")
    files.delete(path, False)
    assert [r["value"] for r in s.read().collect()] == ["one"]
    assert s.merge(row("two", 2), 1)
    assert [r["value"] for r in s.read().collect()] == ["two"]


def test_replacement(spark):
    s = store(spark)
    rows = lambda *ids: spark.createDataFrame([(i, "v", 1) for i in ids], "id string, value string, at long")
    for n, ids in enumerate((["a", "b"], ["c"], [], ["d", "e"])):
        df = rows(*ids) if ids else rows("x").where("false")
        assert s.replace(df, n) and not s.replace(rows("replayed"), n)
        assert sorted(r["id"] for r in s.read().collect()) == ids
    assert s.merge(rows("f"), 4) and sorted(r["id"] for r in s.read().collect()) == ["d", "e", "f"]


def test_store_behind_a_stream(spark, tmp_path):
    s = store(spark, compact_after=2)
    for n in range(5):
        spark.createDataFrame([(f"k{n % 3}", f"v{n}", n)], "id string, value string, at long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, value string, at long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(s.sink()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r["id"]: r["value"] for r in s.read().collect()} == {"k0": "v3", "k1": "v4", "k2": "v2"}


def test_json_that_raises_and_json_that_defaults(spark):
    history = "array<struct<restaurantId: string, viewedAt: string>>"
    rows = spark.createDataFrame([(1, '[{"restaurantId":"a","viewedAt":"t"}]'), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r["h"] for r in rows.select("id", state.stored(F.col("text"), history).alias("h")).collect()}
    assert got[1][0]["restaurantId"] == "a" and got[2] is None and got[3] is None
    bad = spark.createDataFrame([(4, "[{broken")], "id long, text string")
    with pytest.raises(Exception, match="(?i)malformed"):
        bad.select(state.stored(F.col("text"), history)).collect()
    default = F.struct(F.lit(75.0).alias("weight"), F.lit("lose-fat").alias("goal"))
    texts = ['{"weight":60.5,"goal":"maintain"}', "{broken", None, "", "null", '{"goal":"x"}', "} {"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: tuple(r["p"]) for r in rows.select("id", state.stored(F.col("text"), "struct<weight: double, goal: string>", default).alias("p")).collect()}
    kept = (75.0, "lose-fat")
    assert got == {0: (60.5, "maintain"), 1: kept, 2: kept, 3: kept, 4: kept, 5: (None, "x"), 6: kept}
    none = F.array().cast("array<struct<id: string>>")
    lists = spark.createDataFrame([('[{"id":"a"}]',), ("oops",), (None,)], "text string")
    assert [len(r[0]) for r in lists.select(state.stored(F.col("text"), "array<struct<id: string>>", none)).collect()] == [1, 0, 0]
