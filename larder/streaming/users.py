"""A user's favourites, history and profile as state of one stateful operator, for unbounded streams.

Events are rows of (user_id, kind, item_id, payload, ts, event_id) where kind is
``toggle``, ``view`` or ``profile``.  Each user has the favourites (item: toggles
odd or even, and the last one), a list state (the last ``most`` different items
viewed, newest first) and a value state (the last profile written).  All three
merge by (ts, event_id), so late events and any split into batches give the state
of the batch operators over all events.

A call to the state server costs more than all else that is done for an event.
The ``RECENT`` favourites touched last are therefore one value, read and written
once for a user and batch; a map state has those that were touched before, each
looked up only when it is touched again.  Under a time to live, which counts for
each item, all of them are in the map state.

State may have a time to live, counted from its last write, and may begin with a
table of the same columns, such as :func:`snapshot` makes of past events; it
reaches the operator as rows of at most ``CHUNK`` events.  The state store must be one of key ranges; see :func:`session_for`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larder.operators import state
from larder.sources.tables import finished

EVENT = "user_id long, kind string, item_id long, payload string, ts timestamp, event_id long"
CHANGE = "user_id long, kind string, item_id long, pos int, favourite boolean, payload string, us long, event_id long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Favourites of a user that are one value, and past events of a user in one initial row.
RECENT, CHUNK = 512, 1000

Stamp = tuple[int, int]
Toggled = tuple[bool, int, int]

_CHANGE = Row(*(c.split()[0] for c in CHANGE.split(", ")))


def session_for(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in key ranges; ``spark`` stays as it is."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own


class UserState(StatefulProcessor):
    """The state of one user and its changes; see the module's text."""

    def __init__(self, most: int = 20, ttl_ms: int | None = None):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "items array<long>, odd array<boolean>, us array<long>, event_id array<long>, more boolean")
        self.favourites = handle.getMapState("favourites", "item_id long", "odd boolean, us long, event_id long", self.ttl_ms)
        self.history = handle.getListState("history", "item_id long, us long, event_id long", self.ttl_ms)
        self.profile = handle.getValueState("profile", "payload string, us long, event_id long", self.ttl_ms)

    def _recent(self) -> tuple[dict[int, Toggled], bool]:
        """The favourites touched last, the newest at the end, and whether the map state may have others."""
        if self.ttl_ms:
            return {}, True
        if (held := self.recent.get()) is None:
            return {}, False
        items, odd, us, event, more = held
        return dict(zip(items, zip(odd, us, event, strict=True), strict=True)), more

    def _older(self, item: int, more: bool) -> Toggled:
        held = self.favourites.getValue((item,)) if more and (not self.ttl_ms or self.favourites.containsKey((item,))) else None
        return (False, -(2**63), 0) if held is None else tuple(held)

    def _keep(self, recent: dict[int, Toggled], toggled: dict[int, Toggled], more: bool) -> None:
        """Stores the touched items; beyond RECENT the older ones go to the map state, many at a time."""
        recent |= toggled
        moved = list(recent) if self.ttl_ms else list(recent)[: -RECENT // 2] if len(recent) > RECENT else []
        for item in moved:
            self.favourites.updateValue((item,), recent.pop(item))
        if not self.ttl_ms:
            odd, us, event = (list(x) for x in zip(*recent.values(), strict=True))
            self.recent.update((list(recent), odd, us, event, more or bool(moved)))

    def _merge(self, rows: Iterable[Row | dict]) -> tuple[dict[int, Toggled], list | None, tuple | None]:
        """The toggled items, the history and the profile, where the rows change them; all are stored."""
        toggled: dict[int, Toggled] = {}
        recent: dict[int, Toggled] | None = None
        more = False
        seen: dict[int, Stamp] | None = None
        written: tuple | None = None
        for r in rows:
            kind, item, at = r["kind"], r["item_id"], (r["us"], r["event_id"])
            if kind == "toggle":
                if recent is None:
                    recent, more = self._recent()
                if item not in toggled:
                    toggled[item] = recent.pop(item, None) or self._older(item, more)
                odd, *last = toggled[item]
                toggled[item] = (not odd, *max(at, tuple(last)))
            elif kind == "view":
                if seen is None:
                    seen = {i: (t, e) for i, t, e in self.history.get()}
                seen[item] = max(seen.get(item, at), at)
                if len(seen) > 2 * self.most:
                    seen = dict(self._newest(seen))
            elif kind == "profile":
                if written is None:
                    written = self.profile.get() or (None, -(2**63), 0)
                if at >= written[1:]:
                    written = (r["payload"], *at)
        if toggled:
            self._keep(recent, toggled, more)
        viewed = None
        if seen is not None:
            viewed = [(i, *at) for i, at in self._newest(seen)]
            self.history.put(viewed)
        if written is not None:
            self.profile.update(written)
        return toggled, viewed, written

    def _newest(self, seen: dict[int, Stamp]) -> list[tuple[int, Stamp]]:
        return sorted(seen.items(), key=lambda x: x[1], reverse=True)[: self.most]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        toggled, viewed, written = self._merge(rows)
        for i, (odd, us, e) in toggled.items():
            yield _CHANGE(key[0], "toggle", i, None, odd, None, us, e)
        for pos, (i, us, e) in enumerate(viewed or (), 1):
            yield _CHANGE(key[0], "view", i, pos, None, None, us, e)
        if written is not None:
            yield _CHANGE(key[0], "profile", None, None, None, *written)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self._merge(initialState["past"])

    def close(self) -> None:
        pass


def _timed(events: DataFrame) -> DataFrame:
    """Rows without user, time or number can't be placed and are left out."""
    known = events.where("user_id is not null and ts is not null and event_id is not null and (item_id is not null or kind = 'profile')")
    return known.select("user_id", "kind", "item_id", "payload", F.unix_micros("ts").alias("us"), "event_id")


def _chunks(rows: DataFrame) -> DataFrame:
    """A user's rows as few rows of at most ``CHUNK``: the operator is called for each row of an initial table."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    dealt = rows.withColumn("_chunk", F.floor((number - 1) / CHUNK))
    return dealt.groupBy("user_id", "_chunk").agg(F.collect_list(F.struct("kind", "item_id", "payload", "us", "event_id")).alias("past")).select("user_id", "past")


def changes(events: DataFrame, most: int = 20, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """What each batch changes, for update mode: toggled items with their membership, a changed history whole, and a written profile."""
    held = _chunks(_timed(initial)).groupBy("user_id") if initial is not None else None
    time = "ProcessingTime" if ttl_ms else "None"
    return _timed(events).groupBy("user_id").transformWithState(UserState(most, ttl_ms), CHANGE, "Update", time, initialState=held)


def snapshot(events: DataFrame, most: int = 20) -> DataFrame:
    """Past events as few rows of the same columns: one toggle for each favourite, the history's views, the last profile.

    An item that was taken off again has two toggles, so that its last change
    still counts against an older one that comes late.
    """
    kind = lambda k: events.where(F.col("kind") == k)
    row = lambda df, k, item, payload, ts, event: df.select("user_id", F.lit(k).alias("kind"), item.alias("item_id"), payload.alias("payload"), ts.alias("ts"), event.alias("event_id"))
    none = F.lit(None).cast("string")
    toggled = kind("toggle").groupBy("user_id", "item_id").agg(F.count("*").alias("_n"), F.max(F.struct("ts", "event_id")).alias("_v"))
    twice = toggled.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(2) - (F.col("_n") % 2).cast("int"))))
    favs = row(twice, "toggle", F.col("item_id"), none, F.col("_v.ts"), F.col("_v.event_id"))
    latest = kind("view").groupBy("user_id", "item_id").agg(F.max(F.struct("ts", "event_id")).alias("_v"))
    few = state.first_rows(latest, ["user_id"], [F.desc("_v.ts"), F.desc("_v.event_id")], most)
    seen = row(few, "view", F.col("item_id"), none, F.col("_v.ts"), F.col("_v.event_id"))
    last = kind("profile").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "payload")).alias("_p"))
    return favs.unionByName(seen).unionByName(row(last, "profile", F.lit(None).cast("long"), F.col("_p.payload"), F.col("_p.ts"), F.col("_p.event_id")))


def current(log: DataFrame, batch: str = "batch") -> DataFrame:
    """The state at the end of a log of changes: members of favourites, the last history and the last profile of each user."""
    toggle = log.where("kind = 'toggle'").groupBy("user_id", "kind", "item_id").agg(F.max_by(F.struct("favourite", "us", "event_id", "payload", "pos"), batch).alias("s"))
    members = toggle.where("s.favourite").select("user_id", "kind", "item_id", "s.pos", "s.payload", "s.us", "s.event_id")
    # a history and a profile come whole, so the last batch that has a user's has all of it
    whole = log.where("kind in ('view', 'profile')").groupBy("user_id", "kind", batch).agg(F.collect_list(F.struct("item_id", "pos", "payload", "us", "event_id")).alias("x"))
    last = whole.groupBy("user_id", "kind").agg(F.max_by("x", batch).alias("x")).select("user_id", "kind", F.explode("x").alias("x")).select("user_id", "kind", "x.*")
    return members.unionByName(last)


def begun(initial: DataFrame) -> DataFrame:
    """A snapshot as changes."""
    rows = _timed(initial)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id")))
    none = F.lit(None)
    toggled = rows.where("kind = 'toggle'").groupBy("user_id", "kind", "item_id").agg((F.count("*") % 2 == 1).alias("favourite"), F.max(F.struct("us", "event_id")).alias("v"))
    toggled = toggled.select("user_id", "kind", "item_id", none.cast("int").alias("pos"), "favourite", none.cast("string").alias("payload"), "v.us", "v.event_id")
    seen = rows.where("kind = 'view'").select("user_id", "kind", "item_id", place.cast("int").alias("pos"), none.cast("boolean").alias("favourite"), none.cast("string").alias("payload"), "us", "event_id")
    written = rows.where("kind = 'profile'").select("user_id", "kind", "item_id", none.cast("int").alias("pos"), none.cast("boolean").alias("favourite"), "payload", "us", "event_id")
    return toggled.union(seen).union(written)


def drained(events: DataFrame, folder: str, initial: DataFrame | None = None, **options) -> DataFrame:
    """Runs a stream over all that is there, logs its changes under ``folder`` by batch, and gives the state.

    A batch writes its own folder whole, so one that is run again after a failure
    changes nothing; the checkpoint beside it lets the next call go on.  An
    initial snapshot is the log's batch -1, written once.
    """
    spark = events.sparkSession
    if initial is not None and not finished(spark, f"{folder}/log/batch=-1"):
        begun(initial).write.mode("overwrite").parquet(f"{folder}/log/batch=-1")

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")

    run = changes(events, initial=initial, **options).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    # with a time to live there is always another batch to run, so one is all there is
    bound = {"once": True} if options.get("ttl_ms") else {"availableNow": True}
    run.trigger(**bound).foreachBatch(log).start().awaitTermination()
    return current(spark.read.schema(f"{CHANGE}, batch long").parquet(f"{folder}/log"))


def typed(events: DataFrame, kind: Column, payload: Column) -> DataFrame:
    """Events of (event_id, ts, user_id, item_id) with their kind."""
    return events.select(F.col("user_id").cast("long").alias("user_id"), kind.alias("kind"), F.col("item_id").cast("long").alias("item_id"), payload.cast("string").alias("payload"), "ts", F.col("event_id").cast("long").alias("event_id"))
