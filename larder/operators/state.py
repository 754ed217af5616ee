"""Keyed state from an event log, in batch.  Every form aggregates before it shuffles where the semantics allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators.features import first_rows


def favourites(events: DataFrame) -> DataFrame:
    """(user_id, item_id, added): items toggled an odd number of times, with the last toggle's time and event."""
    last = F.max(F.struct("ts", "event_id")).alias("_last")
    odd = events.groupBy("user_id", "item_id").agg(F.count("*").alias("_n"), last).where("_n % 2 = 1")
    return odd.select("user_id", "item_id", F.col("_last.ts").alias("added"), F.col("_last.event_id").alias("added_event"))


def favourite_venues(favs: DataFrame, venues: DataFrame) -> DataFrame:
    return venues.join(favs.select(F.col("item_id").alias("id")), "id", "left_semi")


def history(events: DataFrame, most: int = 20) -> DataFrame:
    """(user_id, item_id, viewed_at, pos): each user's last ``most`` distinct items, newest first.

    Keeping the newest view of an item is the same as moving it to the front: an
    item that left the list can come back only by a newer view.
    """
    latest = events.groupBy("user_id", "item_id").agg(F.max(F.struct("ts", "event_id")).alias("_v"))
    order = [F.desc("_v.ts"), F.desc("_v.event_id")]
    few = first_rows(latest, ["user_id"], order, most)
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return few.select("user_id", "item_id", F.col("_v.ts").alias("viewed_at"), pos.alias("pos"))


def history_venues(seen: DataFrame, venues: DataFrame) -> DataFrame:
    """The history with venue columns; unknown items drop out, order by ``pos``."""
    return seen.join(venues.withColumnRenamed("id", "item_id"), "item_id").orderBy("user_id", "pos")


def latest_profiles(events: DataFrame, schema: str, default: Column) -> DataFrame:
    """(user_id, profile): the last write of each user; malformed or missing text gives the default."""
    last = events.groupBy("user_id").agg(F.max_by("payload", F.struct("ts", "event_id")).alias("_p"))
    bad = F.from_json("_p", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    good = F.when(bad.isNotNull() & bad["_bad"].isNull(), F.struct(*(bad[n].alias(n) for n in names)))
    return last.select("user_id", F.coalesce(good, default).alias("profile"))


def stored(payload: Column, schema: str, default: Column | None = None) -> Column:
    """A stored JSON text as typed data.

    Missing and empty text gives ``default``.  Malformed text gives ``default``
    too where there is one that isn't null; without it, the job fails, as a
    history must not be lost silently.
    """
    missing = F.coalesce(payload, F.lit("")) == ""
    if default is None:
        return F.when(~missing, F.from_json(payload, schema, {"mode": "FAILFAST"}))
    # a column of bad text tells malformed text from objects without fields
    box = F.from_json(F.concat(F.lit('{"v":'), payload, F.lit("}")), f"v {schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(missing | box["_bad"].isNotNull() | box["v"].isNull(), default).otherwise(box["v"])


def lookup(sources: list[DataFrame], ids: DataFrame) -> DataFrame:
    """Each id's row in the first source that has it; ids in none drop out."""
    all_rows = None
    for i, s in enumerate(sources):
        part = s.join(ids, "id", "left_semi").withColumn("_at", F.lit(i))
        all_rows = part if all_rows is None else all_rows.unionByName(part, allowMissingColumns=True)
    return first_rows(all_rows, ["id"], ["_at"], 1).drop("_at")
