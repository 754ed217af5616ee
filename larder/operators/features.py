"""Venue and menu features: cleaning, first-wins rows, capped menus, rounded aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import rules, text
from larder.functions.rounding import half_even
from larder.sources import tables


def clean_venues(raw: DataFrame, most: int | None = 5000) -> DataFrame:
    """Typed venues from raw text rows: blank ids and names go, the first row of an id (by row_seq) stays, then the first ``most``."""
    t = lambda c: text.clean_text(F.col(c)).alias(c)
    rows = raw.select("row_seq", *map(t, ("id", "name", "category", "price_range", "full_address", "zip_code")), *(text.parse_float(F.col(c)).alias(c) for c in ("score", "lat", "lng")), text.parse_int(F.col("ratings")).alias("ratings"))
    kept = first_of(rows.where((F.col("id") != "") & (F.col("name") != "")), ["id"])
    return kept if most is None else kept.orderBy("row_seq").limit(most)


def first_of(rows: DataFrame, keys: list[str], order: str | list[Column] = "row_seq") -> DataFrame:
    """The first row of each key.  The minimum of (order, row) is taken before the shuffle, so hot keys do no harm."""
    by = [F.col(order)] if isinstance(order, str) else order
    row = F.struct(*by, F.struct(*(F.col(c) for c in rows.columns)).alias("_row"))
    return rows.groupBy(*keys).agg(F.min(row).alias("_m")).select("_m._row.*")


def clean_menus(raw: DataFrame, venues: DataFrame, most: int = 30) -> DataFrame:
    """Items of known venues, at most the first ``most`` named ones of each, with estimates; ids follow row_seq."""
    known = raw.withColumn("restaurant_id", text.clean_text(F.col("restaurant_id"))).join(venues.select(F.col("id").alias("restaurant_id")), "restaurant_id", "left_semi")
    named = known.withColumn("name", text.clean_text(F.col("name"))).where(F.col("name") != "")
    kept = first_rows(named, ["restaurant_id"], ["row_seq"], most)  # the other columns are cleaned where rows stay
    rows = kept.select("row_seq", "restaurant_id", "name", *(text.clean_text(F.col(c)).alias(c) for c in ("category", "description")), text.parse_price(F.col("price")).alias("price"))
    return numbered(enriched(rows), "row_seq", "id")


def first_rows(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each key in the given order.  Spark limits each task's rows by group before it shuffles them."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= most).drop("_n")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds a 1-based sequence as text, without one task for all rows.

    Rows are sorted into ranges; each gets its place within its range plus the
    sizes of the ranges before it (one small row for each range).
    """
    from larder.sources.tables import staged

    ranged = staged(rows.repartitionByRange(order).withColumn("_r", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_r").agg(F.count("*").alias("_c"))
    before = sizes.select("_r", F.coalesce(F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy(order))
    return ranged.join(F.broadcast(before), "_r").withColumn(name, (F.col("_before") + place).cast("string")).drop("_r", "_before")


def enriched(menus: DataFrame, version: int = 1, cuisines: bool = False) -> DataFrame:
    """Adds estimates, level and tags, and the cuisine tags by themselves if asked for; each keyword is looked for once in a text."""
    c, words, kinds = F.col, rules.estimate_words(version), rules.cuisine_words(version)
    low = menus.withColumns({"_low_item": rules.joined(c("name"), c("description"), c("category")), "_low_tags": rules.joined(c("category"), c("name"))})
    marked = low.withColumns({"_item": rules.Marks.of(c("_low_item"), words), "_kinds": rules.Marks.of(c("_low_tags"), kinds)}).drop("_low_item", "_low_tags")
    item, kind = rules.Marks(c("_item"), words), rules.Marks(c("_kinds"), kinds)
    est = {n: rules.estimate_of(t, item, version) for n, t in (("estimated_calories", rules.CALORIES), ("estimated_protein", rules.PROTEIN), ("estimated_fiber", rules.FIBER))}
    k, p, f = (c(n) for n in est)
    own = {"cuisine_tags": rules.cuisine_tags_of(kind, version)} if cuisines else {}
    return marked.withColumns(est).withColumns({"health_level": rules.health_level(k, p, f, version), "tags": rules.menu_tags(k, p, f, kind, version), **own}).drop("_item", "_kinds")


def aggregated(menus: DataFrame) -> DataFrame:
    """Rounded averages and scores of each venue's items; one shuffle of partial sums."""
    k, p, f = F.col("estimated_calories"), F.col("estimated_protein"), F.col("estimated_fiber")
    sums = menus.groupBy("restaurant_id").agg(
        F.count("*").alias("n"), F.sum(k).alias("k"), F.sum(p).alias("p"), F.sum(f).alias("f"),
        F.count_if(k <= 600).alias("low"), F.count_if(p >= 30).alias("rich"), F.count_if(f >= 7).alias("fibrous"), F.count_if(k >= 800).alias("heavy"),
    )
    n = F.col("n")
    mean = lambda c: half_even(F.col(c) / n)
    share = lambda c, w: F.col(c) / n * F.lit(float(w))
    df = sums.select(
        "restaurant_id", n.cast("int").alias("menu_count"), mean("k").alias("average_calories"), mean("p").alias("average_protein"), mean("f").alias("average_fiber"),
        half_even(share("low", 40) + share("rich", 35) + share("fibrous", 25)).alias("health_score"), half_even(share("heavy", 100)).alias("cheat_score"),
    )
    fitness = F.col("health_score") - half_even(F.col("cheat_score") * F.lit(0.25)) + 20
    return df.withColumn("fitness_score", F.greatest(F.lit(0), F.least(F.lit(100), fitness)))


def venue_features(venues: DataFrame, menus: DataFrame) -> DataFrame:
    """Venues that have items, with their features and cuisine tags."""
    df = venues.join(aggregated(menus).withColumnRenamed("restaurant_id", "id"), "id")
    return df.withColumn("cuisine_tags", rules.cuisine_tags(F.col("category"), F.col("name")))


def write_features(features: DataFrame, menus: DataFrame, folder: str) -> dict:
    """Writes both cleaned tables and a summary of them, counted by the jobs that write."""
    venue = {"restaurants": F.count("*"), "menu_items": F.sum("menu_count"), "best_fitness": F.max("fitness_score")}
    item = {"kept_items": F.count("*"), "healthy_items": F.count_if(F.col("health_level") == "healthy"), "cheat_items": F.count_if(F.col("health_level") == "cheat")}
    text_lists = lambda df: df.withColumns({c: text.json_list(F.col(c)) for c in ("cuisine_tags", "tags") if c in df.columns})
    seen = {}
    for df, counters, name in ((features, venue, "restaurants_clean"), (menus, item, "menus_clean")):
        seen |= tables.write_observed(df, counters, lambda d, name=name: text_lists(d).write.mode("overwrite").csv(f"{folder}/{name}", header=True, escape='"'))
    if not seen["restaurants"]:
        raise ValueError("no rows to write")
    tables.write_report(features.sparkSession, f"{folder}/summary", seen)
    return seen


def summary(features: DataFrame, menus: DataFrame) -> DataFrame:
    """One row of counters."""
    a = features.agg(F.count("*").alias("restaurants"), F.sum("menu_count").alias("menu_items"), F.max("fitness_score").alias("best_fitness"))
    b = menus.agg(F.count("*").alias("kept_items"), F.count_if(F.col("health_level") == "healthy").alias("healthy_items"), F.count_if(F.col("health_level") == "cheat").alias("cheat_items"))
    return a.join(F.broadcast(b))
