"""The test tables seen as venues, menus, profiles and events.

Dish names and the like are picked by key, the same way as in the oracle's SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.nutrition import Profile
from larder.operators import features, places

DISHES = (
    "Steak Frites", "Green Tea", "Chicken Burger", "Vegan Bean Wrap", "Ice Cream Cake", "Salmon Sushi", "Poke Bowl", "Beef Burrito", "Fish Taco", "Tomato Soup", "Pepperoni Pizza", "Shrimp Curry", "Noodle Bowl",
    "Pancake Stack", "Club Sandwich", "Grilled Chicken Wings", "Vegetable Salad", "Fried Rice", "Pasta Bake", "Fruit Smoothie", "Brownie Sundae", "Plain Plate", "Loaded Nachos", "Tuna Wrap", "Dim Sum Set",
)
SECTIONS = ("Mains", "Healthy Picks", "Desserts", "Brunch", "Japanese", "Drinks", "Sides")
CUISINES = ("Burgers, American", "Japanese", "Indian, Curry", "Mexican", "Healthy, Salad", ",", "Italian , Pizza", "Korean BBQ", "Thai", "Coffee & Bakery", "", "Chinese")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (key % len(names)).cast("int") + 1)


def money(c: str) -> Column:
    return F.col(c).cast("decimal(12,2)").cast("string")


def raw_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    name = F.when(F.col("l_partkey") % 17 == 0, "  ").otherwise(pick(DISHES, F.col("l_partkey")))
    return table(spark, sf_dir, "lineitem").select(
        seq.alias("row_seq"), F.col("l_suppkey").cast("string").alias("restaurant_id"), pick(SECTIONS, F.col("l_linenumber")).alias("category"), name.alias("name"),
        F.concat(F.lit("served "), F.lower("l_returnflag")).alias("description"), F.concat(F.lit("$"), money("l_extendedprice")).alias("price"),
    )


def raw_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier twice; the second row of an id has another name and must lose.  Every 25th has no name."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    first = F.when(key % 25 == 24, "").otherwise(F.concat(F.lit("  "), F.col("s_name"), F.lit(" &amp;  Co")))
    row = lambda seq, name: s.select(
        seq.alias("row_seq"), key.cast("string").alias("id"), name.alias("name"), pick(CUISINES, key).alias("category"), money("s_acctbal").alias("score"),
        F.concat(F.col("s_nationkey").cast("string"), F.lit(".7")).alias("ratings"), F.lit("$$").alias("price_range"), F.concat(F.lit("Street "), F.col("s_nationkey").cast("string")).alias("full_address"),
        F.lit("00000").alias("zip_code"), F.lit("n/a").alias("lat"), F.lit("").alias("lng"),
    )
    return row(key, first).union(row(key + 1_000_000, F.when(key % 25 == 24, "").otherwise("Late Copy")))


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All venues, without the reader's cap."""
    return features.clean_venues(raw_venues(spark, sf_dir), None)


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched items without sequence ids."""
    known = raw_menus(spark, sf_dir).join(venues(spark, sf_dir).select(F.col("id").alias("restaurant_id")), "restaurant_id", "left_semi")
    named = known.withColumn("name", features.text.clean_text(F.col("name"))).where("name <> ''")
    kept = features.first_rows(named, ["restaurant_id"], ["row_seq"], 30)
    return features.enriched(kept.withColumn("price", features.text.parse_price(F.col("price"))))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped items with an id."""
    return capped(spark, sf_dir).withColumn("id", F.col("row_seq").cast("string"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues with nested menus for ranking."""
    i = capped(spark, sf_dir)
    level, num = F.col("health_level"), lambda c: F.col(c).cast("double")
    tags = rules.texts(F.when(level == "healthy", "Healthy"), F.when(level == "cheat", "Cheat Meal"), F.when(F.col("estimated_protein") >= 30, "High Protein"), F.when(F.col("estimated_calories") <= 500, "Low Calorie"))
    item = F.struct(
        "row_seq", F.col("row_seq").cast("string").alias("id"), "name", num("estimated_calories").alias("calories"), num("estimated_protein").alias("protein"),
        (F.col("row_seq") % 61 + 20).cast("double").alias("carbs"), (F.col("row_seq") % 37 + 5).cast("double").alias("fat"), num("estimated_fiber").alias("fiber"), tags.alias("tags"),
    )
    menus = i.groupBy(F.col("restaurant_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("menu"))
    df = venues(spark, sf_dir).select("id", "name", "category").join(menus, "id")
    df = df.withColumn("cuisine", rules.place_cuisine(F.concat_ws(" ", "name", "category")))
    return df.withColumns({**places.venue_numbers(F.col("menu")), "tags": places.venue_tags(F.col("cuisine"), F.col("category"))})


PROFILE = Profile()


MEALS = ("healthy", "cheat", "normal")
FAVOURITES = (("Healthy", "Sushi"), (" Burger",), ("italian", "Indian"), (), ("Thai", "korean "))


def customer_profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Profile]:
    """Every customer as a profile."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    cols = c.select(
        "c_custkey", (key % 60 + 140).cast("double").alias("height"), (key % 70 + 45).cast("double").alias("weight"), (key % 50 + 18).cast("double").alias("age"),
        pick(("male", "female"), key).alias("gender"), pick(("low", "medium", "high"), key).alias("activity"), pick(("lose-fat", "maintain", "gain-muscle", "maintain", "lose-fat"), key).alias("goal"),
        pick(MEALS, key).alias("meal_type"), F.element_at(F.array(*(F.array(*map(F.lit, f)).cast("array<string>") for f in FAVOURITES)), (key % len(FAVOURITES)).cast("int") + 1).alias("favourites"),
    )
    return cols, Profile(*(F.col(x) for x in ("height", "weight", "age", "gender", "activity", "goal", "meal_type", "favourites")))


def events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.where(F.col("event_type").isin(*kinds)) if kinds else e
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), F.col("event_type"), "value")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as generated samples, with planted faults by turn."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    body = F.coalesce("text", F.lit(""))
    name = F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("Venue "), (F.col("conv_id") % 9).cast("string")))
    menu = F.when(k % 11 == 0, F.lit("")).otherwise(F.lit("Recommended Menu:\nDish\n\n"))
    reason = F.when(k % 5 == 0, F.lit("Recommended Reason:\nIt fits the asked-for nutrition well enough to be named here.")).when(k % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("Recommended Reason:\n"), body))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_seq"), F.concat(F.lit("Recommended Restaurant:\n"), name, F.lit("\n\n"), menu, reason).alias("output"))
