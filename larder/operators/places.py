"""External place records as venues with an estimated menu."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import rules, text
from larder.functions.rounding import half_up
from larder.operators.ranking import MENU

# Estimated items (id, name, calories, protein, carbs, fat, fiber) for a cuisine.
ESTIMATED = {
    ("japanese", "sushi"): (("estimated-salmon-sushi-set", "Estimated Salmon Sushi Set", 620, 36, 68, 18, 4), ("estimated-tuna-rice-bowl", "Estimated Tuna Rice Bowl", 580, 42, 62, 12, 5)),
    ("indian",): (("estimated-chicken-curry", "Estimated Chicken Curry", 720, 38, 76, 26, 8), ("estimated-tandoori-chicken", "Estimated Tandoori Chicken", 560, 48, 32, 18, 5)),
    ("burger",): (("estimated-grilled-chicken-burger", "Estimated Grilled Chicken Burger", 650, 44, 58, 22, 5), ("estimated-classic-burger", "Estimated Classic Burger", 860, 38, 72, 42, 4)),
    ("healthy",): (("estimated-chicken-protein-bowl", "Estimated Chicken Protein Bowl", 520, 45, 48, 14, 9), ("estimated-tofu-fiber-bowl", "Estimated Tofu Fiber Bowl", 480, 28, 55, 12, 14)),
}
BALANCED = (("estimated-balanced-meal", "Estimated Balanced Meal", 650, 35, 65, 22, 6), ("estimated-light-meal", "Estimated Light Meal", 520, 30, 55, 16, 7))


def menu_of(items) -> Column:
    return F.from_json(F.lit("[" + ",".join(f'{{"id":"{i}","name":"{n}","calories":{k},"protein":{p},"carbs":{c},"fat":{f},"fiber":{b},"tags":[]}}' for i, n, k, p, c, f, b in items) + "]"), MENU)


def estimated_menu(cuisine: Column) -> Column:
    low = F.lower(cuisine)
    return F.coalesce(*(F.when(low.isin(*names), menu_of(items)) for names, items in ESTIMATED.items()), menu_of(BALANCED))


def venue_numbers(menu: Column) -> dict[str, Column]:
    """Averages and labels of a nested menu; an empty one has defaults."""
    n = F.size(menu).cast("double")
    mean = lambda k: F.aggregate(menu, F.lit(0.0), lambda a, x: a + F.coalesce(x[k], F.lit(0.0))) / F.greatest(n, F.lit(1.0))
    some = n > 0
    kcal = mean("calories")
    health = F.lit(60.0) + F.when(kcal <= 650, 15.0).otherwise(0.0) + F.when(mean("fiber") >= 6, 15.0).otherwise(0.0) + F.when(mean("fat") <= 25, 10.0).otherwise(0.0)
    return {
        "average_calories": F.when(some, half_up(kcal)).otherwise(650.0), "meal_type": F.when(some & (kcal <= 600), "healthy").when(some & (kcal >= 850), "cheat").otherwise("normal"),
        "protein_score": F.when(some, half_up(F.least(F.lit(100.0), mean("protein") / F.lit(45.0) * F.lit(100.0)))).otherwise(60.0),
        "health_score": F.when(some, F.least(F.lit(100.0), health)).otherwise(60.0),
    }


def venue_tags(cuisine: Column, category: Column) -> Column:
    more = F.when(cuisine == "Healthy", "Healthy Meal").when(cuisine == "Japanese", "Balanced").when(cuisine == "Indian", "Curry").when(cuisine == "Burger", "Cheat Meal")
    return F.array_distinct(rules.present(cuisine, category, more))


def adapted(places: DataFrame) -> DataFrame:
    """Places (id, displayName, formattedAddress, primaryType) as venues; the address and map link are not kept."""
    df = places.select(text.safe_id(F.col("id")).alias("id"), F.coalesce("displayName.text", F.lit("Unknown Restaurant")).alias("name"), text.place_type(F.col("primaryType")).alias("category"))
    df = df.withColumn("cuisine", rules.place_cuisine(F.concat_ws(" ", "name", "category")))
    df = df.withColumn("menu", estimated_menu(F.col("cuisine")))
    return df.withColumns({**venue_numbers(F.col("menu")), "match_score": F.lit(0), "tags": venue_tags(F.col("cuisine"), F.col("category"))})
