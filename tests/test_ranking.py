"""Golden rankings of three venues for three profiles."""

import pytest
from pyspark.sql import functions as F

from larder.functions import nutrition
from larder.operators import places, ranking

ITEM = lambda i, c, p, cb, f, fi, *tags: (i, i, float(c), float(p), float(cb), float(f), float(fi), list(tags))


def test_targets(spark):
    rows = [("gain-muscle", 2995, 150, 412, 83, 42, 998), ("lose-fat", 2295, 135, 295, 64, 32, 765), ("maintain", 2695, 120, 385, 75, 38, 898)]
    for goal, *want in rows:
        r = spark.range(1).select(*nutrition.targets(nutrition.Profile(goal=goal)).columns()).first()
        assert (r["bmi"], r["bmr"], r["tdee"]) == (24.5, 1739, 2695)
        assert [r[k] for k in ("kcal", "protein", "carbs", "fat", "fiber", "budget")] == want


def test_zero_height(spark):
    assert spark.range(1).select(nutrition.targets(nutrition.Profile(height=0.0)).bmi).first()[0] is None


def venue(spark, menu):
    df = spark.createDataFrame([("v", "Place", menu)], f"id string, name string, menu {ranking.MENU}")
    return df.withColumns({**places.venue_numbers(F.col("menu")), "cuisine": F.lit("Healthy"), "category": F.lit("Bowls"), "tags": F.array(F.lit("Healthy Meal"))})


def test_ties_keep_menu_order(spark):
    same = [ITEM("a", 600, 40, 50, 20, 8), ITEM("b", 600, 40, 50, 20, 8), ITEM("c", 650, 10, 50, 20, 1)]
    r = ranking.matched(venue(spark, same), nutrition.Profile()).first()
    assert [b["id"] for b in r["best"]] == ["a", "b"] and r["cuisine_part"] == 15.0
    assert 0 <= r["match_score"] <= 100


def test_item_health_total(spark):
    # parts by hand: 500 kcal with 40 g protein and 10 g fiber are at both bounds; fat 10 g is 18 % of the energy
    for values, want in (((500, 40, 50, 10, 10), 15 + 10 + 5 + 10), ((1000, 20, 50, 60, 5), 4 + 3 + 0 + 0), ((0, 10, 0, 0, 0), 0 + 0 + 5 + 10)):
        item = spark.createDataFrame([tuple(map(float, values))], "kcal double, protein double, carbs double, fat double, fiber double")
        row = nutrition.Item(**{f: F.col(f) for f in nutrition.Item.__dataclass_fields__})
        assert item.select(nutrition.health_total(row)).first()[0] == want


def test_empty_menu(spark):
    r = ranking.matched(venue(spark, []), nutrition.Profile()).first()
    assert (r["average_calories"], r["meal_type"], r["protein_score"], r["health_score"]) == (650.0, "normal", 60.0, 60.0)
    assert r["health"]["score"] == 0.0 and r["best"] == [] and r["menu_part"] == 0.0


def test_item_without_energy(spark):
    r = ranking.menu_health(venue(spark, [ITEM("z", 0, 0, 0, 0, 0)])).first()
    assert r["health"]["protein_part"] == 0.0 and r["health"]["energy_part"] == 10.0


@pytest.mark.parametrize("name,cuisine", [("Ramen Bar", "Japanese"), ("Five Guys", "Burger"), ("Hotpot", "Chinese"), ("X", "General")])
def test_places(spark, name, cuisine):
    raw = spark.createDataFrame([("places/A b", (name,), None, "fast_food_restaurant")], "id string, displayName struct<text: string>, formattedAddress string, primaryType string")
    r = places.adapted(raw).first()
    assert (r["id"], r["cuisine"], r["category"]) == ("a-b", cuisine, "Fast Food Restaurant") and len(r["menu"]) == 2


def test_place_without_fields(spark):
    raw = spark.createDataFrame([(None, None, None, None)], "id string, displayName struct<text: string>, formattedAddress string, primaryType string")
    r = places.adapted(raw).first()
    assert (r["name"], r["category"], r["cuisine"]) == ("Unknown Restaurant", "Restaurant", "General")


def test_equal_people_are_ranked_once_and_as_the_columns_do(spark):
    menus = [[ITEM("a", 600, 40, 50, 20, 8), ITEM("b", 600, 40, 50, 20, 8), ITEM("c", 650, 10, 50, 20, 1)], [], [ITEM("z", 0, 0, 0, 0, 0)], [("n", "n", None, 30.0, None, 5.0, 9.0, []), ITEM("d", 900, 55, 90, 45, 2)], None]
    rows = [(f"v{i}", m, "Sushi" if i % 2 else None, "Bowls", ["Healthy Meal"], ("healthy", "cheat", None)[i % 3]) for i, m in enumerate(menus * 3)]
    venues = spark.createDataFrame(rows, f"id string, menu {ranking.MENU}, cuisine string, category string, tags array<string>, meal_type string")
    kinds = [(175.0, "gain-muscle", "healthy", ["Sushi ", None]), (160.0, "lose-fat", "normal", ["bow"]), (0.0, "maintain", "cheat", []), (None, None, None, None), (181.0, "maintain", "healthy", [""])]
    people = spark.createDataFrame([(i, *kinds[i % 5]) for i in range(40)], "k long, height double, goal string, meal_type string, favourites array<string>")
    profile = nutrition.Profile(height=F.col("height"), goal=F.col("goal"), meal_type=F.col("meal_type"), favourites=F.col("favourites"))
    assert ranking.profiles_of(people, profile, "k").select("_who").distinct().count() == len(kinds)
    got = sorted(tuple(r) for r in ranking.ranked_each(venues, people, profile, "k", n=7).collect())
    want = []
    for r in people.collect():
        if r["k"] < 5:
            favourites = F.lit(None).cast("array<string>") if r["favourites"] is None else F.array(*map(F.lit, r["favourites"])).cast("array<string>")
            one = nutrition.Profile(height=F.lit(r["height"]).cast("double"), goal=F.lit(r["goal"]).cast("string"), meal_type=F.lit(r["meal_type"]).cast("string"), favourites=favourites)
            best = ranking.ranked(venues, one).select("id", "match_score").take(7)
            want += [(k, at, b["id"], b["match_score"]) for k in range(r["k"], 40, 5) for at, b in enumerate(best, 1)]
    assert got == sorted(want)
