import pytest
from pyspark.sql import functions as F

from larder.functions import rounding, rules, text
from larder.operators import features


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rounding_families(spark):
    assert [value(spark, rounding.half_even(F.lit(x))) for x in (2.5, 3.5, -2.5)] == [2, 4, -2]
    assert [value(spark, rounding.half_up(F.lit(x))) for x in (2.5, -2.5, 1.4)] == [3.0, -2.0, 1.0]


def test_cleaning(spark):
    assert value(spark, text.clean_text(F.lit(" a   b&amp;amp;\x1f\tc "))) == "a b&amp; c"
    assert value(spark, text.clean_text(F.lit(None))) == ""
    once = value(spark, text.clean_text(F.lit(" x \n y ")))
    assert value(spark, text.clean_text(F.lit(once))) == once


def test_numbers(spark):
    got = lambda f, xs: [value(spark, f(F.lit(x))) for x in xs]
    assert got(text.parse_float, ("4.6", "", "abc", "1.5d", "1_000", None, "-.5")) == [4.6, 0.0, 0.0, 0.0, 1000.0, 0.0, -0.5]
    assert got(text.parse_int, ("12.7", "nan", "inf", "-3.9", "")) == [12, 0, 0, -3, 0]
    assert got(text.parse_price, ("$12.99", "£18", "$$", "1,299", "-5", "")) == [12.99, 18.0, 0.0, 1.0, 5.0, 0.0]


def test_text_pieces(spark):
    got = lambda c: value(spark, c)
    assert got(text.normalize_category(F.lit("a, b ,,c"))) == "a, b, c"
    assert got(text.normalize_category(F.lit(","))) == "" and got(text.normalize_category(F.lit(" "))) == "Unknown"
    assert got(text.place_type(F.lit("fast_food_restaurant"))) == "Fast Food Restaurant" and got(text.place_type(F.lit(None))) == "Restaurant"
    assert got(text.safe_id(F.lit("places/A b/places/c"))) == "a-b-places-c"
    assert got(text.line_after(F.lit("x Menu:\n  Dish \nmore"), "Menu:")) == "Dish" and got(text.line_after(F.lit("x Menu:"), "Menu:")) == ""
    assert got(text.drop_prefixes(F.lit(" </s> <s> hi"), ("<|assistant|>", "</s>", "<s>"))) == "hi"


def test_keywords_stand_inside_words(spark):
    assert value(spark, rules.estimate(rules.CALORIES, F.lit("Steak Frites"), F.lit(""), F.lit(""))) == 350
    assert value(spark, rules.cuisine_tags(F.lit("Burgers"), F.lit("Thai BBQ"))) == ["burger", "korean", "thai"]
    assert value(spark, rules.cuisine_tags(F.lit(None), F.lit(""))) == ["general"]
    assert value(spark, rules.cuisine_matches(["Sushi"], F.lit("Japanese"), F.lit("x"), F.lit(""))) is True
    assert value(spark, rules.cuisine_matches([], F.lit("Japanese"))) is False


def test_rule_sets_differ(spark):
    level = lambda v: value(spark, rules.health_level(F.lit(750), F.lit(10), F.lit(8), v))
    assert (level(1), level(2)) == ("normal", "healthy")


def test_each_keyword_is_looked_for_once(spark):
    menus = spark.createDataFrame([("Pancake Cake", "grilled", "Brunch"), (None, None, None), ("Fish Taco", "", "Deli, BBQ")], "name string, description string, category string")
    for version in (1, 2):
        found = features.enriched(menus, version, cuisines=True)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Contains(") == len(rules.estimate_words(version)) + len(rules.cuisine_words(version))
        low = menus.select(rules.joined(F.col("name"), F.col("description"), F.col("category")).alias("a"), rules.joined(F.col("category"), F.col("name")).alias("b"))
        kcal = rules.estimate_of(rules.CALORIES, F.col("a"), version)
        want = low.select(kcal, rules.cuisine_tags_of(F.col("b"), version)).collect()
        assert [tuple(r) for r in found.select("estimated_calories", "cuisine_tags").collect()] == [tuple(r) for r in want]
    assert rules.Marks.of(F.col("x"), ["a"] * 63) is not None
    with pytest.raises(ValueError):
        rules.Marks.of(F.col("x"), ["a"] * 64)
