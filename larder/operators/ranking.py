"""Ranking of venues with nested menus for a profile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import nutrition as N
from larder.functions import rules
from larder.functions.rounding import half_up
from larder.operators import tiles
from larder.sources.tables import staged

MENU = "array<struct<id: string, name: string, calories: double, protein: double, carbs: double, fat: double, fiber: double, tags: array<string>>>"


def scored_items(venues: DataFrame, profile: N.Profile) -> DataFrame:
    """Adds ``items``: each item with its four part scores, their sum, and its place; scores are made once for each item."""
    t, goal = N.targets(profile), N.value(profile.goal)

    def score(x: Column, at: Column) -> Column:
        i = N.Item.of(x)
        parts = F.struct(N.quality(i, t).alias("quality"), N.goal_match(i, t, goal).alias("goal"), N.calories_match(i, t).alias("calories"), N.macro_match(i, goal).alias("macro"))
        return F.struct(x.alias("item"), parts.alias("parts"), at.alias("at"))

    df = venues.withColumn("_s", F.transform("menu", score))
    total = lambda x: sum((x["parts"][k] for k in ("goal", "calories", "macro")), x["parts"]["quality"])
    return df.withColumn("items", F.transform("_s", lambda x: F.struct((-total(x)).alias("order"), x["at"].alias("at"), x["item"].alias("item"), x["parts"].alias("parts"), total(x).alias("score")))).drop("_s")


def best_items(scored: DataFrame, profile: N.Profile, n: int = 2) -> DataFrame:
    """Adds ``best``: the n items with the highest score, ties in menu order, with the first three reasons."""
    t = N.targets(profile)
    named = lambda x: F.struct(x["item"]["id"].alias("id"), x["score"].alias("score"), N.item_reasons(N.Item.of(x["item"]), x["item"]["tags"], t, profile).alias("reasons"))
    short = F.transform("items", lambda x: F.struct(x["order"].alias("order"), x["at"].alias("at"), x["item"].alias("item"), x["score"].alias("score")))
    ordered = F.slice(F.array_sort(short, lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(a["at"] - b["at"])), 1, n)
    return scored.withColumn("best", F.transform(ordered, named))


def menu_health(venues: DataFrame) -> DataFrame:
    """Adds ``health``: averages of the items' rounded parts and the score out of 100; an empty menu has zeros."""
    n = F.size("menu").cast("double")

    def average(name: str) -> Column:
        total = F.aggregate(F.transform("menu", lambda x: N.health_parts(N.Item.of(x))[name]), F.lit(0.0), lambda a, b: a + b)
        return total / F.greatest(n, F.lit(1.0))

    parts = {k: average(k) for k in ("protein_part", "fiber_part", "fat_part", "energy_part")}
    df = venues.withColumn("_p", F.struct(*(c.alias(k) for k, c in parts.items())))
    total = F.col("_p.protein_part") + F.col("_p.fiber_part") + F.col("_p.fat_part") + F.col("_p.energy_part")
    return df.withColumn("health", F.struct(half_up(total / F.lit(40.0) * F.lit(100.0)).alias("score"), *(half_up(F.col(f"_p.{k}")).alias(k) for k in parts))).drop("_p")


def health_part() -> Column:
    return F.least(F.lit(20.0), F.col("health.score") * F.lit(0.2))


def matched(venues: DataFrame, profile: N.Profile) -> DataFrame:
    """Adds items, best, health (unless it is there), the parts of the match score, and the score itself."""
    df = best_items(scored_items(venues if "health" in venues.columns else menu_health(venues), profile), profile)
    mean = F.aggregate("best", F.lit(0.0), lambda a, x: a + x["score"]) / F.greatest(F.size("best"), F.lit(1)).cast("double")
    meal = N.value(profile.meal_type)
    df = df.withColumns({
        "menu_part": F.when(F.size("best") > 0, F.least(F.lit(50.0), mean * F.lit(0.5))).otherwise(F.lit(0.0)),
        "health_part": health_part(),
        "cuisine_part": F.when(rules.cuisine_matches(profile.favourites, F.col("cuisine"), F.col("category"), F.array_join("tags", " ")), 15.0).otherwise(0.0),
        "meal_part": F.when(F.col("meal_type") == meal, 15.0).when(meal == "normal", 8.0).otherwise(0.0),
    })
    return df.withColumn("match_score", half_up(F.col("menu_part") + F.col("health_part") + F.col("cuisine_part") + F.col("meal_part")))


def ranked(venues: DataFrame, profile: N.Profile, order: str = "id") -> DataFrame:
    """Venues by match score, ties in the given order."""
    return matched(venues, profile).orderBy(F.desc("match_score"), order)


#: Most people (of different profiles) and venues of a tile, and items scored at once.
TILE_PEOPLE, TILE_VENUES, BLOCK_ITEMS = 1024, 1 << 13, 1 << 14
#: A venue with its menu is work enough for few to make a task.
LEAST_VENUES = 16
NUMBERS = ("calories", "protein", "carbs", "fat", "fiber")


def profiles_of(people: DataFrame, profile: N.Profile, key: str) -> DataFrame:
    """(_key, _who, goal, meal_type, favourites, targets): people of equal ``_who`` differ in nothing that a score sees."""
    one = {"goal": N.value(profile.goal), "meal_type": N.value(profile.meal_type), "favourites": F.transform(N.value(profile.favourites), lambda f: F.lower(F.trim(f)))}
    seen = people.select(F.col(key).alias("_key"), *(c.alias(n) for n, c in one.items()), F.array(*N.targets(profile).columns()).alias("targets"))
    same = F.to_json(F.struct(*one, "targets"), {"ignoreNullFields": "false"})
    return seen.withColumn("_who", F.sha2(same, 256))


def ranked_each(venues: DataFrame, people: DataFrame, profile: N.Profile, key: str, n: int = 3, order: str = "id") -> DataFrame:
    """The n best venues of every person: key, rank, ``order`` and match_score; ties in the given order.

    ``profile`` names columns of ``people``.  People whose scores can't differ are
    ranked once.  Profiles and venues meet in tiles; what depends on one side alone
    is made before that, and a tile gives n venues a profile.  The scores are those
    of :func:`matched`; a number that is NaN counts as a missing one.
    """
    asked = profiles_of(people, profile, key)
    profiles = staged(asked.drop("_key").dropDuplicates(["_who"]), "profiles")
    numbers = [F.coalesce(F.col(f"menu.{c}").cast("array<double>"), F.array().cast("array<double>")).alias(c) for c in NUMBERS]
    text = rules.joined(F.col("cuisine"), F.col("category"), F.array_join("tags", " "))
    spots = staged(menu_health(venues).select(F.col(order).alias("_order"), *numbers, health_part().alias("health_part"), text.alias("text"), "meal_type"), "spots")
    g = tiles.grid(profiles.count(), spots.count(), TILE_PEOPLE, TILE_VENUES, tiles.cores(venues), LEAST_VENUES)
    few = min(g.tiles, tiles.MOST_TASKS)
    here, there = (df.repartition(few, "_tile").groupBy("_tile") for df in (tiles.row_tiles(spots, ["_order"], g), tiles.query_tiles(profiles, ["_who"], g)))
    kind = spots.schema["_order"].dataType.simpleString()

    def best_of(spots: pa.Table, profiles: pa.Table) -> pa.Table:
        tile = Tile(spots)
        rows = [(p["_who"], at, score) for p in profiles.to_pylist() for at, score in tile.best(p, n)]
        return pa.table({"_who": pa.array([w for w, _, _ in rows], pa.string()), "_order": tile.order.take(pa.array([a for _, a, _ in rows], pa.int64())), "match_score": pa.array([s for _, _, s in rows], pa.float64())})

    found = here.cogroup(there).applyInArrow(best_of, f"_who string, _order {kind}, match_score double")
    best = Window.partitionBy("_who").orderBy(F.desc("match_score"), "_order")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return asked.select("_key", "_who").join(top, "_who").select(F.col("_key").alias(key), "rank", F.col("_order").alias(order), "match_score")


class Tile:
    """The venues of a tile in their order, and their scores for one profile after another."""

    def __init__(self, spots: pa.Table):
        spots = spots.take(pc.sort_indices(spots, sort_keys=[("_order", "ascending")], null_placement="at_start")).combine_chunks()
        self.order = spots.column("_order")
        self.health, self.meal = spots.column("health_part").to_numpy(), np.array(spots.column("meal_type").to_pylist(), dtype=object)
        self.texts, self.text = np.unique(np.array(spots.column("text").to_pylist(), dtype=object), return_inverse=True)
        self.sizes = pc.list_value_length(spots.column("calories")).to_numpy()
        self.items = N.Item(*(pc.list_flatten(spots.column(c)).to_numpy() for c in NUMBERS))
        self.liked: dict[tuple, np.ndarray] = {}

    def blocks(self) -> Iterator[tuple[slice, N.Item]]:
        """Runs of venues with about ``BLOCK_ITEMS`` items, a whole number of menus each."""
        ends = np.cumsum(self.sizes)
        lo = 0
        while lo < len(ends):
            start = ends[lo] - self.sizes[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, start + BLOCK_ITEMS, "right")))
            yield slice(lo, hi), N.Item(*(x[start : ends[hi - 1]] for x in self.items.__dict__.values()))
            lo = hi

    def menu_parts(self, t: N.Targets, goal: str | None) -> np.ndarray:
        """Of each venue, by the mean of its two best items."""
        out = np.zeros(len(self.sizes))
        for at, items in self.blocks():
            sizes = self.sizes[at]
            some = np.flatnonzero(sizes)
            if len(some):
                best, count = two_best(N.item_score(items, t, goal, N.Arrays), sizes[some])
                out[at.start + some] = np.minimum(50.0, best / count * 0.5)
        return out

    def likes(self, favourites: list[str | None] | None) -> np.ndarray:
        names = tuple(f for f in favourites or () if f is not None)
        if names not in self.liked:
            known = [w for f in names for w in rules.ALIASES.get(f, (f,))]
            self.liked[names] = np.array([any(w in text for w in known) for text in self.texts], dtype=bool)[self.text]
        return self.liked[names]

    def best(self, p: dict, n: int) -> list[tuple[int, float]]:
        """(place, match_score) of the n best venues."""
        t = N.Targets(*(np.nan if x is None else x for x in p["targets"]))
        with np.errstate(all="ignore"):
            menu = self.menu_parts(t, p["goal"])
        meal = np.zeros(len(menu)) if p["meal_type"] is None else np.where(self.meal == p["meal_type"], 15.0, 8.0 if p["meal_type"] == "normal" else 0.0)
        score = np.floor(menu + self.health + np.where(self.likes(p["favourites"]), 15.0, 0.0) + meal + 0.5)
        first = np.argsort(-score, kind="stable")[:n]
        return [(int(i), float(score[i])) for i in first]


def two_best(scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the two greatest scores of each run of the given sizes, and how many they are; no run is empty."""
    starts = np.cumsum(sizes) - sizes
    first = np.maximum.reduceat(scores, starts)
    at = np.where(scores == np.repeat(first, sizes), np.arange(len(scores)), len(scores))
    rest = scores.copy()
    rest[np.minimum.reduceat(at, starts)] = -np.inf
    second = np.maximum.reduceat(rest, starts)
    return first + np.where(sizes > 1, second, 0.0), np.minimum(sizes, 2)


def top_reasons(n: int = 2) -> Column:
    """The first n positive reasons of a matched row."""
    return F.slice(F.filter(match_reasons(), lambda r: r["type"] == "positive"), 1, n)


def match_reasons() -> Column:
    """Reasons of a matched row: (label, points, type)."""
    h = F.col("health.score")
    one = lambda label, points, kind: F.struct(label.alias("label"), half_up(points).alias("points"), kind.alias("type"))
    lit = F.lit
    band = lambda label, kind: one(lit(label), lit(0.0), lit(kind))
    # The reasons' wording.
    return rules.present(
        one(lit("Recommended menu quality"), F.col("menu_part"), lit("positive")),
        one(F.concat(lit("Menu nutrition quality ("), h.cast("long").cast("string"), lit("/100)")), F.col("health_part"), F.when(h >= 70, "positive").otherwise("neutral")),
        F.when(F.col("cuisine_part") > 0, one(lit("Matches your favorite cuisine"), F.col("cuisine_part"), lit("positive"))),
        F.when(F.col("meal_part") > 0, one(lit("Matches your selected meal type"), F.col("meal_part"), lit("positive"))),
        F.when(h >= 85, band("Excellent overall menu health", "positive")).when(h >= 70, band("Good overall menu health", "positive"))
        .when(h >= 55, band("Average overall menu health", "neutral")).otherwise(band("Menu nutrition quality could be improved", "negative")),
    )


def meal_recommendation(profile: N.Profile) -> dict[str, Column]:
    """Calories, protein, message and reasons for a venue with its own averages."""
    b, meal = N.targets(profile).budget, N.value(profile.meal_type)
    gap = F.col("average_calories").cast("double") - b
    when = lambda c, s: F.when(c, F.lit(s))
    if isinstance(profile.favourites, Column):
        liked = F.array_contains(F.transform(profile.favourites, F.lower), F.lower("cuisine"))
    else:
        liked = F.lower("cuisine").isin(*(f.lower() for f in profile.favourites)) if profile.favourites else F.lit(False)
    # The reasons' wording.
    found = rules.present(
        when(F.abs(gap) <= 150, "Calories are close to your suggested meal budget."), when(gap > 150, "This meal may be higher than your suggested meal budget."),
        when(gap < -150, "This meal is lighter than your suggested meal budget."), when(F.col("protein_score") >= 80, "This restaurant is strong for protein."),
        when(F.col("health_score") >= 80, "This restaurant is a healthy choice."), when(F.col("meal_type") == meal, "This restaurant matches your selected meal type."),
        when(liked, "This restaurant matches your favorite cuisine."),
    )
    return {
        "calories": F.col("average_calories").cast("double"), "protein": half_up(F.col("protein_score") / F.lit(100.0) * F.lit(55.0)),
        "message": F.concat(F.lit("Your suggested meal budget is about "), b.cast("long").cast("string"), F.lit(" kcal.")), "reasons": found,
    }
