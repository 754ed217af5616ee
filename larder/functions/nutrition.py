"""Nutrition targets and item scores.  Profiles may be columns or plain values.

The four part scores are written once for :class:`Columns` and :class:`Arrays`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.rounding import half_up


def value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


@dataclass(frozen=True)
class Profile:
    """One person; each field is a value or a column."""

    height: object = 175.0
    weight: object = 75.0
    age: object = 22.0
    gender: object = "male"
    activity: object = "medium"
    goal: object = "gain-muscle"
    meal_type: object = "healthy"
    favourites: Sequence[str] | Column = field(default=("Healthy", "Sushi"))
    known: Targets | None = None  # targets that are columns already


@dataclass(frozen=True)
class Targets:
    bmi: Column
    bmr: Column
    tdee: Column
    kcal: Column
    protein: Column
    carbs: Column
    fat: Column
    fiber: Column
    budget: Column

    def columns(self) -> list[Column]:
        return [c.alias(n) for n, c in self.__dict__.items()]


def d(x: float) -> Column:
    return F.lit(float(x))


def targets(p: Profile) -> Targets:
    """Daily targets and the budget of one meal; a height of 0 has no body mass index."""
    if p.known is not None:
        return p.known
    height, weight, age = (value(x).cast("double") for x in (p.height, p.weight, p.age))
    goal = value(p.goal)
    metre = height / d(100)
    bmi = F.round(F.try_divide(weight, metre * metre), 1)
    bmr = half_up(d(10) * weight + d(6.25) * height - d(5) * age + F.when(value(p.gender) == "male", d(5)).otherwise(d(-161)))
    activity = value(p.activity)
    tdee = half_up(bmr * F.when(activity == "low", d(1.2)).when(activity == "medium", d(1.55)).otherwise(d(1.725)))
    kcal = tdee + F.when(goal == "lose-fat", d(-400)).when(goal == "gain-muscle", d(300)).otherwise(d(0))
    protein = half_up(weight * F.when(goal == "gain-muscle", d(2)).when(goal == "lose-fat", d(1.8)).otherwise(d(1.6)))
    fat = half_up(d(0.25) * kcal / d(9))
    carbs = F.greatest(d(0), half_up((kcal - d(4) * protein - d(9) * fat) / d(4)))
    fiber = half_up(kcal / d(1000) * d(14))
    return Targets(bmi, bmr, tdee, kcal, protein, carbs, fat, fiber, half_up(kcal / d(3)))


@dataclass(frozen=True)
class Item:
    """A menu item's columns."""

    kcal: Column
    protein: Column
    carbs: Column
    fat: Column
    fiber: Column

    @staticmethod
    def of(struct: Column) -> Item:
        return Item(*(struct[k].cast("double") for k in ("calories", "protein", "carbs", "fat", "fiber")))


class Columns:
    """The operations of the scores on Spark's columns."""

    number, greatest, least, abs, when, divide, half_up = map(staticmethod, (d, F.greatest, F.least, F.abs, F.when, F.try_divide, half_up))


class When:
    """``F.when`` on numpy arrays."""

    def __init__(self, *cases: tuple):
        self.cases = cases

    def when(self, condition, x) -> When:
        return When(*self.cases, (condition, x))

    def otherwise(self, x):
        for condition, y in reversed(self.cases):
            x = np.where(condition, y, x)
        return x


class Arrays:
    """The same operations on numpy arrays, where NaN stands for null: the greatest and the least of numbers pass over it."""

    number, greatest, least, abs = map(staticmethod, (float, np.fmax, np.fmin, np.abs))

    @staticmethod
    def when(condition, x) -> When:
        return When((condition, x))

    @staticmethod
    def divide(x, y):
        return np.where(y == 0, np.nan, x / y)

    @staticmethod
    def half_up(x):
        return np.floor(x + 0.5)


def upto(x, most: float, o=Columns):
    return o.least(x, o.number(most))


def third(x, o=Columns):
    return o.greatest(x / o.number(3), o.number(1))


def quality(i: Item, t: Targets, o=Columns):
    """0 to 40: protein, fiber and fat against a third of the day's targets."""
    d, fat = o.number, third(t.fat, o)
    near = o.greatest(d(0), d(1) - o.abs(i.fat - fat) / fat) * d(10)
    return o.half_up(upto(upto(i.protein / third(t.protein, o), 1, o) * d(20) + upto(i.fiber / third(t.fiber, o), 1, o) * d(10) + near, 40, o))


def goal_match(i: Item, t: Targets, goal, o=Columns):
    """0 to 30, by the goal's own weights."""
    d, b, p, f = o.number, t.budget, upto(i.protein / third(t.protein, o), 1, o), upto(i.fiber / third(t.fiber, o), 1, o)
    lose = o.when(i.kcal <= b, d(10)).otherwise(o.greatest(d(0), d(10) * (d(1) - (i.kcal - b) / o.greatest(b, d(1))))) + p * d(10) + f * d(10)
    floor = b - d(150)
    gain = p * d(18) + o.when(i.kcal >= floor, d(7)).otherwise(o.greatest(d(0), i.kcal / o.greatest(floor, d(1)) * d(7))) + o.when(i.carbs >= 40, d(5)).otherwise(upto(i.carbs / d(40), 1, o) * d(5))
    keep = o.greatest(d(0), d(1) - o.abs(i.kcal - b) / o.greatest(b, d(1))) * d(15) + p * d(8) + o.when((i.fat <= 30) & (i.carbs >= 30), d(7)).otherwise(d(4))
    return o.half_up(upto(o.when(goal == "lose-fat", lose).when(goal == "gain-muscle", gain).otherwise(keep), 30, o))


def calories_match(i: Item, t: Targets, o=Columns):
    d = o.number
    return o.half_up(o.greatest(d(0), upto(d(20) * (d(1) - o.abs(i.kcal - t.budget) / o.greatest(t.budget, d(1))), 20, o)))


def macro_match(i: Item, goal, o=Columns):
    """0 to 10: distance of the energy shares from the goal's."""
    d = o.number
    total = i.protein * d(4) + i.carbs * d(4) + i.fat * d(9)
    shares = {"lose-fat": (0.35, 0.35, 0.30), "gain-muscle": (0.35, 0.45, 0.20)}
    want = lambda k: o.when(goal == "lose-fat", d(shares["lose-fat"][k])).when(goal == "gain-muscle", d(shares["gain-muscle"][k])).otherwise(d((0.30, 0.40, 0.30)[k]))
    off = sum((o.abs(o.divide(x * d(e), total) - want(k)) for k, (x, e) in enumerate(((i.protein, 4), (i.carbs, 4), (i.fat, 9)))), d(0))
    return o.when(total <= 0, d(0)).otherwise(o.half_up(o.greatest(d(0), upto(d(10) - off * d(10), 10, o))))


def item_score(i: Item, t: Targets, goal, o=Columns):
    """The sum of the four part scores."""
    return quality(i, t, o) + goal_match(i, t, goal, o) + calories_match(i, t, o) + macro_match(i, goal, o)


def health_parts(i: Item) -> dict[str, Column]:
    """Protein density, fiber density, fat share and energy; items without energy have ratios of 0."""
    ratio = lambda x: F.when(i.kcal <= 0, d(0)).otherwise(F.try_divide(x, i.kcal))
    share = ratio(i.fat * d(9))
    return {
        "protein_part": half_up(F.greatest(d(0), upto(ratio(i.protein) * d(100) / d(8) * d(15), 15))),
        "fiber_part": half_up(F.greatest(d(0), upto(ratio(i.fiber) * d(100) / d(2) * d(10), 10))),
        "fat_part": F.when(share <= 0.25, d(5)).when(share <= 0.35, d(3)).when(share <= 0.45, d(1)).otherwise(d(0)),
        "energy_part": F.when(i.kcal <= 500, d(10)).when(i.kcal <= 650, d(8)).when(i.kcal <= 800, d(5)).when(i.kcal <= 950, d(2)).otherwise(d(0)),
    }


def health_total(i: Item) -> Column:
    """An item's health out of 40: the sum of its four parts."""
    p = health_parts(i)
    return p["protein_part"] + p["fiber_part"] + p["fat_part"] + p["energy_part"]


def item_reasons(i: Item, tags: Column, t: Targets, p: Profile) -> Column:
    """The first three reasons for an item."""
    goal, meal, b = value(p.goal), value(p.meal_type), t.budget
    gap = F.abs(i.kcal - b)
    tagged = lambda x: F.array_contains(tags, x)
    when = lambda c, s: F.when(c, F.lit(s))
    # The reasons' wording.
    found = F.array_compact(F.array(
        when(gap <= b * d(0.15), "Close to your meal calorie budget.").when(i.kcal < b, "Lower calorie option for this meal.").otherwise("Higher calorie option, better for flexible meals."),
        when((goal == "lose-fat") & (i.kcal <= b), "Good fit for fat loss."),
        when((goal == "lose-fat") & (i.fiber >= 8), "Good fiber content for fullness."),
        F.when(goal == "gain-muscle", when(i.protein >= 40, "Strong protein choice for muscle gain.").when(i.protein >= 30, "Decent protein amount.")),
        when((goal == "maintain") & (gap <= b * d(0.2)), "Balanced option for maintenance."),
        when((meal == "healthy") & tagged("Healthy"), "Matches your healthy meal preference."),
        when((meal == "healthy") & (i.fat <= 25), "Moderate fat level."),
        when((meal == "cheat") & tagged("Cheat Meal"), "Matches your cheat meal preference."),
        when(tagged("High Protein"), "Tagged as high protein."),
        when(tagged("Low Calorie"), "Tagged as low calorie."),
    ))
    return F.slice(found, 1, 3)
