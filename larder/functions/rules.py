"""Keyword rules as data, and their compiler to one Column.

A keyword counts wherever it stands inside the lowered text, within words too.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[object, tuple[str, ...]]


# Cuisine tags and their keywords, first rule set and second.
CUISINES = {
    1: (
        ("sushi", ("sushi", "japanese", "poke")), ("burger", ("burger", "burgers")), ("pizza", ("pizza",)), ("chinese", ("chinese", "dim sum", "noodle")),
        ("mexican", ("mexican", "taco", "burrito")), ("indian", ("indian", "curry")), ("thai", ("thai",)), ("korean", ("korean", "bbq")),
        ("coffee", ("coffee", "tea", "smoothie")), ("salad", ("salad", "healthy", "bowl")), ("sandwich", ("sandwich", "subs", "deli")),
        ("breakfast", ("breakfast", "brunch")), ("dessert", ("dessert", "ice cream", "bakery", "cake")), ("seafood", ("seafood", "fish", "shrimp")),
        ("chicken", ("chicken", "wings")), ("vegetarian", ("vegetarian", "vegan")),
    ),
    2: (
        ("sushi", ("sushi", "japanese", "poke")), ("burger", ("burger",)), ("pizza", ("pizza",)), ("chinese", ("chinese", "dim sum", "noodle")),
        ("mexican", ("mexican", "taco", "burrito")), ("indian", ("indian",)), ("thai", ("thai",)), ("korean", ("korean",)),
        ("coffee", ("coffee", "tea", "cafe")), ("salad", ("salad", "healthy", "bowl")), ("breakfast", ("breakfast", "brunch")),
        ("dessert", ("dessert", "cake", "ice cream")), ("seafood", ("seafood", "fish", "shrimp")), ("vegetarian", ("vegetarian", "vegan")),
    ),
}

# Estimates by the first rule that matches, and their defaults.
CALORIES = {
    1: ((
        (350, ("salad", "soup", "smoothie", "tea")), (520, ("sushi", "poke", "bowl")), (650, ("sandwich", "wrap", "sub")), (680, ("chicken", "grilled")),
        (900, ("burger", "fries")), (850, ("pizza",)), (700, ("dessert", "cake", "ice cream")), (750, ("breakfast", "pancake", "waffle")),
        (780, ("burrito", "taco", "nachos")), (760, ("curry", "rice", "noodle")),
    ), 650),
    2: ((
        (350, ("salad", "smoothie", "soup")), (520, ("sushi", "poke")), (650, ("sandwich", "wrap")), (900, ("burger",)), (850, ("pizza",)),
        (700, ("dessert", "cake", "ice cream")), (750, ("breakfast", "waffle", "pancake")), (780, ("taco", "burrito")), (760, ("rice", "noodle", "curry")),
    ), 650),
}
PROTEIN = {
    1: ((
        (38, ("chicken", "beef", "steak", "salmon", "tuna", "fish", "shrimp")), (28, ("burger", "burrito", "bowl", "sandwich", "wrap")),
        (24, ("salad", "sushi", "poke")), (20, ("pizza", "pasta", "noodle", "rice")), (8, ("dessert", "cake", "ice cream", "drink", "tea")),
    ), 18),
    2: (((38, ("chicken", "beef", "steak", "salmon", "tuna", "fish")), (28, ("burger", "sandwich", "burrito")), (24, ("salad", "sushi", "poke")), (20, ("pizza", "rice", "noodle"))), 15),
}
FIBER = {
    1: (((9, ("salad", "vegetable", "vegan", "vegetarian", "bean")), (7, ("bowl", "wrap", "burrito")), (4, ("sandwich", "rice", "noodle")), (2, ("burger", "pizza", "dessert"))), 3),
    2: (((9, ("salad", "vegetable", "vegan", "bean")), (7, ("bowl", "wrap", "burrito")), (4, ("sandwich", "rice", "noodle"))), 2),
}

# One cuisine label for a place.
PLACE_CUISINES = (
    ("Japanese", ("sushi", "japanese", "ramen")), ("Indian", ("indian", "curry", "tandoori", "biryani")), ("Burger", ("burger", "grill", "five guys")),
    ("Healthy", ("healthy", "salad", "bowl", "protein")), ("Chinese", ("chinese", "noodle", "dumpling", "hotpot")), ("Korean", ("korean", "bbq", "kimchi")),
    ("Italian", ("pizza", "pasta", "italian")), ("Mexican", ("mexican", "taco", "burrito")),
)

# Words that stand for a favourite cuisine.
ALIASES = {
    "healthy": ("healthy", "salad", "bowl", "fitness", "low fat"), "sushi": ("sushi", "japanese", "roll", "sashimi", "nigiri"),
    "burger": ("burger", "beef burger", "chicken burger", "fast food"), "indian": ("indian", "curry", "tandoori", "biryani", "north indian", "south indian", "masala"),
    "chinese": ("chinese", "noodle", "dumpling", "rice bowl", "hotpot", "sichuan", "cantonese"), "korean": ("korean", "bibimbap", "kimchi", "bbq", "bulgogi"),
    "italian": ("italian", "pizza", "pasta", "risotto"), "mexican": ("mexican", "taco", "burrito", "quesadilla"),
}

# Signs of a dessert.
SWEETS = ("dessert", "cake", "cupcake", "sundae", "ice cream", "milkshake", "brownie", "baklava", "cookie", "soda", "sweet", "cheesecake", "shake")


def any_word(text: Column | Marks, keywords: Sequence[str]) -> Column:
    if isinstance(text, Marks):
        return text.any(keywords)
    return reduce(or_, (F.contains(text, F.lit(k)) for k in keywords))


class Marks:
    """A text's keywords as bits of one long column, so that each is looked for once however many rules name it."""

    def __init__(self, column: Column, keywords: Sequence[str]):
        self.column, self.bit = column, {k: 1 << n for n, k in enumerate(keywords)}

    @staticmethod
    def of(text: Column, keywords: Sequence[str]) -> Column:
        """The column to make of a text."""
        if len(keywords) > 63:
            raise ValueError("a long has room for 63 keywords")
        return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.contains(text, F.lit(k)).cast("long"), n) for n, k in enumerate(keywords)))

    def any(self, keywords: Sequence[str]) -> Column:
        return self.column.bitwiseAND(F.lit(sum(self.bit[k] for k in set(keywords))).cast("long")) != F.lit(0).cast("long")


def estimate_words(version: int) -> list[str]:
    """The keywords of the three estimates."""
    return sorted({k for what in (CALORIES, PROTEIN, FIBER) for _, ks in what[version][0] for k in ks})


def cuisine_words(version: int) -> list[str]:
    return sorted({k for _, ks in CUISINES[version] for k in ks})


def first_match(text: Column | Marks, rules: Sequence[Rule], default) -> Column:
    """The value of the first rule with a keyword in the text."""
    return F.coalesce(*(F.when(any_word(text, ks), F.lit(v)) for v, ks in rules), F.lit(default))


def tag_list(tags: Sequence[tuple[str, Column]]) -> Column:
    """The tags whose condition holds, sorted by name; at least one always holds.

    The order is settled when the plan is built, and joining and splitting names
    stays in generated code, which array functions do not.
    """
    return F.split(F.concat_ws(",", *(F.when(c, F.lit(t)) for t, c in sorted(tags, key=lambda x: x[0]))), ",")


def texts(*items: Column) -> Column:
    """Like :func:`present` for texts that are neither empty nor hold the unit separator."""
    joined_up = F.concat_ws("\x1f", *items)
    return F.when(joined_up == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(joined_up, "\x1f"))


def present(*items: Column) -> Column:
    """The items that are not null, in order."""
    return F.array_compact(F.array(*items))


def joined(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def cuisines(low: Column | Marks, version: int = 1) -> list[tuple[str, Column]]:
    """Each cuisine tag with its condition on a lowered text; a general one where no other holds."""
    known = [(tag, any_word(low, ks)) for tag, ks in CUISINES[version]]
    return [*known, ("general", ~any_word(low, cuisine_words(version)))]


def cuisine_tags(category: Column, name: Column, version: int = 1) -> Column:
    return cuisine_tags_of(joined(category, name), version)


def cuisine_tags_of(low: Column | Marks, version: int = 1) -> Column:
    return tag_list(cuisines(low, version))


def estimate(what: dict, name: Column, description: Column, category: Column, version: int = 1) -> Column:
    return estimate_of(what, joined(name, description, category), version)


def estimate_of(what: dict, low: Column | Marks, version: int = 1) -> Column:
    rules, default = what[version]
    return first_match(low, rules, default)


def menu_tags(kcal: Column, protein: Column, fiber: Column, low: Column | Marks, version: int = 1) -> Column:
    """Nutrition tags with the cuisine tags of a lowered text, sorted and distinct."""
    own = [
        ("low_calorie", kcal <= 500), ("high_calorie", kcal >= 800), ("high_protein", protein >= 30), ("high_fiber", fiber >= 7),
        ("fitness_friendly", (kcal <= 600) & (protein >= 25)), ("cheat_meal", kcal >= (800 if version == 1 else 850)),
    ]
    return tag_list([*own, *cuisines(low, version)])


def health_level(kcal: Column, protein: Column, fiber: Column, version: int = 1) -> Column:
    fibrous = (fiber >= 7) & (kcal <= 700) if version == 1 else fiber >= 7
    return F.when((kcal <= 600) & (protein >= 25), "healthy").when(kcal >= 850, "cheat").when(fibrous, "healthy").otherwise("normal")


def item_scores(kcal: Column, protein: Column, fiber: Column) -> dict[str, Column]:
    """The second rule set's scores of one item."""
    health = F.least(
        F.lit(100),
        F.when(kcal <= 600, 40).when(kcal <= 750, 25).otherwise(0) + F.when(protein >= 30, 35).when(protein >= 20, 20).otherwise(0) + F.when(fiber >= 7, 25).when(fiber >= 4, 15).otherwise(0),
    )
    cheat = F.when(kcal >= 900, 100).when(kcal >= 800, 80).when(kcal >= 700, 50).otherwise(10)
    fitness = F.greatest(F.lit(0), F.least(F.lit(100), health - (cheat * F.lit(0.25)).cast("int") + 20))
    return {"item_health": health, "item_cheat": cheat, "item_fitness": fitness}


def goals(kcal: Column, protein: Column, fiber: Column, level: Column, tags: Column) -> Column:
    """Goals that an item serves, in fixed order."""
    healthy = (level == "healthy") | F.contains(tags, F.lit("healthy"))
    return texts(
        F.when(protein >= 25, "high_protein"), F.when(protein >= 30, "muscle_gain"), F.when(kcal <= 550, "fat_loss"), F.when(kcal <= 550, "low_calorie"),
        F.when(fiber >= 6, "high_fiber"), F.when(healthy, "healthy_eating"), F.when((protein >= 20) & (kcal <= 700), "post_workout"), F.lit("maintenance"),
    )


def place_cuisine(text: Column) -> Column:
    return first_match(F.lower(text), PLACE_CUISINES, "General")


def cuisine_matches(favourites: Sequence[str] | Column, *fields: Column) -> Column:
    """Whether a word for any favourite stands in the joined fields; no favourites, or null ones, match nothing."""
    if isinstance(favourites, Column):
        low, text = F.transform(favourites, lambda f: F.lower(F.trim(f))), joined(*fields)
        listed = reduce(or_, (F.array_contains(low, name) & any_word(text, words) for name, words in ALIASES.items()))
        return F.coalesce(listed, F.lit(False)) | F.coalesce(F.exists(low, lambda f: ~f.isin(*ALIASES) & F.contains(text, f)), F.lit(False))
    known = [w for f in favourites for w in ALIASES.get(f.strip().lower(), (f.strip().lower(),))]
    return any_word(joined(*fields), known) if known else F.lit(False)
