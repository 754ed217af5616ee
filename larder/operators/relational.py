"""The joins of the relational store as SQL text with named parameters, over tables given by name.

Tables are bound for one statement, so no view is left in the session, and values
are bound as parameters, so no text is pasted into a statement.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

#: Items with their venue, in the order and under the names of a training candidate.
ITEMS = """
SELECT v.id AS restaurant_id, v.name AS restaurant_name, v.category AS restaurant_category, v.health_score, v.fitness_score,
  m.id AS menu_id, m.name AS menu_name, m.category AS menu_category, m.estimated_calories, m.estimated_protein, m.estimated_fiber, m.health_level, m.tags
FROM {menus} m JOIN {venues} v ON v.id = m.restaurant_id
WHERE m.name IS NOT NULL AND v.name IS NOT NULL AND m.estimated_calories IS NOT NULL AND m.estimated_protein IS NOT NULL AND m.estimated_fiber IS NOT NULL
"""

#: The keys of n such items, in an order that the seed and the keys alone decide.
CHOSEN = """
SELECT m.id, m.restaurant_id FROM {menus} m LEFT SEMI JOIN (SELECT id FROM {venues} WHERE name IS NOT NULL) v ON v.id = m.restaurant_id
WHERE m.name IS NOT NULL AND m.estimated_calories IS NOT NULL AND m.estimated_protein IS NOT NULL AND m.estimated_fiber IS NOT NULL
ORDER BY md5(concat_ws('|', cast(:seed AS string), m.id)), m.id LIMIT :n
"""

VENUE = "SELECT * FROM {venues} WHERE id = :id LIMIT 1"
ITEMS_OF = "SELECT * FROM {menus} WHERE restaurant_id = :id"
NUTRITIOUS = ITEMS + " AND m.estimated_calories <= :kcal AND m.estimated_protein >= :protein ORDER BY m.estimated_protein DESC, m.estimated_fiber DESC, m.estimated_calories, m.id LIMIT :n"


def select(text: str, tables: dict[str, DataFrame], **values: Any) -> DataFrame:
    """The statement's rows; ``{name}`` in the text is a table and ``:name`` a value."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(text, args=values, **tables)


def sampled_candidates(menus: DataFrame, venues: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n items of the join, picked at random but repeatably.

    The choice needs two keys of an item, so it is made on those: every task keeps
    its n first by hash, and wide columns are read for the n chosen alone.  n rows
    pass one task, as in any limit.
    """
    chosen = select(CHOSEN, {"menus": menus, "venues": venues}, seed=seed, n=n)
    few = menus.join(chosen, ["id", "restaurant_id"], "left_semi")
    return select(ITEMS, {"menus": few, "venues": venues})
