"""Venues as text documents, and the texts of prompts and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators.features import first_rows

MENU_LINES = 8

# The wording of documents, prompts and answers.
CLOSING = (
    "Use this restaurant as evidence for fitness meal recommendation when it matches the user's nutrition goal, cuisine preference, "
    "calorie target, protein target, fiber target, and budget constraint."
)
DEFAULT_REASON = "This restaurant is recommended because it matches your nutrition request based on the retrieved evidence."
NOTHING_FOUND = "No suitable restaurant was retrieved. Explain that no reliable recommendation can be made."
PROMPT = """You are a fitness meal recommendation assistant.

The recommendation has already been selected by the retrieval system.
You must not choose another restaurant.
You must only explain why the selected restaurant matches the user's request.

User Request:
{query}

Selected Restaurant:
{restaurant_name}

Category:
{category}

Nutrition Summary:
Calories: {average_calories} kcal
Protein: {average_protein} g
Fiber: {average_fiber} g
Fitness Score: {fitness_score}

Evidence:
{evidence}

Answer only with one paragraph.

Do not repeat the restaurant name.
Do not recommend another restaurant.
Explain only why the selected restaurant matches the user's request.

Reason:"""


def filled(template: str, **columns: Column) -> Column:
    """A template with ``{name}`` places as one concatenation; null counts as empty."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


# The wording of a venue's document and of its lines.
DOCUMENT = "\n".join((
    "Restaurant name: {name}", "Restaurant ID: {id}", "Category: {category}", "Cuisine tags: {cuisine_tags}", "Price range: {price_range}", "Address: {full_address}",
    "Average calories: {average_calories} kcal", "Average protein: {average_protein} g", "Average fiber: {average_fiber} g", "Health score: {health_score}",
    "Fitness score: {fitness_score}", "Representative menu items:", "{menu_text}", CLOSING,
))
MENU_LINE = "- {name} ({category}): {estimated_calories} kcal, {estimated_protein}g protein, {estimated_fiber}g fiber, health level: {health_level}, tags: {tags}"


def venue_documents(features: DataFrame, menus: DataFrame, lines: int = MENU_LINES) -> DataFrame:
    """One document for each venue with items: its facts and its first items, cut to that many before any text is built."""
    first = first_rows(menus.where(F.coalesce("restaurant_id", F.lit("")) != ""), ["restaurant_id"], ["row_seq"], lines)
    line = filled(MENU_LINE, tags=text.json_list(F.col("tags")), **{c: F.col(c) for c in ("name", "category", "estimated_calories", "estimated_protein", "estimated_fiber", "health_level")})
    listed = first.groupBy(F.col("restaurant_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("row_seq", line.alias("line")))).alias("lines"))
    df = features.join(listed, "id").withColumns({"cuisine_tags": text.json_list(F.col("cuisine_tags")), "menu_text": F.array_join(F.transform("lines", lambda x: x["line"]), "\n")})
    facts = ("category", "cuisine_tags", "average_calories", "average_protein", "average_fiber", "health_score", "fitness_score")
    body = filled(DOCUMENT, **{c: F.col(c) for c in ("name", "id", "price_range", "full_address", "menu_text", *facts)})
    return df.select(
        "id", F.lit("restaurant_rag_document").alias("type"), F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"),
        *(F.col(c).cast("string").alias(c) for c in facts), F.size("lines").alias("menu_count_in_document"), body.alias("text"),
    )


def prompt(query: Column, found: dict[str, Column], evidence: Column) -> Column:
    """The prompt for the best result; the evidence's first 800 characters."""
    return filled(PROMPT, query=query, evidence=F.substring(text.blank_if_null(evidence), 1, 800), **found)


def safe_answer(found: dict[str, Column], raw: Column) -> Column:
    """Facts from the row, the reason from the model's text, or a default where that is short."""
    reason = text.strip(raw)
    reason = F.when(F.contains(reason, F.lit("Reason:")), text.text_after(reason, "Reason:")).otherwise(reason)
    marker = "Recommended Restaurant:"
    reason = F.when(F.contains(reason, F.lit(marker)), text.strip(text.before(reason, marker))).otherwise(reason)
    reason = F.when(F.length(reason) < 20, DEFAULT_REASON).otherwise(reason)
    # Fixed value: the answer's wording.
    body = "Recommended Restaurant:\n{restaurant_name}\n\nNutrition Summary:\n{average_calories} kcal\n{average_protein} g protein\n{average_fiber} g fiber\n\nRecommended Reason:\n{reason}"
    return filled(body, reason=reason, **{k: found[k] for k in ("restaurant_name", "average_calories", "average_protein", "average_fiber")})


def clean_response(raw: Column) -> Column:
    return text.drop_prefixes(raw, ("<|assistant|>", "</s>", "<s>"))


def messages(system: Column, user: Column) -> Column:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", system), turn("user", user))
