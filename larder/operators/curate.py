"""Training samples: candidates, goal expansion, constraint labels, texts and the quality filter."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import rules, text
from larder.operators.documents import filled
from larder.sources import tables
from larder.sources.tables import staged

# Requests for each goal.
TEMPLATES = {
    "fat_loss": ("I want a lower-calorie {cuisine} meal that supports fat loss.", "Recommend a {cuisine} meal for fat loss with reasonable calories.", "I need a fitness-friendly {cuisine} meal that is not too heavy."),
    "muscle_gain": ("I want a high-protein {cuisine} meal for muscle gain.", "Recommend a {cuisine} meal that supports strength training.", "I need a protein-focused {cuisine} meal after a workout."),
    "maintenance": ("I want a {cuisine} meal for daily fitness maintenance.", "Recommend a {cuisine} meal for regular fitness maintenance.", "I need an everyday {cuisine} meal that supports my fitness routine."),
    "high_fiber": ("I want a high-fiber {cuisine} meal for better nutrition.", "Recommend a {cuisine} meal with good fiber content.", "I need a {cuisine} meal that includes meaningful fiber."),
    "high_protein": ("I want a high-protein {cuisine} meal under 600 calories.", "Recommend a protein-rich {cuisine} meal.", "I need a {cuisine} meal with strong protein content."),
    "healthy_eating": ("I want a healthy {cuisine} meal recommendation.", "Recommend a nutrition-conscious {cuisine} meal.", "I need a nutritious {cuisine} meal option."),
    "post_workout": ("I want a post-workout {cuisine} meal.", "Recommend a {cuisine} meal after training.", "I need a recovery-friendly {cuisine} meal."),
    "low_calorie": ("I want a low-calorie {cuisine} meal.", "Recommend a lighter {cuisine} meal option.", "I need a {cuisine} meal that is not too high in calories."),
}

# What each constraint says.
SAID = {
    "under_yes": "The requested calorie limit under 600 kcal is satisfied.",
    "under_no": "The requested calorie limit under 600 kcal is not satisfied because the menu has {kcal} kcal.",
    "low_yes": "The lower-calorie preference is satisfied.",
    "low_part": "The calorie level is moderate, but it is not clearly low-calorie.",
    "low_no": "The lower-calorie preference is not satisfied because the calorie level is high.",
    "protein_yes": "The protein requirement is strongly satisfied.",
    "protein_part": "The protein content is meaningful, but it is not very high.",
    "protein_no": "The high-protein requirement is not fully satisfied.",
    "fiber_yes": "The high-fiber requirement is satisfied.",
    "fiber_part": "The fiber content is moderate, but it is not clearly high-fiber.",
    "fiber_no": "The high-fiber requirement is not satisfied.",
    "healthy_yes": "The healthy-eating request is supported by the provided health level or tags.",
    "healthy_part": "The request asks for healthy eating, but the evidence does not explicitly label this menu as healthy.",
    "keep_yes": "The maintenance goal is reasonably supported by moderate calories and protein.",
    "keep_part": "The maintenance goal is only partially supported by the available nutrition evidence.",
    "sweet": "The menu appears to be dessert-like or sweet, so its fitness value should not be overstated unless the evidence strongly supports it.",
}
# The wording of instructions, samples, prompts and chats.
INSTRUCTION = "Recommend a fitness meal based on the user's nutrition request."
STRUCTURED = "Goal:\n{goal}\n\nCuisine:\n{cuisine}\n\nCalories:\n{kcal} kcal\n\nProtein:\n{protein} g\n\nFiber:\n{fiber} g\n\nUser Request:\n{request}"
SIMPLE = (
    "Recommended Restaurant:\n{restaurant_name}\n\nRecommended Menu:\n{menu_name}\n\nNutrition Summary:\n{kcal} kcal, {protein}g protein, {fiber}g fiber\n\nRecommended Reason:\n"
    "{restaurant_name} is recommended because {menu_name} is a {level} option with {protein}g protein, {fiber}g fiber, and {kcal} kcal. This makes it suitable for a fitness-oriented meal recommendation."
)
SAMPLE = (
    "Recommended Restaurant:\n{restaurant_name}\n\nRecommended Menu:\n{menu_name}\n\nNutrition Summary:\nCalories:\n{kcal} kcal\n\nProtein:\n{protein} g\n\n"
    "Fiber:\n{fiber} g\n\nRecommended Reason:\n{explanation}"
)
TEACHER = (
    "User Request\n\n{structured_input}\n\nRetrieved Restaurant\n\n{restaurant_name}\n\nRestaurant Category\n\n{restaurant_category}\n\nRetrieved Menu\n\n{menu_name}\n\n"
    "Menu Category\n\n{menu_category}\n\nNutrition Evidence\n\nCalories:\n{kcal} kcal\n\nProtein:\n{protein} g\n\nFiber:\n{fiber} g\n\nHealth Level:\n{level}\n\nTags:\n{tags}\n\n"
    "Constraint Evaluation\n\n{report}\n\nTeacher Task\n\nExplain the retrieved recommendation.\n\nYou MUST follow the supplied constraint evaluation.\n\n"
    "You MUST NOT change the overall match.\n\nYou MUST explain:\n\n1. Which constraints are satisfied.\n\n2. Which constraints are only partially satisfied.\n\n"
    "3. Which constraints are violated.\n\n4. Why the recommendation is still selected.\n\nNever recommend another restaurant.\n\nNever recommend another menu.\n\n"
    "Never modify nutrition facts.\n\nNever infer information that is not explicitly supported.\n\nOutput explanation only."
)
CHAT = (
    "<|system|>\nYou are a fitness meal recommendation assistant. You generate evidence-based restaurant and menu explanations.\n</s>\n"
    "<|user|>\nInstruction:\n{instruction}\n\nUser Request:\n{input}\n</s>\n<|assistant|>\n{output}\n</s>"
)

K, P, FI = "estimated_calories", "estimated_protein", "estimated_fiber"


def candidates(menus: DataFrame, venues: DataFrame, most: int = 100, kcal: int = 700, protein: int = 18) -> DataFrame:
    """Nutritious items with their venue: richest first, ties by item id."""
    item = menus.where((F.col(K) <= kcal) & (F.col(P) >= protein) & F.col("name").isNotNull()).select(
        F.col("id").alias("menu_id"), "restaurant_id", F.col("name").alias("menu_name"), F.col("category").alias("menu_category"), K, P, FI, "health_level", "tags")
    venue = venues.where("name is not null").select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"), F.col("category").alias("restaurant_category"))
    return item.join(venue, "restaurant_id").orderBy(F.desc(P), F.desc(FI), K, "menu_id").limit(most)


def seeded_order(*keys: str, seed: int) -> Column:
    """A repeatable shuffle key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sampled(rows: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """n rows in a shuffled order that depends on the seed and the keys alone."""
    return rows.orderBy(seeded_order(*keys, seed=seed), *keys).limit(n)


def simple_request(category: Column, kcal: Column, protein: Column, fiber: Column, tags: Column) -> Column:
    meal = lambda a, b: F.concat(F.lit(f"I want a {a} "), category, F.lit(f" meal{b}"))
    return (
        F.when((protein >= 35) & (kcal <= 600), meal("high-protein", " under 600 calories.")).when((fiber >= 8) & (kcal <= 600), meal("high-fiber healthy", " under 600 calories."))
        .when(kcal <= 500, meal("low-calorie", " under 500 calories.")).when(F.contains(F.lower(tags), F.lit("vegetarian")), meal("vegetarian", " with good nutrition."))
        .otherwise(meal("fitness-friendly", " recommendation."))
    )


def facts(level: str = "health_level") -> dict[str, Column]:
    """An item's columns under the names that the texts use."""
    c = F.col
    return {"restaurant_name": c("restaurant_name"), "menu_name": c("menu_name"), "level": c(level), "kcal": text.whole(c(K)), "protein": text.whole(c(P)), "fiber": text.whole(c(FI))}


def simple_samples(items: DataFrame) -> DataFrame:
    request = simple_request(F.col("restaurant_category"), F.col(K), F.col(P), F.col(FI), text.json_list(F.col("tags")))
    return items.select("menu_id", F.lit(INSTRUCTION).alias("instruction"), request.alias("input"), filled(SIMPLE, **facts()).alias("output"))


def expanded(items: DataFrame) -> DataFrame:
    """Every item with each of its goals and that goal's requests; templates are literals of fixed size."""
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in TEMPLATES.items() for x in kv))
    df = items.withColumns({"cuisine": text.clean_cuisine(F.col("restaurant_category")), "tags_text": text.json_list(F.col("tags"))})
    df = df.withColumn("goal", F.explode(rules.goals(F.col(K), F.col(P), F.col(FI), F.col("health_level"), F.col("tags_text"))))
    df = df.select("*", F.posexplode(known[F.col("goal")]).alias("template", "t")).withColumn("user_request", F.replace("t", F.lit("{cuisine}"), F.col("cuisine"))).drop("t")
    structured = filled(STRUCTURED, goal=F.col("goal"), cuisine=F.col("cuisine"), request=F.col("user_request"), **{k: v for k, v in facts().items() if k in ("kcal", "protein", "fiber")})
    return df.withColumns({"constraint": F.col("goal"), "structured_input": structured})


def chosen_requests(requests: DataFrame, each: int = 5, seed: int = 42) -> DataFrame:
    """A seeded choice of requests for each item, without repeated inputs."""
    order, n = [F.col("goal"), F.col("template")], F.row_number()
    # an item's requests meet once, by windows: these carry the columns that are asked for and no others, and inputs as 128 bits
    rows = requests.withColumn("_same", F.unhex(F.md5("structured_input"))).repartition("menu_id")
    firsts = rows.withColumn("_n", n.over(Window.partitionBy("menu_id", "restaurant_id", "_same").orderBy(*order))).where("_n = 1")
    shuffled = seeded_order("menu_id", "goal", "template", seed=seed)
    return firsts.withColumn("_n", n.over(Window.partitionBy("menu_id").orderBy(shuffled))).where(F.col("_n") <= each).drop("_n", "_same")


def dessert_like(name: Column, category: Column, tags: Column) -> Column:
    return rules.any_word(F.lower(name), rules.SWEETS) | rules.any_word(F.lower(category), rules.SWEETS) | rules.any_word(F.lower(tags), rules.SWEETS)


def evaluated(requests: DataFrame) -> DataFrame:
    """Adds satisfied, partial, violated, limitations and overall_match; ``tags_text`` is the item's tags as :func:`expanded` gives them."""
    k, p, f, goal = F.col(K), F.col(P), F.col(FI), F.col("goal")
    tags = F.col("tags_text") if "tags_text" in requests.columns else text.json_list(F.col("tags"))
    under, low = F.contains(F.lower("user_request"), F.lit("under 600")), goal.isin("fat_loss", "low_calorie")
    strong, fibrous, healthy, keep = goal.isin("high_protein", "muscle_gain", "post_workout"), goal == "high_fiber", goal == "healthy_eating", goal == "maintenance"
    well = (F.col("health_level") == "healthy") | F.contains(tags, F.lit("healthy")) | F.contains(tags, F.lit("fitness_friendly"))
    good = (k <= 700) & (p >= 15)
    say = lambda c, key: F.when(c, F.lit(SAID[key]))
    df = requests.withColumns({
        "satisfied": rules.texts(say(under & (k <= 600), "under_yes"), say(low & (k <= 550), "low_yes"), say(strong & (p >= 35), "protein_yes"), say(fibrous & (f >= 8), "fiber_yes"), say(healthy & well, "healthy_yes"), say(keep & good, "keep_yes")),
        "partial": rules.texts(say(low & (k > 550) & (k <= 700), "low_part"), say(strong & (p < 35) & (p >= 25), "protein_part"), say(fibrous & (f < 8) & (f >= 5), "fiber_part"), say(healthy & ~well, "healthy_part"), say(keep & ~good, "keep_part")),
        "violated": rules.texts(F.when(under & (k > 600), filled(SAID["under_no"], kcal=text.whole(k))), say(low & (k > 700), "low_no"), say(strong & (p < 25), "protein_no"), say(fibrous & (f < 5), "fiber_no")),
        "limitations": rules.texts(say(dessert_like(F.col("menu_name"), F.col("menu_category"), tags), "sweet")),
    })
    clean = (F.size("violated") == 0) & (F.size("partial") == 0)
    return df.withColumn("overall_match", F.when(clean, "Full Match").when(F.size("satisfied") > 0, "Partial Match").otherwise("Weak Match"))


def report() -> Column:
    """The constraint report of an evaluated row."""
    def part(title: str, c: str, none: str) -> Column:
        lines = F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
        return F.concat(F.lit(f"\n\n{title}:\n"), F.when(F.size(c) == 0, none).otherwise(lines))

    return F.concat(
        F.lit("Overall Match:\n"), F.col("overall_match"), part("Satisfied Constraints", "satisfied", "- None explicitly satisfied."),
        part("Partially Satisfied Constraints", "partial", "- None."), part("Violated Constraints", "violated", "- None."), part("Limitations", "limitations", "- None."),
    )


def teacher_prompt() -> Column:
    more = {"structured_input": F.col("structured_input"), "restaurant_category": text.strip(F.col("restaurant_category")), "menu_category": text.strip(F.col("menu_category")), "tags": text.json_list(F.col("tags")), "report": report()}
    return filled(TEACHER, **facts(), **more)


def samples(rows: DataFrame, explanation: Column, model: str = "stand-in", version: str = "1") -> DataFrame:
    """Instruction, input, output and metadata of evaluated rows with an explanation."""
    c = F.col
    meta = F.struct(
        "restaurant_id", c("restaurant_name").alias("restaurant"), "restaurant_category", "menu_id", c("menu_name").alias("menu"), "menu_category", "goal", "constraint", "overall_match",
        c("satisfied").alias("satisfied_constraints"), c("partial").alias("partial_constraints"), c("violated").alias("violated_constraints"), "limitations",
        F.lit(model).alias("teacher_model"), F.lit(version).alias("dataset_version"), *(c(x).cast("double").alias(x) for x in (K, P, FI)), "health_level", text.json_list(c("tags")).alias("tags"),
    )
    return rows.select(F.lit(INSTRUCTION).alias("instruction"), c("structured_input").alias("input"), filled(SAMPLE, explanation=explanation, **facts()).alias("output"), meta.alias("metadata"))


def valid_sample(restaurant: Column, menu: Column, output: Column) -> Column:
    """Both names are given and stand in the output, and it has a reason."""
    return (restaurant != "") & (menu != "") & F.contains(output, restaurant) & F.contains(output, menu) & F.contains(output, F.lit("Recommended Reason:"))


def validated(rows: DataFrame, explanation: Column) -> DataFrame:
    """Adds ``output`` and ``valid`` to evaluated rows; a null explanation is a failed generation."""
    out = filled(SAMPLE, explanation=explanation, **facts())
    good = explanation.isNotNull() & valid_sample(F.col("restaurant_name"), F.col("menu_name"), out)
    return rows.withColumns({"output": out, "valid": F.coalesce(good, F.lit(False))})


def generated(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` valid rows of a validated table; ``order`` is ascending and tells all rows apart."""
    return rows.where("valid").orderBy(*order).limit(most)


def generation_report(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """One row: valid samples taken, and failures met before the last of them (all of them where fewer than ``most`` are valid)."""
    taken = generated(rows, most, *order).agg(F.count("*").alias("_taken"), F.max(F.struct(*order)).alias("_last"))
    met = ~F.col("valid") & ((F.col("_taken") < most) | (F.struct(*order) < F.col("_last")))
    return rows.select("valid", *order).join(F.broadcast(taken)).agg(F.coalesce(F.max("_taken"), F.lit(0)).alias("generated_samples"), F.count_if(met).alias("failed_samples"))


def judged(rows: DataFrame, least: int = 50, most: int = 1200) -> DataFrame:
    """Adds restaurant, menu, reason and reject_reason (null: passes) to rows with ``output`` and ``row_seq``.

    Repeats are looked for only among rows that pass everything else.
    """
    out = F.col("output")
    df = rows.withColumns({"restaurant": text.line_after(out, "Recommended Restaurant:"), "menu": text.line_after(out, "Recommended Menu:"), "reason": F.coalesce(text.text_after(out, "Recommended Reason:"), F.lit(""))})
    fault = (
        F.when(F.col("restaurant") == "", "missing_restaurant").when(F.col("menu") == "", "missing_menu").when(F.col("reason") == "", "missing_reason")
        .when(~F.length("reason").between(least, most), "invalid_reason_length")
    )
    df = df.withColumn("reject_reason", fault)
    # repeats are grouped by 128 bits, so texts stay out of the shuffle; lengths keep the parts apart
    same = F.unhex(F.md5(F.concat_ws("|", F.length("restaurant"), F.length("menu"), "restaurant", "menu", "reason")))
    firsts = df.where("reject_reason is null").groupBy(same.alias("_same")).agg(F.min("row_seq").alias("_first")).select("_first")
    df = df.join(firsts, F.col("row_seq") == F.col("_first"), "left")
    again = F.col("reject_reason").isNull() & F.col("_first").isNull()
    return df.withColumn("reject_reason", F.when(again, "duplicate").otherwise(F.col("reject_reason"))).drop("_first")


FAULTS = ("missing_restaurant", "missing_menu", "missing_reason", "invalid_reason_length", "duplicate")


def filter_counters() -> dict[str, Column]:
    """Counters of a judged table."""
    kinds = {r: F.count_if(F.col("reject_reason") == r) for r in FAULTS}
    return {"total_samples": F.count("*"), "valid_samples": F.count_if(F.col("reject_reason").isNull()), **kinds}


def filter_report(rows: DataFrame) -> DataFrame:
    """One row of counters of a judged table."""
    return rows.agg(*(c.alias(n) for n, c in filter_counters().items()))


def write_filtered(rows: DataFrame, samples: str, report: str, invalid_json: int = 0) -> dict:
    """Writes the rows that pass as a line file and the report of all rows, counted by the job that writes.

    The rows are judged once: they are staged, as a job that is tried again counts
    again from the same rows.  ``invalid_json`` is the reader's count of bad lines.
    """
    kept = staged(judged(rows), "judged")
    names = [c for c in rows.columns if c != "row_seq"]
    n = tables.write_observed(kept, filter_counters(), lambda df: tables.write_jsonl(df.where("reject_reason is null").select(*names), samples))
    total, valid = n["total_samples"], n["valid_samples"]
    told = {"total_samples": total, "valid_samples": valid, "invalid_samples": total - valid, "duplicate_samples": n["duplicate"], "details": {"invalid_json": invalid_json} | {r: n[r] for r in FAULTS}}
    tables.write_report(rows.sparkSession, report, told)
    return told


def chat_text(instruction: Column, user: Column, output: Column) -> Column:
    return filled(CHAT, instruction=instruction, input=user, output=output)


@cache
def tokenizer(path: str):
    """A worker's tokenizer, read once."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenised(rows: DataFrame, column: str, length: int, tokenizer_path: str) -> DataFrame:
    """Adds input_ids, attention_mask and labels (-100 where padded), cut and padded to ``length``."""
    @F.pandas_udf("struct<input_ids: array<int>, attention_mask: array<int>, labels: array<int>>")
    def encode(texts: pd.Series) -> pd.DataFrame:
        ids = [e.ids[:length] for e in tokenizer(tokenizer_path).encode_batch(texts.fillna("").tolist(), add_special_tokens=False)]
        pad = lambda xs, v: xs + [v] * (length - len(xs))
        return pd.DataFrame({"input_ids": [pad(x, 0) for x in ids], "attention_mask": [pad([1] * len(x), 0) for x in ids], "labels": [pad(x, -100) for x in ids]})

    return rows.withColumn("_e", encode(column)).select("*", "_e.*").drop("_e")
