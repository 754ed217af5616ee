"""Registered queries: each applies one operator to a view of the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import nutrition, rules, text
from larder.operators import curate, documents, features, models, places, ranking, relational, state, vectors
from larder.plans import standins, views
from larder.plans.views import table
from larder.session import compiled
from larder.sources import catalog, tables
from larder.streaming import stores, users

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def tags(c: str):
    return F.array_join(c, ",").alias(c)


@query
def restaurant_features(spark, sf):
    """The flagship: venues by fitness score with all features."""
    df = features.venue_features(views.venues(spark, sf), views.capped(spark, sf))
    return df.select("id", "name", "category", "score", "ratings", "menu_count", "average_calories", "average_protein", "average_fiber", "health_score", "cheat_score", "fitness_score", tags("cuisine_tags"))


@query
def feature_summary(spark, sf):
    menus = views.capped(spark, sf)
    return features.summary(features.venue_features(views.venues(spark, sf), menus), menus)


@query
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_text(F.concat(F.lit(" &amp;amp; "), "text", F.lit("   x "))).alias("cleaned"))


@query
def parse_numbers(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("$12.99", "£18", "$$", "1,299", "-5", "", "abc", "12.7", "nan", "1.5d", "1_000", " 7 "))), (F.col("o_orderkey") % 12).cast("int") + 1)
    df = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"), views.money("o_totalprice").alias("price"))
    zero = F.nanvl(text.parse_float(F.col("raw")), F.lit(-1.0))
    return df.select("o_orderkey", zero.alias("as_float"), text.parse_int(F.col("raw")).alias("as_int"), text.parse_price(F.col("raw")).alias("as_price"), text.parse_float(F.col("price")).alias("total"), text.is_empty(F.col("raw")).alias("empty"))


@query
def normalize_category(spark, sf):
    raw = F.concat_ws(",", "p_brand", F.lit("  "), F.when(F.col("p_size") % 3 == 0, F.col("p_type")))
    raw = F.when(F.col("p_size") % 7 == 0, F.lit(" , ")).when(F.col("p_size") % 11 == 0, F.lit("")).otherwise(raw)
    return table(spark, sf, "part").select("p_partkey", text.normalize_category(raw).alias("category"), text.clean_cuisine(raw).alias("cuisine"))


def estimates(spark, sf, version: int):
    m = features.enriched(views.raw_menus(compiled(spark), sf).withColumn("name", F.trim("name")), version, cuisines=True)
    own = rules.item_scores(F.col("estimated_calories"), F.col("estimated_protein"), F.col("estimated_fiber"))
    return m.select("row_seq", "estimated_calories", "estimated_protein", "estimated_fiber", "health_level", tags("tags"), tags("cuisine_tags"), *(c.alias(n) for n, c in own.items()))


@query
def menu_estimates_v1(spark, sf):
    return estimates(spark, sf, 1)


@query
def menu_estimates_v2(spark, sf):
    return estimates(spark, sf, 2)


@query
def document_cuisine_tags(spark, sf):
    low = table(spark, sf, "documents").select("doc_id", rules.joined(F.col("source"), F.col("text")).alias("low"))
    return low.select("doc_id", F.array_join(rules.cuisine_tags_of(F.col("low")), ",").alias("cuisine_tags"))


@query
def clean_menus(spark, sf):
    """Known venues, named items, first 30 of each, sequence ids."""
    df = features.clean_menus(views.raw_menus(spark, sf), views.venues(spark, sf))
    return df.select("id", "restaurant_id", "row_seq", "category", "name", "description", "price", "estimated_calories", "health_level", text.json_list(F.col("tags")).alias("tags"))


@query
def clean_venues(spark, sf):
    """Typed venues, the first 5000: the reader's cap is shown here alone."""
    return features.clean_venues(views.raw_venues(spark, sf), 5000).drop("row_seq")


@query
def first_wins_dedup(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_seq"), F.col("o_custkey").cast("string").alias("id"), "o_orderstatus", "o_totalprice")
    return features.first_of(rows, ["id"])


@query
def rag_documents(spark, sf):
    menus = views.capped(spark, sf)
    return documents.venue_documents(features.venue_features(views.venues(spark, sf), menus), menus)


def probes(spark, sf) -> DataFrame:
    """The vectors that are searched for: every id that 20 divides."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0")


@query
def ip_topk(spark, sf):
    best = vectors.top_k_each(table(spark, sf, "embeddings"), probes(spark, sf), 5, key="vec_id")
    return best.select("query_id", "rank", "vec_id", F.round("similarity_score", 4).alias("similarity_score"))


@query
def retrieve_join(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").cast("string").alias("restaurant_id"), F.col("text").alias("document_text"))
    vecs = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_ord")
    rows = views.venues(spark, sf).select("id", "name")
    late = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    found = vectors.retrieved(vectors.top_k_each(vecs, probes(spark, sf).withColumnRenamed("vec_id", "doc_ord"), 20), docs, [rows, late])
    return found.select("query_id", "rank", "doc_ord", F.round("similarity_score", 4).alias("similarity_score"), "document_text", F.col("database_record.name").alias("name"))


@query
def top_evidence(spark, sf):
    """The first three pieces of evidence that a search shows."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").cast("string").alias("restaurant_id"), F.col("text").alias("document_text"))
    vecs = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_ord")
    found = vectors.retrieved(vectors.top_k_each(vecs, probes(spark, sf).withColumnRenamed("vec_id", "doc_ord"), 20), docs, [views.venues(spark, sf).select("id", "name")])
    return features.first_rows(found, ["query_id"], ["rank"], 3).select("query_id", "rank", "doc_ord", "document_text")


@query
def embedded_documents(spark, sf):
    """All documents through an embedding model, as ten-thousandths."""
    found = models.embedded(table(spark, sf, "documents").select("doc_id", "text"), standins.LETTERS)
    return found.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 10_000).cast("string")), ",").alias("vector"), "failure")


@query
def batch_answers(spark, sf):
    """Embedding, retrieval from all documents and an answer for the turns of every conversation whose number 20 divides."""
    turns = table(spark, sf, "conversations").where("conv_id % 20 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    d = table(spark, sf, "documents")
    facts = {"restaurant_name": F.concat(F.lit("Venue "), F.col("doc_id").cast("string")), "category": F.col("source"), "average_calories": F.col("n_chars"), "average_protein": F.col("n_chars") % 50, "average_fiber": F.col("n_chars") % 9, "fitness_score": F.col("n_chars") % 100}
    docs = d.select(F.col("doc_id").alias("doc_ord"), "text", *(c.alias(n) for n, c in facts.items()))
    found = models.recommended_each(turns, docs, standins.LETTERS, standins.COUNTING, F.lit("You explain recommendations only."))
    ids = F.array_join(F.transform("results", lambda r: r["doc_ord"].cast("string")), ",")
    return found.select("query_id", "retrieved_count", ids.alias("found"), "generated_answer", "failure")


@query
def vector_stats(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.shape(e).join(F.broadcast(e.agg(F.round(F.max(vectors.norm(F.col("embedding"))), 4).alias("max_norm"))))


@query
def safe_answer(spark, sf):
    c = table(spark, sf, "conversations")
    raw = F.when(F.col("turn") == 0, F.concat(F.lit("so. Reason: "), "text")).when(F.col("turn") == 1, F.concat("text", F.lit(" Recommended Restaurant: other"))).when(F.col("turn") == 2, F.lit("<s></s> short")).otherwise(F.col("text"))
    found = {"restaurant_name": F.concat(F.lit("Venue "), F.col("conv_id").cast("string")), "average_calories": F.col("turn"), "average_protein": F.col("turn") + 1, "average_fiber": F.lit("4")}
    return c.select("conv_id", "turn", documents.safe_answer(found, raw).alias("answer"), documents.clean_response(F.concat(F.lit(" <|assistant|> <s> "), "text")).alias("cleaned"))


@query
def prompt_text(spark, sf):
    d = table(spark, sf, "documents")
    found = {k: F.col("source") for k in ("restaurant_name", "category")} | {k: F.col("n_chars") for k in ("average_calories", "average_protein", "average_fiber", "fitness_score")}
    return d.select("doc_id", documents.prompt(F.col("lang"), found, F.col("text")).alias("prompt"))


@query
def training_candidates(spark, sf):
    df = curate.candidates(views.items(spark, sf), views.venues(spark, sf))
    return df.select("menu_id", "restaurant_id", "restaurant_name", "restaurant_category", "menu_name", "menu_category", "estimated_calories", "estimated_protein", "estimated_fiber")


@query
def training_output(spark, sf):
    df = curate.simple_samples(curate.candidates(views.items(spark, sf), views.venues(spark, sf)))
    return df.withColumn("chat", curate.chat_text(F.col("instruction"), F.col("input"), F.col("output")))


def requests(spark, sf):
    v = views.venues(spark, sf).select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"), F.col("category").alias("restaurant_category"))
    m = views.items(spark, sf).withColumnsRenamed({"id": "menu_id", "name": "menu_name", "category": "menu_category"})
    return curate.expanded(m.join(v, "restaurant_id"))


@query
def goal_expansion(spark, sf):
    return requests(spark, sf).select("menu_id", "goal", "template", "user_request", "structured_input")


@query
def constraint_labels(spark, sf):
    df = curate.evaluated(requests(spark, sf))
    return df.select("menu_id", "goal", "template", "overall_match", *(F.array_join(c, "|").alias(c) for c in ("satisfied", "partial", "violated", "limitations")))


@query
def constraint_report(spark, sf):
    return curate.evaluated(requests(spark, sf)).select("menu_id", "goal", "template", curate.report().alias("report"))


@query
def teacher_prompt(spark, sf):
    df = curate.evaluated(requests(spark, sf))
    out = curate.samples(df, F.lit("because")).select(F.col("metadata.menu_id").alias("menu_id"), "input", "output", F.col("metadata.estimated_calories").alias("kcal"), F.col("metadata.overall_match").alias("label"))
    ask = df.where("template = 0").select("menu_id", F.col("structured_input").alias("input"), curate.teacher_prompt().alias("prompt"))
    return ask.join(out, ["menu_id", "input"])


@query
def request_choice(spark, sf):
    return curate.chosen_requests(requests(spark, sf)).select("menu_id", "goal", "template")


TRIED = ("low_protein", "low_fiber", "estimated_calories", "menu_id", "turn")
MAX_SAMPLES = 150


def tried(spark, sf):
    """Requests in the generator's order; generation fails where 3 divides the item's number."""
    menus = curate.candidates(views.items(spark, sf), views.venues(spark, sf))
    asked = curate.chosen_requests(curate.expanded(menus))
    why = F.when(F.col("menu_id").cast("long") % 3 != 0, F.concat(F.lit("It serves "), "goal", F.lit(".")))
    rows = curate.validated(asked, why)
    return rows.withColumns({"low_protein": -F.col("estimated_protein"), "low_fiber": -F.col("estimated_fiber"), "turn": curate.seeded_order("menu_id", "goal", "template", seed=42)})


@query
def valid_samples(spark, sf):
    """The first 150 samples that are valid: the stop is the operator."""
    return curate.generated(tried(spark, sf), MAX_SAMPLES, *TRIED).select("menu_id", "goal", "template", "output")


@query
def generation_report(spark, sf):
    return curate.generation_report(tried(spark, sf), MAX_SAMPLES, *TRIED)


@query
def dataset_filter(spark, sf):
    return curate.judged(views.outputs(spark, sf)).select("row_seq", "restaurant", "menu", "reason", "reject_reason")


@query
def filter_report(spark, sf):
    return curate.filter_report(curate.judged(views.outputs(spark, sf)))


@query
def seeded_sample(spark, sf):
    """A sample of 50 parts: the limit is the operator."""
    return curate.sampled(table(spark, sf, "part"), 50, "p_partkey", seed=7).select("p_partkey", "p_name")


@query
def sampled_candidates(spark, sf):
    """A sample of 40 items of the join with their venues' scores: the limit is the operator."""
    v = features.venue_features(views.venues(spark, sf), views.capped(spark, sf))
    df = relational.sampled_candidates(views.items(spark, sf), v, 40, seed=11)
    return df.withColumn("tags", F.array_join("tags", ","))


@query
def observed_filter_report(spark, sf):
    """The filter's report, counted by the job that writes the samples, and read back from its file."""
    folder = tables.new_folder(spark, "filtered")
    curate.write_filtered(views.outputs(spark, sf), f"{folder}/samples", f"{folder}/report")
    details = ", ".join(f"{f}: bigint" for f in ("invalid_json", *curate.FAULTS))
    told = tables.read_report(spark, f"{folder}/report", f"total_samples bigint, valid_samples bigint, invalid_samples bigint, duplicate_samples bigint, details struct<{details}>")
    written = spark.read.schema("output string").json(f"{folder}/samples").agg(F.count("output").alias("written_samples"))
    return told.select("total_samples", "valid_samples", "invalid_samples", "duplicate_samples", "details.*").join(F.broadcast(written))


@query
def observed_summary(spark, sf):
    """The summary of the cleaned tables, counted by the jobs that write them."""
    folder, menus = tables.new_folder(spark, "features"), views.capped(spark, sf)
    features.write_features(features.venue_features(views.venues(spark, sf), menus), menus, folder)
    return tables.read_report(spark, f"{folder}/summary", "restaurants bigint, menu_items bigint, best_fitness int, kept_items bigint, healthy_items bigint, cheat_items bigint")


@query
def nutrition_targets(spark, sf):
    df, profile = views.customer_profiles(spark, sf)
    return df.select("c_custkey", *nutrition.targets(profile).columns())


@query
def menu_scores(spark, sf):
    df = ranking.scored_items(views.nested(spark, sf), views.PROFILE).select("id", F.explode("items").alias("x"))
    return df.select("id", F.col("x.item.id").alias("item_id"), *(F.col(f"x.parts.{k}").alias(k) for k in ("quality", "goal", "calories", "macro")), F.col("x.score").alias("score"))


@query
def top2_menu(spark, sf):
    df = ranking.best_items(ranking.scored_items(views.nested(spark, sf), views.PROFILE), views.PROFILE)
    df = df.select("id", F.posexplode("best").alias("at", "x"))
    return df.select("id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("item_id"), F.col("x.score").alias("score"), F.array_join("x.reasons", "|").alias("reasons"))


@query
def restaurant_health(spark, sf):
    return ranking.menu_health(views.nested(spark, sf)).select("id", "health.*")


@query
def match_score(spark, sf):
    df = ranking.matched(views.nested(spark, sf), views.PROFILE)
    return df.select("id", "cuisine", "meal_type", "menu_part", "health_part", "cuisine_part", "meal_part", "match_score")


@query
def match_reasons(spark, sf):
    df = ranking.matched(views.nested(spark, sf), views.PROFILE).select("id", F.posexplode(ranking.match_reasons()).alias("pos", "x"))
    return df.select("id", "pos", "x.*")


@query
def top_reasons(spark, sf):
    """The first two positive reasons of each venue."""
    df = ranking.matched(views.nested(spark, sf), views.PROFILE).select("id", F.posexplode(ranking.top_reasons()).alias("pos", "x"))
    return df.select("id", "pos", "x.label", "x.points")


@query
def profile_ranking(spark, sf):
    """The three best venues, out of all, for every customer whose number 20 divides."""
    people, profile = views.customer_profiles(spark, sf)
    return ranking.ranked_each(views.nested(spark, sf), people.where("c_custkey % 20 = 0"), profile, "c_custkey")


@query
def meal_recommendation(spark, sf):
    rec = ranking.meal_recommendation(views.PROFILE)
    return views.nested(spark, sf).select("id", rec["calories"].alias("calories"), rec["protein"].alias("protein"), rec["message"].alias("message"), F.array_join(rec["reasons"], "|").alias("reasons"))


@query
def places_adapter(spark, sf):
    p = table(spark, sf, "part")
    name = F.when(F.col("p_size") % 5 != 0, F.concat(views.pick(views.DISHES, F.col("p_partkey")), F.lit(" House")))
    kind = F.when(F.col("p_size") % 4 != 0, F.regexp_replace(F.lower("p_type"), " ", "_"))
    raw = p.select(F.concat(F.lit("places/Ab_places/"), "p_name").alias("id"), F.struct(name.alias("text")).alias("displayName"), F.lit(None).cast("string").alias("formattedAddress"), kind.alias("primaryType"))
    df = places.adapted(raw)
    return df.select("id", "name", "category", "cuisine", "meal_type", "average_calories", "protein_score", "health_score", tags("tags"), F.array_join(F.transform("menu", lambda x: x["id"]), ",").alias("menu"))


@query
def favorites_toggle(spark, sf):
    favs = state.favourites(views.events(spark, sf, "click"))
    return favs.select("user_id", "item_id", F.unix_micros("added").alias("added_us"))


@query
def favorite_venues(spark, sf):
    favs = state.favourites(views.events(spark, sf, "click")).withColumn("item_id", F.col("item_id").cast("string"))
    return state.favourite_venues(favs, views.venues(spark, sf)).select("id", "name")


@query
def history_recent(spark, sf):
    return state.history(views.events(spark, sf, "view", "click", "error")).select("user_id", "item_id", F.unix_micros("viewed_at").alias("viewed_us"), "pos")


@query
def history_venues(spark, sf):
    seen = state.history(views.events(spark, sf, "view")).withColumn("item_id", F.col("item_id").cast("string"))
    return state.history_venues(seen, views.venues(spark, sf).select("id", "name")).select("user_id", "pos", "item_id", "name")


@query
def profile_latest(spark, sf):
    e = views.events(spark, sf)
    good = F.concat(F.lit('{"weight":'), F.col("item_id").cast("string"), F.lit(',"goal":"maintain"}'))
    e = e.withColumn("payload", F.when(F.col("item_id") % 3 == 0, "{broken").when(F.col("item_id") % 5 == 0, F.lit(None)).otherwise(good))
    df = state.latest_profiles(e, "weight double, goal string", F.struct(F.lit(75.0).alias("weight"), F.lit("gain-muscle").alias("goal")))
    return df.select("user_id", "profile.weight", "profile.goal")


def user_events(spark, df):
    """Clicks as toggles, views, and purchases as written profiles."""
    t = F.col("event_type")
    kind = F.when(t == "click", "toggle").when(t == "view", "view").when(t == "purchase", "profile").otherwise("none")
    e = df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), "event_type")
    return users.typed(e, kind, F.concat(F.lit("w"), F.col("item_id").cast("string")))


@query
def stream_user_state(spark, sf):
    """All users' favourites, histories and profiles by a stateful stream over half of the events, begun with a snapshot of the other half."""
    own = users.session_for(spark)
    raw = own.read.parquet(f"{sf}/events.parquet")
    # the pattern lets a stream read a table that is one file
    past = users.snapshot(user_events(own, raw.where("event_id % 2 = 0")))
    stream = user_events(own, own.readStream.schema(raw.schema).parquet(f"{sf}/events[.]parquet").where("event_id % 2 = 1"))
    found = users.drained(stream, tables.new_folder(spark, "users"), initial=past)
    return found.select("user_id", "kind", "item_id", F.col("pos").cast("long").alias("pos"), "payload", "us")


@query
def stored_profiles(spark, sf):
    """Every user's last profile from a keyed store that five batches of events were merged into, two of them twice; malformed text gives the default."""
    e = user_events(spark, table(spark, sf, "events")).where("user_id is not null")
    text_ = F.when(F.col("item_id") % 7 == 0, "{broken").when(F.col("item_id") % 5 == 0, "").otherwise(F.concat(F.lit('{"weight":'), F.col("item_id").cast("string"), F.lit(',"goal":"maintain"}')))
    rows = e.select("user_id", text_.alias("value"), "ts", "event_id")
    store = stores.KeyedStore(spark, tables.new_folder(spark, "store"), "user_id long, value string, ts timestamp, event_id long", ("user_id",), ("ts", "event_id"), compact_after=2)
    write = store.sink()
    for n in (0, 1, 1, 2, 3, 2, 4):
        write(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == n), n)
    default = F.struct(F.lit(75.0).alias("weight"), F.lit("gain-muscle").alias("goal"))
    return store.read().select("user_id", state.stored(F.col("value"), "struct<weight: double, goal: string>", default).alias("p")).select("user_id", "p.*")


@query
def venue_lookup(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    late = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    return state.lookup([views.venues(spark, sf).select("id", "name"), late], ids)


@query
def bucketed_lookup(spark, sf):
    folder, mark = tables.new_folder(spark, "catalog"), uuid.uuid4().hex
    ids = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    late = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    named = {"ids": ids, "venues": views.venues(spark, sf).select("id", "name"), "late": late}
    at = {k: catalog.write_bucketed(df, f"{k}_{mark}", folder) for k, df in named.items()}
    return catalog.lookup(spark, at["ids"], [at["venues"], at["late"]], ["name"])
