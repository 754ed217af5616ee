"""Equal SQL for DuckDB.  Keyword tables and wordings come from the modules that hold them; everything else is written out here."""

from __future__ import annotations

from string import ascii_lowercase

from larder.functions import rules
from larder.operators import curate, documents, places
from larder.plans.views import CUISINES, DISHES, FAVOURITES, MEALS, SECTIONS

BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(names) -> str:
    return "[" + ", ".join(map(q, names)) + "]"


def pick(names, key: str) -> str:
    return f"list_extract({listed(names)}, cast({key} % {len(names)} as int) + 1)"


def has(t: str, words) -> str:
    return "(" + " or ".join(f"contains({t}, {q(w)})" for w in words) + ")"


def first(t: str, table, default) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else str(v)
    return "case " + " ".join(f"when {has(t, ws)} then {lit(v)}" for v, ws in table) + f" else {lit(default)} end"


def present(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x is not null)"


def cuisine_list(t: str, version: int) -> str:
    found = present(*(f"case when {has(t, ws)} then {q(v)} end" for v, ws in rules.CUISINES[version]))
    return f"(case when len({found}) = 0 then ['general'] else list_sort({found}) end)"


def clean(e: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({e}, ''), '&amp;', '&'), '{BLANKS}+', ' ', 'g'))"


def strip(e: str) -> str:
    return f"regexp_replace(coalesce({e}, ''), '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def json_list(e: str) -> str:
    return f"""('["' || array_to_string({e}, '", "') || '"]')"""


def even(e: str) -> str:
    return f"cast(round_even(cast({e} as double), 0) as int)"


def up(e: str) -> str:
    return f"floor(cast({e} as double) + 0.5::double)"


def fill(template: str, **values: str) -> str:
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(f"coalesce(cast({values[p]} as varchar), '')" if i % 2 else q(p) for i, p in enumerate(parts) if p) + ")"


def estimated(version: int, t: str = "t") -> str:
    return ", ".join(f"{first(t, *tab[version])} as {n}" for n, tab in (("estimated_calories", rules.CALORIES), ("estimated_protein", rules.PROTEIN), ("estimated_fiber", rules.FIBER)))


K, P, FI = "estimated_calories", "estimated_protein", "estimated_fiber"


def level(version: int) -> str:
    more = " and estimated_calories <= 700" if version == 1 else ""
    return f"case when {K} <= 600 and {P} >= 25 then 'healthy' when {K} >= 850 then 'cheat' when {FI} >= 7{more} then 'healthy' else 'normal' end"


def menu_tags(version: int) -> str:
    own = present(
        f"case when {K} <= 500 then 'low_calorie' when {K} >= 800 then 'high_calorie' end", f"case when {P} >= 30 then 'high_protein' end", f"case when {FI} >= 7 then 'high_fiber' end",
        f"case when {K} <= 600 and {P} >= 25 then 'fitness_friendly' end", f"case when {K} >= {800 if version == 1 else 850} then 'cheat_meal' end",
    )
    return f"list_sort(list_distinct(list_concat({own}, {cuisine_list('ct', version)})))"


def enriched(source: str, version: int) -> str:
    texts = f"select *, lower(name || ' ' || description || ' ' || category) as t, lower(category || ' ' || name) as ct from {source}"
    return f"select *, {level(version)} as health_level, {menu_tags(version)} as tags from (select *, {estimated(version)} from ({texts}))"


MONEY = "cast(cast({} as decimal(12,2)) as varchar)"
RAW = f"""
raw_menus as (select ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as row_seq, cast(l_suppkey as varchar) as restaurant_id, {pick(SECTIONS, 'l_linenumber')} as category,
  case when l_partkey % 17 = 0 then '' else {pick(DISHES, 'l_partkey')} end as name, 'served ' || lower(l_returnflag) as description, '$' || {MONEY.format('l_extendedprice')} as price from lineitem),
raw_venues as (select s_suppkey as row_seq, cast(s_suppkey as varchar) as id, case when s_suppkey % 25 = 24 then '' else s_name || ' & Co' end as name, {pick(CUISINES, 's_suppkey')} as raw_category,
  cast({MONEY.format('s_acctbal')} as double) as score, s_nationkey as ratings, '$$' as price_range, 'Street ' || s_nationkey as full_address, '00000' as zip_code, 0.0::double as lat, 0.0::double as lng from supplier),
venues as (select *, {clean('raw_category')} as category from raw_venues where name <> ''),
named as (select * from raw_menus where name <> '' and restaurant_id in (select id from venues)),
capped0 as (select * from named qualify row_number() over (partition by restaurant_id order by row_seq) <= 30),
menus as ({enriched('capped0', 1)})"""
AGG = f"""
sums as (select restaurant_id, count(*) as n, sum({K}) as k, sum({P}) as p, sum({FI}) as f, count(*) filter ({K} <= 600) as low, count(*) filter ({P} >= 30) as rich,
  count(*) filter ({FI} >= 7) as fib, count(*) filter ({K} >= 800) as heavy from menus group by 1),
scores as (select restaurant_id, n::int as menu_count, {even('k::double / n')} as average_calories, {even('p::double / n')} as average_protein, {even('f::double / n')} as average_fiber,
  {even('low::double / n * 40::double + rich::double / n * 35::double + fib::double / n * 25::double')} as health_score, {even('heavy::double / n * 100::double')} as cheat_score from sums),
features as (select v.*, s.* exclude (restaurant_id), greatest(0, least(100, health_score - {even('cheat_score * 0.25::double')} + 20)) as fitness_score,
  {cuisine_list("lower(category || ' ' || name)", 1)} as cuisine_tags from venues v join scores s on v.id = s.restaurant_id)"""
ITEMS = f"""
items as (select cast(m.row_seq as varchar) as menu_id, m.restaurant_id, v.name as restaurant_name, v.category as restaurant_category, m.name as menu_name, m.category as menu_category,
  {K}, {P}, {FI}, health_level, m.tags from menus m join venues v on m.restaurant_id = v.id),
picked as (select * from items where {K} <= 700 and {P} >= 18 order by {P} desc, {FI} desc, {K}, menu_id limit 100)"""
TEXT_TAGS = json_list("tags")
GOALS = present(
    f"case when {P} >= 25 then 'high_protein' end", f"case when {P} >= 30 then 'muscle_gain' end", f"case when {K} <= 550 then 'fat_loss' end", f"case when {K} <= 550 then 'low_calorie' end",
    f"case when {FI} >= 6 then 'high_fiber' end", f"case when health_level = 'healthy' or contains({TEXT_TAGS}, 'healthy') then 'healthy_eating' end",
    f"case when {P} >= 20 and {K} <= 700 then 'post_workout' end", "'maintenance'",
)
FACTS = {"restaurant_name": "restaurant_name", "menu_name": "menu_name", "level": "health_level", "kcal": K, "protein": P, "fiber": FI}


def comma_items(e: str) -> str:
    return f"list_filter(list_transform(string_split({e}, ','), lambda x: trim(x)), lambda x: x <> '')"


EXPANDED = f"""
templates as (select * from (values {", ".join(f"({q(g)}, {i}, {q(t)})" for g, ts in curate.TEMPLATES.items() for i, t in enumerate(ts))}) as t(goal, template, words)),
goaled as (select *, coalesce({comma_items('restaurant_category')}[1], 'restaurant') as cuisine, unnest({GOALS}) as goal from items),
asked as (select g.*, template, replace(words, '{{cuisine}}', cuisine) as user_request from goaled g join templates using (goal)),
requests as (select *, {fill(curate.STRUCTURED, goal='goal', cuisine='cuisine', request='user_request', kcal=K, protein=P, fiber=FI)} as structured_input from asked)"""


def say(c: str, key: str) -> str:
    return f"case when {c} then {fill(curate.SAID[key], kcal=K)} end"


UNDER, LOW, STRONG = "contains(lower(user_request), 'under 600')", "goal in ('fat_loss', 'low_calorie')", "goal in ('high_protein', 'muscle_gain', 'post_workout')"
WELL = f"(health_level = 'healthy' or contains({TEXT_TAGS}, 'healthy') or contains({TEXT_TAGS}, 'fitness_friendly'))"
GOOD = f"({K} <= 700 and {P} >= 15)"
SWEET = " or ".join(has(f"lower({c})", rules.SWEETS) for c in ("menu_name", "menu_category", TEXT_TAGS))
JUDGED = f"""
weighed as (select *,
  {present(say(f'{UNDER} and {K} <= 600', 'under_yes'), say(f'{LOW} and {K} <= 550', 'low_yes'), say(f'{STRONG} and {P} >= 35', 'protein_yes'), say(f"goal = 'high_fiber' and {FI} >= 8", 'fiber_yes'), say(f"goal = 'healthy_eating' and {WELL}", 'healthy_yes'), say(f"goal = 'maintenance' and {GOOD}", 'keep_yes'))} as satisfied,
  {present(say(f'{LOW} and {K} between 551 and 700', 'low_part'), say(f'{STRONG} and {P} between 25 and 34', 'protein_part'), say(f"goal = 'high_fiber' and {FI} between 5 and 7", 'fiber_part'), say(f"goal = 'healthy_eating' and not {WELL}", 'healthy_part'), say(f"goal = 'maintenance' and not {GOOD}", 'keep_part'))} as partial,
  {present(say(f'{UNDER} and {K} > 600', 'under_no'), say(f'{LOW} and {K} > 700', 'low_no'), say(f'{STRONG} and {P} < 25', 'protein_no'), say(f"goal = 'high_fiber' and {FI} < 5", 'fiber_no'))} as violated,
  {present(say(SWEET, 'sweet'))} as limitations from requests),
labelled as (select *, case when len(violated) = 0 and len(partial) = 0 then 'Full Match' when len(satisfied) > 0 then 'Partial Match' else 'Weak Match' end as overall_match from weighed)"""


def part(title: str, c: str, none: str) -> str:
    return f"chr(10) || chr(10) || '{title}:' || chr(10) || case when len({c}) = 0 then '{none}' else '- ' || array_to_string({c}, chr(10) || '- ') end"


REPORT = "'Overall Match:' || chr(10) || overall_match || " + " || ".join((
    part("Satisfied Constraints", "satisfied", "- None explicitly satisfied."), part("Partially Satisfied Constraints", "partial", "- None."),
    part("Violated Constraints", "violated", "- None."), part("Limitations", "limitations", "- None.")))

NUM = "{}::double"
TARGETS = f"""
t0 as (select *, {up("10::double * weight + 6.25::double * height - 5::double * age + case when gender = 'male' then 5 else -161 end")} as bmr from people),
t1 as (select *, {up("bmr * case activity when 'low' then 1.2::double when 'medium' then 1.55::double else 1.725::double end")} as tdee from t0),
t2 as (select *, tdee + case goal when 'lose-fat' then -400 when 'gain-muscle' then 300 else 0 end as kcal, {up("weight * case goal when 'gain-muscle' then 2::double when 'lose-fat' then 1.8::double else 1.6::double end")} as protein from t1),
t3 as (select *, {up('0.25::double * kcal / 9::double')} as fat from t2),
goals as (select *, greatest(0::double, {up('(kcal - 4::double * protein - 9::double * fat) / 4::double')}) as carbs, {up('kcal / 1000::double * 14::double')} as fiber, {up('kcal / 3::double')} as budget,
  round(weight / ((height / 100::double) * (height / 100::double)), 1) as bmi from t3)"""
ME = "people as (select 175.0::double as height, 75.0::double as weight, 22.0::double as age, 'male' as gender, 'medium' as activity, 'gain-muscle' as goal, 'healthy' as meal)"
NESTED = f"""
places0 as (select id, name, category, {first("lower(name || ' ' || category)", rules.PLACE_CUISINES, 'General')} as cuisine from venues),
food as (select restaurant_id as id, row_seq, row_number() over (partition by restaurant_id order by row_seq) as ord, {K}::double as c, {P}::double as p, {FI}::double as fi, (row_seq % 61 + 20)::double as cb, (row_seq % 37 + 5)::double as ft,
  {present("case when health_level = 'healthy' then 'Healthy' end", "case when health_level = 'cheat' then 'Cheat Meal' end", f"case when {P} >= 30 then 'High Protein' end", f"case when {K} <= 500 then 'Low Calorie' end")} as tags from menus),
means as (select id, avg(c) as mc, avg(p) as mp, avg(fi) as mf, avg(ft) as mt from food group by id),
spots as (select v.*, {up('mc')} as average_calories, case when mc <= 600 then 'healthy' when mc >= 850 then 'cheat' else 'normal' end as meal_type, {up('least(100::double, mp / 45::double * 100::double)')} as protein_score,
  least(100::double, 60::double + case when mc <= 650 then 15 else 0 end + case when mf >= 6 then 15 else 0 end + case when mt <= 25 then 10 else 0 end) as health_score from places0 v join means using (id))"""
SCORED = f"""
parts as (select f.*, g.kcal, g.budget as b, g.goal as want, g.meal, greatest(g.protein / 3, 1) as gp, greatest(g.fiber / 3, 1) as gf, greatest(g.fat / 3, 1) as gt from food f, goals g),
points as (select *,
  {up('least(40, least(p / gp, 1) * 20 + least(fi / gf, 1) * 10 + greatest(0, 1 - abs(ft - gt) / gt) * 10)')} as quality,
  {up('least(30, least(p / gp, 1) * 18 + case when c >= b - 150 then 7 else greatest(0, c / greatest(b - 150, 1) * 7) end + case when cb >= 40 then 5 else least(cb / 40, 1) * 5 end)')} as goal_points,
  {up('greatest(0, least(20 * (1 - abs(c - b) / greatest(b, 1)), 20))')} as calories,
  {up('greatest(0, least(10 - (abs(p * 4 / (p * 4 + cb * 4 + ft * 9) - 0.35::double) + abs(cb * 4 / (p * 4 + cb * 4 + ft * 9) - 0.45::double) + abs(ft * 9 / (p * 4 + cb * 4 + ft * 9) - 0.20::double)) * 10, 10))')} as macro from parts),
summed as (select *, quality + goal_points + calories + macro as score from points),
top as (select *, row_number() over (partition by id order by score desc, ord) as rank from summed)"""
WHY = f"""list_slice({present(
    "case when abs(c - b) <= b * 0.15::double then 'Close to your meal calorie budget.' when c < b then 'Lower calorie option for this meal.' else 'Higher calorie option, better for flexible meals.' end",
    "case when p >= 40 then 'Strong protein choice for muscle gain.' when p >= 30 then 'Decent protein amount.' end",
    "case when list_contains(tags, 'Healthy') then 'Matches your healthy meal preference.' end", "case when ft <= 25 then 'Moderate fat level.' end",
    "case when list_contains(tags, 'High Protein') then 'Tagged as high protein.' end", "case when list_contains(tags, 'Low Calorie') then 'Tagged as low calorie.' end")}, 1, 3)"""
HEALTH = f"""
hp as (select id, {up('greatest(0, least(p / c * 100 / 8 * 15, 15))')} as a1, {up('greatest(0, least(fi / c * 100 / 2 * 10, 10))')} as a2,
  case when ft * 9 / c <= 0.25 then 5 when ft * 9 / c <= 0.35 then 3 when ft * 9 / c <= 0.45 then 1 else 0 end as a3, case when c <= 500 then 10 when c <= 650 then 8 when c <= 800 then 5 when c <= 950 then 2 else 0 end as a4 from food),
healths as (select id, {up('(sum(a1)::double / count(*) + sum(a2)::double / count(*) + sum(a3)::double / count(*) + sum(a4)::double / count(*)) / 40::double * 100::double')} as score, {up('sum(a1)::double / count(*)')} as protein_part, {up('sum(a2)::double / count(*)')} as fiber_part, {up('sum(a3)::double / count(*)')} as fat_part, {up('sum(a4)::double / count(*)')} as energy_part from hp group by id)"""
SPOT_TAGS = f"list_concat([cuisine, category], {present(*(f'case when cuisine = {q(c)} then {q(t)} end' for c, t in (('Healthy', 'Healthy Meal'), ('Japanese', 'Balanced'), ('Indian', 'Curry'), ('Burger', 'Cheat Meal'))))})"
LIKED = has(f"lower(cuisine || ' ' || category || ' ' || array_to_string({SPOT_TAGS}, ' '))", (*rules.ALIASES["healthy"], *rules.ALIASES["sushi"]))
MATCHED = f"""
best as (select id, least(50::double, sum(score) / count(*) * 0.5::double) as menu_part from top where rank <= 2 group by id),
matched as (select s.id, s.cuisine, s.meal_type, h.score as h, menu_part, least(20::double, h.score * 0.2::double) as health_part, case when {LIKED} then 15.0::double else 0.0::double end as cuisine_part,
  case when meal_type = 'healthy' then 15.0::double else 0.0::double end as meal_part from spots s join best using (id) join healths h using (id))"""
PEOPLE = f"people as (select c_custkey, (c_custkey % 60 + 140)::double as height, (c_custkey % 70 + 45)::double as weight, (c_custkey % 50 + 18)::double as age, {pick(('male', 'female'), 'c_custkey')} as gender, {pick(('low', 'medium', 'high'), 'c_custkey')} as activity, {pick(('lose-fat', 'maintain', 'gain-muscle', 'maintain', 'lose-fat'), 'c_custkey')} as goal, {pick(MEALS, 'c_custkey')} as meal from customer)"
SPOT_TEXT = f"lower(cuisine || ' ' || category || ' ' || array_to_string({SPOT_TAGS}, ' '))"
WANTED = {i: [w for f in fs for w in rules.ALIASES.get(f.strip().lower(), (f.strip().lower(),))] for i, fs in enumerate(FAVOURITES)}
LIKED_BY = f"case c_custkey % {len(FAVOURITES)} " + " ".join(f"when {i} then {has(SPOT_TEXT, ws) if ws else 'false'}" for i, ws in WANTED.items()) + " end"
#: Every customer whose number 20 divides, against all venues.
MATCHED_EACH = f"""
best as (select c_custkey, id, any_value(meal) as meal, least(50::double, sum(score) / count(*) * 0.5::double) as menu_part from top where rank <= 2 group by c_custkey, id),
matched as (select c_custkey, id, {up(f"menu_part + least(20::double, h.score * 0.2::double) + case when {LIKED_BY} then 15 else 0 end + case when meal_type = meal then 15 when meal = 'normal' then 8 else 0 end")} as match_score
  from spots s join best using (id) join healths h using (id))"""
GAIN = "least(p / gp, 1) * 18 + case when c >= b - 150 then 7 else greatest(0, c / greatest(b - 150, 1) * 7) end + case when cb >= 40 then 5 else least(cb / 40, 1) * 5 end"
LOSE = "case when c <= b then 10 else greatest(0, 10 * (1 - (c - b) / greatest(b, 1))) end + least(p / gp, 1) * 10 + least(fi / gf, 1) * 10"
KEEP = "greatest(0, 1 - abs(c - b) / greatest(b, 1)) * 15 + least(p / gp, 1) * 8 + case when ft <= 30 and cb >= 30 then 7 else 4 end"
#: The scores of one person who gains muscle, widened to every person and goal.
SCORED_EACH = SCORED
for one, each in (
    ("select f.*, g.kcal", "select f.*, g.c_custkey, g.kcal"), ("partition by id", "partition by c_custkey, id"), (GAIN, f"case want when 'lose-fat' then {LOSE} when 'gain-muscle' then {GAIN} else {KEEP} end"),
    ("0.35::double", "(case want when 'maintain' then 0.30 else 0.35 end)::double"), ("0.45::double", "(case want when 'lose-fat' then 0.35 when 'gain-muscle' then 0.45 else 0.40 end)::double"), ("0.20::double", "(case want when 'gain-muscle' then 0.20 else 0.30 end)::double"),
):
    assert SCORED_EACH.count(one) == 1
    SCORED_EACH = SCORED_EACH.replace(one, each)
TRIED = f"""
chosen as (select *, md5('42|' || menu_id || '|' || goal || '|' || template) as turn from requests where menu_id in (select menu_id from picked) qualify row_number() over (partition by restaurant_id, menu_id, structured_input order by goal, template) = 1),
tried as (select *, menu_id::bigint % 3 <> 0 as valid, row_number() over (order by {P} desc, {FI} desc, {K}, menu_id, turn) as pos from chosen qualify row_number() over (partition by menu_id order by turn) <= 5),
taken as (select * from tried where valid order by pos limit 150)"""
REASONS = f"""rs as (select id, {present(f"{{'label': 'Recommended menu quality', 'points': {up('menu_part')}, 'type': 'positive'}}",
        f"{{'label': 'Menu nutrition quality (' || h::bigint || '/100)', 'points': {up('health_part')}, 'type': case when h >= 70 then 'positive' else 'neutral' end}}",
        "case when cuisine_part > 0 then {'label': 'Matches your favorite cuisine', 'points': 15.0::double, 'type': 'positive'} end",
        "case when meal_part > 0 then {'label': 'Matches your selected meal type', 'points': 15.0::double, 'type': 'positive'} end",
        "{'label': case when h >= 85 then 'Excellent overall menu health' when h >= 70 then 'Good overall menu health' when h >= 55 then 'Average overall menu health' else 'Menu nutrition quality could be improved' end, 'points': 0.0::double, 'type': case when h >= 70 then 'positive' when h >= 55 then 'neutral' else 'negative' end}")} as r from matched)"""
REC = present(
    "case when abs(gap) <= 150 then 'Calories are close to your suggested meal budget.' end", "case when gap > 150 then 'This meal may be higher than your suggested meal budget.' end",
    "case when gap < -150 then 'This meal is lighter than your suggested meal budget.' end", "case when protein_score >= 80 then 'This restaurant is strong for protein.' end",
    "case when health_score >= 80 then 'This restaurant is a healthy choice.' end", "case when meal_type = meal then 'This restaurant matches your selected meal type.' end",
    "case when lower(cuisine) in ('healthy', 'sushi') then 'This restaurant matches your favorite cuisine.' end")


def with_(*parts: str) -> str:
    return "with " + ",".join(parts) + " "


EV = "ev as (select event_id, ts, user_id, cast(props->>'$.k' as bigint) as item_id, event_type from events)"
RAW_NUMBERS = "list_extract(['$12.99', '£18', '$$', '1,299', '-5', '', 'abc', '12.7', 'nan', '1.5d', '1_000', ' 7 '], cast(o_orderkey % 12 as int) + 1)"
RAW_CATEGORY = "case when p_size % 7 = 0 then ' , ' when p_size % 11 = 0 then '' else concat_ws(',', p_brand, '  ', case when p_size % 3 = 0 then p_type end) end"
OUTPUTS = """
o0 as (select conv_id * 1000 + turn as row_seq, conv_id, conv_id + turn as k, coalesce(text, '') as body from conversations),
o1 as (select row_seq, case when k % 7 = 0 then '' else 'Venue ' || (conv_id % 9) end as restaurant, case when k % 11 = 0 then '' else 'Dish' end as menu,
  case when k % 5 = 0 then 'It fits the asked-for nutrition well enough to be named here.' when k % 13 = 0 then '' else """ + strip("body") + """ end as reason from o0),
o2 as (select *, case when restaurant = '' then 'missing_restaurant' when menu = '' then 'missing_menu' when reason = '' then 'missing_reason' when length(reason) < 50 or length(reason) > 1200 then 'invalid_reason_length' end as fault from o1),
o3 as (select row_seq, restaurant, menu, reason, case when fault is null and row_number() over (partition by restaurant, menu, reason, fault is null order by row_seq) > 1 then 'duplicate' else fault end as reject_reason from o2)"""
FEATURE_FACTS = {c: c for c in ("name", "id", "category", "price_range", "full_address", "average_calories", "average_protein", "average_fiber", "health_score", "fitness_score")}
#: Every vector whose id 20 divides, against all vectors.
RANKED = """
asked as (select vec_id as query_id, embedding as wanted from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id, list_sum(list_transform(list_zip(e.embedding, wanted), lambda x: x[1]::double * x[2]::double)) as sc from embeddings e cross join asked),
b as (select *, row_number() over (partition by query_id order by sc desc, vec_id)::int as rank from s)"""
LETTERS = "[" + ", ".join(f"length(t) - length(replace(replace(t, '{c}', ''), '{c.upper()}', ''))" for c in ascii_lowercase) + "]"
LENGTH = "greatest(sqrt(list_sum(list_transform(v, lambda x: x::double * x::double))), 1e-12::double)"


def unit_letters(source: str) -> str:
    """id and vector of each text of ``source`` (id, t)."""
    return f"select id, list_transform(v, lambda x: (x::double / {LENGTH})::float) as v from (select id, {LETTERS} as v from ({source}) where t is not null)"


ANSWERS = f"""
dv as materialized ({unit_letters("select doc_id as id, text as t from documents")}),
turns as (select conv_id * 1000 + turn as id, text as t from conversations where conv_id % 20 = 0),
qv as materialized ({unit_letters("from turns")}),
hits as (select qv.id as query_id, dv.id as doc_id, list_sum(list_transform(list_zip(dv.v, qv.v), lambda x: x[1]::double * x[2]::double)) as sc from qv cross join dv),
ranked as (select *, row_number() over (partition by query_id order by sc desc, doc_id) as rank from hits qualify rank <= 5),
lists as (select query_id, count(*)::int as n, string_agg(doc_id::varchar, ',' order by rank) as found, min_by(doc_id, rank) as doc_id from ranked group by query_id),
asked as (select query_id, n, found, d.*, t from lists join turns on id = query_id join documents d using (doc_id)),
said as (select *, {fill(documents.PROMPT, query='t', evidence="left(coalesce(text, ''), 800)", restaurant_name="('Venue ' || doc_id)", category='source', average_calories='n_chars', average_protein='n_chars % 50', average_fiber='n_chars % 9', fitness_score='n_chars % 100')} as p from asked)"""
ESTIMATED = {c: [i[0] for i in items] for names, items in places.ESTIMATED.items() for c in names}


def version_sql(v: int) -> str:
    health = f"least(100, case when {K} <= 600 then 40 when {K} <= 750 then 25 else 0 end + case when {P} >= 30 then 35 when {P} >= 20 then 20 else 0 end + case when {FI} >= 7 then 25 when {FI} >= 4 then 15 else 0 end)"
    cheat = f"case when {K} >= 900 then 100 when {K} >= 800 then 80 when {K} >= 700 then 50 else 10 end"
    return with_(RAW, f"e as ({enriched('raw_menus', v)}), s as (select *, {health} as item_health, {cheat} as item_cheat from e)") + f"""
select row_seq, {K}, {P}, {FI}, health_level, array_to_string(tags, ',') as tags, array_to_string({cuisine_list('ct', v)}, ',') as cuisine_tags, item_health, item_cheat,
greatest(0, least(100, item_health - cast(trunc(item_cheat * 0.25::double) as int) + 20)) as item_fitness from s"""


def place_numbers() -> str:
    rows = [(c, items) for names, items in places.ESTIMATED.items() for c in names] + [("", places.BALANCED)]
    return ", ".join(f"({q(c)}, {sum(i[2] for i in it) / 2}::double, {sum(i[3] for i in it) / 2}::double, {sum(i[5] for i in it) / 2}::double, {sum(i[6] for i in it) / 2}::double, {q(','.join(i[0] for i in it))})" for c, it in rows)


ORACLES: dict[str, str] = {
    "restaurant_features": with_(RAW, AGG) + "select id, name, category, score, ratings::int as ratings, menu_count, average_calories, average_protein, average_fiber, health_score, cheat_score, fitness_score, array_to_string(cuisine_tags, ',') as cuisine_tags from features",
    "feature_summary": with_(RAW, AGG) + "select (select count(*) from features) as restaurants, (select sum(menu_count)::bigint from features) as menu_items, (select max(fitness_score) from features) as best_fitness, count(*) as kept_items, count(*) filter (health_level = 'healthy') as healthy_items, count(*) filter (health_level = 'cheat') as cheat_items from menus",
    "clean_text": f"select doc_id, {clean("' &amp;amp; ' || text || '   x '")} as cleaned from documents",
    "parse_numbers": f"""with r as (select *, {RAW_NUMBERS} as raw from orders)
select o_orderkey, case raw when '-5' then -5.0 when '12.7' then 12.7 when 'nan' then -1.0 when '1_000' then 1000.0 when ' 7 ' then 7.0 else 0.0 end::double as as_float,
case raw when '-5' then -5 when '12.7' then 12 when '1_000' then 1000 when ' 7 ' then 7 else 0 end::int as as_int, coalesce(try_cast(regexp_extract(raw, '[0-9]+(\\.[0-9]+)?', 0) as double), 0.0::double) as as_price,
cast(cast(o_totalprice as decimal(12,2)) as double) as total, raw = '' as empty from r""",
    "normalize_category": f"""with r as (select p_partkey, {RAW_CATEGORY} as raw from part) select p_partkey, case when trim(raw) = '' then 'Unknown' else array_to_string({comma_items('raw')}, ', ') end as category,
coalesce({comma_items('raw')}[1], 'restaurant') as cuisine from r""",
    "menu_estimates_v1": version_sql(1),
    "menu_estimates_v2": version_sql(2),
    "document_cuisine_tags": f"with d as (select doc_id, lower(concat_ws(' ', coalesce(source, ''), coalesce(text, ''))) as t from documents) select doc_id, array_to_string({cuisine_list('t', 1)}, ',') as cuisine_tags from d",
    "clean_menus": with_(RAW) + f"select cast(row_number() over (order by row_seq) as varchar) as id, restaurant_id, row_seq, category, name, description, cast(price[2:] as double) as price, {K}, health_level, {TEXT_TAGS} as tags from menus",
    "clean_venues": with_(RAW) + "select id, name, category, price_range, full_address, zip_code, score, lat, lng, ratings::int as ratings from venues order by row_seq limit 5000",
    "first_wins_dedup": "select o_orderkey as row_seq, cast(o_custkey as varchar) as id, o_orderstatus, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1",
    "rag_documents": with_(RAW, AGG, f"""l as (select *, row_number() over (partition by restaurant_id order by row_seq) as rn from menus),
lines as (select restaurant_id, count(*)::int as n, string_agg({fill(documents.MENU_LINE, tags=TEXT_TAGS, **{c: c for c in ('name', 'category', K, P, FI, 'health_level')})}, chr(10) order by row_seq) as menu_text from l where rn <= 8 group by 1),
f as (select id, name, category, price_range, full_address, average_calories, average_protein, average_fiber, health_score, fitness_score, {json_list('cuisine_tags')} as cuisine_tags, menu_text, n from features join lines on id = restaurant_id)""")
    + f"""select id, 'restaurant_rag_document' as type, id as restaurant_id, name as restaurant_name, category, cuisine_tags, average_calories::varchar as average_calories, average_protein::varchar as average_protein, average_fiber::varchar as average_fiber,
health_score::varchar as health_score, fitness_score::varchar as fitness_score, n as menu_count_in_document, {fill(documents.DOCUMENT, cuisine_tags='cuisine_tags', menu_text='menu_text', **FEATURE_FACTS)} as text from f""",
    "ip_topk": with_(RANKED) + "select query_id, rank, vec_id, round(sc, 4) as similarity_score from b where rank <= 5",
    "retrieve_join": with_(RAW, RANKED)
    + "select query_id, rank, vec_id as doc_ord, round(sc, 4) as similarity_score, d.text as document_text, coalesce(v.name, c.c_name) as name from b join documents d on d.doc_id = vec_id left join venues v on v.id = cast(vec_id as varchar) left join customer c on c.c_custkey = vec_id where rank <= 20",
    "embedded_documents": f"select d.doc_id, array_to_string(list_transform(v, lambda x: floor(x::double * 10000)::bigint), ',') as vector, case when text is null then 'no input' end as failure from documents d left join ({unit_letters('select doc_id as id, text as t from documents')}) on id = d.doc_id",
    "batch_answers": with_(ANSWERS)
    + f"""select turns.id as query_id, coalesce(n, 0) as retrieved_count, coalesce(found, '') as found, case when turns.t is null then null when n is null then 'No suitable restaurant was found.' else
{fill("Recommended Restaurant:{nl}Venue {doc}{nl}{nl}Nutrition Summary:{nl}{a} kcal{nl}{b} g protein{nl}{c} g fiber{nl}{nl}Recommended Reason:{nl}The request of {d} letters names protein {e} times.", nl='chr(10)', doc='doc_id', a='n_chars', b='n_chars % 50', c='n_chars % 9', d='length(p)', e="(length(p) - length(replace(p, 'protein', ''))) // 7")} end as generated_answer,
case when turns.t is null then 'no input' end as failure from turns left join said on turns.id = query_id""",
    "vector_stats": "select count(*) as n_docs, max(len(embedding))::int as dim, round(max(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 4) as max_norm from embeddings",
    "safe_answer": f"""with r as (select *, {strip("text")} as s from conversations),
a as (select *, case turn when 0 then s when 1 then {strip("coalesce(text, '')")} when 2 then '<s></s> short' else s end as reason from r),
b as (select *, case when contains(reason, 'Reason:') then {strip("reason[strpos(reason, 'Reason:') + 7:]")} else reason end as r1 from a),
c as (select *, case when contains(r1, 'Recommended Restaurant:') then {strip("left(r1, strpos(r1, 'Recommended Restaurant:') - 1)")} else r1 end as r2 from b)
select conv_id, turn, {fill("Recommended Restaurant:{nl}Venue {conv_id}{nl}{nl}Nutrition Summary:{nl}{turn} kcal{nl}{more} g protein{nl}4 g fiber{nl}{nl}Recommended Reason:{nl}{reason}", nl='chr(10)', conv_id='conv_id', turn='turn', more='turn + 1', reason=f"case when length(r2) < 20 then {q(documents.DEFAULT_REASON)} else r2 end")} as answer, s as cleaned from c""",
    "prompt_text": f"select doc_id, {fill(documents.PROMPT, query='lang', evidence='left(text, 800)', **dict.fromkeys(('restaurant_name', 'category'), 'source'), **dict.fromkeys(('average_calories', 'average_protein', 'average_fiber', 'fitness_score'), 'n_chars'))} as prompt from documents",
    "training_candidates": with_(RAW, ITEMS) + f"select menu_id, restaurant_id, restaurant_name, restaurant_category, menu_name, menu_category, {K}, {P}, {FI} from picked",
    "training_output": with_(RAW, ITEMS, f"""w as (select *, case when {P} >= 35 and {K} <= 600 then 'I want a high-protein ' || restaurant_category || ' meal under 600 calories.' when {FI} >= 8 and {K} <= 600 then 'I want a high-fiber healthy ' || restaurant_category || ' meal under 600 calories.'
when {K} <= 500 then 'I want a low-calorie ' || restaurant_category || ' meal under 500 calories.' when contains(lower({TEXT_TAGS}), 'vegetarian') then 'I want a vegetarian ' || restaurant_category || ' meal with good nutrition.' else 'I want a fitness-friendly ' || restaurant_category || ' meal recommendation.' end as input,
{q(curate.INSTRUCTION)} as instruction, {fill(curate.SIMPLE, **FACTS)} as output from picked)""") + f"select menu_id, instruction, input, output, {fill(curate.CHAT, instruction='instruction', input='input', output='output')} as chat from w",
    "goal_expansion": with_(RAW, ITEMS, EXPANDED) + "select menu_id, goal, template::int as template, user_request, structured_input from requests",
    "constraint_labels": with_(RAW, ITEMS, EXPANDED, JUDGED) + "select menu_id, goal, template::int as template, overall_match, array_to_string(satisfied, '|') as satisfied, array_to_string(partial, '|') as partial, array_to_string(violated, '|') as violated, array_to_string(limitations, '|') as limitations from labelled",
    "constraint_report": with_(RAW, ITEMS, EXPANDED, JUDGED) + f"select menu_id, goal, template::int as template, {REPORT} as report from labelled",
    "teacher_prompt": with_(RAW, ITEMS, EXPANDED, JUDGED) + f"""select menu_id, structured_input as input, {fill(curate.SAMPLE, explanation="'because'", **FACTS)} as output, {K}::double as kcal, overall_match as label,
{fill(curate.TEACHER, structured_input='structured_input', restaurant_category=strip('restaurant_category'), menu_category=strip('menu_category'), tags=TEXT_TAGS, report=REPORT, **FACTS)} as prompt from labelled where template = 0""",
    "request_choice": with_(RAW, ITEMS, EXPANDED) + "select menu_id, goal, template::int as template from requests qualify row_number() over (partition by menu_id order by md5('42|' || menu_id || '|' || goal || '|' || template)) <= 5",
    "valid_samples": with_(RAW, ITEMS, EXPANDED, TRIED) + f"select menu_id, goal, template::int as template, {fill(curate.SAMPLE, explanation="'It serves ' || goal || '.'", **FACTS)} as output from taken",
    "generation_report": with_(RAW, ITEMS, EXPANDED, TRIED) + "select (select count(*) from taken) as generated_samples, (select count(*) from tried where not valid and ((select count(*) from taken) < 150 or pos < (select max(pos) from taken))) as failed_samples",
    "profile_ranking": with_(RAW, PEOPLE.replace("from customer)", "from customer where c_custkey % 20 = 0)"), TARGETS, NESTED, SCORED_EACH, HEALTH, MATCHED_EACH) + "select c_custkey, row_number() over (partition by c_custkey order by match_score desc, id)::int as rank, id, match_score from matched qualify rank <= 3",
    "top_reasons": with_(RAW, ME, TARGETS, NESTED, SCORED, HEALTH, MATCHED, REASONS, "w as (select id, list_filter(r, lambda x: x.type = 'positive')[1:2] as r from rs), u as (select id, unnest(range(len(r)))::int as pos, unnest(r) as x from w)") + "select id, pos, x.label as label, x.points as points from u",
    "top_evidence": with_(RANKED) + "select query_id, rank, doc_id as doc_ord, text as document_text from b join documents on doc_id = vec_id where rank <= 20 qualify row_number() over (partition by query_id order by rank) <= 3",
    "dataset_filter": with_(OUTPUTS) + "select * from o3",
    "filter_report": with_(OUTPUTS) + "select count(*) as total_samples, count(*) filter (reject_reason is null) as valid_samples, " + ", ".join(f"count(*) filter (reject_reason = '{r}') as {r}" for r in ("missing_restaurant", "missing_menu", "missing_reason", "invalid_reason_length", "duplicate")) + " from o3",
    "seeded_sample": "select p_partkey, p_name from part order by md5('7|' || p_partkey), p_partkey limit 50",
    "sampled_candidates": with_(RAW, AGG) + f"select v.id as restaurant_id, v.name as restaurant_name, v.category as restaurant_category, v.health_score, v.fitness_score, cast(m.row_seq as varchar) as menu_id, m.name as menu_name, m.category as menu_category, {K}, {P}, {FI}, health_level, array_to_string(tags, ',') as tags from menus m join features v on v.id = m.restaurant_id order by md5('11|' || m.row_seq), m.row_seq limit 40",
    "observed_filter_report": with_(OUTPUTS) + "select count(*) as total_samples, count(*) filter (reject_reason is null) as valid_samples, count(reject_reason) as invalid_samples, count(*) filter (reject_reason = 'duplicate') as duplicate_samples, 0::bigint as invalid_json, " + ", ".join(f"count(*) filter (reject_reason = '{r}') as {r}" for r in curate.FAULTS) + ", count(*) filter (reject_reason is null) as written_samples from o3",
    "observed_summary": with_(RAW, AGG) + "select (select count(*) from features) as restaurants, (select sum(menu_count)::bigint from features) as menu_items, (select max(fitness_score) from features) as best_fitness, count(*) as kept_items, count(*) filter (health_level = 'healthy') as healthy_items, count(*) filter (health_level = 'cheat') as cheat_items from menus",
    "nutrition_targets": with_(PEOPLE, TARGETS)
    + "select c_custkey, bmi, bmr, tdee, kcal, protein, carbs, fat, fiber, budget from goals",
    "menu_scores": with_(RAW, ME, TARGETS, NESTED, SCORED) + "select id, cast(row_seq as varchar) as item_id, quality, goal_points as goal, calories, macro, score from summed",
    "top2_menu": with_(RAW, ME, TARGETS, NESTED, SCORED) + f"select id, rank::int as rank, cast(row_seq as varchar) as item_id, score, array_to_string({WHY}, '|') as reasons from top where rank <= 2",
    "restaurant_health": with_(RAW, NESTED, HEALTH) + "select * from healths",
    "match_score": with_(RAW, ME, TARGETS, NESTED, SCORED, HEALTH, MATCHED) + f"select id, cuisine, meal_type, menu_part, health_part, cuisine_part, meal_part, {up('menu_part + health_part + cuisine_part + meal_part')} as match_score from matched",
    "match_reasons": with_(RAW, ME, TARGETS, NESTED, SCORED, HEALTH, MATCHED, REASONS, """u as (select id, unnest(range(len(r)))::int as pos, unnest(r) as x from rs)""") + "select id, pos, x.label as label, x.points as points, x.type as type from u",
    "meal_recommendation": with_(RAW, ME, TARGETS, NESTED, "m as (select s.*, average_calories - budget as gap, budget, meal from spots s, goals)") + f"select id, average_calories as calories, {up('protein_score / 100::double * 55::double')} as protein, 'Your suggested meal budget is about ' || budget::bigint || ' kcal.' as message, array_to_string({REC}, '|') as reasons from m",
    "places_adapter": f"""with p as (select lower(regexp_replace('Ab_places/' || p_name, '[^A-Za-z0-9_-]', '-', 'g')) as id, case when p_size % 5 <> 0 then {pick(DISHES, 'p_partkey')} || ' House' else 'Unknown Restaurant' end as name,
case when p_size % 4 <> 0 then array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') else 'Restaurant' end as category from part),
c as (select *, {first("lower(name || ' ' || category)", rules.PLACE_CUISINES, 'General')} as cuisine from p),
m as (select * from (values {place_numbers()}) as t(key, k, pr, ft, fb, ids)),
j as (select c.*, m.* from c join m on m.key = case when lower(cuisine) in ({', '.join(q(k) for k in ESTIMATED)}) then lower(cuisine) else '' end)
select id, name, category, cuisine, case when k <= 600 then 'healthy' when k >= 850 then 'cheat' else 'normal' end as meal_type, {up('k')} as average_calories, {up('least(100::double, pr / 45::double * 100::double)')} as protein_score,
least(100::double, 60::double + case when k <= 650 then 15 else 0 end + case when fb >= 6 then 15 else 0 end + case when ft <= 25 then 10 else 0 end) as health_score, array_to_string({SPOT_TAGS}, ',') as tags, ids as menu from j""",
    "favorites_toggle": with_(EV) + "select user_id, item_id, epoch_us(max(ts)) as added_us from ev where event_type = 'click' group by 1, 2 having count(*) % 2 = 1",
    "favorite_venues": with_(RAW, EV) + "select id, name from venues where id in (select cast(item_id as varchar) from ev where event_type = 'click' group by user_id, item_id having count(*) % 2 = 1)",
    "history_recent": with_(EV, "l as (select user_id, item_id, max((ts, event_id)) as v from ev where event_type in ('view', 'click', 'error') group by 1, 2), r as (select *, row_number() over (partition by user_id order by v desc)::int as pos from l)") + "select user_id, item_id, epoch_us(v[1]) as viewed_us, pos from r where pos <= 20",
    "history_venues": with_(RAW, EV, "l as (select user_id, item_id, max((ts, event_id)) as v from ev where event_type = 'view' group by 1, 2), r as (select *, row_number() over (partition by user_id order by v desc)::int as pos from l)") + "select user_id, pos, id as item_id, name from r join venues on id = cast(item_id as varchar) where pos <= 20",
    "profile_latest": with_(EV, "l as (select * from ev qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)") + "select user_id, case when item_id % 3 = 0 or item_id % 5 = 0 then 75.0 else item_id end::double as weight, case when item_id % 3 = 0 or item_id % 5 = 0 then 'gain-muscle' else 'maintain' end as goal from l",
    "stream_user_state": with_(EV, "known as (select * from ev where user_id is not null and ts is not null)", "l as (select user_id, item_id, max((ts, event_id)) as v from known where event_type = 'view' and item_id is not null group by 1, 2), r as (select *, row_number() over (partition by user_id order by v desc) as pos from l)")
    + """select user_id, 'toggle' as kind, item_id, null::bigint as pos, null as payload, epoch_us(max(ts)) as us from known where event_type = 'click' and item_id is not null group by 1, 3 having count(*) % 2 = 1
union all select user_id, 'view', item_id, pos, null, epoch_us(v[1]) from r where pos <= 20
union all (select user_id, 'profile', null, null, 'w' || item_id, epoch_us(ts) from known where event_type = 'purchase' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)""",
    "stored_profiles": with_(EV, "l as (select * from ev where user_id is not null qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)") + "select user_id, case when item_id % 7 = 0 or item_id % 5 = 0 then 75.0 else item_id end::double as weight, case when item_id % 7 = 0 or item_id % 5 = 0 then 'gain-muscle' else 'maintain' end as goal from l",
    "venue_lookup": with_(RAW) + "select cast(c_custkey as varchar) as id, coalesce(v.name, p.p_name) as name from customer c left join venues v on v.id = cast(c_custkey as varchar) left join part p on p.p_partkey = c_custkey where coalesce(v.name, p.p_name) is not null",
    "bucketed_lookup": with_(RAW) + "select cast(c_custkey as varchar) as id, coalesce(v.name, p.p_name) as name from customer c left join venues v on v.id = cast(c_custkey as varchar) left join part p on p.p_partkey = c_custkey where coalesce(v.name, p.p_name) is not null",
}
