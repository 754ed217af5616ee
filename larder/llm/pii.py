"""Personal data by candidate generation and gradient-boosted trees, in DataFrame functions only.

1. Generators propose spans.  The contract's four kinds are checked by rule and
   always stay.  High-recall generators propose further, overlapping spans:
   secrets, account numbers, local phone numbers, national ids.
2. Each proposed span gets format and context features, all built-in functions.
3. Boosted trees of depth two score the spans.  They are fitted on ``TRAIN_ROWS``
   labelled examples that Spark generates from a seed (the documented bound), and
   compiled into one ``CASE`` expression, so that scoring is a projection.
4. On held-out examples the margins are calibrated to probabilities (Platt) and
   the threshold with the asked-for precision is chosen; spans above it are kept
   unless they overlap a base span or a better one.

Work on one text grows with its length and, by n^(4/3) at most, with its n matches
(:func:`running`); overlaps are found by halving.

Places are code points, ends exclusive.  The patterns have no nested repeats over
long runs, so very long runs of digits or letters take linear time and no deep
stack.  Defined results: a null text is empty and has no spans; repeated rows give
repeated rows; extra columns are ignored by :func:`find`, and kept by
:func:`redacted`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import let, text_of

KINDS = ("email", "ip", "card", "phone")
MORE = ("account", "secret", "local_phone", "national_id")

TRAIN_ROWS = 6000
ROUNDS = 24
RATE = 0.3
PRECISION = 0.97
CONTEXT = 24
#: Code points of a piece of a text: a place is found without walking over the whole text.
CHUNK = 1024

# Between digits a single blank or dash joins them; it is replaced by this mark first, one for one,
# so that a run of joined digits is one run of a character class.
JOIN = "\ue000"
LOCAL = r"[A-Za-z0-9._%+-]"
# A match starts where a run starts, or where the last match ended.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = rf"[0-9][0-9{JOIN}]*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+"
LOCAL_PHONE = r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
NATIONAL = r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![0-9A-Za-z-])"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"

NONE = "cast(array() as array<struct<kind: string, start: bigint, end: bigint, s: string>>)"


def running(a: Column, add: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """Running totals of an array of longs, each with its own element.

    An array grows by copying, so n totals are made in blocks of the cube root of
    n: totals within blocks, the same over the blocks' last ones, and both added.
    """

    def short(block: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return let(F.when(F.size(acc) == 0, x).otherwise(add(F.element_at(acc, -1), x)), lambda v: F.concat(acc, F.array(v)))

        return F.aggregate(block, F.expr("cast(array() as array<bigint>)"), step)

    def blocks(a: Column) -> Column:
        long = F.greatest(F.ceil(F.pow(F.size(a), F.lit(1.0 / levels))), F.lit(1)).cast("int")
        cut = let(long, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / n).cast("int")), lambda b: F.slice(a, b * n + 1, n)))
        within = F.transform(cut, short)
        return let(within, lambda w: let(running(F.transform(w, lambda b: F.element_at(b, -1)), add, levels - 1), lambda last: joined(w, last)))

    def joined(w: Column, last: Column) -> Column:
        return F.flatten(F.transform(w, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: add(F.get(last, i - 1), x)))))

    if levels == 1:
        return short(a)
    return let(a, lambda x: F.when(F.size(x) < 8, short(x)).otherwise(blocks(x)))


def up_to(sorted_longs: Column, at: Column) -> Column:
    """How many of the longs are at most ``at``, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.size(sorted_longs).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        right = F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        left = F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(F.get(sorted_longs, mid) <= at, right).otherwise(left)

    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(sorted_longs)))), start, halve, lambda s: s["lo"])


def sides(kinds: list[Column]) -> Column:
    """Each kind's spans with their starts and ends; spans of one kind never overlap, so both rise."""
    of = lambda a: F.struct(a.alias("all"), F.transform(a, lambda x: x["start"]).alias("starts"), F.transform(a, lambda x: x["end"]).alias("ends"))
    return F.array(*map(of, kinds))


def part(chunks: Column, at: Column, n: Column) -> Column:
    """``n`` code points of a chunked text from place ``at``; only their chunks are read."""
    first, last = F.floor(at / CHUNK), F.floor((at + n) / CHUNK)
    near = F.array_join(F.slice(chunks, first.cast("int") + 1, (last - first).cast("int") + 1), "")
    return F.substring(near, (at - first * CHUNK).cast("int") + 1, n.cast("int"))


def chunked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """Leftmost matches that do not overlap, and the pieces between them; only texts under ``guard`` are searched."""
    return F.when(guard, F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")))


def with_spans(df: DataFrame, searches: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds ``c_<name>``, the matches of each search as (kind, start, end, s).

    Pieces and matches add up to the places; all searches' sums are one expression,
    which would take seconds to plan for each.
    """
    df = df.select("*", *(found.alias(f"m_{name}") for name, (_, found) in searches.items()))
    lengths = lambda m: F.coalesce(F.transform(m["found"], lambda s, i: (F.length(F.get(m["gaps"], i)) + F.length(s)).cast("bigint")), F.expr("cast(array() as array<bigint>)"))
    df = df.withColumn("ends", F.transform(F.array(*(lengths(F.col(f"m_{name}")) for name in searches)), lambda x: running(x, lambda a, b: a + b)))

    def spans(name: str, kind: str, number: int) -> Column:
        def one(s: Column, end: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), (end - F.length(s)).alias("start"), end.alias("end"), s.alias("s"))

        placed = F.transform(F.col(f"m_{name}.found"), lambda s, i: one(s, F.get(F.get("ends", F.lit(number)), i)))
        return F.coalesce(placed, F.expr(NONE)).alias(f"c_{name}")

    return df.select("*", *(spans(name, kind, i) for i, (name, (kind, _)) in enumerate(searches.items()))).drop("ends", *(f"m_{name}" for name in searches))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less nine where over nine; the sum ends in 0."""
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def holds(kind: str, s: Column) -> Column:
    """The contract's check of one candidate."""
    n = F.length(digits_of(s))
    if kind == "ip":
        return s.rlike(OCTETS)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits_of(s))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def proposals(df: DataFrame) -> DataFrame:
    """Adds ``base`` and ``more``: arrays of spans, from the column ``t``."""
    t = F.col("t")
    joined = F.when(t.rlike("[0-9]{2}|[0-9][ -][0-9]"), F.regexp_replace(F.translate(t, JOIN, "?"), "(?<=[0-9])[ -](?=[0-9])", JOIN)).otherwise(F.lit(""))
    df = df.withColumn("j", joined)
    j = F.col("j")
    some = lambda p: t.rlike(p)
    searches = {
        "email": ("email", matches(t, EMAIL, t.contains("@"))),
        "ip": ("ip", matches(t, IP, some(r"[0-9]\.[0-9]"))),
        "card": ("card", matches(j, DIGITS, j.rlike(f"[0-9{JOIN}]{{8}}"))),
        "phone": ("phone", matches(t, PHONE, t.contains("+"))),
        "secret": ("secret", matches(t, SECRET, some("[A-Za-z0-9_+/-]{20}"))),
        "local": ("local_phone", matches(t, LOCAL_PHONE, some("[0-9][ .-][0-9]{4}"))),
        "national": ("national_id", matches(t, NATIONAL, some("[0-9]{2}(-[0-9]{4}|[A-Z0-9]{11})"))),
    }
    df = with_spans(df, searches)
    long_runs = F.filter("c_card", lambda x: F.length(digits_of(x["s"])).between(8, 19))
    accounts = F.transform(long_runs, lambda x: x.withField("kind", F.lit("account")))
    checked = lambda kind: F.filter(f"c_{kind}", lambda x: holds(kind, x["s"]))
    df = df.select("*", *(checked(k).alias(f"b_{k}") for k in KINDS))
    df = df.select("*", F.concat(*(f"b_{k}" for k in KINDS)).alias("base"), F.concat(accounts, "c_secret", "c_local", "c_national").alias("proposed"))

    def meets(x: Column, of: Column) -> Column:
        """Whether the first span that ends behind x's start begins before x's end."""
        return F.coalesce(F.get(of["starts"], up_to(of["ends"], x["start"])) < x["end"], F.lit(False))

    def clear(bases: Column) -> Column:
        return F.filter("proposed", lambda x: ~F.exists(bases, lambda of: meets(x, of)))

    more = F.when((F.size("base") == 0) | (F.size("proposed") == 0), F.col("proposed")).otherwise(let(sides([F.col(f"b_{k}") for k in KINDS]), clear))
    made = [*(f"c_{k}" for k in searches), *(f"b_{k}" for k in KINDS)]
    return df.withColumn("more", more).drop("j", "proposed", *made)


#: Features of a candidate from its kind, its text and the text around it; whole numbers.
def features(kind: Column, s: Column, before: Column, after: Column) -> dict[str, Column]:
    yes = lambda c: c.cast("int")
    low = F.lower(before)
    return {
        "is_account": yes(kind == "account"), "is_secret": yes(kind == "secret"), "is_phone": yes(kind == "local_phone"), "is_national": yes(kind == "national_id"),
        "length": F.length(s), "digits": F.length(digits_of(s)), "letters": F.length(F.regexp_replace(s, "[^A-Za-z]", "")),
        "hex": yes(s.rlike("^[0-9a-fA-F]+$")), "mixed": yes(s.rlike("[0-9]") & s.rlike("[A-Za-z]")),
        "changes": F.size(F.split(s, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")),
        "groups": F.size(F.split(s, f"[ .{JOIN}-]")),
        "assigned": yes(before.rlike("[=:][ ]?[\"']?$")), "quoted": yes(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "said_secret": yes(low.rlike("token|secret|passw|api|key|bearer|auth")),
        "said_phone": yes(low.rlike("tel|phone|call|fax|mobile|cell")),
        "said_account": yes(low.rlike("account|card|acct|iban|bank|konto|compte|cuenta")),
        "said_id": yes(low.rlike("ssn|social|passport|national|tax")),
        "said_other": yes(low.rlike("order|invoice|version|isbn|page|commit|sha|md5|part|item|build|serial|ref")),
    }


@dataclass(frozen=True)
class Tree:
    """If a < x: the left pair of values, else the right pair, each split by another feature."""

    feature: str
    cut: float
    sides: tuple[tuple[str, float, float, float], tuple[str, float, float, float]]


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree, ...]
    slope: float
    shift: float
    threshold: float

    def margin(self) -> str:
        """The sum of the trees as SQL over the features' names."""
        side = lambda s: f"if({s[0]} > {s[1]}, {s[3]!r}D, {s[2]!r}D)"
        return " + ".join([f"{self.start!r}D", *(f"if({t.feature} > {t.cut}, {side(t.sides[1])}, {side(t.sides[0])})" for t in self.trees)])

    def probability(self) -> str:
        return f"1D / (1D + exp(-({self.slope!r}D * ({self.margin()}) + {self.shift!r}D)))"


def examples(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = 7) -> DataFrame:
    """Labelled candidates (kind, s, before, after, y) that Spark generates from a seed."""
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    pick = lambda k, words: F.get(F.array(*map(F.lit, words)), draw(k, len(words)).cast("int"))
    hexes = F.lower(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"x{seed}")), 256))
    base64 = F.translate(F.base64(F.sha2(F.col("id").cast("string"), 256).cast("binary")), "=", "")
    number = lambda k, n: F.substring(F.translate(F.sha2(F.concat_ws("-", "id", F.lit(f"{k}{seed}")), 256), "abcdef", "123456"), 1, n)
    plain = ("and then the ", "with of the ", "est que la ", "und der die ", "")
    fours = F.concat_ws(JOIN, *(number(f"f{i}", 4) for i in range(4)))
    kinds = (
        ("secret", F.substring(hexes, 1, 40), pick(1, ('token = "', 'secret: "', "api_key=", 'password = "', "Bearer ", 'key = "')), pick(2, ('"', '" and', "")), 1),
        ("secret", F.substring(base64, 3, 36), pick(1, ('token = "', "secret=", 'auth: "', "passwd = ")), pick(2, ('"', '" the', " of")), 1),
        ("secret", pick(3, ("internationalization-aware", "well-known-and-much-used-words", "https/example/path/of/pages", "______________________________", "-----------------------------", "thisisaverylongwordofletters")), pick(1, plain), pick(2, (" and", ".", "")), 0),
        ("secret", F.substring(hexes, 1, 40), pick(1, ("commit ", "sha1 of ", "md5 ", "build ")), pick(2, (" and", ".")), 0),
        ("account", F.substring(number("a", 19), 1, 16), pick(1, plain), pick(2, (" and", ".", "")), 1),
        ("account", fours, pick(1, ("card ", "account: ", "", "the ")), pick(2, (" and", "")), 1),
        ("account", F.substring(number("a", 19), 1, 10), pick(1, ("account ", "konto ", "acct: ", "bank account no ")), pick(2, (" and", "")), 1),
        ("account", F.substring(number("b", 19), 1, 9), pick(1, ("order ", "invoice ", "version ", "part ", "isbn ", "the ", "page ")), pick(2, (" and", ".")), 0),
        ("account", F.concat(number("c", 4), F.lit(JOIN), number("d", 4)), pick(1, ("years ", "pages ", "the ", "from ")), pick(2, (" and", ".")), 0),
        ("local_phone", F.concat(F.lit("("), number("e", 3), F.lit(") "), number("g", 3), F.lit("-"), number("h", 4)), pick(1, ("call ", "tel: ", "phone ", "", "on the ")), pick(2, (" and", ".")), 1),
        ("local_phone", F.concat_ws("-", number("e", 3), number("g", 3), number("h", 4)), pick(1, ("call ", "tel: ", "phone ", "", "mobile ")), pick(2, (" and", ".")), 1),
        ("local_phone", F.concat_ws(" ", number("e", 3), number("g", 3), number("h", 4)), pick(1, ("order ", "part ", "item ", "serial ")), pick(2, (" and", ".")), 0),
        ("national_id", F.concat_ws("-", number("e", 3), number("g", 2), number("h", 4)), pick(1, ("ssn ", "social security ", "tax id ", "the ", "")), pick(2, (" and", ".")), 1),
        ("national_id", F.concat(F.lit("DE"), number("i", 20)), pick(1, ("iban ", "account ", "the ")), pick(2, (" and", ".")), 1),
        ("national_id", F.concat_ws("-", number("e", 3), number("g", 2), number("h", 4)), pick(1, ("part ", "item ", "serial ", "ref ")), pick(2, (" and", ".")), 0),
    )
    which = draw(0, len(kinds))
    made = F.coalesce(*(F.when(which == i, F.struct(F.lit(k).alias("kind"), s.alias("s"), b.alias("before"), a.alias("after"), F.lit(y).alias("y"))) for i, (k, s, b, a, y) in enumerate(kinds)))
    return spark.range(rows).select("id", made.alias("x")).select("id", "x.*")


def fit(rows: Sequence[tuple[dict[str, int], int]], rounds: int = ROUNDS, rate: float = RATE, precision: float = PRECISION) -> Model:
    """Logistic boosting with trees of depth two; every fifth example is held out for calibration."""
    import numpy as np

    names = list(rows[0][0])
    x = np.array([[r[n] for n in names] for r, _ in rows], dtype=float)
    y = np.array([v for _, v in rows], dtype=float)
    held = np.arange(len(y)) % 5 == 0
    xt, yt = x[~held], y[~held]
    cuts = [np.unique(xt[:, j])[:-1][:: max(1, len(np.unique(xt[:, j])) // 16)] for j in range(len(names))]
    rate_of = min(max(yt.mean(), 1e-3), 1 - 1e-3)
    start = math.log(rate_of / (1 - rate_of))

    def split(rows_of, g, h):
        """The best (gain, feature, cut) for gradients g and curvatures h."""
        best = (0.0, 0, float(xt[:, 0].max()))
        for j, at in enumerate(cuts):
            for c in at:
                left = rows_of & (xt[:, j] <= c)
                right = rows_of & ~left
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1.0) for m in (left, right))
                best = max(best, (float(gain), j, float(c)), key=lambda v: v[0])
        return best

    def leaf(m, g, h) -> float:
        return round(rate * float(g[m].sum() / (h[m].sum() + 1.0)), 6)

    trees, f = [], np.full(len(yt), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = yt - p, p * (1 - p)
        everything = np.ones(len(yt), dtype=bool)
        _, j, c = split(everything, g, h)
        sides = []
        for m in (xt[:, j] <= c, xt[:, j] > c):
            _, k, d = split(m, g, h)
            low, high = m & (xt[:, k] <= d), m & (xt[:, k] > d)
            sides.append((names[k], d, leaf(low, g, h), leaf(high, g, h)))
            f[low] += sides[-1][2]
            f[high] += sides[-1][3]
        trees.append(Tree(names[j], c, tuple(sides)))

    def margin(v) -> float:
        r = dict(zip(names, v, strict=True))
        total = start
        for t in trees:
            k, d, low, high = t.sides[int(r[t.feature] > t.cut)]
            total += high if r[k] > d else low
        return total

    m, yh = np.array([margin(v) for v in x[held]]), y[held]
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of Platt's two parameters, with a light pull towards (1, 0)
        p = 1 / (1 + np.exp(-(slope * m + shift)))
        w = p * (1 - p)
        g = np.array([((yh - p) * m).sum() - (slope - 1), (yh - p).sum() - shift])
        hess = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
        step = np.linalg.solve(hess, g)
        slope, shift = slope + step[0], shift + step[1]
        if abs(step).max() < 1e-9:
            break
    p = 1 / (1 + np.exp(-(slope * m + shift)))
    good = [c for c in np.arange(0.3, 0.96, 0.05) if (p >= c).any() and yh[p >= c].mean() >= precision]
    return Model(round(start, 6), tuple(trees), round(float(slope), 6), round(float(shift), 6), round(float(good[0]) if good else 0.95, 2))


def fitted(spark: SparkSession) -> Model:
    made = examples(spark)
    cols = features(F.col("kind"), F.col("s"), F.col("before"), F.col("after"))
    rows = made.select("id", "y", *(c.alias(n) for n, c in cols.items())).orderBy("id").limit(TRAIN_ROWS).collect()
    return fit([({n: r[n] for n in cols}, r["y"]) for r in rows])


def scored(df: DataFrame, model: Model) -> DataFrame:
    """Replaces ``more`` by the chosen spans: above the threshold, and better than those they overlap."""
    def score(x: Column, chunks: Column) -> Column:
        lead = F.least(x["start"], F.lit(CONTEXT))
        near = F.struct(part(chunks, x["start"] - lead, lead).alias("before"), part(chunks, x["end"], F.lit(4)).alias("after"))
        cols = lambda n: F.struct(*(c.alias(name) for name, c in features(x["kind"], x["s"], n["before"], n["after"]).items()))
        return let(let(near, cols), lambda f: probability(model, f))

    p = let(chunked(F.col("t")), lambda chunks: F.transform("more", lambda x: x.withField("p", score(x, chunks))))
    df = df.withColumn("more", F.when(F.size("more") > 0, F.filter(p, lambda x: x["p"] >= model.threshold)))
    better = lambda x, o: (o["p"] > x["p"]) | ((o["p"] == x["p"]) & (F.struct(o["start"], o["kind"]) < F.struct(x["start"], x["kind"])))

    def beaten(x: Column, of: Column) -> Column:
        """Whether a better span of one kind overlaps x; those that overlap it stand together."""
        first, end = up_to(of["ends"], x["start"]), up_to(of["starts"], x["end"] - 1)
        met = let(first, lambda f: F.slice(of["all"], f + 1, F.greatest(end - f, F.lit(0))))
        return F.exists(met, lambda o: better(x, o))

    def alone(kinds: Column) -> Column:
        return F.filter("more", lambda x: ~F.exists(kinds, lambda of: beaten(x, of)))

    of = lambda kind: F.filter("more", lambda x: x["kind"] == kind)
    each = sides([of(k) for k in MORE])
    return df.withColumn("more", F.when(F.size("more") > 1, let(each, alone)).when(F.size("more") == 1, F.col("more")))


def probability(model: Model, f: Column) -> Column:
    def side(s) -> Column:
        return F.when(f[s[0]] > s[1], s[3]).otherwise(s[2])

    total = F.lit(model.start)
    for t in model.trees:
        total = total + F.when(f[t.feature] > t.cut, side(t.sides[1])).otherwise(side(t.sides[0]))
    return 1.0 / (1.0 + F.exp(-(total * model.slope + model.shift)))


def listed(spans: Column) -> Column:
    """kind:start:end by kind and start, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def by_kind(spans: Column, kinds: Sequence[str]) -> Column:
    of = lambda kind: F.sort_array(F.filter(spans, lambda x: x["kind"] == kind))
    return F.concat(*map(of, kinds))


def searched(df: DataFrame, model: Model | None = None) -> DataFrame:
    """Adds ``base`` and ``more`` for the column ``t``; base is in the listed order."""
    model = model or fitted(df.sparkSession)
    out = scored(proposals(df), model)
    chosen = F.transform(F.coalesce("more", F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint, s: string, p: double>>)")), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s")))
    return out.withColumn("more", by_kind(chosen, MORE))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each document: counts, the digest of the base spans, and all spans."""
    df = searched(docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("t")), model)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_more"),
    )


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in angle brackets; other columns stay."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    df = searched(docs.select(row.alias("row"), text_of(docs).alias("t")), model)

    def cut(spans: Column) -> Column:
        """Overlapping spans are cut as one, under the first one's kind."""
        t = F.col("t")

        def pieces(x: Column) -> Column:
            """The text before each span and the span's mark, and the text behind the last one."""
            def piece(span: Column, i: Column) -> Column:
                return let(F.coalesce(F.get(x["ends"], i - 1), F.lit(0).cast("bigint")), lambda at: F.concat(part(x["chunks"], at, F.greatest(span["start"] - at, F.lit(0))), F.when(span["start"] >= at, F.concat(F.lit("<"), span["kind"], F.lit(">"))).otherwise("")))

            last = F.element_at(x["ends"], -1)
            return F.concat(F.array_join(F.transform(spans, piece), ""), part(x["chunks"], last, F.length(t) - last))

        ends = running(F.transform(spans, lambda x: x["end"]), F.greatest)
        return let(F.struct(ends.alias("ends"), chunked(t).alias("chunks")), pieces)

    placed = F.array_sort(F.transform(F.concat("base", "more"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    df = df.select("row", "t", placed.alias("placed"))
    text = F.when(F.size("placed") > 0, cut(F.col("placed"))).otherwise(F.col("row.text"))
    return df.select(*((text if c.lower() == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))
