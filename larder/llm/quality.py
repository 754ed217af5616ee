"""Quality rules: a threshold table compiled into one Spark projection.

A rule names two integer measures of a text and the largest (or least) allowed
ratio between them, written as whole numbers so that every engine decides alike:
``Rule("symbols", "n_symbols", "n_words", most=(1, 10))`` rejects a text with
``10 * n_symbols > 1 * n_words``.  All measures are built-in functions; there is
no shuffle and no user function, so the plan is a scan and projections.

Defined results: a null or empty text has no words, fails the base rule and is
not kept; repeated rows give repeated rows; columns other than ``doc_id`` and
``text`` are ignored by :func:`measure` and kept, whatever their names, by
:func:`quality_filter`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import SPACE, let, text_of

SYMBOLS = r"[#*$%&|<>]"
CAPITALS = "[A-Z]"
WORD_CHAR = r"[^\x20\x09-\x0D]"

# Frequent function words of English, French, Spanish and German.
STOP_WORDS = tuple(
    "the of and to in is that for on with as are was be this it by at from or an a not have has "
    "de la le les des et en un une du que qui dans pour par sur est au aux se ce il elle "
    "el los las por con para del no su al lo como y o "
    "der die das und von zu den mit sich ist ein eine dem nicht auch im als für auf".split()
)


@dataclass(frozen=True)
class Rule:
    """``num / den`` must stay within ``most`` and ``least``, each (a, b) for a / b."""

    name: str
    num: str
    den: str
    most: tuple[int, int] | None = None
    least: tuple[int, int] | None = None
    min_words: int = 0

    def broken(self) -> str:
        """The SQL condition under which the rule rejects a text; Spark and DuckDB read it alike."""
        parts = []
        if self.most:
            parts.append(f"{self.most[1]} * {self.num} > {self.most[0]} * {self.den}")
        if self.least:
            parts.append(f"{self.least[1]} * {self.num} < {self.least[0]} * {self.den}")
        said = " or ".join(parts)
        return f"(n_words >= {self.min_words} and ({said}))" if self.min_words else f"({said})"


#: The contract's own rules.
BASE_RULES = (
    Rule("too_short", "n_words", "1", least=(50, 1)),
    Rule("repeated_words", "n_repeat_words", "n_words", most=(50, 100)),
)

#: The method's table.
RULES = (
    Rule("word_length", "word_chars", "n_words", most=(12, 1), least=(5, 2)),
    Rule("symbols", "n_symbols", "n_words", most=(1, 10)),
    Rule("stop_words", "n_stop", "n_words", least=(5, 100), min_words=80),
    Rule("capitals", "n_upper", "word_chars", most=(3, 10)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=(40, 100)),
)


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def window_hashes(words: Column, n: Column) -> Column:
    """A hash for each window of three words; ``words`` holds the words' own hashes."""
    each = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, each).otherwise(F.expr("cast(array() as array<bigint>)"))


def repeated_word_count(hashes: Column) -> Column:
    """Words in windows of three that are found twice or more, from the windows' hashes.

    (hash, place) pairs are sorted, so equal windows are neighbours and no list
    is searched for each of its members; texts without equal windows skip that.
    """

    def covered(pairs: Column) -> Column:
        at = lambda i: F.get(pairs, i)["h"]
        same = lambda x, i: F.coalesce(at(i + 1) == x["h"], F.lit(False)) | ((i > 0) & (at(F.greatest(i - 1, F.lit(0))) == x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(F.filter(pairs, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, covered)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the integer measures of each text, one row for each input row."""
    text = text_of(docs)
    df = docs.select(docs["doc_id"].alias("doc_id"), text.alias("t"))
    df = df.select(
        "doc_id",
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(CAPITALS)).cast("long").alias("n_upper"),
        word_array(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD_CHAR)).alias("lines"),
    )
    n = F.size("w")
    df = df.select(
        "doc_id", "n_symbols", "n_upper", F.length(F.array_join("w", "")).cast("long").alias("word_chars"), n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("hw"),
    )
    df = df.withColumn("windows", window_hashes(F.col("hw"), F.size("hw"))).drop("hw")
    return df.withColumn("n_repeat_words", repeated_word_count(F.col("windows"))).drop("windows")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Measures and verdicts: base_failed, kept, and the broken rules' names."""
    all_broken = F.array_compact(F.array(*(F.when(F.expr(r.broken()), r.name) for r in (*base, *rules))))
    base_failed = F.expr(" or ".join(r.broken() for r in base))
    df = measure(docs).withColumns({"base_failed": base_failed, "broken": F.array_join(all_broken, ",")})
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("broken") == "").alias("kept"), "n_lines", "n_stop", "n_upper", F.col("broken").alias("broken_rules"))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that break no rule, with their own columns.

    The verdict is taken in the same projection as the row itself (the row is
    carried as one struct), so there is no join back by id.  A row leaves by the
    outer explode of an empty array: a plain filter would be pushed below the
    projections and take every measure apart once more inside each loop.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    carried = docs.select(row.alias("doc_id"), text_of(docs).alias("text"))
    kept = F.when(F.col("kept"), F.array("doc_id"))
    return quality(carried, rules).select(F.explode_outer(kept).alias("row")).where("row is not null").select("row.*")


ORACLE = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from d),
g as (select rid, w, unnest(range(1, len(w) - 1)) as i from w),
f as (select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as n from g),
r as (select rid, count(distinct p) as n_repeat_words
      from (select rid, unnest([i, i + 1, i + 2]) as p from f where n > 1) group by rid),
m as (select doc_id, len(w)::bigint as n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
             len(lines)::bigint as n_lines,
             len(list_filter(w, lambda x: lower(x) in ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::bigint as n_stop,
             (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint as n_upper
      from w left join r using (rid)),
b as (select *, concat_ws(',', {", ".join(f"case when {r.broken()} then '{r.name}' end" for r in (*BASE_RULES, *RULES))}) as broken_rules from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({" or ".join(r.broken() for r in BASE_RULES)}) as base_failed, broken_rules = '' as kept,
       n_lines, n_stop, n_upper, broken_rules
from b
"""
