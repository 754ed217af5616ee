"""Runs of periodic words in whole texts, by Main and Lorentz's divide and conquer.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) that no neighbouring word extends; it counts here if it holds its
period ``TIMES`` times and has ``LEAST`` words.

1. Words are interned: equal words of a text have equal numbers, without hashes.
2. :func:`stretches` leaves out words that no run can hold.  In a run every three
   consecutive words stand at least three times: with period 1 its first four
   triples are equal, and with period q > 1 it has at least 4q - 2 triples, so at
   least three in each class modulo q.  A word outside all such triples is in no
   run, so a run lies in one stretch of the others, and grows nowhere else.
3. :func:`runs_of` halves a stretch again and again.  At each midpoint the
   Z-function of the right half, and that of the left half read backwards, give
   for every period how far a repetition reaches that has two periods on that
   side; one of the two sides always has, as a run holds four.  What reaches far
   enough is extended over the midpoint, word by word.  A period whose two
   copies lie in a run of a smaller period at the same midpoint isn't the
   smallest one, and is passed over; intervals found twice count once.

Texts are independent rows, so nothing is shuffled.  Time is n log n in the
text's words.  A task holds the words of a part of a batch, or of one text,
as numbers, and each different word once.

Defined results: a null or empty text has no runs and an empty collapsed text;
repeated rows, ties and null ids give their own rows; other columns, also of
clashing names, are ignored; an empty table gives no rows; very long texts are
read whole (some 100 bytes a word while in work).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import arrow_batches, let, text_of
from larder.llm.words import parts

#: Words of the shortest run, and how often it holds its period.
LEAST, TIMES = 6, 4
#: Bytes of a text that are split at a time.
CHUNK = 1 << 20

RUN = "struct<start: long, length: long, period: long>"
FOUND = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"

Run = tuple[int, int, int]
_SPACE = re.compile(rb"[\x09-\x0D\x20]")


def interned(text: str) -> tuple[array, list[bytes]]:
    """The numbers of a text's words, and the words by number; ASCII white space separates."""
    data, numbers, ids = text.encode("utf-8", "surrogatepass"), {}, array("l")
    lo = 0
    while lo < len(data):
        # a part ends at white space
        at = _SPACE.search(data, lo + CHUNK)
        hi = at.start() if at else len(data)
        for word in data[lo:hi].split():
            ids.append(numbers.setdefault(word, len(numbers)))
        lo = hi
    return ids, list(numbers)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return number.astype(np.int64), count


def stretches(texts: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """For each text the (first word, end) of what can hold a run."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    n = int(sizes.sum())
    if n < LEAST:
        return out
    ends = np.cumsum(sizes)
    known = np.cumsum([0] + [int(t.max()) + 1 if len(t) else 0 for t in texts])
    word = np.concatenate([t + base for t, base in zip(texts, known[:-1].tolist(), strict=True)])
    many = int(known[-1])
    if many**3 < 2**63:
        triple = (word[:-2] * many + word[1:-1]) * many + word[2:]
    else:  # pairs first, so that the key stays below 64 bits
        pair, _ = _numbered(word[:-1] * many + word[1:])
        triple = pair[:-1] * many + word[2:]
    number, count = _numbered(triple)
    held = np.zeros(n + 3, dtype=np.int64)
    # triples over two texts have words of both, so they stand once
    at = np.flatnonzero(count[number] >= 3)
    np.add.at(held, at, 1)
    np.add.at(held, at + 3, -1)
    inside = np.concatenate([[False], np.cumsum(held[:n]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        i = int(np.searchsorted(ends, lo, side="right"))
        while lo < hi:  # neighbouring texts may touch
            end, base = min(hi, int(ends[i])), int(ends[i] - sizes[i])
            if end - lo >= LEAST:
                out[i].append((lo - base, end - base))
            lo, i = end, i + 1
    return out


def reach(words: list[int], most: int) -> list[tuple[int, int]]:
    """The Z-function where it isn't zero: (shift, common prefix with the shifted words), up to ``most`` shifts."""
    n, found, values = len(words), [], {}
    left = right = 0
    first, shift = words[0], 0
    while True:
        try:
            shift = words.index(first, shift + 1, most + 1)
        except ValueError:
            return found
        z = min(right - shift, values.get(shift - left, 0)) if shift < right else 0
        while shift + z < n and words[z] == words[shift + z]:
            z += 1
        if shift + z > right:
            left, right = shift, shift + z
        values[shift] = z
        found.append((shift, z))


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every run, ordered."""
    found: set[Run] = set()
    todo = [(0, len(words))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        mid, most = (lo + hi) // 2, (hi - lo) // times
        todo += [(lo, mid), (mid, hi)]
        covered = mid
        for q, z in reach(words[mid:hi], min(most, (hi - mid) // 2)):
            if z >= q and mid + 2 * q > covered:
                start, covered = mid, mid + q + z
                while start > lo and words[start - 1] == words[start + q - 1]:
                    start -= 1
                found.add((start, covered - start, q))
        covered = mid
        for q, z in reach(words[lo:mid][::-1], min(most, (mid - lo) // 2)):
            if z >= q and mid - 2 * q < covered:
                end, covered = mid, mid - q - z
                while end < hi and words[end] == words[end - q]:
                    end += 1
                found.add((covered, end - covered, q))
    # halves cut runs: what a neighbouring word extends was found whole at a midpoint above
    return sorted(r for r in found if r[1] >= max(least, times * r[2]) and _whole(words, r))


def _whole(words: list[int], run: Run) -> bool:
    start, length, q = run
    end = start + length
    return not (start and words[start - 1] == words[start + q - 1]) and not (end < len(words) and words[end] == words[end - q])


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, all runs by start and period, and the text without the repeats, its words joined by one space."""
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            texts, names = [], []
            for t in part.column(1):
                ids, words = interned(t.as_py())
                texts.append(np.frombuffer(ids, dtype=np.int64) if len(ids) else np.zeros(0, dtype=np.int64))
                names.append(words)
            found, left = [], []
            for ids, words, some in zip(texts, names, stretches(texts), strict=True):
                runs = [(lo + s, length, q) for lo, hi in some for s, length, q in runs_of(ids[lo:hi].tolist())]
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                kept = ids[collapsed(len(ids), runs)] if runs else ids
                left.append(b" ".join([words[i] for i in kept.tolist()]).decode("utf-8", "surrogatepass"))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(found, schema.field("runs").type), pa.array(left, pa.string())], schema=schema)

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return arrow_batches(texts).mapInArrow(scan, FOUND)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, of which one in ten gets a periodic end that its id and length decide; native expressions only."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text_of(docs), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        # a whole number of periods is repeated as words, and cut to the text's length
        again = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        tail = F.slice(again, F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")).otherwise(F.lit(""))

    text = F.when(h % 10 == 0, let(words, planted)).otherwise(text_of(docs))
    return docs.select(docs["doc_id"], text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of :func:`find`'s rows."""
    r = F.col("runs")
    best = F.array_min(F.transform(r, lambda x: F.struct((-x["length"]).alias("l"), x["start"].alias("start"), x["period"].alias("period"))))
    lines = F.array_join(F.transform(r, lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size(r).cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("b.l")
    return out.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"), F.floor(1000 * length / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Equal words at equal distances, gathered into stretches; the smallest period of nested ones stays.
ORACLE = r"""WITH crc AS (SELECT row_number() OVER () AS r, doc_id, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda x, b: list_reduce(range(8), lambda y, _: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(x, b)), 4294967295::BIGINT) AS x,
  coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
docs AS (SELECT r, doc_id, xor(x, 4294967295) AS h, w, len(w) AS n FROM crc),
cut AS (SELECT *, (h // 10) % greatest(n, 1) AS a FROM docs),
step AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cut),
word AS MATERIALIZED (SELECT r, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS w, n FROM (SELECT *, unnest(range(n)) AS i FROM step)),
equal AS (SELECT x.r, y.i - x.i AS q, x.i AS i FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 4),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM equal),
long AS MATERIALIZED (SELECT r, q, min(i) AS s, count(*) + q AS l FROM island GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r),
per AS (SELECT r, count(*) AS c, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t, min({'l': -l, 's': s, 'q': q}) AS b FROM runs GROUP BY r)
SELECT doc_id, coalesce(c, 0) AS n_runs, b.s AS start, -b.l AS length, b.q AS period, (1000 * -b.l) // b.q AS exponent_milli, sha256(coalesce(per.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM docs LEFT JOIN per USING (r) LEFT JOIN kept USING (r)"""
