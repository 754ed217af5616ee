"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK walk reads a string of words: each step emits the word under the cursor
and moves on by a random bit that depends on the step and the word.  Two strings
at a small edit distance emit strings at a small Hamming distance, so sampling a
few emitted places is a locality-sensitive hash for edit distance.

Windows have the item's size: every item belongs to the largest class of ``SPANS``
that is at most ``FILL`` of its words, and is walked from anchors along its length;
every word of a text starts a window of each class in use.  Only what a walk emits
before the item's end is compared.  The samples a walk of each class gets follow
from ``TARGET``, the recall at the most allowed edits, which :func:`planned` measures
on random strings; an exact copy is always found.  A candidate is verified by the
exact least edit distance, in words, between the whole item and any part of the
text around it.

The benchmark is read in blocks of bounded size; a block's keys are broadcast and
every text is scanned against them, without a shuffle and without pairs.

Defined results: letters are lower-cased and ASCII punctuation separates words;
null and empty texts have no matches; items of fewer than ``LEAST_WORDS`` words
(null too) are evidence of nothing and match nothing; a document and item give
one row, at the first of the closest places; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import words
from larder.llm.common import arrow_batches, text_of
from larder.llm.words import SIGNS, mix

#: Edits allowed for each word of an item.
EDITS = 0.2
LEAST_WORDS = 4
#: Classes of windows, in words, each with the emitted places of one sample.
SPANS = {2: 2, 4: 2, 6: 3, 8: 3, 12: 4, 18: 4}
#: The share of its words that an item's window has at most; the rest leaves room for anchors.
FILL = 0.6
#: Recall at the most edits, and the walks and most samples of a walk that may be spent on it.
TARGET, WALKS, SAMPLES = 0.999, 2, 32
#: Anchors of an item, about.
ANCHORS = 16
#: An item block's bounds.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
#: Window starts that are walked at once; small enough for a CPU's cache.
CHUNK = 16_384

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
#: For each walk the sampled steps of each sample.
Plan = tuple[tuple[tuple[int, ...], ...], ...]


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and their number in each text; 0 stands between texts and is no word's."""
    tokens, n = words.hashed(texts, SIGNS)
    return tokens | _U(1), n


def word_hashes(text: str) -> np.ndarray:
    return hashes([text])[0]


def span_of(n: int) -> int:
    """The class of an item of n words."""
    return max(s for s in SPANS if s <= FILL * n)


def steps_of(span: int) -> int:
    """Steps that a walk may be sampled at: by then its cursor is still within the window, most times."""
    return span + span // 2


def allowed(n: int) -> int:
    """The most edits of an item of n words."""
    return int(EDITS * n)


def anchors_of(n: int, span: int) -> np.ndarray:
    return np.unique([*range(0, n - span, max(1, (n - span) // ANCHORS)), n - span])


def walk(tokens: np.ndarray, starts: np.ndarray, plans: dict[int, Plan], traced: bool = False) -> Iterator[tuple]:
    """(span, a key for each start) for every walk and sample; with ``traced`` the last cursor and the number of words sampled too.

    ``tokens`` ends with enough zeros for the longest walk.
    """
    for w in range(WALKS):
        bits = mix(tokens + _U(7 * w + 3))  # 64 random bits for each word, one for each step
        at, now, turn = starts.astype(np.int64), np.empty(len(starts), dtype=np.uint64), np.empty(len(starts), dtype=np.uint64)
        keys = {(s, i): np.full(len(starts), 1000 * s + 50 * w + i, dtype=np.uint64) for s, p in plans.items() for i in range(len(p[w]))}
        at_step: dict[int, list[tuple[int, int]]] = {}
        for s, i in keys:
            for step in plans[s][w][i]:
                at_step.setdefault(step, []).append((s, i))
        trace = {k: [] for k in keys}
        for step in range(max(at_step, default=-1) + 1):
            if step in at_step:
                np.take(tokens, at, out=now, mode="clip")
                for k in at_step[step]:
                    keys[k] += now
                    keys[k] *= _MUL
                    if traced:
                        trace[k].append(at.copy())
            np.take(bits, at, out=turn, mode="clip")
            turn >>= _U(step)
            turn &= _U(1)
            at += turn.view(np.int64)
        for k, key in keys.items():
            if traced:
                seen = np.array(trace[k])
                yield k[0], mix(key), seen[-1], 1 + (np.diff(seen, axis=0) > 0).sum(axis=0)
            else:
                yield k[0], mix(key)


def item_keys(items: list[np.ndarray], plans: dict[int, Plan]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class the keys of its items, with item and anchor.

    A key counts if its walk is still inside the item and it has sampled as many
    different words as the class asks for, or as the item's best key has.
    """
    out = {}
    span = np.array([span_of(len(w)) for w in items])
    for s in np.unique(span).tolist():
        of = np.flatnonzero(span == s)
        places = [anchors_of(len(items[k]), s) for k in of]
        pad = np.zeros(2 * s + 1, dtype=np.uint64)
        base = np.cumsum([0] + [len(items[k]) + len(pad) for k in of])[:-1]
        anchor = np.concatenate(places)
        row = np.repeat(np.arange(len(of)), [len(p) for p in places])
        end = base + [len(items[k]) for k in of]
        tokens = np.concatenate([x for k in of for x in (items[k], pad)])
        found = [(key, np.where(last < end[row], words_read, 0)) for _, key, last, words_read in walk(tokens, base[row] + anchor, {s: plans[s]}, traced=True)]
        keys, read = np.concatenate([k for k, _ in found]), np.concatenate([r for _, r in found])
        row, anchor = np.tile(row, len(found)), np.tile(anchor, len(found))
        best = np.zeros(len(of), dtype=np.int64)
        np.maximum.at(best, row, read)
        good = read >= np.maximum(1, np.minimum(best, min(SPANS[s], 3)))[row]
        out[s] = keys[good], of[row[good]], anchor[good]
    return out


@cache
def planned(span: int, target: float = TARGET, trials: int = 300) -> Plan:
    """Samples for one class: as few as find the target's share of random items at the most edits, at every length of the class."""
    rng = np.random.default_rng(span)
    most = [[tuple(sorted(rng.choice(steps_of(span), SPANS[span], replace=False).tolist())) for _ in range(SAMPLES)] for _ in range(WALKS)]
    lengths = [n for n in range(LEAST_WORDS, 2 * max(SPANS) + 1) if span_of(n) == span]
    hardest = sorted(lengths, key=lambda n: allowed(n) / n)[-3:]
    items = [rng.integers(1, 2**62, n).astype(np.uint64) for n in hardest for _ in range(trials)]
    texts = [np.concatenate([rng.integers(1, 2**62, 8).astype(np.uint64), edited(w, allowed(len(w)), rng), rng.integers(1, 2**62, 2 * span + 8).astype(np.uint64)]) for w in items]
    plan: Plan = ()
    for n in (2, 3, 4, 6, 8, 12, 16, 24, SAMPLES):
        plan = tuple(tuple(w[:n]) for w in most)
        index = item_keys(items, {span: plan})[span]
        own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        tokens = np.concatenate([*texts, np.zeros(2 * span + 1, dtype=np.uint64)])
        known = mix(index[0] + index[1].astype(np.uint64) * _MUL)
        found = {t for _, key in walk(tokens, np.arange(len(own)), {span: plan}) for t in np.unique(own[np.isin(mix(key + own.astype(np.uint64) * _MUL), known)]).tolist()}
        if len(found) >= target * len(items):
            break
    return plan


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """``item`` after so many random changes, removals and insertions of words."""
    out = item.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        out[at : at + (kind < 2)] = [] if kind == 1 else [int(rng.integers(1, 2**62))]
    return np.array(out, dtype=np.uint64)


@dataclass
class Index:
    """A block of items: their words, and for each class the keys that lead to (item, anchor)."""

    ids: list
    words: list[np.ndarray]
    plans: dict[int, Plan]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    owner: dict[int, np.ndarray] = field(default_factory=dict)
    anchor: dict[int, np.ndarray] = field(default_factory=dict)
    seen: dict[int, np.ndarray] = field(default_factory=dict)


def build_index(items: list[tuple[object, str | None]]) -> Index:
    tokens, n = hashes([t or "" for _, t in items])
    kept = [(i, w) for (i, _), w in zip(items, np.split(tokens, np.cumsum(n))[:-1], strict=True) if len(w) >= LEAST_WORDS]
    own = [w for _, w in kept]
    index = Index([i for i, _ in kept], own, {s: planned(s) for s in sorted({span_of(len(w)) for w in own})})
    for s, (keys, owner, anchor) in item_keys(own, index.plans).items() if own else ():
        order = np.argsort(keys, kind="stable")
        index.keys[s], index.owner[s], index.anchor[s] = keys[order], owner[order], anchor[order]
        index.seen[s] = np.zeros(1 << 20, dtype=bool)
        index.seen[s][keys >> _U(44)] = True
    return index


def place_of(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``window`` nearest to ``item``, if within ``most`` edits."""
    if len(set(item.tolist()).difference(window.tolist())) > most:
        return None  # each word that is missing costs an edit
    n = len(window)
    cost = np.zeros(n + 1, dtype=np.int64)
    start = np.arange(n + 1)
    step = np.arange(n + 1)
    for i, w in enumerate(item, 1):
        swap, drop = cost[:-1] + (window != w), cost[1:] + 1
        best = np.concatenate([[i], np.minimum(swap, drop)])
        came = np.concatenate([[0], np.where(swap <= drop, start[:-1], start[1:])])
        # insertions run to the right: the least of best - place so far
        level = best - step
        low = np.minimum.accumulate(level)
        src = np.maximum.accumulate(np.where(level == low, step, 0))
        cost, start = low + step, came[src]
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= most else None


def candidates(index: Index, tokens: np.ndarray, pad: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, item) of the windows that share a key with an item, as places of the item's start, each once."""
    for lo in range(0, len(tokens) - pad, CHUNK):
        hi = min(lo + CHUNK, len(tokens) - pad)
        places, owners = [], []
        for s, key in walk(tokens[lo : hi + pad], np.arange(hi - lo), index.plans):
            hit = np.flatnonzero(index.seen[s][key >> _U(44)])
            left, right = np.searchsorted(index.keys[s], key[hit], "left"), np.searchsorted(index.keys[s], key[hit], "right")
            n = right - left
            entry = np.arange(n.sum()) + np.repeat(left - np.cumsum(n) + n, n)
            places.append(np.repeat(hit + lo, n) - index.anchor[s][entry])
            owners.append(index.owner[s][entry])
        if places:
            yield tuple(np.unique(np.stack([np.concatenate(places), np.concatenate(owners)]), axis=1))


def matches(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, word after the last) for each matched text and item."""
    if not index.ids:
        return []
    found, n = hashes(texts)
    own = np.split(found, np.cumsum(n))[:-1]
    pad = np.zeros(2 * max(SPANS) + 1, dtype=np.uint64)
    tokens = np.concatenate([x for w in own for x in (w, pad)])
    begin = np.cumsum([0] + [len(w) + len(pad) for w in own])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for places, owners in candidates(index, tokens, len(pad)):
        size = np.array([len(w) for w in index.words])[owners]
        of = np.maximum(np.searchsorted(begin, places + size // 2, "right") - 1, 0)
        order = np.lexsort((places, owners, of))
        last: tuple[int, int] | None = None
        for t, k, at in [*zip(of[order].tolist(), owners[order].tolist(), (places - begin[of])[order].tolist(), strict=True), (-1, -1, 0)]:
            if (t, k) == last and at - hi <= len(index.words[k]):  # places close together are verified as one
                hi = at
                continue
            if last is not None:
                item, most = index.words[last[1]], allowed(len(index.words[last[1]]))
                start = max(0, lo - most)
                if near := place_of(item, own[last[0]][start : max(0, hi + len(item) + most)], most):
                    now = (near[0], start + near[1], start + near[2])
                    best[last] = min(best.get(last, now), now)
            last, lo, hi = (t, k), at, at
    return [(t, k, *v) for (t, k), v in sorted(best.items())]


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark's items as indexes of bounded size."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), text_of(benchmark).alias("text"))
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    n = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["chars"] or 0) // BLOCK_CHARS))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield build_index(sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=str))


SPAN = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64())])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    cast = arrow_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")))
    out = None
    for index in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in words.parts(batches):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[t], sent.value.ids[k], e, a, b) for t, k, e, a, b in matches(sent.value, part.column("text").to_pylist())]
                yield words.batch(SPAN, **{n: [r[i] for r in rows] for i, n in enumerate(SPAN.names)})

        found = cast.mapInArrow(scan, "doc_id long, item_id long, edits int, start_word long, end_word long")
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    name = next(c for c in docs.columns if c.lower() == "text")
    for index in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in words.parts(batches, name):
                keep = np.ones(len(part), dtype=bool)
                for t, *_ in matches(sent.value, [t or "" for t in part.column(name).to_pylist()]):
                    keep[t] = False
                yield part.filter(pa.array(keep))

        docs = arrow_batches(docs).mapInArrow(clean, docs.schema)
    return docs
