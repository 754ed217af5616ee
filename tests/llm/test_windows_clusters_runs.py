"""Window packing, centroid clustering and periodic runs against slow versions, on odd inputs too."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import kmeans, periodic_runs, window_packing
from larder.llm.packing import default_tokenizer

ODD = "doc_id long, text string, start string, runs string, v string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(random.Random(3).choice("red green blue one two three".split()) for _ in range(40_000))
    rows = [(1, "one two three", "x"), (2, None, "x"), (3, "", "y"), (None, "no id", None), (5, long, "a"), (5, long, "a"), (6, " \t\n ", "b"), (7, "é ü 漢字 \x1c\x85 x", "c"), (8, "la " * 900, "d")]
    return spark.createDataFrame([(i, t, c, c, c) for i, t, c in rows], ODD)


# --- op11


def test_capacities_find_the_tightest():
    r = random.Random(1)
    for window in (1, 7, 64, 1000):
        tree, plain = window_packing.Capacities(window), []
        for k in range(500):
            if r.random() < 0.6:
                plain.append(r.randrange(1, window + 1))
                tree.add(plain[-1], k)
            least = r.randrange(1, window + 1)
            want = min((c for c in plain if c >= least), default=-1)
            assert tree.tightest(least) == want
            if want > 0 and r.random() < 0.4:
                plain.remove(want)
                tree.take(want)


def test_best_fit_equals_a_scan_of_all_open_windows():
    r = random.Random(2)
    for _ in range(50):
        lengths = [r.randrange(1, 100) for _ in range(r.randrange(80))]
        gaps, want = [], []
        for n in sorted(lengths, reverse=True):
            fit = [g for g in gaps if g >= n]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - n)
            else:
                gaps.append(100 - n)
        placed = window_packing.best_fit(lengths, 100)
        assert sorted(100 - window_packing.filled(of) for of in placed) == sorted(gaps)
        assert sorted(p for of in placed for p in of) == [(i, 0, n) for i, n in enumerate(lengths)]
        done = window_packing.closed(placed, 100)
        assert all(window_packing.filled(of) in (100, 64, 32, 16, 8, 4, 2, 1) for of in done)
        assert sum(window_packing.filled(of) < 100 for of in done) <= sum(0 < g < 100 and 100 - g in (64, 32, 16, 8, 4, 2, 1) for g in gaps) + 7
        parts = sorted(p for of in done for p in of)
        whole = {}
        for i, lo, hi in parts:
            assert lo == whole.get(i, 0)
            whole[i] = hi
        assert whole == dict(enumerate(lengths))


@pytest.mark.parametrize("held", [3, 16_384])
def test_pieces_give_all_ids_back(odd, held):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()) for r in odd.collect())
    rows = window_packing.packed(odd, held=held).collect()
    lengths, copies = {}, {}
    for r in rows:
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        copies.setdefault((r["doc_id"] is not None, r["doc_id"] or 0), []).append(r)
    for placed in lengths.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    for has, doc, ids in want:
        pieces, at = copies[has, doc], 0
        while at < len(ids) // 4:  # equal rows share their pieces' starts; take one of each
            r = next(p for p in pieces if p["start"] == at)
            pieces.remove(r)
            assert r["doc_tokens"] == len(ids) // 4 and r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
    assert not any(copies.values())


def test_no_documents_no_pieces(odd):
    assert window_packing.packed(odd.where("false")).count() == 0


# --- op12


def slow_clusters(vectors, k, rounds):
    """Plain Lloyd in Python's whole numbers; vectors are (id, list) in any order."""
    key = lambda x: (x[0] is None, hashlib.sha256(f"2:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1])
    centroids = [v for _, v in sorted(vectors, key=key)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for t in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (square(v, centroids[c]), c)) for _, v in vectors]
        if t < rounds:
            for c in range(len(centroids)):
                of = [v for (_, v), o in zip(vectors, own, strict=True) if o == c]
                if of:
                    centroids[c] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    return sorted(((i is not None, i or 0), o, square(v, centroids[o])) for (i, v), o in zip(vectors, own, strict=True)), centroids


def test_clusters_equal_plain_rounds_with_ties(spark):
    r = random.Random(9)
    for dim, spread, n, k in ((2, 3, 90, 7), (3, 1, 60, 12), (4, 500, 120, 9), (2, 4_000_000, 60, 5)):
        vectors = [(i % 50 if i % 13 else None, [r.randrange(-spread, spread + 1) for _ in range(dim)]) for i in range(n)]
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], "vec_id long, embedding array<double>").repartition(3)
        state, centroids = kmeans.clustered(df, k=k, rounds=4, dim=dim, scale=1)
        want, last = slow_clusters(vectors, k, 4)
        got = sorted(((x["vec_id"] is not None, x["vec_id"] or 0), x["cluster"], x["distance"]) for x in state.collect())
        assert got == want and centroids.tolist() == last


def test_bounds_skip_distances_but_change_nothing():
    r = np.random.default_rng(4)
    v = np.concatenate([r.integers(-20, 20, (300, 8)) + 1000 * c for c in range(6)])
    centroids = v[::300].copy()
    own, upper, lower, best, _ = kmeans.first_assignment(v, centroids)
    now = np.stack([v[own == c].sum(axis=0) // max(1, (own == c).sum()) for c in range(6)])
    moved = kmeans.root_up(((now - centroids) ** 2).sum(axis=1))
    a = kmeans.reassigned(v, own, upper, lower, now, moved)
    b = kmeans.first_assignment(v, now)
    assert (a[0] == b[0]).all() and (a[3] == b[3]).all()
    assert a[4].mean() < 1.5  # of 6


def test_vectors_that_are_left_out(spark):
    good, none = [0.5, -1.25], float("nan")
    rows = [(1, good), (2, None), (3, [0.5]), (4, [0.5, None]), (5, [none, 1.0]), (6, [float("inf"), 1.0]), (7, [0.5, -1.25, 0.0]), (8, []), (None, good), (1, good)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("cluster", F.lit("clash"))
    found = kmeans.assignments(df, k=3, dim=2).collect()
    assert sorted((r["vec_id"] or 0, r["cluster"], r["distance"], r["inertia"]) for r in found) == [(0, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0)]
    assert {r["centroid_sha256"] for r in found} == {hashlib.sha256(b"128,-320").hexdigest()}
    assert kmeans.assignments(df.where("false"), k=3, dim=2).count() == 0
    with pytest.raises(Exception, match="too large"):
        kmeans.assignments(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), k=1, dim=2).count()


# --- op13


def slow_runs(words):
    """Every period and start by comparing words; the smallest period of nested runs stays."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(s <= i and s + k >= i + length for s, k, _ in out):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def periodic(r):
    words = []
    for _ in range(r.randrange(7)):
        part = [f"w{r.randrange(3)}" for _ in range(r.randrange(1, 6))]
        words += (part * 8)[: r.randrange(1, 8 * len(part))] if r.random() < 0.6 else [f"w{r.randrange(9)}" for _ in part]
    return words


def test_runs_equal_comparison_of_all_periods(spark):
    r = random.Random(11)
    texts = [periodic(r) for _ in range(3000)]
    for words in texts:
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        assert periodic_runs.runs_of([numbers[w] for w in words]) == slow_runs(words)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts[:600])], "doc_id long, text string")
    for row in periodic_runs.find(docs).collect():
        words = texts[row["doc_id"]]
        runs = slow_runs(words)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        assert [tuple(x) for x in row["runs"]] == runs and row["n_words"] == len(words)
        assert row["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_odd_texts(odd):
    rows = {r["doc_id"]: r for r in periodic_runs.find(odd).collect()}
    assert [tuple(x) for x in rows[8]["runs"]] == [(0, 900, 1)] and rows[8]["collapsed"] == "la"
    assert all(rows[i]["runs"] == [] and rows[i]["collapsed"] == "" for i in (2, 3, 6))
    assert rows[None]["collapsed"] == "no id" and rows[7]["collapsed"] == "é ü 漢字 \x1c\x85 x"
    assert rows[5]["n_words"] == 40_000 and periodic_runs.find(odd).count() == 9
    ids = np.frombuffer(periodic_runs.interned(next(r["text"] for r in odd.collect() if r["doc_id"] == 5))[0], dtype=np.int64)
    long = []
    for q in range(1, len(ids) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids[:-q] == ids[q:], [0]])))
        long += [(s, e + q - s, q) for s, e in edges.reshape(-1, 2).tolist() if e + q - s >= max(6, 4 * q) and not any(a <= s and a + k >= e + q for a, k, _ in long)]
    assert [tuple(x) for x in rows[5]["runs"]] == sorted(long) != []
    digest = {r["doc_id"]: r for r in periodic_runs.digests(periodic_runs.find(odd)).collect()}
    assert (digest[8]["start"], digest[8]["length"], digest[8]["period"], digest[8]["exponent_milli"]) == (0, 900, 1, 900_000)
    assert digest[2]["start"] is None and digest[2]["runs_sha256"] == digest[2]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert periodic_runs.find(odd.where("false")).count() == 0


def test_planted_ends(spark):
    words = [f"w{i}" for i in range(97)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(300)] + [(i, " ") for i in range(300, 400)], "doc_id long, text string")
    planted = 0
    for r in periodic_runs.with_planted_runs(docs).collect():
        h = zlib.crc32(str(r["doc_id"]).encode())
        own = words if r["doc_id"] < 300 else []
        if h % 10:
            assert r["text"].split() == own
            continue
        g, n, planted = h // 10, len(own), planted + 1
        if n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r["text"].split(" ") == [w if i < a else own[a + (i - a) % p] for i, w in enumerate(own)]
        else:
            assert r["text"] == ""
    assert planted > 20


def test_long_and_periodic_texts_end():
    assert periodic_runs.runs_of([0] * 300_000) == [(0, 300_000, 1)]
    ids, words = periodic_runs.interned("ab  cd\n" * 300_000 + "x" * 3_000_000)
    assert len(ids) == 600_001 and words[:2] == [b"ab", b"cd"] and len(words[2]) == 3_000_000
