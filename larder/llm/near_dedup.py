"""Near-duplicate classes by ProbMinHash, banding and exact verification.

1. :func:`sketches` (Arrow, one row in, one row out) hashes each text's five-word
   shingles with their counts as weights.  Each shingle is a Poisson process
   whose rate is its weight; its arrivals fall on random registers, and it stops
   once it comes later than every register's first arrival.  A register's
   earliest shingle agrees between two texts with probability their probability
   Jaccard.  A sketch holds one hash per band of registers and 128 low bits.
2. Exact copies (equal words) fold into one node by a pre-aggregated ``min``; a
   node stands for a text, whatever ids it has, and only nodes go on.
3. In each band bucket every member is linked to the bucket's centre, the member
   with most company in all its buckets.  A group of copies so has the same few
   centres in all its buckets and few links a member; links that the low bits
   allow are verified on the whole texts; connected components follow.
4. Where the members under one centre still belong to several components, those
   outside the largest one are compared with all the others, so that no link is
   lost because a centre was too far away.  First their sketches are, four bits
   a register, in tiles of ``TILE`` members a side; texts of similarity 0.8 agree
   in fewer than ``AGREE`` registers once in 70,000 pairs, less similar templates
   hardly ever in so many.  Members with such a partner, and no others, are dealt
   with their shingles into cells of bounded size; a cell counts common shingles
   exactly and returns one link for each member and component, so a group of
   copies never becomes all its pairs.

Defined results: words are split at white space after lower-casing; a text of
fewer than five words has one shingle, all its words; texts without words (null
too) are copies of one another; repeated rows are members of one class; an id
that names several texts has a row for each of them, each with its text's class;
extra columns are ignored.  Rows without an id are linked like all others; a
class has the least id of its rows, null only where none of them has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm import words
from larder.llm.common import arrow_batches, small, staged, text_of
from larder.llm.words import BASE, mix

SHINGLE = 5
SIMILAR = 0.8
REGISTERS = 128
#: Registers in a band; 25 bands of 5 find a pair of similarity 0.8 with probability over 0.9999.
BAND = 5
#: Differing low bits allowed before verification: 12.8 are expected at similarity 0.8, deviation 3.4.
BITS_APART = 27
#: Registers of 128 that agree in their four low bits: 104 are expected at similarity 0.8, deviation 4.4.
AGREE = 86
#: Members of a tile's sides.
TILE = 8192
#: Shingles of a cell's blocks, about.
CELL = 100_000
#: Shingles that advance together in a sketch.
TOGETHER = 1 << 18

_U = np.uint64


def windows(tokens: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; for a shorter text one for all its words."""
    k = min(k, len(tokens))
    if not k:
        return tokens
    out = np.zeros(len(tokens) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = mix(out * _U(BASE) + tokens[i : len(tokens) - k + 1 + i])
    return out


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles' hashes in order, and their counts."""
    return np.unique(windows(words.hashed([text])[0], SHINGLE), return_counts=True)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements of 1 / sum over all elements of the larger ratio of weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    wa, wb = a[1].astype(float), b[1].astype(float)
    ra, rb = wa[i], wb[j]
    only_a, only_b = wa.sum() - ra.sum(), wb.sum() - rb.sum()
    # sum over elements of max(x / ra, y / rb): the common ones are sorted by y / x, so that prefix sums give each maximum
    order = np.argsort(rb / ra, kind="stable")
    x, y = ra[order], rb[order]
    from_b = np.cumsum(y[::-1])[::-1]  # where y / x is at least the element's own ratio, y counts
    from_a = np.concatenate([[0.0], np.cumsum(x)[:-1]])
    total = (only_a + from_a) / x + (only_b + from_b) / y
    return float((1.0 / total).sum())


def registers(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, m: int = REGISTERS) -> np.ndarray:
    """The earliest element in each register of each document, as [docs, m] hashes.

    ``doc`` names each element's document.  Elements advance together, one
    arrival a round, and leave once no register of their document can change.
    """
    first = np.full(docs * m, np.inf)
    who = np.zeros(docs * m, dtype=np.uint64)
    for lo in range(0, len(elements), TOGETHER):
        e, rate, of = elements[lo : lo + TOGETHER], weights[lo : lo + TOGETHER].astype(float), doc[lo : lo + TOGETHER]
        at = np.zeros(len(e))
        step = 0
        while len(e):
            r = mix(e + _U((step * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64))
            at = at - np.log1p(-(r >> _U(11)).astype(float) * 2.0**-53) / rate
            place = of * m + (mix(r) % _U(m)).astype(np.int64)
            live = at < first[place]
            np.minimum.at(first, place[live], at[live])
            won = live & (at == first[place])
            who[place[won]] = e[won]
            go = at < first.reshape(docs, m).max(axis=1)[of]
            e, rate, of, at = e[go], rate[go], of[go], at[go]
            step += 1
    return who.reshape(docs, m)


SKETCH = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("u", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("b1", pa.int64()), ("b2", pa.int64()), ("low", pa.list_(pa.int64())), ("size", pa.int64())])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t, u): t and u are two hashes that name a text wherever it stands."""
    text = text_of(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u"))


def listed(rows: np.ndarray) -> pa.ListArray:
    """A list for each row."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def sketches(texts: DataFrame) -> DataFrame:
    """One sketch for each row of :func:`keyed`."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.parts(batches):
            tokens, n = words.hashed(part.column("text").to_pylist())
            each = np.split(tokens, np.cumsum(n))[:-1]
            exact = np.array([divmod(xxhash.xxh3_128_intdigest(w.tobytes()), 1 << 64) for w in each], dtype=np.uint64).view(np.int64)
            found = [np.unique(windows(w, SHINGLE), return_counts=True) for w in each]
            doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            sig = registers(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), doc, len(found))
            band = np.zeros((len(found), REGISTERS // BAND), dtype=np.uint64)
            for i in range(BAND):
                band = mix(band * _U(BASE) + sig[:, i : band.shape[1] * BAND : BAND])
            band = mix(band + np.arange(band.shape[1], dtype=np.uint64))
            ends = (mix(sig) & _U(15)).astype(np.uint8)
            bits = np.packbits(ends & 1, axis=1).view(np.int64)
            low = np.ascontiguousarray(ends[:, ::2] << 4 | ends[:, 1::2]).view(np.int64)
            yield words.batch(SKETCH, doc_id=part.column("doc_id"), t=part.column("t"), u=part.column("u"), h1=exact[:, 0], h2=exact[:, 1], bands=listed(band.view(np.int64)), b1=bits[:, 0], b2=bits[:, 1], low=listed(low), size=[len(f[0]) for f in found])

    return arrow_batches(texts.select("doc_id", "t", "u", "text")).mapInArrow(sketch, "doc_id long, t long, u long, h1 long, h2 long, bands array<long>, b1 long, b2 long, low array<long>, size long")


def apart(a: str, b: str) -> Column:
    """Differing low bits of the sketches of sides ``a`` and ``b``."""
    return sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in ("b1", "b2")), F.lit(0))


def verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough; texts has a row for each node."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, tuple] = (None, ())
        for part in words.parts(batches, "tb", rows=128):
            good = []
            for a, ta, tb in zip(part.column("a").to_pylist(), part.column("ta"), part.column("tb"), strict=True):
                if last[0] != a:
                    last = (a, shingles(ta.as_py()))
                good.append(probability_jaccard(last[1], shingles(tb.as_py())) >= similar - 1e-9)
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return arrow_batches(both.select("a", "b", "ta", "tb")).mapInArrow(check, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): the least id reachable over the edges; min-label with pointer jumping.

    Each round every label takes the least label among its neighbours' and then
    its label's own label, so rounds grow with the logarithm of a path.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    if both.isEmpty():
        return nodes.select("id", F.col("id").alias("comp"))
    linked = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(linked.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        better = linked.join(near, "id").select("id", F.least("comp", "c").alias("new"), F.col("comp").alias("was"))
        jump = linked.select(F.col("id").alias("new"), F.col("comp").alias("up"))
        after = staged(better.join(jump, "new").select("id", F.least("new", "up").alias("comp"), "was"), "labels")
        linked = after.select("id", "comp")
        if after.where("comp <> was").isEmpty():
            break
    return nodes.join(linked, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def centred(members: DataFrame) -> DataFrame:
    """Distinct (c, id, far): each member under the centres of its buckets, and whether its low bits exclude a link to it.

    The centre is the member with most company: of a group of copies the one whose buckets hold most others.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowd = staged(members.join(sizes, "key"), "buckets")
    score = crowd.groupBy("id").agg(F.sum("n").alias("score"))
    ranked = crowd.drop("n").join(score, "id")
    centre = ranked.groupBy("key").agg(F.max(F.struct("score", "id", "b1", "b2")).alias("c")).select("key", "c.*")
    far = apart("m", "c") > BITS_APART
    return crowd.alias("m").join(centre.alias("c"), "key").select(F.col("c.id").alias("c"), F.col("m.id").alias("id"), far.alias("far")).distinct()


def shingled(texts: DataFrame) -> DataFrame:
    """(id, s, w): each text's shingles and their weights."""
    schema = pa.schema([("id", pa.int64()), ("s", pa.list_(pa.int64())), ("w", pa.list_(pa.int32()))])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.parts(batches):
            found = [shingles(t.as_py()) for t in part.column("text")]
            yield words.batch(schema, id=part.column("id"), s=[s.view(np.int64) for s, _ in found], w=[n for _, n in found])

    return arrow_batches(texts.select("id", "text")).mapInArrow(spread, "id long, s array<long>, w array<int>")


def tiles(under: DataFrame, comps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c, i, j, one, id, comp, own, low): the members under a centre whose sketches are to be compared.

    A tile has one part of those outside the largest component (``one``), and
    one of all members; ``own`` is the block of the member in :func:`cells`.  A
    centre with a single member is here only if no link between them was verified.
    """
    rows = staged(under.select("c", "id", "far").join(comps, "id").join(nodes.select("id", "size"), "id"), "members")
    of = rows.groupBy("c", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("far").alias("far"))
    of = of.groupBy("c").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("k"), F.max("far").alias("far"))
    of = of.where("k > 1 and (n > 2 or far)").select("c", F.col("main.comp").alias("main"), F.ceil(F.col("size") / CELL).alias("blocks"), F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    dealt = rows.join(of, "c").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    dealt = dealt.join(nodes.select("id", "low"), "id")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.where("comp <> main").select("c", F.col("part").alias("i"), other.alias("j"), F.lit(True).alias("one"), "id", "comp", "own", "low")
    return left.union(dealt.select("c", other.alias("i"), F.col("part").alias("j"), F.lit(False).alias("one"), "id", "comp", "own", "low"))


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of 128 in whose four low bits ``a`` agrees with each row of ``b``."""
    x = a ^ b
    x |= x >> _U(2)
    x |= x >> _U(1)
    return 128 - np.bitwise_count(x & _U(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def cells(tiled: DataFrame) -> DataFrame:
    """(c, i, j, one, id, comp): the members whose shingles are to be compared; those with ``one`` with the others of their cell."""

    def select(tile: pa.Table) -> pa.Table:
        one, ids, comp, own = (tile.column(c).to_numpy() for c in ("one", "id", "comp", "own"))
        low = tile.column("low").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        right = np.flatnonzero(~one)
        sketch, other, block = low[right], comp[right], own[right]
        lefts: list[tuple[np.ndarray, np.ndarray]] = []
        met: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(one):
            hit = (agreeing(low[k], sketch) >= AGREE) & (other != comp[k])
            if hit.any():
                at = np.unique(block[hit])
                lefts.append((np.full(len(at), k), at))
                met[own[k]] = met.get(own[k], False) | hit
        rights = [(i, right[hit]) for i, hit in met.items()]
        who = np.concatenate([ids[:0].astype(np.int64), *(k for k, _ in lefts), *(r for _, r in rights)])
        i = np.concatenate([own[:0], *(own[k] for k, _ in lefts), *(np.full(len(r), i, own.dtype) for i, r in rights)])
        j = np.concatenate([own[:0], *(at for _, at in lefts), *(own[r] for _, r in rights)])
        n = sum(len(k) for k, _ in lefts)
        return pa.table({"c": np.full(len(who), tile.column("c")[0].as_py()), "i": i, "j": j, "one": np.arange(len(who)) < n, "id": ids[who], "comp": comp[who]})

    return arrow_batches(tiled).groupBy("c", "i", "j").applyInArrow(select, "c long, i int, j int, one boolean, id long, comp long").distinct()


def similarities(x: np.ndarray, y: np.ndarray, of: np.ndarray, mine: float, theirs: np.ndarray) -> np.ndarray:
    """Probability Jaccard of one text with several: the weights x and y of each common element, and whose it is.

    Elements with equal weights on both sides add equal terms, so they are counted.
    """
    step = int(y.max()) + 1
    pairs, which = np.unique(x.astype(np.int64) * step + y, return_inverse=True)
    xs, ys = pairs // step, pairs % step
    larger = np.maximum(xs / xs[:, None], ys / ys[:, None])
    out = np.zeros(len(theirs))
    for lo in range(0, len(theirs), slab := max(1, 1_000_000 // len(pairs))):
        here = (of >= lo) & (of < lo + slab)
        n = min(slab, len(theirs) - lo)
        count = np.bincount((of[here] - lo) * len(pairs) + which[here], minlength=n * len(pairs)).reshape(n, -1).astype(float)
        total = (mine - count @ xs)[:, None] / xs + (theirs[lo : lo + n] - count @ ys)[:, None] / ys + count @ larger.T
        out[lo : lo + n] = (count / np.maximum(total, 1e-300)).sum(axis=1)
    return out


def compared(dealt: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(a, b): for each member one partner of each other component of its cell that is similar enough."""

    def compare(cell: pa.Table) -> pa.Table:
        one, ids, comp = (cell.column(c).to_numpy() for c in ("one", "id", "comp"))
        s, w = cell.column("s").combine_chunks(), cell.column("w").combine_chunks()
        size = np.diff(s.offsets.to_numpy())
        at = np.concatenate([[0], np.cumsum(size)])
        codes, weight = np.unique(s.flatten().to_numpy(), return_inverse=True)[1], w.flatten().to_numpy()
        held = np.zeros(codes.max() + 1 if len(codes) else 0, dtype=weight.dtype)
        right = np.flatnonzero(~one)
        take = np.concatenate([np.arange(at[r], at[r + 1]) for r in right]) if len(right) else at[:0]
        of = np.repeat(np.arange(len(right)), size[right])
        total = np.bincount(np.repeat(np.arange(len(size)), size), weights=weight, minlength=len(size))
        found: list[tuple[int, int]] = []
        for k in np.flatnonzero(one):
            mine = slice(at[k], at[k + 1])
            held[codes[mine]] = weight[mine]
            x = held[codes[take]]
            held[codes[mine]] = 0
            common = np.flatnonzero((x > 0) & (comp[right] != comp[k])[of])
            if len(common):
                close = similarities(x[common], weight[take[common]], of[common], total[k], total[right])
                done: set[int] = set()
                for r in right[np.flatnonzero(close >= similar - 1e-9)].tolist():
                    if comp[r] not in done:
                        done.add(comp[r])
                        found.append((ids[k], ids[r]))
        both = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": both.min(axis=1), "b": both.max(axis=1)})

    rows = arrow_batches(dealt.join(shingled(texts), "id"))
    return rows.groupBy("c", "i", "j").applyInArrow(compare, "a long, b long").distinct()


#: The row that stands for a group: that of the least id, rows without an id last.
ROW = "struct(doc_id is null as without, doc_id, t, u)"


def classified(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and for each text (h1, h2) its own ``row`` and its class's ``head`` (see ROW)."""
    texts = keyed(docs)
    sk = staged(sketches(texts), "sketches")
    groups = sk.groupBy("h1", "h2").agg(F.min(F.expr(ROW)).alias("row"), F.first("bands").alias("bands"), F.first("b1").alias("b1"), F.first("b2").alias("b2"), F.first("low").alias("low"), F.first("size").alias("size"))
    groups = staged(groups, "groups")
    # of texts whose first halves are equal by chance, all but one get another node
    again = groups.groupBy("h1").agg(F.count("*").alias("n"), F.min("h2").alias("one")).where("n > 1").select("h1", "one")
    if again.isEmpty():
        nodes = groups.withColumn("id", F.col("h1"))
    else:
        nodes = groups.join(again, "h1", "left").withColumn("id", F.when(F.col("one") != F.col("h2"), F.xxhash64("h1", "h2")).otherwise(F.col("h1"))).drop("one")
    members = nodes.select("id", F.explode("bands").alias("key"), "b1", "b2")
    named = nodes.select("id", "row.t", "row.u")
    under = staged(centred(members), "centres")
    links = under.where("not far and c <> id").select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")).distinct()
    edges = staged(checked(links, named, texts, similar), "near")
    comps = staged(components(nodes.select("id"), edges), "comps")
    dealt = staged(cells(tiles(under, comps, nodes)), "cells")
    if not dealt.isEmpty():
        extra = staged(compared(dealt, needed(dealt.select("id").distinct(), named, texts), similar), "near")
        comps = comps if extra.isEmpty() else staged(components(nodes.select("id"), edges.union(extra)), "comps")
    both = staged(nodes.select("h1", "h2", "id", "row").join(comps, "id"), "classes")
    heads = both.groupBy("comp").agg(F.min("row").alias("head"))
    return sk, both.join(heads, "comp").select("h1", "h2", "row", "head")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row for each document: doc_id, class_id (the class's least doc_id), copy_of, kept.

    ``copy_of`` is the least id of the document's exact copies; ``kept`` is true
    for one document of each class (and for rows that repeat its id and text).
    """
    sk, classes = classified(docs, similar)
    out = sk.select("doc_id", "t", "u", "h1", "h2").join(classes, ["h1", "h2"])
    return out.select("doc_id", F.col("head.doc_id").alias("class_id"), F.col("row.doc_id").alias("copy_of"), F.expr("doc_id <=> head.doc_id and t = head.t and u = head.u").alias("kept"))


def needed(ids: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, text) of the named nodes; only their texts are shuffled."""
    want = staged(nodes.join(ids, "id", "left_semi"), "named")
    found = staged(texts.select("t", "u", "text").join(small(want), ["t", "u"]).select("id", "text"), "texts")
    return found.groupBy("id").agg(F.first("text").alias("text"))


def checked(links: DataFrame, nodes: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Verified links."""
    named = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    return verified(links, needed(named, nodes, texts), similar)


def deduplicated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate class, with all their columns.

    Of rows that repeat the chosen id and text one stays; they are counted to
    find them, so that only such rows are shuffled.
    """
    sk, classes = classified(docs, similar)
    heads = classes.where("row = head").select(F.col("head.doc_id").alias("i"), F.col("head.t").alias("t"), F.col("head.u").alias("u"))
    seen = sk.groupBy(F.col("doc_id").alias("i"), "t", "u").agg((F.count("*") > 1).alias("again"))
    kept = staged(seen.join(heads.select(F.col("i").alias("hi"), "t", "u"), ["t", "u"]).where("i <=> hi").drop("hi"), "kept")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("t"), F.xxhash64(F.lit(1), text_of(docs)).alias("u"))
    rows = rows.join(small(kept), ["t", "u"]).where("doc_id <=> i")
    order = Window.partitionBy("doc_id", "t", "u").orderBy(F.lit(1))
    once = rows.where("again").withColumn("n", F.row_number().over(order)).where("n = 1")
    return rows.where("not again").select("row.*").union(once.select("row.*"))
