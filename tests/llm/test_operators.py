"""Corpus operators on small tables, against brute force or exact round trips."""

import hashlib
import bisect
import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import decontaminate, html_extract, licenses, near_dedup, packing, pii, quality, sharding, substring_dedup, suffixes, warc
from tests.oracle import compare

WORDS = [f"w{i}" for i in range(900)]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, an extra column with a clashing name."""
    long = text(1, 4000)
    rows = [(1, text(2, 120), "x"), (2, None, None), (3, "", "y"), (None, text(3, 90), "z"), (5, long, None), (5, long, None), (6, long, "q"), (7, "a.b@c.org 10.0.0.1", "k"), (7, text(4, 70), "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, `kept` string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_every_operator_takes_odd_and_empty_tables(spark, odd, none, tmp_path):
    items = spark.createDataFrame([(1, text(2, 40)), (2, None), (3, "short")], "item_id long, text string")
    for docs, n in ((odd, 9), (none, 0)):
        assert quality.quality(docs).count() == n
        assert near_dedup.near_duplicates(docs).count() == n
        assert near_dedup.deduplicated(docs).columns == docs.columns
        assert decontaminate.decontaminated(docs, items).columns == docs.columns
        assert licenses.licenses(docs).count() == n
        assert pii.find(docs).count() == n
        assert pii.redacted(docs).columns == docs.columns
        assert packing.packed(docs).count() >= n
        assert substring_dedup.passages(docs).count() >= 0
        assert substring_dedup.deduplicated(docs).columns == docs.columns
        pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h.org/a").alias("url"), F.col("text").alias("html"), "kept")
        assert html_extract.main_text(pages).count() == n
        assert warc.resolved(warc.page_captures(pages)).count() == 2 * n
        shards = sharding.ShardSet(spark, f"file://{tmp_path}/s{n}")
        shards.append(docs)
        assert shards.read().count() == n
    assert decontaminate.contamination(odd, items.where("false")).count() == 0


def test_quality_measures(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("a b c d # e$ \n f".split(" ")) for _ in range(r.randrange(120)))) for i in range(80)]
    got = {x["doc_id"]: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = {k + j for k, x in enumerate(win) if win.count(x) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (want[5] and got[i]["kept"])


def test_near_duplicates_against_all_pairs(spark):
    rows = []
    for g in range(25):
        base = text(100 + g, 160).split()
        for c in range(3):
            w = list(base)
            for _ in range(c * 2):
                w[random.Random(g * 7 + c).randrange(len(w))] = f"new{g}{c}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: near_dedup.shingles(t) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and near_dedup.probability_jaccard(sets[a], sets[b]) >= 0.8 - 1e-9:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {i: root(i) for i in parent}


def test_decontamination_finds_edited_items(spark):
    items = [(i, text(500 + i, 30)) for i in range(12)]
    docs = []
    for i, t in items:
        w = t.split()
        w[7] = "changed"
        del w[20]
        docs.append((i, f"{text(700 + i, 60)} {' '.join(w)} {text(800 + i, 60)}"))
    docs += [(100 + i, text(900 + i, 150)) for i in range(12)]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(12)} and all(r["edits"] == 2 for r in found)


def test_decontamination_finds_short_items_at_the_most_edits():
    """Against the least distance to the whole text, of all texts and items."""
    rng = random.Random(5)
    items, texts = [], []
    for n in (4, 5, 7, 9, 10, 12, 14, 15, 16, 17, 20, 30):
        for _ in range(20):
            words = [f"w{rng.randrange(400)}" for _ in range(n)]
            items.append((len(items), " ".join(words)))
            for _ in range(n // 5):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = rng.choice([[], [f"x{rng.randrange(400)}"]])
            around = [" ".join(f"w{rng.randrange(400)}" for _ in range(40)) for _ in range(2)]
            texts.append(" ".join([around[0], *words, around[1]]))
    index = decontaminate.build_index(items)
    found = {(t, k): v for t, k, *v in decontaminate.matches(index, texts)}
    for t, text_ in enumerate(texts):
        whole = decontaminate.word_hashes(text_)
        for k in range(len(items)):
            item = index.words[k]
            place = decontaminate.place_of(item, whole, int(decontaminate.EDITS * len(item)))
            assert (place is None) == ((t, k) not in found) and (place is None or place[0] == found[t, k][0])
    assert all((t, t) in found for t in range(len(texts)))


def test_packing_is_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    texts = ["hello world", "", None, "  two  blanks <|endoftext|>", text(1, 3000), "naïve 日本 ١٢"] + [text(i, 50 * i) for i in range(1, 30)]
    rows = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    whole = Tokenizer.from_file(packing.default_tokenizer())
    by_sequence: dict = {}
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"]):
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(piece.tobytes()))
            at += r["length"]
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= sum(r["length"] for r in rows) / 2048 * 1.1 + 1


def test_sharding_round_trip(spark, tmp_path):
    shards = sharding.ShardSet(spark, f"file://{tmp_path}/set", target=1 << 20)
    for k in range(9):
        shards.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
        shards.compact()
    assert sorted(r[0] for r in shards.read().collect()) == list(range(90))
    assert len(shards.shards()[1]) < 9
    shards.expire()
    assert shards.read().count() == 90 and len(shards.versions()) == 1


def test_licenses(spark):
    full = next(t for label, t in licenses.WORDINGS if label == "bsd")
    rows = [(1, f"see the MIT, License and Apache\nLicense. {full}"), (2, "General Public License general public license"), (3, "a mit"), (4, None)]
    got = {r["doc_id"]: r for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["base_labels"], got[1]["labels"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == ("apache,mit", "apache,bsd,mit", 2, 2, 5)
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 0, 3)
    assert (got[3]["n_base"], got[4]["n_words"], got[4]["score"]) == (0, 0, 0.0)


def test_each_wording_has_its_own_label_only(spark):
    docs = spark.createDataFrame([(i, f"{text(i, 30)} {t} {text(i + 50, 30)}") for i, (_, t) in enumerate(licenses.WORDINGS)], "doc_id long, text string")
    for r in licenses.licenses(docs).collect():
        label, wording = licenses.WORDINGS[r["doc_id"]]
        assert set(r["labels"].split(",")) == {label} | set(filter(None, r["base_labels"].split(","))), wording
        assert {s.split(":")[0] for s in r["spans"].split(",")} == {label} and r["score"] == 1.0


def test_license_sql_on_neighbouring_wordings(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(80):
        words = " ".join(rng.choice(licenses.WORDINGS)[1] if rng.random() < 0.5 else text(rng.random(), rng.randrange(1, 12)) for _ in range(6)).split()
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = rng.choice(["", "new", "Mit License"])
        rows.append((i, " ".join(words)))
    rows += [(80, None), (81, ""), (82, "mit"), (3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (tmp_path / "whole").mkdir()
    spark.read.parquet(f"{tmp_path}/documents.parquet").toPandas().to_parquet(tmp_path / "whole" / "documents.parquet")
    compare(spark, "op6", lambda s, d: licenses.licenses(s.read.parquet(f"{d}/documents.parquet")), licenses.ORACLE, str(tmp_path / "whole"))


def test_repeated_notices_are_as_many_spans(spark, tmp_path):
    """Verbatim wordings between other words, and the same one many times in a row, against a search for whole wordings."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    whole = [(label, cut(t)) for label, t in licenses.WORDINGS]
    texts = {0: " ".join(["All rights reserved."] * 40), 1: "\n".join(["SPDX-License-Identifier: MIT"] * 40)}
    for n in range(2, 202):
        r, parts = random.Random(n), []
        for _ in range(r.randrange(6)):
            parts += [text(r.random(), r.randrange(1, 9))] + [r.choice(licenses.WORDINGS)[1]] * r.choice([1, 1, 1, 2, 5])
        texts[n] = " ".join(parts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["spans"] for r in licenses.licenses(docs).collect()}
    for n, t in texts.items():
        w = cut(t)
        found = {(i, i + len(p) - 1, label) for label, p in whole for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p}
        kept = sorted(s for s in found if not any(b[0] <= s[0] and b[1] >= s[1] and b[:2] != s[:2] for b in found))
        assert got[n] == ",".join(f"{label}:{i}:{j}" for i, j, label in kept), n
    assert got[0].count("reserved:") == 40 and got[1].count("mit:") == 40
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"select doc_id, spans, labels, score from ({licenses.ORACLE})").fetchall()
    assert {w[0]: w[1] for w in want} == got


def test_pii_base_spans(spark):
    texts = ["mail A.b@c-d.org, x@y and 10.2.3.4 or 300.1.1.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +49 (30) 1234-567 now", "é a@b.c", "", None, "1.2.3.4.5.6.7.8 a@b@c.d"]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}"
    card, phone = r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"

    def luhn(s):
        d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0

    checks = (("email", email, lambda s: True), ("ip", ip, lambda s: all(int(p) <= 255 for p in s.split("."))), ("card", card, luhn), ("phone", phone, lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15))
    for i, t in enumerate(texts):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in checks for m in re.finditer(p, t or "") if ok(m[0])]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), (t, got[i]["spans"], spans)


def test_pii_held_out_accuracy(spark):
    model = pii.fitted(spark)
    made = pii.examples(spark, 1500, seed=11)
    cols = pii.features(F.col("kind"), F.col("s"), F.col("before"), F.col("after"))
    df = made.select("y", *(c.alias(n) for n, c in cols.items())).withColumn("p", F.expr(model.probability()) >= model.threshold)
    hits = {(r["y"], r["p"]): r["n"] for r in df.groupBy("y", "p").agg(F.count("*").alias("n")).collect()}
    assert hits.get((1, True), 0) / max(1, hits.get((1, True), 0) + hits.get((0, True), 0)) >= 0.95
    assert hits.get((1, True), 0) / sum(n for (y, _), n in hits.items() if y) >= 0.8


PAGE = """<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li>Menu</ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>Bold<br>text<p>1 &lt; 2 &amp more&nbsp;x</p><aside>side</aside><div class="comments"><p>me too</div></article><footer>&copy; h</footer>"""


def test_pii_finds_short_accounts_alone(spark):
    model = pii.fitted(spark)
    texts = ["bank account no 1234567890 and", "account 12345678", "konto 123 456 789 and", "order 123456789 and", "in 1999 to 2003"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    proposed = {r[0]: [x["s"].replace(pii.JOIN, " ") for x in r[1]] for r in pii.proposals(docs.withColumnRenamed("text", "t")).select("doc_id", "more").collect()}
    assert proposed == {0: ["1234567890"], 1: ["12345678"], 2: ["123 456 789"], 3: ["123456789"], 4: []}
    assert pii.find(docs, model).where("doc_id = 0").first()["spans"] == "account:16:26"
    assert pii.redacted(docs, model).where("doc_id = 0").first()["text"] == "bank account no <account> and"


def test_pii_sums_and_places(spark):
    r = random.Random(3)
    rows = [([r.randrange(50) for _ in range(n)],) for n in (0, 1, 7, 8, 9, 26, 27, 28, 63, 64, 65, 500, 1001)]
    df = spark.createDataFrame(rows, "a array<bigint>")
    places = F.transform(F.array(*(F.lit(x).cast("bigint") for x in range(-1, 51))), lambda x: pii.up_to(F.sort_array("a"), x))
    for a, sums, most, found in df.select("a", pii.running(F.col("a"), lambda x, y: x + y), pii.running(F.col("a"), F.greatest), places).collect():
        assert sums == list(itertools.accumulate(a)) and most == list(itertools.accumulate(a, max))
        assert found == [bisect.bisect_right(sorted(a), x) for x in range(-1, 51)]


def test_pii_texts_with_many_spans(spark):
    """Places beyond the first pieces of a text, and characters of several bytes before them."""
    one = "\u00e9\U0001f600 a%d@b.org (555) 123-4567 konto 123 456 789 ssn 123-45-6789 9.9.9.9 "
    t = "".join(one % i for i in range(3000))
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
    model = pii.fitted(spark)
    got = pii.find(docs, model).first()
    spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in got["spans"].split(","))]
    assert [t[a:b] for k, a, b in spans if k == "email"] == [f"a{i}@b.org" for i in range(3000)]
    assert (got["n_ip"], got["n_more"]) == (3000, len(spans) - 6000)
    few = pii.find(spark.createDataFrame([(1, one % 7)], "doc_id long, text string"), model).first()["spans"]
    per = [x.split(":")[0] for x in few.split(",")]
    assert all(sum(k == kind for k, _, _ in spans) == 3000 for kind in set(per)) and len(spans) == 3000 * len(per)
    placed = sorted((a, b, k) for k, a, b in spans)
    want, at = [], 0
    for a, b, k in placed:
        want += [t[at:a], f"<{k}>"] if a >= at else []
        at = max(at, b)
    assert pii.redacted(docs, model).first()["text"] == "".join(want) + t[at:]


def test_html(spark):
    boiler = "Read this long notice that every page of the host carries word for word so that readers know what they agree to when they stay here today"
    rows = [(1, "http://h.org/1", PAGE), (2, "http://h.org/2", None), (3, "http://h.org/3", f"<div>{text(1, 40)}</div><div>{boiler}</div>"), (4, "http://h.org/4", f"<div>{boiler}</div><div>{text(2, 40)}</div>"), (5, "http://o.org/", f"<div>{boiler}</div>")]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Head & line\nBold text\n1 < 2 & more x", 2: "", 3: text(1, 40), 4: text(2, 40), 5: boiler}
    assert html.unescape("&amp more") == "& more"


TITLE, BODY = "Title of it", " ".join(["Words of the article stand here."] * 4)
WHOLE = f"<h1>{TITLE}</h1><p>{BODY}</p>"
ARTICLE = f"<article>{WHOLE}</article>"


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar">{ARTICLE}<div class="sidebar">x y z</div></div>', f'<div class="page no-sidebar"><main>{WHOLE}</main></div>', f'<div id="header-wrap">{ARTICLE}</div>',
        f'<form id="aspnetForm"><nav>menu</nav>{ARTICLE}<footer>foot</footer></form>', f"<form><nav>menu</nav>{WHOLE}<footer>foot</footer></form>", f'<p data-x="hidden">{ARTICLE}',
        f'<article><div class="article-header"><h1>{TITLE}</h1></div><p title="hidden gems">{BODY}</p></article>', f'<article><div class="header"><h1>{TITLE}</h1></div><p class="share-price">{BODY}</p></article>',
        f'<article><h1>{TITLE}</h1><section class="related-work"><p>{BODY}</p></section></article>', f'<div class="ad-slot">{ARTICLE}', f'<div class="post comments-open">{ARTICLE}</div>',
    ],
)
def test_html_keeps_articles_in_containers_named_like_furniture(page):
    assert html_extract.kept_text(page, set())[0] == f"{TITLE}\n{BODY}"


@pytest.mark.parametrize(
    "more",
    [
        f'<div class="comments"><article>{"a reader says so. " * 40}</article></div>', "<div hidden>no</div>", '<div style="display: none">no</div>', '<div aria-hidden="true"><main>no</main></div>',
        '<div role="navigation">no</div><div role="form">no</div>', "<form><p>Enter your name</p></form>", '<div class="advert">no</div><aside><article>no</article></aside>', '<div class="no ad">no</div>',
    ],
)
def test_html_drops_furniture_beside_and_in_the_article(more):
    assert html_extract.kept_text(ARTICLE + more, set())[0] == f"{TITLE}\n{BODY}"
    if "<article>" not in more:
        assert html_extract.kept_text(f"<article>{WHOLE}{more}</article>", set())[0] == f"{TITLE}\n{BODY}"


def test_html_drops_named_parts_of_the_article():
    parts = '<section class="comment-list"><p>me too</p></section><div class="related-posts"><a href="x">More of these</a></div><div class="newsletter-signup">Sign up</div><div class="share">Share</div>'
    assert html_extract.kept_text(f"<article>{WHOLE}{parts}</article>", set())[0] == f"{TITLE}\n{BODY}"
    assert html_extract.kept_text("<form><p>Enter your name here</p></form>", set())[0] == ""


def test_passages_against_brute_force(spark):
    shared, rare = text(11, 57), text(12, 50)
    docs = [f"{text(20 + i, 80)} {shared} {text(40 + i, 30 + i)}" for i in range(12)] + [f"{text(60, 9)} {rare}", f"{rare} {text(61, 90)}", text(62, 200), text(62, 200), text(63, 49), text(63, 49), f"{shared[:-60]}"]
    got = substring_dedup.passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    cover = {(r["doc_id"], k) for r in got if r["kind"] == "span" for k in range(r["start_word"], r["end_word"])}
    seen: dict = {}
    for i, t in enumerate(docs):
        w = t.split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add((i, k))
    want = {(i, k + j) for at in seen.values() if len({docs[i] for i, _ in at}) > 1 for i, k in at for j in range(50)}
    assert cover == want
    assert {r["doc_id"] for r in got if r["kind"] == "copy"} == {14, 15}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert sum(shared in t for t in left.values()) == 1 and len(left) == len(docs) - 1


def test_revisits(spark):
    h = lambda **k: [(n.replace("_", "-"), v) for n, v in k.items()]
    rows = [
        (1, "http://WWW.a.org:80/x/?b=2&utm_source=q&a=1#f", 10, 200, h(ETag='"1"', Date="d1", Server="s"), "A"), (2, "https://a.org/x?a=1&b=2", 20, 304, h(ETag='W/"1"', Date="d2", Server="no"), None),
        (3, "https://a.org/x?a=1&b=2", 30, 200, h(ETag='"2"', Last_Modified="t"), "B"), (4, "https://a.org/x?a=1&b=2", 40, 304, h(ETag='"1"'), None), (5, "https://a.org/x?a=1&b=2", 50, 304, h(Last_Modified="t"), None),
        (6, "https://a.org/x?a=1&b=2", 60, 304, h(), None), (7, "https://b.org/", 5, 304, h(ETag='"1"'), None), (8, None, 5, 304, None, None), (9, "https://b.org/", None, 404, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, date long, status int, headers array<struct<name: string, value: string>>, digest string")
    got = {r["record_id"]: r for r in warc.resolved(df.withColumn("date", F.timestamp_seconds("date"))).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "full", 2: "resolved", 3: "full", 4: "mismatch", 5: "resolved", 6: "no_validator", 7: "no_earlier", 8: "no_earlier", 9: "other"}
    assert (got[2]["source_id"], got[2]["digest"], got[5]["source_id"]) == (1, "A", 3)
    assert {x["name"]: x["value"] for x in got[2]["headers"]} == {"ETag": 'W/"1"', "Date": "d2", "Server": "s"}


def test_asof_against_brute_force_over_ranges(spark):
    r = random.Random(3)
    rows = [(i, "https://hot.org/" if r.random() < 0.5 else f"https://h.org/{r.randrange(20)}", r.randrange(200), r.choice((200, 304, 304)), [("ETag", str(r.randrange(2)))], str(i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "record_id long, url string, date long, status int, headers array<struct<name: string, value: string>>, digest string").withColumn("date", F.timestamp_seconds("date"))
    got = {x["record_id"]: x["source_id"] for x in warc.resolved(df).collect()}
    last: dict = {}
    for i, url, _, status, hs, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        s = last.get(url.rstrip("/"))
        assert got[i] == (s[0] if status == 304 and s and s[1] == hs[0][1] else None)
        if status == 200:
            last[url.rstrip("/")] = (i, hs[0][1])


def test_warc_files(spark, tmp_path):
    rows = [("a", "response", "http://x.org/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nA: b", b"WARC/1.1\r\n\r\n\x00body"), ("b", "metadata", None, None, None, b"")]
    df = spark.createDataFrame(rows, warc.WARC)
    warc.written(df, f"file://{tmp_path}/w")
    assert sorted(tuple(r) for r in warc.records(spark, f"file://{tmp_path}/w").collect()) == sorted((*r[:5], bytearray(r[5])) for r in rows)
    (tmp_path / "x.warc").write_bytes(b"".join(warc.record_bytes(*r) for r in rows) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut")
    assert warc.records(spark, f"file://{tmp_path}/x.warc").count() == 2


def test_word_hashes_against_a_regular_expression(monkeypatch):
    from larder.llm import words

    r = random.Random(1)
    for step in (7, 1 << 16):  # steps that cut words too
        monkeypatch.setattr(words, "STEP", step)
        for _ in range(60):
            texts = ["".join(r.choice("aB \n\té日") for _ in range(r.randrange(60))) for _ in range(r.randrange(5))]
            found, n = words.hashed(texts)
            want = [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in texts]
            assert n.tolist() == [len(w) for w in want]
            known: dict = {}
            for w, h in zip((w for ws in want for w in ws), found.tolist(), strict=True):
                assert known.setdefault(w, h) == h
            assert len(set(known.values())) == len(known)


def test_near_duplicates_without_ids_and_of_shared_ids(spark):
    a, b, c = (text(900 + i, 120) for i in range(3))
    near = a.replace(a.split()[5], "other", 1)
    rows = [(None, a), (None, near), (7, b), (7, c), (8, c + " more"), (8, c + " more"), (9, b.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit(1), "_again": F.lit(2), "n": F.lit(3), "t": F.lit(4), "row": F.lit(5)})
    got = sorted(((r["doc_id"], r["class_id"], r["copy_of"]) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, None, None), (None, None, None), (7, 7, 7), (7, 7, 7), (8, 7, 8), (8, 7, 8), (9, 7, 7)], key=str)
    left = near_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in left.collect())
    assert [i for i, _ in kept] == [0, 7, 7] and {t for _, t in kept[1:]} == {b, c}


def test_a_large_group_of_near_copies_is_one_class(spark):
    base = text(77, 150).split()
    rows = []
    for i in range(600):
        w, r = list(base), random.Random(i)
        for _ in range(r.randrange(6)):
            del w[r.randrange(len(w))]
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: near_dedup.shingles(t) for i, t in rows}
    for i in range(0, 600, 3):  # each has a link wherever brute force finds one
        near = [j for j in range(600) if j != i and near_dedup.probability_jaccard(sets[i], sets[j]) >= 0.8]
        assert all(got[j] == got[i] for j in near)


def template_texts(n):
    """Texts of one template whose five-word shingles have a similarity of 0.37 or so: no near copies."""
    base, rows = text(55, 300).split(), []
    for i in range(n):
        r = random.Random(i)
        rows.append((i, " ".join(f"own{r.randrange(10**9)}" if r.random() < 0.06 else w for w in base)))
    return rows


def test_texts_of_a_template_are_not_compared_by_shingles(spark, monkeypatch):
    made = {}
    real = near_dedup.staged

    def counted(df, name):
        out = real(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "staged", counted)
    rows = template_texts(800)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["class_id"] == r["doc_id"] for r in got)
    assert made["members"] > 2 * len(rows) and made["cells"] < len(rows)


def test_tiles_and_cells_find_each_pair_of_two_components(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 7)
    monkeypatch.setattr(near_dedup, "CELL", 2000)
    base, rows = text(91, 200).split(), []
    for i in range(60):
        w, r = list(base), random.Random(i)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    sets = {i: near_dedup.shingles(t) for i, t in rows}
    nodes = near_dedup.sketches(near_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string"))).withColumn("id", F.col("doc_id"))
    under = nodes.select(F.lit(0).cast("long").alias("c"), "id", F.lit(False).alias("far"))
    comps = nodes.select("id", F.col("id").alias("comp"))
    dealt = near_dedup.cells(near_dedup.tiles(under, comps, nodes))
    texts = spark.createDataFrame(rows, "id long, text string")
    found = {(r["a"], r["b"]) for r in near_dedup.compared(dealt, texts, 0.8).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and near_dedup.probability_jaccard(sets[a], sets[b]) >= 0.8 - 1e-9}
    assert len(want) > 100 and found == want


def test_spans_of_texts_that_share_an_id(spark):
    shared = text(31, 60)
    rows = [(1, f"{text(32, 60)} {shared}"), (2, f"{shared} {text(33, 60)}"), (2, text(34, 200)), (3, text(35, 80)), (3, text(35, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_gone": F.lit(1), "_cuts": F.lit(2), "cuts": F.lit(3)})
    left = substring_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    kept = [r["text"] for r in left.collect()]
    assert len(kept) == 4 and text(34, 200) in kept and kept.count(text(35, 80)) == 1 and sum(shared in t for t in kept) == 1


def test_html_repeats_decide(spark):
    foot = "All contents belong to the host and its many friends"
    open_pages = [(i, "http://o.org/", f"<div>Home</div><div>{text(600 + i, 60)}</div><div>{foot}</div>") for i in range(4)]
    links = " ".join(f"<a href='/{i}'>see the page number {i} of ours</a>" for i in range(6))
    declared = [(10 + i, "http://d.org/", f"<article><p>{text(700 + i, 80)}</p><p>{links}</p></article>") for i in range(4)]
    copies = [(20 + i, "http://c.org/", f"<div>{text(800, 90)}</div>") for i in range(2)]
    quoted = [(30 + i, "http://q.org/", f"<article><p>{text(820, 40)}</p><p>{text(830 + i, 80)}</p></article>") for i in range(2)]
    pages = spark.createDataFrame(open_pages + declared + copies + quoted, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    assert all(got[i] == text(600 + i, 60) for i in range(4))  # menu and footer are too short for a suffix
    assert all(got[10 + i] == text(700 + i, 80) for i in range(4))  # links that every page repeats, inside its article
    assert all(got[20 + i] == text(800, 90) for i in range(2))  # copies of a page are no boilerplate
    assert all(got[30 + i] == f"{text(820, 40)}\n{text(830 + i, 80)}" for i in range(2))  # nor is a quoted passage


def pages_by_search(pages):
    """The text of each page, where every run of REACH words of a host is looked up in a plain dictionary."""
    read = [(i, url, html_extract.blocks_of(page)) for i, url, page in pages]
    seen = {}
    for i, url, blocks in read:
        words = " ".join(t for _, t, _ in blocks).split()
        for x in [("run", *words[p : p + 20]) for p in range(len(words) - 19)] + [("block", t) for _, t, _ in blocks if len(t.split()) < 20]:
            seen.setdefault((url, x), set()).add(i)
    opened = {url for _, url, blocks in read if blocks and all(k != html_extract.CONTENT for k, _, _ in blocks)}
    out = {}
    for i, url, blocks in read:
        words = " ".join(t for _, t, _ in blocks).split()
        at = [(p, n) for p in range(len(words) - 19) if (n := len(seen[url, ("run", *words[p : p + 20])])) > 1]
        short = {b: n for b, (_, t, _) in enumerate(blocks) if url in opened and len(t.split()) < 20 and (n := len(seen[url, ("block", t)])) > 1}
        kinds, sizes, links = [k for k, _, _ in blocks], [len(t.split()) for _, t, _ in blocks], [2 * l > len(t) for _, t, l in blocks]
        drop = html_extract.chosen(kinds, sizes, links, at, short, sum(u == url for _, u, _ in read))
        kind = html_extract.CONTENT if html_extract.CONTENT in kinds else html_extract.OTHER
        out[i] = "\n".join(t for b, (k, t, _) in enumerate(blocks) if k == kind and b not in drop)
    return out


def test_html_repeats_are_found_at_every_place(spark):
    # repeats of 20 words, the fewest that count: at the end of articles, and inside blocks of pages that declare no content
    feet = [(100 * h + i, f"http://f{h}.org/", f"<article><p>{text(100 * h + i, 70)}</p><p>{text(9000 + h, 20)}</p></article>") for h in range(12) for i in range(3)]
    inner = [(5000 + 100 * h + i, f"http://i{h}.org/", f"<div>{text(5000 + 100 * h + i, 60)}</div><div>{text(9100 + h, 20)} {text(9200 + 10 * h + i, 8)}</div>") for h in range(12) for i in range(3)]
    rng = random.Random(3)
    mixed = []
    for i in range(90):
        some = [text(9500 + rng.randrange(6), rng.choice([5, 19, 20, 21, 24, 45])) if rng.random() < 0.4 else text(20_000 + 10 * i + j, rng.choice([3, 15, 30, 60])) for j in range(5)]
        body = "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<p><a href='x'>{}</a></p>", "<nav>{}</nav>"]).format(t) for t in some)
        mixed.append((10_000 + i, f"http://m{i % 8}.org/", f"<article>{body}</article>" if i % 8 < 4 or i % 3 else body))
    pages = feet + inner + mixed
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == text(i, 70) for i, _, _ in feet)
    assert all(got[i] == text(i, 60) for i, _, _ in inner)
    assert got == pages_by_search(pages)


def test_a_full_bitmap_loses_no_key(spark, monkeypatch):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 50_000)
    other = np.random.default_rng(2).integers(-(2**63), 2**63, 50_000).view(np.uint64)
    rows = spark.createDataFrame([(int(k),) for k in keys], "key long")
    held = suffixes.bitmap(rows)
    assert suffixes.hits(keys.view(np.uint64), held).all() and suffixes.hits(other, held).mean() < 0.1
    monkeypatch.setattr(suffixes, "MOST_BITS", 1 << 16)
    held = suffixes.bitmap(rows)
    assert len(held) == 1 << 13 and suffixes.hits(keys.view(np.uint64), held).all()


def test_revisits_keep_columns_with_any_name(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "x"), (2, "http://a.org/", "y")], "page_id long, url string, html string")
    plain = warc.page_captures(pages)
    odd = plain.withColumns({c: F.lit(c) for c in ("_full", "_range", "_near", "_far", "__source")})
    got = warc.resolved(odd)
    assert set(got.columns) == set(warc.resolved(plain).columns) | {"_full", "_range", "_near", "_far", "__source"}
    assert all(r["_full"] == "_full" and r["__source"] == "__source" for r in got.collect())


def test_one_of_two_writers_gets_a_version(spark, tmp_path):
    a, b = (sharding.ShardSet(spark, f"file://{tmp_path}/two") for _ in range(2))
    a.append(spark.range(3))
    v, now = b.shards()
    assert a._commit(v + 1, now) and not b._commit(v + 1, [])
    assert b.shards() == (v + 1, now) and b.append(spark.range(3, 5)) == v + 2
    assert a.read().count() == 5


def test_a_tier_that_cannot_be_packed_does_not_stop_the_others(spark, tmp_path, monkeypatch):
    shards = sharding.ShardSet(spark, f"file://{tmp_path}/tiers", target=1 << 20)
    for k in range(4):
        shards.append(spark.range(k, k + 1).coalesce(1))
    real, calls = shards._write, []

    def write(df, born):
        calls.append(born)
        return [s for _ in range(4) for s in real(df, born)] if len(calls) == 1 else real(df, born)

    monkeypatch.setattr(shards, "_write", write)
    before = len(list((tmp_path / "tiers").glob("data-*")))
    shards.compact()
    assert shards.read().count() == 4 and len(list((tmp_path / "tiers").glob("data-*"))) >= before
