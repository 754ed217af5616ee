"""WARC records, and resolution of not-modified revisits.

* :func:`written` stores records as gzip-compressed WARC files and
  :func:`records` reads such files back; both are Spark jobs over files.
* :func:`resolved` joins each revisit (status 304) as of its date to the latest
  earlier full response (status 200) of the same canonical URL.  Validators
  must agree: the ETag where both sides name one (weak marks are ignored), else
  Last-Modified; where neither can be compared the revisit isn't resolved.
  Headers that a 304 may update replace the stored ones, the others stay.

The as-of join has no window over a whole URL: records are sorted by URL and date
into ranges (one range shuffle), each range of a URL is filled in by itself, and
only the last full response of each (URL, range) is carried on, at most one row for each
range.  So a URL with a third of all rows is dealt over as many tasks as it
needs.

Canonical URLs: scheme and host in lower case, ``http`` as ``https``, no leading
``www.`` or ``m.``, no default port, fragment, trailing slash, session or tracking parameter; the
other parameters sorted.  Defined results: null dates come first; records
of one URL and date are ordered by record id; a null or empty URL is its own
canonical form, under which nothing is resolved; other statuses are kept and
neither resolve nor are resolved; repeated rows give repeated rows; extra
columns are kept unless they have an output column's name.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import staged, text_of

# Query parameters that don't choose a page, and headers that a 304 may replace.
TRACKING = ("ref", "fbclid", "gclid", "msclkid", "sessionid", "phpsessid", "jsessionid", "sid")
PERMITTED = ("age", "cache-control", "date", "etag", "expires", "last-modified", "vary", "warning")


def canonical_url(url: Column) -> Column:
    parts = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    scheme = F.regexp_replace(F.lower(F.regexp_extract(url, parts, 1)), "^http$", "https")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, parts, 2)), r":(80|443)?$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(url, parts, 3), "/+$", "")
    fixed = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, parts, 4), "&"), lambda p: (p != "") & ~fixed(p).isin(*TRACKING) & ~fixed(p).startswith("utm_")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, path, query)).otherwise(F.trim(F.coalesce(url, F.lit(""))))


def header(headers: Column, name: str) -> Column:
    """A header's value; names are compared in lower case, of several the first counts."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merged_headers(stored: Column, update: Column) -> Column:
    """``stored`` with the permitted headers of ``update`` in their place; new ones at the end."""
    low = lambda h: F.lower(h["name"])
    new = F.filter(update, lambda h: low(h).isin(*PERMITTED))
    stays = F.filter(stored, lambda h: ~F.exists(new, lambda n: low(n) == low(h)))
    return F.concat(stays, new)


def resolved(captures: DataFrame) -> DataFrame:
    """Adds canonical_url, source_id, source_date, verdict and merged headers to each record.

    ``captures`` has record_id (long), url, date (timestamp), status (int),
    headers (array of name, value) and digest.  ``verdict`` is "full",
    "resolved", "no_earlier", "mismatch", "no_validator" or "other"; ``digest``
    and ``headers`` of a resolved revisit are its source's and the merged ones.
    """
    u = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in captures.columns), default=0))  # begins no column's name
    named = captures.withColumn("canonical_url", canonical_url(F.col("url")))
    full = (F.col("status") == 200) & (F.col("canonical_url") != "")
    mine = F.when(full, F.struct(F.col("record_id").alias("id"), F.col("date").alias("at"), F.col("headers").alias("kept"), F.col("digest").alias("body")))
    # ranges are written down, so that a recomputed task finds the same ones
    ranged = named.withColumn(u + "full", mine).repartitionByRange("canonical_url", "date", "record_id")
    ranged = staged(ranged.withColumn(u + "range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("canonical_url", u + "range").orderBy("date", "record_id")
    inner = ranged.withColumn(u + "near", F.last(u + "full", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    latest = ranged.where(F.col(u + "full").isNotNull()).groupBy("canonical_url", u + "range").agg(F.max_by(u + "full", F.struct("date", "record_id")).alias(u + "far"))
    spans = ranged.select("canonical_url", u + "range").distinct().join(latest, ["canonical_url", u + "range"], "left")
    over = Window.partitionBy("canonical_url").orderBy(u + "range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn(u + "far", F.last(u + "far", ignorenulls=True).over(over)).where(F.col(u + "far").isNotNull())
    both = inner.join(carried, ["canonical_url", u + "range"], "left").withColumn(u + "source", F.coalesce(u + "near", u + "far"))
    source = lambda f: F.col(f"{u}source.{f}")
    tag = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")
    same_tag = tag(F.col("headers")) == tag(source("kept"))
    same_time = header(F.col("headers"), "last-modified") == header(source("kept"), "last-modified")
    agrees = F.coalesce(same_tag, same_time)
    verdict = (
        F.when(full, "full").when((F.col("status") != 304) | F.col("status").isNull(), "other").when((F.col("canonical_url") == "") | F.col(u + "source").isNull(), "no_earlier")
        .when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("mismatch")
    )
    both = both.withColumn("verdict", verdict)
    ok = F.col("verdict") == "resolved"
    return both.withColumns({
        "source_id": F.when(ok, source("id")), "source_date": F.when(ok, source("at")),
        "digest": F.when(ok, source("body")).otherwise(F.col("digest")),
        "headers": F.when(ok, merged_headers(source("kept"), F.col("headers"))).otherwise(F.col("headers")),
    }).drop(u + "full", u + "range", u + "near", u + "far", u + "source")


def with_payload(found: DataFrame, payloads: DataFrame) -> DataFrame:
    """Joins (record_id, payload): a resolved revisit gets its source's."""
    body = payloads.select(F.col("record_id").alias("_body"), "payload")
    return found.join(body, F.coalesce("source_id", "record_id") == F.col("_body"), "left").drop("_body")


def page_captures(pages: DataFrame) -> DataFrame:
    """Two captures of every page: its full response, and a later not-modified answer with the page's validators.

    Pages stand for fetches one minute apart, and each is asked for again a day
    after its fetch, so a revisit sees whatever was fetched last under its URL.
    """
    html = text_of(pages, "html")
    page = pages["page_id"].cast("long")
    digest = F.sha1(html)
    first = F.timestamp_seconds(F.lit(1_700_000_000) + page * 60)
    h = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    date = lambda at: F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    again = F.timestamp_seconds(F.lit(1_700_000_000 + 86_400) + page * 60)
    full = F.struct((page * 2).alias("record_id"), first.alias("date"), F.lit(200).alias("status"), F.array(h("Content-Type", F.lit("text/html")), h("Content-Length", F.length(html)), h("Date", date(first)), h("ETag", tag)).alias("headers"), digest.alias("digest"))
    none = F.lit(None).cast("string")
    back = F.struct((page * 2 + 1).alias("record_id"), again.alias("date"), F.lit(304).alias("status"), F.array(h("Date", date(again)), h("ETag", F.concat(F.lit("W/"), tag)), h("Cache-Control", F.lit("max-age=60")), h("Content-Length", F.lit("0"))).alias("headers"), none.alias("digest"))
    return pages.select(page.alias("page_id"), pages["url"].cast("string").alias("url"), F.explode(F.array(full, back)).alias("c")).select("page_id", "url", "c.*")


WARC = "record_id string, kind string, url string, date string, headers string, payload binary"


def written(records_df: DataFrame, folder: str) -> None:
    """Writes (record_id, kind, url, date, headers, payload) as WARC files, one gzip member for a record.

    Members are made in tasks and stored by Spark as a binary column; :func:`records` reads either these or plain .warc.gz files.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"record_id": frame["record_id"], "member": [gzip.compress(record_bytes(*r), mtime=0) for r in frame[["record_id", "kind", "url", "date", "headers", "payload"]].itertuples(index=False)]})

    records_df.mapInPandas(pack, "record_id string, member binary").write.parquet(folder)


def record_bytes(record_id: str, kind: str, url: str | None, date: str | None, headers: str | None, payload: bytes | None) -> bytes:
    block = ((headers or "").encode() + b"\r\n\r\n" if headers is not None else b"") + (payload or b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Target-URI", url), ("WARC-Date", date), ("Content-Type", "application/http" if headers is not None else "application/octet-stream"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(stream) -> Iterator[tuple]:
    """Records of an open, uncompressed WARC stream; a cut-off last record is left out."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            return
        http = fields.get("content-type", "").startswith("application/http")
        head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        record = fields.get("warc-record-id", "").removeprefix("<urn:uuid:").removesuffix(">")
        yield record, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"), head.decode("utf-8", "replace") if http else None, body


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of files written by :func:`written`, or of .warc and .warc.gz files (each file is one task's work)."""
    if folder.endswith((".warc", ".gz")) or "*" in folder:
        source = spark.read.format("binaryFile").load(folder).select(F.col("content").alias("member"))
    else:
        source = spark.read.parquet(folder).select("member")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for member in frame["member"]:
                raw = io.BytesIO(member)
                stream = gzip.open(raw) if member[:2] == b"\x1f\x8b" else raw
                yield pd.DataFrame(list(parsed(stream)), columns=["record_id", "kind", "url", "date", "headers", "payload"])

    return source.mapInPandas(unpack, WARC)


#: Equal SQL of the page captures and their resolution: a plain window over each URL instead of ranges.
ORACLE = rf"""
with p as (
  select page_id::bigint as page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as body,
         regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query']) as u
  from pages),
q as (
  select *, case when lower(u.scheme) = 'http' then 'https' else lower(u.scheme) end as scheme,
         regexp_replace(regexp_replace(lower(u.host), ':(80|443)?$', ''), '^(www|m)\.', '') as host, regexp_replace(u.path, '/+$', '') as path,
         list_sort(list_filter(string_split(u.query, '&'), lambda x: x <> '' and not lower(split_part(x, '=', 1)) in ({", ".join(f"'{x}'" for x in TRACKING)})
                                                                   and not starts_with(lower(split_part(x, '=', 1)), 'utm_'))) as params
  from p),
n as (
  select page_id, html, body, '"' || body[1:16] || '"' as tag, 1700000000 + page_id * 60 as fetched,
         case when coalesce(scheme, '') = '' then trim(coalesce(url, ''), ' ')
              else scheme || '://' || host || path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end end as canonical_url
  from q),
c as (
  select page_id, page_id * 2 as record_id, canonical_url, fetched as date, 200 as status, tag, body, length(html) as size from n
  union all
  select page_id, page_id * 2 + 1, canonical_url, fetched + 86400, 304, tag, null, null from n),
s as (
  select *, last_value(case when status = 200 and canonical_url <> '' then {{'id': record_id, 'at': date, 'tag': tag, 'body': body, 'size': size}} end ignore nulls)
            over (partition by canonical_url order by date, record_id rows between unbounded preceding and 1 preceding) as source
  from c),
v as (
  select *, case when status = 200 and canonical_url <> '' then 'full' when status <> 304 then 'other'
                 when canonical_url = '' or source is null then 'no_earlier' when source.tag = tag then 'resolved' else 'mismatch' end as verdict,
         'Date: ' || strftime(make_timestamp(date * 1000000), '%Y-%m-%d %H:%M:%S') as dated
  from s)
select page_id, record_id, canonical_url, date, status::int as status, verdict,
       case when verdict = 'resolved' then source.id end as source_id, case when verdict = 'resolved' then source.at end as source_date,
       case when verdict = 'resolved' then source.body else body end as digest,
       array_to_string(case
         when status = 200 then ['Content-Type: text/html', 'Content-Length: ' || size, dated, 'ETag: ' || tag]
         when verdict = 'resolved' then ['Content-Type: text/html', 'Content-Length: ' || source.size, dated, 'ETag: W/' || tag, 'Cache-Control: max-age=60']
         else [dated, 'ETag: W/' || tag, 'Cache-Control: max-age=60', 'Content-Length: 0'] end, chr(10)) as headers
from v
"""
