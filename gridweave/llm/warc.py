"""Resolution of not-modified revisits in web archives.

A revisit record says that a page had not changed when it was fetched again; it
has no payload.  It is resolved by an as-of join, by canonical URL, to the
latest earlier full response.  The revisit's validators must agree with that
response's; then the response's headers are taken, updated with those headers
that a 304 answer may change.

The join is a running "last full response" in order of time.  A URL may hold
any share of all records, so the order is cut into spans of time: within a span
the last response is a window function over (URL, span), and what a span begins
with is a window function over one row for each (URL, span).

Defined results, by `status`:
  resolved      the validators agree;
  mismatch      the latest earlier full response has other validators;
  no_validator  one side has none that the other has too;
  missing       there is no earlier full response, or the URL or time is null.
Records of one moment are ordered by record_id.  Equal records are resolved
each by itself.  Null headers count as none.  Header names do not depend on
case; of fields with one name that counts whose name as written comes first in
the order of bytes (a map has no order of its own).  A response without
URL or time is the answer to nothing.  An empty table gives no rows.  Further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import read
from gridweave.llm.secrets import let

#: Seconds of a span: what one URL has in it is ordered in one task.
SPAN = 300
# Header fields that a 304 answer carries (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that only track visitors.
TRACKING = r"(utm_[^=&]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid|sessionid|phpsessid|jsessionid)"


def canonical_url(url: Column) -> Column:
    """Scheme, `www.`, default ports, fragments, tracking parameters, index
    pages and trailing slashes do not count; host and parameter order neither."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/index\.(html?|php)$", "/"), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^{TRACKING}(=|$)"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def _headers() -> Column:
    """The headers with names in lower case, each once."""
    given = F.map_entries(F.coalesce("headers", F.expr("map()").cast("map<string,string>")))
    entries = F.array_sort(F.transform(given, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["key"].alias("written"), e["value"].alias("value"))))
    first = lambda all_: F.filter(all_, lambda e, i: F.array_position(F.transform(all_, lambda x: x["key"]), e["key"]) == i + 1)
    once = F.transform(let(entries, first), lambda e: F.struct(e["key"], e["value"]))
    return F.map_from_entries(once)


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """A row for each revisit among records.

    records: record_id, url, ts (seconds), kind (`response` or `revisit`),
    http_status, headers (map).  Full responses have kind response and a status
    of 200.  Gives record_id, canonical_url, status, refers_to, age (seconds
    since the response) and headers (map; null unless resolved).
    """
    full = (F.col("kind") == "response") & (F.col("http_status") == 200)
    wanted = records.where(full | (F.col("kind") == "revisit")).select("record_id", "ts", canonical_url(F.col("url")).alias("canonical_url"), F.coalesce(full, F.lit(False)).alias("full"), _headers().alias("headers"))
    # records without URL or time resolve nothing; they would all be one group
    placed = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    rows = wanted.where(placed).withColumn("span", F.floor(F.col("ts") / span)).withColumn("own", F.when(F.col("full"), F.struct("ts", "record_id", "headers")))
    order = [F.col("ts"), F.col("record_id")]
    within = Window.partitionBy("canonical_url", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last("own", ignorenulls=True).over(within))
    spans = rows.groupBy("canonical_url", "span").agg(F.max_by("own", F.struct("own.ts", "own.record_id")).alias("last"))
    over = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("canonical_url", "span", F.last("last", ignorenulls=True).over(over).alias("carried")).where("carried is not null")
    joined = rows.where("not full").join(carried, ["canonical_url", "span"], "left")
    columns = ["record_id", "ts", "canonical_url", "headers", F.coalesce("near", "carried").alias("response")]
    none = F.lit(None).cast(rows.schema["own"].dataType)
    found = joined.select(*columns).union(wanted.where(~placed & ~F.col("full")).select(*columns[:-1], none))

    new, old = F.col("headers"), F.col("response.headers")
    agree = F.when(new["etag"].isNotNull() & old["etag"].isNotNull(), _weak(new["etag"]) == _weak(old["etag"])).when(
        new["last-modified"].isNotNull() & old["last-modified"].isNotNull(), F.trim(new["last-modified"]) == F.trim(old["last-modified"])
    )
    status = F.when(F.col("response").isNull(), "missing").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("mismatch")
    changes = F.map_filter(new, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(changes), k)), changes)
    return found.select(
        "record_id",
        "canonical_url",
        status.alias("status"),
        F.col("response.record_id").alias("refers_to"),
        (F.col("ts") - F.col("response.ts")).alias("age"),
        F.when(status == "resolved", merged).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """An archive made of pages: each is fetched once in full, ten seconds after
    the page before, and asked for again half an hour later by a request that
    is answered with 304.

    Of the answers, those of every seventh page have another ETag, those of
    every eleventh no ETag but Last-Modified, and those of every thirteenth no
    validator at all.
    """
    at = F.col("page_id") * 10
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    day = F.concat(F.lit("day "), F.floor(F.col("page_id") / 100).cast("string"))
    length = F.length(F.coalesce("html", F.lit(""))).cast("string")
    fields = {"ETag": etag, "Last-Modified": day, "Content-Length": length, "Date": at.cast("string"), "Cache-Control": F.lit("max-age=60")}
    first = F.struct(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        at.alias("ts"),
        F.lit("response").alias("kind"),
        F.lit(200).alias("http_status"),
        F.create_map(*(x for name, value in fields.items() for x in (F.lit(name), value))).alias("headers"),
    )
    again = at + 1800
    changes = F.create_map(F.lit("Date"), again.cast("string"), F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0"))
    more = (
        F.when(F.col("page_id") % 13 == 0, F.expr("map()").cast("map<string,string>"))
        .when(F.col("page_id") % 11 == 0, F.create_map(F.lit("Last-Modified"), day))
        .when(F.col("page_id") % 7 == 0, F.create_map(F.lit("ETag"), F.lit('"other"')))
        .otherwise(F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), etag)))
    )
    second = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), "url", again.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("http_status"), F.map_concat(changes, more).alias("headers"))
    return pages.select(F.explode(F.array(first, second)).alias("r")).select("r.*")


def revisits_of_pages(spark, sf_dir: str) -> DataFrame:
    """Revisits of the archive of all pages; headers as sorted lines."""
    out = resolve(records_of_pages(read(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return out.withColumn("headers", lines)


#: The archive of `records_of_pages`, and then resolution of any such archive: headers are lists of (k, v).
ORACLE = """
WITH made AS (
  SELECT page_id, url, page_id * 10 AS t, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || CAST(page_id // 100 AS VARCHAR) AS day, CAST(length(coalesce(html, '')) AS VARCHAR) AS n FROM pages),
records AS (
  SELECT page_id * 2 AS record_id, url, t AS ts, 'response' AS kind, 200 AS http_status,
         [{k: 'ETag', v: tag}, {k: 'Last-Modified', v: day}, {k: 'Content-Length', v: n}, {k: 'Date', v: CAST(t AS VARCHAR)}, {k: 'Cache-Control', v: 'max-age=60'}] AS headers FROM made
  UNION ALL
  SELECT page_id * 2 + 1, url, t + 1800, 'revisit', 304,
         list_concat([{k: 'Date', v: CAST(t + 1800 AS VARCHAR)}, {k: 'Cache-Control', v: 'max-age=600'}, {k: 'Content-Length', v: '0'}],
           CASE WHEN page_id % 13 = 0 THEN [] WHEN page_id % 11 = 0 THEN [{k: 'Last-Modified', v: day}] WHEN page_id % 7 = 0 THEN [{k: 'ETag', v: '"other"'}] ELSE [{k: 'ETag', v: 'W/' || tag}] END) FROM made),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM records),
cut AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www[0-9]*\\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/index\\.(html?|php)$', '/'), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=&]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid|sessionid|phpsessid|jsessionid)(=|$)'))), '&') AS query FROM bare),
lowered AS (
  SELECT record_id, ts, kind, http_status, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url, list_transform(coalesce(headers, []), lambda h: {k: lower(trim(h.k)), v: h.v}) AS l FROM cut),
own AS (SELECT * EXCLUDE (l), list_filter(l, lambda h, i: list_position(list_transform(l, lambda x: x.k), h.k) = i) AS h FROM lowered),
valid AS (SELECT *, list_filter(h, lambda x: x.k = 'etag')[1].v AS etag, list_filter(h, lambda x: x.k = 'last-modified')[1].v AS modified FROM own),
joined AS (
  SELECT r.record_id, r.canonical_url, r.ts, r.h, r.etag, r.modified, f.record_id AS refers_to, f.ts AS f_ts, f.h AS f_h, f.etag AS f_etag, f.modified AS f_modified
  FROM valid r LEFT JOIN valid f ON f.kind = 'response' AND f.http_status = 200 AND f.canonical_url = r.canonical_url AND (f.ts < r.ts OR f.ts = r.ts AND f.record_id < r.record_id)
  WHERE r.kind = 'revisit' QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) = 1),
judged AS (
  SELECT *, list_filter(h, lambda x: x.k IN ('cache-control', 'content-location', 'date', 'etag', 'expires', 'vary')) AS changes,
         CASE WHEN refers_to IS NULL THEN 'missing'
              WHEN etag IS NOT NULL AND f_etag IS NOT NULL THEN CASE WHEN regexp_replace(trim(etag), '^W/', '') = regexp_replace(trim(f_etag), '^W/', '') THEN 'resolved' ELSE 'mismatch' END
              WHEN modified IS NOT NULL AND f_modified IS NOT NULL THEN CASE WHEN trim(modified) = trim(f_modified) THEN 'resolved' ELSE 'mismatch' END
              ELSE 'no_validator' END AS status FROM joined)
SELECT record_id, canonical_url, status, refers_to, ts - f_ts AS age,
       CASE WHEN status = 'resolved' THEN array_to_string(list_sort(list_transform(
         list_concat(list_filter(f_h, lambda x: NOT list_contains(list_transform(changes, lambda c: c.k), x.k)), changes), lambda x: x.k || ': ' || x.v)), chr(10)) END AS headers
FROM judged
"""
