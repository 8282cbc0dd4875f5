"""WARC: not-modified revisits resolved by an as-of join on the canonical URL.

A revisit record has no payload of its own. It takes that of the latest earlier full response for the same canonical URL
whose validators agree (etag, or last-modified where the revisit has no etag, or payload digest where it has neither); headers that a not-modified answer may
update are merged over those of the stored response, all others are the response's.

The as-of join runs on slim columns. A URL captured very often is cut into time slices: within a slice a window carries the
latest response forward, across slices only one row a slice travels. Payloads are then fetched by record id.

Defined cases: a revisit without earlier response, or whose validators differ from the latest one's, stays unresolved (payload null, ``resolved`` false);
full responses pass as they are; of captures of one record_id at different times, and of different responses of one record_id, the first by time, then by content counts as the response others refer to; null URLs and null times match nothing; among responses of the same time the largest record id is
latest, and a response at the revisit's own time counts as earlier if its id is smaller; repeated rows of a record are one record; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch

#: Headers that a 304 answer may replace in the stored response (RFC 9110, 15.4.5, and RFC 9111, 3.2): fixed values.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not change what a URL names: fixed values.
IGNORED_PARAMETERS = "utm_[a-z]+|gclid|fbclid"
SLICES = 256


def canonical_url(url: Column, ignored: str = IGNORED_PARAMETERS, fold_hosts: bool = False) -> Column:
    """Lower-case host, no scheme (https as http), default port, fragment or ``ignored`` parameters; sorted parameters; no slash at the end. fold_hosts: ``www.`` and ``m.`` name the same pages as the bare host."""
    url = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)", 2))
    host = F.regexp_replace(head, r":(80|443)$", "")
    if fold_hosts:
        host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)", 1), "/+$", "")
    parts = F.split(F.regexp_extract(url, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(parts, lambda p: (p != "") & ~F.lower(p).rlike(f"^({ignored})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def resolve_revisits(records: DataFrame, **canonical) -> DataFrame:
    """records: record_id long, url, ts (orderable as long), kind ('response' or 'revisit'), etag, last_modified, digest, headers map, payload.

    Any other columns are not read; ``canonical`` are options of ``canonical_url``. Returns record_id, url, canonical, ts, kind, source_id (of the response used), resolved, headers, payload.
    """
    base = records.select("record_id", "url", canonical_url(F.col("url"), **canonical).alias("canonical"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", "digest", "headers", "payload")
    scratch = Scratch(records.sparkSession, "warc")
    keys = scratch.save(base.where(F.col("canonical").isNotNull() & F.col("ts").isNotNull()).select("record_id", "canonical", "ts", "kind", "etag", "last_modified", "digest"), "keys")  # canonical URLs are made once
    spread = keys.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    lo, width = spread.lo or 0, max(1, ((spread.hi or 0) - (spread.lo or 0)) // SLICES + 1)
    keys = keys.withColumn("slice", ((F.col("ts") - F.lit(lo)) / F.lit(width)).cast("int"))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest"))
    keys = keys.withColumn("full", full)
    last = keys.groupBy("canonical", "slice").agg(F.max("full").alias("slice_last"))
    carried = last.withColumn("carried", F.last("slice_last", True).over(Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("canonical", "slice", "carried")
    within = keys.withColumn("within", F.last("full", True).over(Window.partitionBy("canonical", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)))
    found = within.where("kind = 'revisit'").join(carried, ["canonical", "slice"], "left").withColumn("hit", F.coalesce("within", "carried"))
    agrees = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("hit.etag")).when(F.col("last_modified").isNotNull(), F.col("last_modified") == F.col("hit.last_modified")).otherwise(F.col("digest") == F.col("hit.digest"))
    # A record_id may be there several times, also at different times: each capture is resolved by its own time.
    pairs = scratch.save(found.where(agrees).select("record_id", "ts", "canonical", F.col("hit.record_id").alias("source_id")).distinct().groupBy("record_id", "ts", "canonical").agg(F.max("source_id").alias("source_id")), "pairs")
    wanted = pairs.select("source_id").distinct()
    content = F.struct(F.coalesce("ts", F.lit((1 << 63) - 1)).alias("ts"), F.md5("payload").alias("m"), F.array_sort(F.map_entries("headers")).alias("h"), "payload")
    stored = base.where("kind = 'response'").withColumnRenamed("record_id", "source_id").join(wanted, "source_id", "left_semi").groupBy("source_id").agg(F.min(content).alias("s")).select("source_id", F.map_from_entries("s.h").alias("stored_headers"), F.col("s.payload").alias("stored_payload"))
    revisits = base.where("kind = 'revisit'").drop("payload")
    same = ["record_id", "ts", "canonical"]
    matched = revisits.join(pairs, same).join(stored, "source_id").withColumn("payload", F.lit(None).cast("string"))
    # The rest carries no payload from elsewhere and isn't shuffled with any.
    unmatched = revisits.join(pairs, same, "left_anti").withColumn("payload", F.lit(None).cast("string"))
    others = base.where("kind is null or kind <> 'revisit'")
    out = matched.unionByName(unmatched, allowMissingColumns=True).unionByName(others, allowMissingColumns=True)
    allowed = F.array(*[F.lit(h) for h in PERMITTED])
    update = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.array_contains(allowed, F.lower(k)) & v.isNotNull())
    names = F.transform(F.map_keys(update), lambda k: F.lower(k))
    rest = F.map_filter(F.coalesce("stored_headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(names, F.lower(k)))
    resolved = F.col("source_id").isNotNull()
    response = F.col("kind") == "response"
    return out.select(
        "record_id", "url", "canonical", "ts", "kind", F.when(response, F.col("record_id")).otherwise(F.col("source_id")).alias("source_id"), (F.coalesce(response, F.lit(False)) | resolved).alias("resolved"),
        F.when(resolved, F.map_concat(rest, update)).otherwise(F.col("headers")).alias("headers"), F.when(resolved, F.col("stored_payload")).otherwise(F.when(response, F.col("payload"))).alias("payload"),
    )


#: Visits in one crawl series of ``capture_log``.
SERIES = 4


def capture_log(pages: DataFrame) -> DataFrame:
    """Every page as a small crawl history: a full response and three later visits that answered "not modified".

    Visit 1 has an etag, visit 2 only a date, visit 3 an etag that does not agree (its revisit can't be resolved).
    """
    visit = F.explode(F.sequence(F.lit(0), F.lit(SERIES - 1)))
    log = pages.select("page_id", "url", "html", visit.alias("visit")).withColumn("visit", F.col("visit").cast("long"))
    etag, modified = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')), F.concat(F.lit("day-"), (F.col("page_id") % 28).cast("string"))
    return log.select(
        (F.col("page_id") * SERIES + F.col("visit")).alias("record_id"), F.when(F.col("visit") == 2, F.concat("url", F.lit("#again"))).otherwise(F.col("url")).alias("url"), (F.col("visit") * 1_000_000_000 + F.col("page_id")).alias("ts"),
        F.when(F.col("visit") == 0, "response").otherwise("revisit").alias("kind"), F.when(F.col("visit") < 2, etag).when(F.col("visit") == 3, F.lit('"other"')).alias("etag"), modified.alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.when(F.col("visit") == 0, F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.lit("0"))).otherwise(F.create_map(F.lit("date"), F.col("visit").cast("string"), F.lit("content-type"), F.lit("none"))).alias("headers"),
        F.when(F.col("visit") == 0, F.col("html")).alias("payload"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(capture_log(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "canonical", "kind", "source_id", "resolved", text.alias("headers"), F.md5("payload").alias("payload_md5"), F.length("payload").cast("long").alias("payload_chars"))


def oracle() -> str:
    """DuckDB SQL for ``query``."""
    url = "regexp_replace(trim(url), '#.*$', '')"
    return rf"""
WITH v AS (SELECT page_id, url, html, unnest([0, 1, 2, 3])::BIGINT AS visit FROM pages),
rec AS (SELECT page_id * {SERIES} + visit AS record_id, url, visit * 1000000000 + page_id AS ts, CASE WHEN visit = 0 THEN 'response' ELSE 'revisit' END AS kind,
  CASE WHEN visit < 2 THEN '"' || md5(coalesce(html, '')) || '"' WHEN visit = 3 THEN '"other"' END AS etag, 'day-' || (page_id % 28) AS lm, visit, CASE WHEN visit = 0 THEN html END AS payload FROM v),
parts AS (SELECT *, regexp_replace(lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)', 2)), ':(80|443)$', '') AS host,
  regexp_replace(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract({url}, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^({IGNORED_PARAMETERS})(=|$)'))) AS q FROM rec),
c AS (SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM parts),
hit AS (SELECT a.record_id, max_by(b.record_id, b.ts) AS src FROM c a JOIN c b ON a.canonical = b.canonical AND a.kind = 'revisit' AND b.kind = 'response' AND b.ts < a.ts GROUP BY 1),
ok AS (SELECT c.*, CASE WHEN c.kind = 'response' THEN c.record_id WHEN CASE WHEN c.etag IS NOT NULL THEN c.etag = s.etag ELSE c.lm = s.lm END THEN s.record_id END AS source_id FROM c LEFT JOIN hit USING (record_id) LEFT JOIN c s ON s.record_id = hit.src)
SELECT ok.record_id, ok.canonical, ok.kind, ok.source_id, ok.source_id IS NOT NULL AS resolved,
  CASE WHEN ok.kind = 'response' THEN 'Content-Type=text/html;Date=0' WHEN ok.source_id IS NOT NULL THEN 'Content-Type=text/html;date=' || ok.visit ELSE 'content-type=none;date=' || ok.visit END AS headers,
  md5(s.payload) AS payload_md5, length(s.payload)::BIGINT AS payload_chars FROM ok LEFT JOIN c s ON s.record_id = ok.source_id"""
