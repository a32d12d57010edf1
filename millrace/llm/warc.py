"""WARC revisits: a not-modified record joined as of its time to the full response that it confirms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Headers of a 304 response that update the stored ones; all others, such as Content-Length, keep the stored value.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Without scheme, user, leading ``www.``, default port, fragment, utm parameters and final slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])(utm_[a-z]*=[^&]*&)+", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?&]utm_[a-z]*=[^&]*$", ""), "[?]$", "")
    return F.concat(host, F.regexp_replace(rest, "/$", ""))


def parse_headers(block: Column) -> Column:
    """An array of (name, value), names in lower case and in order, from header lines; of equal names the last counts."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: x.rlike("^[^:\\s]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, "^([^:]+):", 1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]+:", "")).alias("value")))
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["name"])))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1)["value"].alias("value")))


def header(parsed: Column, name: str) -> Column:
    """A header's value, null if there is none."""
    return F.get(F.filter(parsed, lambda p: p["name"] == name), F.lit(0))["value"]


def _bare_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """A row for each revisit record: (record_id, url, fetched, outcome, refers_to, headers, payload_digest, payload_length).

    ``records`` has (record_id, kind, url, fetched, status, headers, payload_digest, payload_length) of
    kind ``response`` or ``revisit``. A revisit refers to the response with status 200 of the same
    canonical URL that was fetched latest before it; of those fetched at one time, the one of greatest
    record_id. ``outcome`` is ``resolved`` if the validators agree: entity tags, compared weakly, where
    the revisit has one, else dates of last modification. Otherwise it is ``validator_mismatch``,
    ``no_validator``, or ``no_earlier_response``, and the columns after it are null or 0 (but refers_to,
    where there is a candidate). ``headers`` are the response's lines in order of name, those of PERMITTED
    replaced by or added from the revisit.

    Nulls: a record without url or time neither resolves nor is referred to; one without record_id takes
    part like any other and loses ties; null headers are none. Repeated revisits give a row each. A
    response fetched at the revisit's own time isn't earlier. URLs and headers of any length count in
    whole. No rows give no rows. Other columns aren't read; payloads themselves don't travel, only digest and length.
    """
    short = records.select("record_id", "kind", "url", F.col("fetched").cast("timestamp").alias("fetched"), F.col("status").cast("int").alias("status"), "headers", "payload_digest", F.col("payload_length").cast("long").alias("payload_length"))
    short = short.where("kind = 'revisit' or (kind = 'response' and status = 200 and url is not null and fetched is not null)")
    keyed = short.withColumn("canonical", canonical_url(F.col("url"))).withColumn("micros", F.unix_micros("fetched"))
    # revisits without url or time meet no response, so they need not meet each other in one task either
    lone = F.when(F.col("url").isNull() | F.col("fetched").isNull(), F.concat(F.lit(" "), F.xxhash64("record_id").cast("string")))
    keyed = keyed.withColumn("canonical", F.coalesce(lone, "canonical"))
    before = Window.partitionBy("canonical").orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("kind") == "response", F.struct("micros", "record_id", "headers", "payload_digest", "payload_length"))
    found = keyed.withColumn("full", F.max(full).over(before)).where("kind = 'revisit'")
    found = found.withColumn("full", F.when(F.col("fetched").isNotNull() & F.col("url").isNotNull(), F.col("full")))
    found = found.withColumn("new", parse_headers(F.col("headers"))).withColumn("old", parse_headers(F.col("full.headers")))
    tag, date = header(F.col("new"), "etag"), header(F.col("new"), "last-modified")
    agree = F.when(tag.isNotNull(), F.coalesce(_bare_tag(tag) == _bare_tag(header(F.col("old"), "etag")), F.lit(False))).when(date.isNotNull(), F.coalesce(date == header(F.col("old"), "last-modified"), F.lit(False)))
    outcome = F.when(F.col("full").isNull(), "no_earlier_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("validator_mismatch")
    found = found.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    permitted = F.array(*map(F.lit, PERMITTED))
    update = F.filter("new", lambda p: F.array_contains(permitted, p["name"]))
    kept = F.filter("old", lambda p: ~F.exists(update, lambda q: q["name"] == p["name"]))
    lines = F.array_join(F.transform(F.array_sort(F.concat(kept, update)), lambda p: F.concat(p["name"], F.lit(": "), p["value"])), "\n")
    return found.select(
        "record_id", "url", "fetched", "outcome", F.col("full.record_id").alias("refers_to"), F.when(ok, lines).alias("headers"),
        F.when(ok, F.col("full.payload_digest")).alias("payload_digest"), F.when(ok, F.coalesce("full.payload_length", F.lit(0))).otherwise(0).alias("payload_length"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Records about the pages table, which has none: for each page its response and two later revisits, whose validators agree or not depending on page_id; a few revisits come before their response."""
    n = F.col("page_id")
    base = F.lit(1_704_067_200) + F.pmod(n * 7919, F.lit(31_536_000))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.pmod(n, F.lit(365)).cast("string"))
    line = lambda name, value, when: F.when(when, F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")
    record = lambda name, kind, url, at, status, headers, has: F.struct(F.concat(F.lit(name), n.cast("string")).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), F.timestamp_seconds(at).alias("fetched"), F.lit(status).alias("status"), headers.alias("headers"), (F.col("digest") if has else F.lit(None).cast("string")).alias("payload_digest"), (F.col("size") if has else F.lit(None).cast("long")).alias("payload_length"))
    response = F.concat(line("ETag", tag, n % 7 != 0), line("Last-Modified", day, n % 5 != 0), line("Content-Length", F.col("size").cast("string"), F.lit(True)), line("Server", F.lit("httpd"), F.lit(True)), line("Cache-Control", F.lit("max-age=60"), n % 2 == 0))
    first = F.concat(line("etag", F.when(n % 11 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag)), n % 7 != 0), line("Last-Modified", day, n % 5 != 0), line("Content-Length", F.lit("0"), F.lit(True)), line("Cache-Control", F.lit("no-cache"), n % 3 == 0), line("Date", F.lit("later"), F.lit(True)))
    second = F.concat(line("Last-Modified", F.when(n % 17 == 0, F.lit("day x")).otherwise(day), n % 5 != 0), line("Expires", F.lit("never"), F.lit(True)))
    longer = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_medium=again"))
    made = F.array(record("r", "response", F.col("url"), base, 200, response, True), record("v", "revisit", longer, base + F.when(n % 13 == 0, -86_400).otherwise(86_400), 304, first, False), record("w", "revisit", F.col("url"), base + 172_800, 304, second, False))
    short = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    return short.select(F.explode(made).alias("x")).select("x.*")


def op6(spark, sf_dir: str) -> DataFrame:
    """All revisits of all pages, resolved."""
    return resolve_revisits(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


_LINES = "list_filter(regexp_split_to_array(coalesce({}, ''), '\\r?\\n'), lambda x: regexp_matches(x, '^[^:\\s]+:'))"
_PAIR = "{{'name': lower(regexp_extract(x, '^([^:]+):', 1)), 'value': trim(regexp_replace(x, '^[^:]+:', ''))}}"


def _parsed(block: str) -> str:
    lines = _LINES.format(block)
    return f"list_transform({lines}, lambda x: {_PAIR.format()})"


def _value(pairs: str, name: str) -> str:
    return f"list_filter({pairs}, lambda p: p.name = '{name}')[-1].value"


_SQL = f"""
with s as (
  select page_id as n, url, md5(coalesce(html, '')) as digest, strlen(coalesce(html, ''))::bigint as size, 1704067200 + (page_id * 7919) % 31536000 as base from pages
), t as (
  select *, '"' || substr(digest, 1, 16) || '"' as tag, 'day ' || (n % 365) as day, chr(13) || chr(10) as nl from s
), responses as (
  select 'r' || n as record_id, url, base as secs, digest, size,
    (case when n % 7 <> 0 then 'ETag: ' || tag || nl else '' end) || (case when n % 5 <> 0 then 'Last-Modified: ' || day || nl else '' end)
    || 'Content-Length: ' || size || nl || 'Server: httpd' || nl || (case when n % 2 = 0 then 'Cache-Control: max-age=60' || nl else '' end) as headers from t
), revisits as (
  select 'v' || n as record_id, regexp_replace(url, '#.*$', '') || (case when contains(url, '?') then '&' else '?' end) || 'utm_medium=again' as url,
    base + (case when n % 13 = 0 then -86400 else 86400 end) as secs,
    (case when n % 7 <> 0 then 'etag: ' || (case when n % 11 = 0 then '"other"' else 'W/' || tag end) || nl else '' end) || (case when n % 5 <> 0 then 'Last-Modified: ' || day || nl else '' end)
    || 'Content-Length: 0' || nl || (case when n % 3 = 0 then 'Cache-Control: no-cache' || nl else '' end) || 'Date: later' || nl as headers from t
  union all select 'w' || n, url, base + 172800, (case when n % 5 <> 0 then 'Last-Modified: ' || (case when n % 17 = 0 then 'day x' else day end) || nl else '' end) || 'Expires: never' || nl from t
), u as (
  select record_id, url, secs, headers, digest, size, true as full_ from responses union all select record_id, url, secs, headers, null, null, false from revisits
), b as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?@]*@)?', '') as bare from u
), c as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '([?&])(utm_[a-z]*=[^&]*&)+', '\\1', 'g'), '[?&]utm_[a-z]*=[^&]*$', ''), '[?]$', ''), '/$', '') as canonical from b
), best as (
  select canonical, secs, max(record_id) as record_id, max_by(headers, record_id) as headers, max_by(digest, record_id) as digest, max_by(size, record_id) as size from c where full_ and url is not null group by all
), j as (
  select v.record_id, v.url, v.secs, {_parsed("v.headers")} as new, r.record_id as refers_to, {_parsed("r.headers")} as old, r.digest, r.size
  from (select * from c where not full_) v asof left join best r on v.canonical = r.canonical and v.secs > r.secs
), o as (
  select *, case when refers_to is null then 'no_earlier_response'
    when {_value("new", "etag")} is not null then case when regexp_replace({_value("new", "etag")}, '^W/', '') = regexp_replace({_value("old", "etag")}, '^W/', '') then 'resolved' else 'validator_mismatch' end
    when {_value("new", "last-modified")} is not null then case when {_value("new", "last-modified")} = {_value("old", "last-modified")} then 'resolved' else 'validator_mismatch' end
    else 'no_validator' end as outcome,
    list_filter(new, lambda p: list_contains({list(PERMITTED)}, p.name)) as update_ from j
)
select record_id, url, to_timestamp(secs)::timestamp as fetched, outcome, refers_to,
  case when outcome = 'resolved' then array_to_string(list_transform(list_sort(list_concat(list_filter(old, lambda p: not list_contains(list_transform(update_, lambda q: q.name), p.name)), update_)), lambda p: p.name || ': ' || p.value), chr(10)) end as headers,
  case when outcome = 'resolved' then digest end as payload_digest, case when outcome = 'resolved' then size else 0 end as payload_length
from o
"""

QUERIES: dict[str, Callable] = {"op6_warc_revisits": op6}
SQL: dict[str, str] = {"op6_warc_revisits": _SQL}
