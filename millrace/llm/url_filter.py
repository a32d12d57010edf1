"""URL filters that change in time: dated list entries as validity intervals, joined as of each capture's fetch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .membership import among

_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)"
#: How much an entry says of a URL: the kind first, then the length of its pattern.
_RANK = {"host": 0, "prefix": 1, "url": 2}


def _bare(url: Column) -> tuple[Column, Column]:
    """A URL's host, and all of it without scheme, user, port and fragment, in lower case."""
    low = F.regexp_replace(F.lower(F.trim(url)), "#.*$", "")
    host = F.regexp_extract(low, _AUTHORITY, 1)
    return host, F.concat(host, F.regexp_replace(F.regexp_replace(low, _AUTHORITY, ""), "^:[0-9]*", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, kind, pattern, action, valid_from, valid_to): when each entry holds, valid_to excluded and null for an open end.

    ``entries`` has (list_name, kind, pattern, action, event, at): ``event`` is ``add`` or ``remove``.
    A further add of the same list, kind and pattern ends what held before. Of events at one time a
    removal comes last, and of adds ``allow``. Entries without kind, pattern, action or time don't count;
    repeated entries count once. Patterns are read like URLs, without scheme, user, port and fragment; of
    a host's pattern the host counts, and a prefix without a slash is a whole host's.
    """
    host, rest = _bare(F.col("pattern"))
    pattern = F.when(F.lower("kind") == "host", host).when((F.lower("kind") == "prefix") & (rest == host) & (host != ""), F.concat(host, F.lit("/"))).otherwise(rest)
    given = entries.select("list_name", F.lower("kind").alias("kind"), pattern.alias("pattern"), F.lower("action").alias("action"), F.lower("event").alias("event"), F.col("at").cast("timestamp").alias("valid_from"))
    given = given.where("kind in ('host', 'prefix', 'url') and pattern <> '' and action in ('block', 'allow') and event in ('add', 'remove') and valid_from is not null").distinct()
    w = Window.partitionBy("list_name", "kind", "pattern").orderBy("valid_from", "event", F.desc("action"))
    dated = given.withColumn("valid_to", F.lead("valid_from").over(w))
    return dated.where("event = 'add' and (valid_to is null or valid_to > valid_from)").drop("event")


def url_keys(url: str):
    """Column: all (kind, pattern, tail) under which an entry may list the URL: its host and each parent domain, each prefix up to a slash with what follows it, itself.

    Scheme, user, port and fragment don't count, and case doesn't.
    """
    host, rest = _bare(F.col(url))
    labels = F.split(host, r"\.")
    key = lambda kind, pattern, tail=F.lit(""): F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), tail.alias("tail"))
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: key("host", F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    parts = F.split(F.regexp_replace(rest, r"\?.*$", ""), "/")
    up_to = lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: key("prefix", up_to(k), F.substr(rest, F.length(up_to(k)) + 1)))
    # a URL that ends with its host has the root's path
    root = F.array(key("prefix", F.concat(host, F.lit("/")), F.substr(rest, F.length(host) + 1)))
    return F.array_distinct(F.concat(hosts, F.when(F.size(parts) > 1, prefixes).otherwise(root), F.array(key("url", rest))))


def filter_urls(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, fetched, verdict, list_name, kind, pattern, active) for each distinct capture (key, url, fetched).

    Of the entries that hold at the fetch the one that says most decides: a whole URL before a prefix
    before a host, then the longer pattern; of equals ``allow``, then the first list by name. Without
    any, the verdict is ``allow`` and the three columns are null. ``active`` counts entries that hold. A
    prefix may end anywhere in a path or a query.

    A capture without url is blocked, for nothing can be said of it; one without fetch time is judged
    by no entry, so it is allowed. Repeated captures give one row; URLs of any length count in whole. An
    entry holds from its start on and no longer at its end. No captures give no rows; no entries allow
    all. Columns other than the three aren't read.

    Each key of a capture, without its URL, meets a bitmap of the keys that entries have; what passes is
    joined to the intervals, by their size broadcast or not, under one of a pattern's last slash. So keys
    such as a top-level domain travel only if they are listed. URLs travel once, when hits come back to captures.
    """
    held = intervals(entries)
    one = captures.select(F.col(key).alias("_key"), F.col("url"), F.col("fetched").cast("timestamp").alias("fetched"))
    rank = F.create_map(*[F.lit(x) for pair in _RANK.items() for x in pair])
    place = F.when(F.col("kind") == "prefix", F.regexp_extract(F.regexp_replace("pattern", r"\?.*$", ""), "^(.*/)", 1)).otherwise(F.col("pattern"))
    held = held.select("list_name", "kind", "pattern", "action", "valid_from", "valid_to", rank[F.col("kind")].alias("rank"), place.alias("place"))
    held = held.withColumn("rest", F.when(F.col("kind") == "prefix", F.substr("pattern", F.length("place") + 1)).otherwise("")).withColumn("hash", F.xxhash64("kind", "place"))
    keyed = one.select("_key", F.xxhash64("url").alias("_url"), "fetched", F.explode(url_keys("url")).alias("k"))
    keyed = keyed.select("_key", "_url", F.col("fetched").alias("_at"), F.xxhash64("k.kind", "k.pattern").alias("hash"), F.col("k.kind").alias("k_kind"), F.col("k.pattern").alias("k_pattern"), F.col("k.tail").alias("k_tail"))
    listed = among(keyed.where("_at is not null"), held.select("hash"), "hash").drop("hash")
    holds = (F.col("kind") == F.col("k_kind")) & (F.col("place") == F.col("k_pattern")) & F.startswith("k_tail", "rest") & (F.col("valid_from") <= F.col("_at")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    hit = F.struct((-F.col("rank")).alias("rank"), (-F.length("pattern")).alias("length"), "action", "list_name", "kind", "pattern")
    # copies of one capture would count their entries again, so entries are gathered as a set
    met = listed.join(held.drop("hash"), holds).groupBy("_key", "_at", "_url").agg(F.collect_set(hit).alias("hits"))
    whole = one.groupBy("_key", F.col("fetched").alias("_at"), F.xxhash64("url").alias("_url")).agg(F.first("url").alias("url"))
    met = whole.alias("w").join(met.alias("m"), F.expr("w._key <=> m._key and w._at <=> m._at and w._url = m._url"), "left").select("w.*", "m.hits")
    best = F.array_min("hits")
    return met.select(
        F.col("_key").alias(key), "url", F.col("_at").alias("fetched"),
        F.when(F.col("url").isNull(), "block").otherwise(F.coalesce(best["action"], F.lit("allow"))).alias("verdict"),
        best["list_name"].alias("list_name"), best["kind"].alias("kind"), best["pattern"].alias("pattern"), F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits")).cast("long").alias("active"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no fetch times: they follow from page_id, within 2024."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(525_600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + minute * 60).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated entries about the hosts of the pages table: some hosts blocked, unblocked and blocked again, some prefixes allowed, two domains blocked for a while."""
    host = F.regexp_extract(F.lower("url"), "//([^/]+)", 1)
    hosts = pages.where("url is not null").select(host.alias("host")).where("host <> ''").distinct()
    n = F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long")
    event = lambda name, kind, pattern, action, what, day: F.struct(F.lit(name).alias("list_name"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), F.lit(what).alias("event"), F.timestamp_seconds(F.lit(1_704_067_200) + day * 86_400).alias("at"))
    made = F.array(
        event("hosts", "host", F.col("host"), "block", "add", n % 150),
        event("hosts", "host", F.col("host"), "block", "remove", n % 150 + 60),
        event("hosts", "host", F.col("host"), "block", "add", n % 150 + 120),
        event("paths", "prefix", F.concat("host", F.lit("/en/")), "allow", "add", n % 90 + 30),
        event("paths", "prefix", F.concat("host", F.lit("/de/")), "block", "add", n % 200),
        event("domains", "host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), "block", "add", F.lit(200)),
        event("domains", "host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), "block", "remove", F.lit(230)),
    )
    return hosts.select(F.explode(made).alias("e")).select("e.*")


def op5(spark, sf_dir: str) -> DataFrame:
    """Every page's capture against the entries that held when it was fetched."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(page_captures(pages), page_entries(pages))


_SQL = r"""
with captures as (
  select distinct page_id, url, to_timestamp(1704067200 + ((page_id * 7919) % 525600) * 60)::timestamp as fetched from pages
), hosts as (
  select distinct regexp_extract(lower(url), '//([^/]+)', 1) as host from pages where regexp_extract(lower(url), '//([^/]+)', 1) <> ''
), n as (select host, ('0x' || substr(md5(host), 1, 8))::bigint as n, regexp_extract(host, '([^.]+\.[^.]+)$', 1) as domain from hosts),
events as (
  select 'hosts' as list_name, 'host' as kind, host as pattern, 'block' as action, 'add' as event, n % 150 as day from n
  union select 'hosts', 'host', host, 'block', 'remove', n % 150 + 60 from n
  union select 'hosts', 'host', host, 'block', 'add', n % 150 + 120 from n
  union select 'paths', 'prefix', host || '/en/', 'allow', 'add', n % 90 + 30 from n
  union select 'paths', 'prefix', host || '/de/', 'block', 'add', n % 200 from n
  union select 'domains', 'host', domain, 'block', 'add', 200 from n
  union select 'domains', 'host', domain, 'block', 'remove', 230 from n
), dated as (
  select *, to_timestamp(1704067200 + day * 86400)::timestamp as valid_from,
    lead(to_timestamp(1704067200 + day * 86400)::timestamp) over (partition by list_name, kind, pattern order by day, event, action desc) as valid_to
  from events
), held as (
  select * from dated where event = 'add' and (valid_to is null or valid_to > valid_from)
), parts as (
  select *, regexp_replace(lower(trim(url)), '#.*$', '') as bare from captures
), split as (
  select *, regexp_extract(bare, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1) as host,
    regexp_replace(regexp_replace(bare, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', ''), '^:[0-9]*', '') as path from parts
), keys as (
  select page_id, url, fetched, 'host' as kind, array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.') as pattern
    from split, unnest(range(1, len(string_split(host, '.')) + 1)) as u(k)
  union select page_id, url, fetched, 'url', host || path from split
  union select page_id, url, fetched, 'prefix', array_to_string(list_slice(string_split(regexp_replace(host || path, '\?.*$', ''), '/'), 1, k), '/') || '/'
    from split, unnest(range(1, len(string_split(regexp_replace(host || path, '\?.*$', ''), '/')))) as u(k)
), hits as (
  select k.page_id, k.url, k.fetched, h.list_name, h.kind, h.pattern, h.action,
    case h.kind when 'host' then 0 when 'prefix' then 1 else 2 end as rank
  from keys k join held h on h.kind = k.kind and h.pattern = k.pattern and h.valid_from <= k.fetched and (h.valid_to is null or k.fetched < h.valid_to)
), ranked as (
  select *, row_number() over (partition by page_id, url, fetched order by rank desc, length(pattern) desc, action, list_name) as r, count(*) over (partition by page_id, url, fetched) as active from hits
)
select c.page_id, c.url, c.fetched, case when c.url is null then 'block' else coalesce(r.action, 'allow') end as verdict,
  r.list_name, r.kind, r.pattern, coalesce(r.active, 0) as active
from captures c left join ranked r on r.page_id = c.page_id and r.url = c.url and r.fetched = c.fetched and r.r = 1
"""

QUERIES: dict[str, Callable] = {"op5_url_filter": op5}
SQL: dict[str, str] = {"op5_url_filter": _SQL}
