"""URL filters as a temporal list join.

A list is a history: on a day, a pattern is blocked, allowed or taken off. Each entry holds from its day until the
pattern's next entry, and a capture is judged by the entries in force on the day it was fetched.

The join is an equi-join on (pattern kind, pattern, period): a capture yields its few possible patterns, an interval the
periods it touches, so neither a busy host nor a pattern with a long history multiplies the other. Only prefixes as
deep as the deepest listed one are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factorwise.llm.common import cut, table

#: Days of a period.
PERIOD = 32
#: Most specific first.
KINDS = ("url", "prefix", "host", "domain")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, action, start, until) for entries (list, kind, pattern, action, day).

    Of entries for one pattern on one day the strongest counts: block, then allow, then remove. ``until`` is exclusive
    and null for the last entry; removals end an interval and start none. Entries with a null in any column are void.
    """
    strength = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    whole = entries.filter(F.col("list").isNotNull() & F.col("kind").isin(*KINDS) & F.col("pattern").isNotNull() & F.col("day").isNotNull() & strength.isNotNull())
    daily = whole.groupBy("list", "kind", "pattern", "day").agg(F.max(F.struct(strength.alias("s"), "action")).alias("x"))
    later = F.lead("day").over(W.partitionBy("list", "kind", "pattern").orderBy("day"))
    return (
        daily.select("list", "kind", "pattern", F.col("x.action").alias("action"), F.col("day").alias("start"), later.alias("until"))
        .filter("action <> 'remove'")
    )


def judge(captures: DataFrame, entries: DataFrame, *, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """One row per row of ``captures``: key, decision, list, kind, pattern, valid_from, valid_to.

    Of the entries in force the most specific decides (url, longer prefix, host, longer domain); between lists, block
    beats allow, then the first list by name. decision is block, allow, none (nothing in force) or invalid (url without
    a host, or no fetch day). Domains cover their subdomains; prefixes end at a slash boundary and do not see queries.
    Repeated rows are judged one by one; both tables may be empty; only the named columns are read.
    """
    held = cut(intervals(entries))
    span = captures.agg(F.max(fetched).alias("last")).first()
    depth = held.filter("kind = 'prefix'").agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    period = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / PERIOD).cast("int")
    last = F.lit(span.last).cast("date")
    stop = F.coalesce(F.date_sub("until", 1), last)
    spread = held.filter(F.col("start") <= last).withColumn(
        "period", F.explode(F.sequence(period(F.col("start")), F.greatest(period(F.col("start")), F.least(period(stop), period(last)))))
    )
    rows = cut(
        captures.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(url).alias("url"), F.col(fetched).alias("day")
        ).withColumn("host", host_of(F.col("url")))
    )
    labels, steps = F.split("host", r"\."), F.split(F.concat("host", path_of(F.col("url"))), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    deep = F.least(F.size(steps), F.lit(depth + 1))
    prefixes = F.transform(F.sequence(F.lit(1), deep), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    named = lambda kind, arr: F.transform(arr, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern")))
    keys = F.concat(named("url", F.array("url")), named("prefix", prefixes), named("host", F.array("host")), named("domain", domains))
    asked = rows.filter("host is not null and day is not null").select("row", "day", period(F.col("day")).alias("period"), F.explode(keys).alias("k"))
    met = asked.select("row", "day", "period", "k.kind", "k.pattern").join(spread, ["kind", "pattern", "period"])
    met = met.filter((F.col("day") >= F.col("start")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    order = F.struct(
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("place"),
        (-F.length("pattern")).alias("short"),
        (F.col("action") != "block").alias("mild"),
        "list",
        "action",
        "kind",
        "pattern",
        "start",
        "until",
    )
    best = met.groupBy("row").agg(F.min(order).alias("b"))
    none = F.when(F.col("host").isNull() | F.col("day").isNull(), "invalid").otherwise("none")
    return rows.join(best, "row", "left").select(
        F.col("key").alias(key),
        F.coalesce("b.action", none).alias("decision"),
        F.col("b.list").alias("list"),
        F.col("b.kind").alias("kind"),
        F.col("b.pattern").alias("pattern"),
        F.col("b.start").alias("valid_from"),
        F.col("b.until").alias("valid_to"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages with a day of fetching each, spread over a year by id (the table has none)."""
    return pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id * 7919 % 366 as int))").alias("fetched"))


def page_lists(pages: DataFrame) -> DataFrame:
    """Dated list entries made from the pages' own hosts and urls (no list is given)."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct().withColumn("shift", F.length("host") % 28)
    bare = F.regexp_replace("host", r"^(www|m|blog)\.", "")

    def on(where: str, name: str, kind: str, pattern: Column, action: str, day: str) -> DataFrame:
        return hosts.filter(where).select(
            F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), F.expr(f"date_add(date'{day}', shift)").alias("day")
        )

    bad, blog, third = "host rlike '(casino|bets|pills|spam|ads-|adult)'", "host like 'blog.%'", "length(host) % 3 = 0"
    parts = [
        on(bad, "trade", "domain", bare, "block", "2024-02-01"),
        on(bad, "trade", "domain", bare, "remove", "2024-05-01"),
        on(bad, "trade", "domain", bare, "block", "2024-07-01"),
        on(blog, "hosts", "host", F.col("host"), "block", "2024-03-01"),
        on(blog, "hosts", "host", F.col("host"), "allow", "2024-09-01"),
        on(third, "paths", "prefix", F.concat("host", F.lit("/en")), "block", "2024-04-01"),
        on(third, "paths", "prefix", F.concat("host", F.lit("/en")), "remove", "2024-10-01"),
    ]
    single = pages.filter("page_id % 20 = 0").select(
        F.lit("review").alias("list"), F.lit("url").alias("kind"), F.col("url").alias("pattern"), F.lit("allow").alias("action"), F.lit("2024-01-15").cast("date").alias("day")
    )
    out = single
    for p in parts:
        out = out.unionByName(p)
    return out


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(page_captures(pages), page_lists(pages))


OP4_SQL = r"""
with p as (
  select page_id, url, date '2024-01-01' + cast(page_id * 7919 % 366 as int) as day,
         nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), '\.?(:[0-9]*)?$', ''), '') as host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path
  from pages),
h as (select distinct host, cast(length(host) % 28 as int) as shift, regexp_replace(host, '^(www|m|blog)\.', '') as bare from p where host is not null),
e as (
  select distinct 'review' as list, 'url' as kind, url as pattern, 'allow' as action, date '2024-01-15' as day from p where page_id % 20 = 0
  union all select 'trade', 'domain', bare, a, d + shift from h, (values ('block', date '2024-02-01'), ('remove', date '2024-05-01'), ('block', date '2024-07-01')) t(a, d)
    where regexp_matches(host, '(casino|bets|pills|spam|ads-|adult)')
  union all select 'hosts', 'host', host, a, d + shift from h, (values ('block', date '2024-03-01'), ('allow', date '2024-09-01')) t(a, d) where host like 'blog.%'
  union all select 'paths', 'prefix', host || '/en', a, d + shift from h, (values ('block', date '2024-04-01'), ('remove', date '2024-10-01')) t(a, d) where length(host) % 3 = 0),
s as (select list, kind, pattern, day, max(case action when 'block' then 2 when 'allow' then 1 else 0 end) as s from e group by all),
i as (select list, kind, pattern, s, day as start, lead(day) over (partition by list, kind, pattern order by day) as until from s),
m as (
  select p.page_id, i.*, row_number() over (partition by p.page_id order by
      case i.kind when 'url' then 1 when 'prefix' then 2 when 'host' then 3 else 4 end, -length(i.pattern), i.s <> 2, i.list) as r
  from p join i on i.s > 0 and p.day >= i.start and (i.until is null or p.day < i.until) and p.host is not null and case i.kind
      when 'url' then i.pattern = p.url
      when 'prefix' then p.host || p.path = i.pattern or starts_with(p.host || p.path, i.pattern || '/')
      when 'host' then i.pattern = p.host
      else p.host = i.pattern or ends_with(p.host, '.' || i.pattern) end)
select p.page_id, case when m.s = 2 then 'block' when m.s = 1 then 'allow' when p.host is null then 'invalid' else 'none' end as decision,
       m.list, m.kind, m.pattern, m.start as valid_from, m.until as valid_to
from p left join m on m.page_id = p.page_id and m.r = 1
"""
