"""URL filters by a temporal list join (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import carried, if_small, stored

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?([^/?#:@]*)", 1)), r"\.+$", "")


def url_path(url: Column) -> Column:
    """Path without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_extract(url, _SCHEME + r"[^/?#]*(/[^?#]*)?", 1), "/+$", "")


def url_keys(url: Column, labels_at_least: int = 1) -> Column:
    """What a list may name to cover a URL: its host and each parent domain of so many labels or
    more, with no path or any of the path's leading parts, as host/path."""
    labels, parts = F.split(url_host(url), r"\."), F.split(url_path(url), "/")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels) - labels_at_least + 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    none = (url_host(url) == "") | (F.size(labels) < labels_at_least)
    return F.array_distinct(F.when(none, F.array().cast("array<string>")).otherwise(keys))


def entry_key(entry: Column) -> Column:
    """A list entry (host, host/path or URL) as a key."""
    bare = F.regexp_replace(F.trim(entry), _SCHEME, "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?#:]*", 0)), r"^\*?\.|\.+$", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*(/[^?#]*)", 1), "/+$", ""))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (entry, dated, action 'add' or 'remove') -> (key, since, until).

    An addition holds from its day until the day of the key's next removal, and without end
    (until null) if there is none; adding what is there or removing what is not changes
    nothing.  On one day a removal comes after an addition.  Entries without a key or a date are
    left out, and other actions raise no objection but do nothing.
    """
    days = entries.select(entry_key(F.col("entry")).alias("key"), F.col("dated").cast("date").alias("day"), F.lower("action").alias("action"))
    days = days.filter("key <> '' AND day IS NOT NULL AND action IN ('add', 'remove')")
    days = days.groupBy("key", "day").agg((F.max("action") == "add").alias("on"))
    order = Window.partitionBy("key").orderBy("day")
    turns = days.withColumn("was", F.lag("on").over(order)).filter("on <> coalesce(was, false)")
    spans = turns.withColumn("until", F.lead("day").over(order)).filter("on")
    return spans.select("key", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """Each capture with url_blocked and url_rules, by the entries active when it was fetched.

    captures have a URL and a time of fetching, entries are as in validity().  url_rules are the
    keys active on that day that cover the URL, sorted.  A null URL or one without a host is
    covered by nothing, and neither is a capture of unknown time.  Repeated rows stay; empty
    tables are as good as any; other columns are carried along, but for two named url_blocked and
    url_rules, which give way.

    As-of join: captures that a listed key could cover are first reduced to distinct days of that key, so that a host with
    a third of all captures is as many rows as it has days.  Of those and the beginnings of
    intervals, ordered by day, each day takes the last interval that began before it.
    """
    spans = stored(validity(entries), "url-validity")
    listed = stored(spans.select("key").distinct(), "url-listed")
    # parent domains shorter than any that is listed, such as those that most captures share, are no keys
    least = listed.agg(F.coalesce(F.min(F.size(F.split(F.split_part("key", F.lit("/"), F.lit(1)), r"\."))), F.lit(1))).first()[0]
    url, day = F.col(url_col).cast("string"), F.col(fetched_col).cast("date")
    hits = captures.select(url.alias("_url"), day.alias("_day")).select("_url", "_day", F.explode(url_keys(F.col("_url"), least)).alias("key"))
    hits = stored(hits.filter("_day IS NOT NULL").join(if_small(listed), "key", "left_semi").distinct(), "url-hits")
    distinct = hits.select("key", F.col("_day").alias("day")).distinct()
    order = Window.partitionBy("key").orderBy("day", F.col("asked")).rowsBetween(Window.unboundedPreceding, 0)
    span = F.struct("since", "until")
    timeline = spans.select("key", F.col("since").alias("day"), F.lit(False).alias("asked"), span.alias("span")).union(
        distinct.select("key", "day", F.lit(True), F.lit(None).cast("struct<since:date,until:date>")))
    last = timeline.withColumn("span", F.last("span", ignorenulls=True).over(order)).filter("asked")
    active = last.filter("span.since <= day AND (span.until IS NULL OR day < span.until)").select("key", F.col("day").alias("_day"))
    rules = hits.join(if_small(stored(active, "url-active")), ["key", "_day"]).groupBy("_url", "_day").agg(F.array_sort(F.collect_set("key")).alias("_rules"))
    rules = if_small(stored(rules, "url-rules"))
    names = carried(captures, "url_blocked", "url_rules")
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), url.alias("_url"), day.alias("_day"))
    found = F.coalesce("_rules", F.array().cast("array<string>"))
    rows = rows.join(rules, ["_url", "_day"], "left")
    return rows.select(*(F.col(f"_row.`{c}`").alias(c) for c in names), F.col("_rules").isNotNull().alias("url_blocked"), found.alias("url_rules"))
