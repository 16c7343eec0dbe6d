"""URL filters: a temporal join of captures with dated block-list entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many intervals are broadcast; beyond it captures and list meet by a salted shuffle.
BROADCAST_ROWS, SALTS = 50_000, 16
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL; null without one."""
    host = F.regexp_extract(F.lower(url), _HOST, 1)
    return F.when(host != "", F.regexp_replace(host, r"\.+$", ""))


def keys_of(url: Column) -> Column:
    """The list keys that a URL falls under: its host and parent domains, and the host with each leading part of the path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))), lambda k: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>")))))


def validity(entries: DataFrame) -> DataFrame:
    """(key, since, until) from dated entries (kind, value, day, action): a key is listed from an `add` to the next `remove`.

    kind is domain or prefix; other kinds list nothing. A host counts whatever its case, a prefix
    with or without a scheme and a last slash. Of a key's entries of one day an add wins; repeats
    of an action change nothing; until is null while listed. Entries with a null in any of the four
    are ignored.
    """
    bare = F.regexp_replace(F.trim("value"), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    prefix = F.regexp_replace(F.concat(F.lower(F.regexp_extract(bare, "^[^/]*", 0)), F.regexp_extract(bare, "/.*$", 0)), r"/+$", "")
    value = F.when(F.col("kind") == "domain", F.regexp_replace(F.lower(F.trim("value")), r"\.+$", "")).when(F.col("kind") == "prefix", prefix)
    rows = entries.select(F.concat("kind", F.lit(":"), value).alias("key"), F.col("day").cast("date").alias("day"), (F.col("action") == "add").alias("on"))
    days = rows.dropna().groupBy("key", "day").agg(F.max("on").alias("on"))
    order = Window.partitionBy("key").orderBy("day")
    changed = days.withColumn("was", F.lag("on").over(order)).filter("on != coalesce(was, false)")
    return changed.withColumn("until", F.lead("day").over(order)).filter("on").select("key", F.col("day").alias("since"), "until")


def listed(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(page_id, url, fetched_at, host, blocked, listed_key, listed_since) for each capture.

    A capture is blocked if one of its keys was listed when it was fetched, since included and
    until not; listed_key is the longest such key, ties to the lesser, listed_since its date. A null
    or relative URL or a null time is never blocked. Repeated captures each have their row. Empty
    captures give an empty result, an empty list blocks nothing; other columns are ignored.
    """
    rows = captures.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{time_col}`").cast("timestamp").alias("fetched_at"))
    # Equal captures fare alike and meet the list once.
    asked = rows.select("url", F.to_date("fetched_at").alias("day")).dropna().distinct()
    keyed = asked.withColumn("key", F.explode(keys_of(F.col("url"))))
    list_ = validity(entries)
    if list_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = keyed.join(F.broadcast(list_), "key")
    else:
        salted = list_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keyed.withColumn("salt", F.pmod(F.hash("url", "day"), F.lit(SALTS))).join(salted, ["key", "salt"])
    active = met.filter("since <= day and (until is null or day < until)")
    best = active.groupBy("url", "day").agg(F.min(F.struct((-F.length("key")).alias("n"), "key", "since")).alias("hit"))
    out = rows.withColumn("day", F.to_date("fetched_at")).join(best, ["url", "day"], "left")
    return out.select("page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"), F.col("hit").isNotNull().alias("blocked"), F.col("hit.key").alias("listed_key"), F.col("hit.since").alias("listed_since"))
