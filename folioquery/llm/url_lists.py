"""URL filter lists that change over time, joined as of each capture's fetch.

List entries are dated statements about a key: a host, a parent domain, or a host
with the first path segment. For each key they become validity intervals (a
statement holds until the next one for the same key); a capture meets the entries
of all keys it falls under that were valid at fetch time, and the most specific
key decides. Intervals are cut into periods, so that a key with a long history
meets a hot host's captures period by period, as an equi-join that adaptive
execution can split.

Defined cases: null or unparsable URLs and null dates match nothing and are
``none``; statements with null key, day or action are ignored; several statements
for one key and day count as the strictest (block, then allow, then remove);
repeated captures keep a row each; empty tables give no rows or no matches; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 64
# Strictest first.
ACTIONS = ["block", "allow", "remove"]


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::\d*)?(?:[/?#]|$)", 1))


def first_segment(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def keys_of(url: Column) -> Column:
    """(key, rank): host with first path segment, host, then every parent of two or more labels."""
    host, segment = host_of(url), first_segment(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(
        F.sequence(F.lit(2), F.greatest(n, F.lit(2))),
        lambda k: F.struct(F.concat_ws(".", F.slice(labels, n - F.least(k, n) + 1, F.least(k, n))).alias("key"), k.alias("rank")),
    )
    path = F.array(F.struct(F.concat_ws("/", host, segment).alias("key"), F.lit(1000).alias("rank")))
    none = F.expr("cast(array() as array<struct<key:string,rank:int>>)")
    return F.when((host != "") & (n >= 2), F.concat(parents, F.when(segment != "", path).otherwise(none))).otherwise(none)


def validity(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to) with valid_to exclusive and null while open."""
    strictness = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    per_day = (
        entries.filter("key is not null and day is not null and action is not null")
        .filter(F.col("action").isin(ACTIONS))
        .groupBy("key", "day")
        .agg(F.min_by("action", strictness).alias("action"))
    )
    by_key = Window.partitionBy("key").orderBy("day")
    return (
        per_day.withColumn("valid_to", F.lead("day").over(by_key))
        .filter("action <> 'remove'")
        .select("key", "action", F.col("day").alias("valid_from"), "valid_to")
    )


def judge_captures(captures: DataFrame, entries: DataFrame, horizon: int, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """One row per capture: decision, the deciding key and since when it was listed.

    Days are whole numbers; ``horizon`` is the last day that open intervals reach.
    """
    period = lambda c: F.floor(c / PERIOD_DAYS)
    seen = captures.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.col(day_col).alias("fetch_day"),
    ).withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    asked = seen.filter("url is not null and fetch_day is not null").select(
        "_row", "fetch_day", F.explode(keys_of(F.col("url"))).alias("k"), period(F.col("fetch_day")).alias("period")
    ).select("_row", "fetch_day", "period", "k.key", "k.rank")
    last = F.coalesce(F.col("valid_to") - 1, F.greatest(F.lit(horizon), F.col("valid_from")))
    listed = validity(entries).withColumn("period", F.explode(F.sequence(period(F.col("valid_from")), period(last))))
    hit = (
        asked.join(listed, ["key", "period"])
        .filter("fetch_day >= valid_from and (valid_to is null or fetch_day < valid_to)")
        .select("_row", F.struct("rank", "key", "action", "valid_from").alias("m"))
    )
    best = hit.groupBy("_row").agg(F.max("m").alias("m"))
    return seen.join(best, "_row", "left").select(
        "page_id", "url", "fetch_day", "host", F.coalesce("m.action", F.lit("none")).alias("decision"),
        F.col("m.key").alias("key"), F.col("m.valid_from").alias("listed_day"),
    )
