"""The TTL cache as table jobs: lookup, upsert, clearing, miss-only work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.operators.keys import last_per
from hirelake.operators.keys import lookup as lookup_side
from hirelake.rules import Rules

EMPTY_VALUES = ("", "[]", "{}", "null", '""')


def expiry_after(created: Column | str, seconds: Column | str | int) -> Column:
    """``created`` plus a lifetime in seconds; one below zero is over at once."""
    start = F.col(created) if isinstance(created, str) else created
    span = F.lit(seconds) if isinstance(seconds, int) else F.col(seconds) if isinstance(seconds, str) else seconds
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), span.cast("decimal(18,6)"))


def upsert(entries: DataFrame, version: str = "version") -> DataFrame:
    """One row per key, the last written one (an aggregate; repeats of a key combine map-side)."""
    return last_per(entries, ["key"], version)


def write(stored: DataFrame, writes: DataFrame, rules: Rules) -> DataFrame:
    """The entries after a batch of writes: a write replaces its key's value and expiry.

    ``writes(key, version, value, created_at, ttl_seconds)``; without seconds of its own a write gets the rules'
    lifetime. The latest write (time, then version) of a key counts, also against ``stored``, which has the result's columns
    ``(key, version, value, created_at, expires_at)``. One aggregate, combined before its shuffle.
    """
    seconds = F.coalesce("ttl_seconds", F.lit(rules.cache_ttl_seconds))
    fresh = writes.select("key", "version", "value", "created_at", expiry_after("created_at", seconds).alias("expires_at"))
    both = stored.select(*fresh.columns).unionByName(fresh)
    return last_per(both, ["key"], F.struct("created_at", "version"))


def is_live(as_of: str, expires: str = "expires_at") -> Column:
    """An entry expiring exactly now is still served."""
    return F.col(expires) >= F.lit(as_of).cast("timestamp_ntz")


def lookup(requests: DataFrame, entries: DataFrame, as_of: str,
           treat_empty_as_miss: bool = True) -> DataFrame:
    """Requests with their cached ``value`` (null on a miss) and ``hit``.

    Expired entries are dropped before the join. Callers differ on whether an empty value is a hit.
    """
    live = entries.where(is_live(as_of)).select("key", "value")
    if treat_empty_as_miss:
        live = live.where(~F.col("value").isin(*EMPTY_VALUES))
    found = live.withColumn("_live", F.lit(True))
    whole = F.struct(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in requests.columns])
    joined = lookup_side(requests.withColumn("_row", whole), found, ["key"], ["key"], row_id="_row").drop("_row")
    return joined.withColumn("hit", F.coalesce("_live", F.lit(False))).drop("_live")


def drop_key(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("key").distinct(), "key", "left_anti")


def clear_expired(entries: DataFrame, as_of: str) -> DataFrame:
    """The entries that stay."""
    return entries.where(is_live(as_of))


def expired_count(entries: DataFrame, as_of: str) -> DataFrame:
    return entries.agg(F.count_if(~is_live(as_of)).alias("expired"), F.count("*").alias("entries"))


def compute_missing(requests: DataFrame, entries: DataFrame, as_of: str,
                    compute: Callable[[DataFrame], DataFrame],
                    treat_empty_as_miss: bool = True) -> DataFrame:
    """Distinct requested keys with values: cached where live, else computed.

    ``compute`` gets each missing key once and returns ``(key, value)``.
    """
    keyed = requests.select("key").distinct()
    looked = lookup(keyed, entries, as_of, treat_empty_as_miss)
    hits = looked.where("hit").select("key", "value", F.lit("cache").alias("origin"))
    made = compute(looked.where(~F.col("hit")).select("key"))
    return hits.unionByName(made.select("key", "value", F.lit("computed").alias("origin")))
