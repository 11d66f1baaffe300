"""Per-domain fetch statistics: totals, merge, blacklist, in-run breaker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.operators.keys import lookup
from hirelake.rules import Rules


def domain_totals(log: DataFrame) -> DataFrame:
    """Successes and failures per domain; rows without a domain are ignored."""
    return log.where(F.col("domain") != "").groupBy("domain").agg(
        F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"))


def merge_totals(successes: DataFrame, failures: DataFrame) -> DataFrame:
    """Union of two keyed counters; a side without the key counts 0."""
    return successes.join(failures, "domain", "full").select(
        "domain", F.coalesce("successes", F.lit(0)).alias("successes"),
        F.coalesce("failures", F.lit(0)).alias("failures"))


def blacklist(totals: DataFrame, rules: Rules) -> DataFrame:
    """Domains that only ever failed, often enough, plus the seed list."""
    spark = totals.sparkSession
    bad = totals.where(
        (F.col("failures") >= rules.blacklist_failures) & (F.col("successes") == 0)
    ).select("domain")
    seeds = spark.createDataFrame([(d,) for d in rules.seed_blocked], "domain STRING")
    return bad.unionByName(seeds).distinct()


def trip_points(log: DataFrame, rules: Rules) -> DataFrame:
    """Time and id of the failure that disables a domain in a run (successes do not reset).

    Ranking stops at the n-th failure, which Spark applies before the shuffle: a domain that fails
    all day sends n rows per task.
    """
    rank = F.row_number().over(W.partitionBy("run_day", "domain").orderBy("ts", "id"))
    failed = log.where(~F.col("ok") & (F.col("domain") != ""))
    return failed.select("run_day", "domain", "ts", "id").withColumn("_rn", rank) \
        .where(F.col("_rn") <= rules.breaker_failures) \
        .where(F.col("_rn") == rules.breaker_failures) \
        .select("run_day", "domain", F.col("ts").alias("tripped_ts"), F.col("id").alias("tripped_id"))


def with_breaker(log: DataFrame, rules: Rules) -> DataFrame:
    """Every fetch with whether its domain was disabled before it in that run."""
    points = trip_points(log, rules)
    joined = lookup(log, points, ["run_day", "domain"], ["run_day", "domain"])
    later = F.struct("ts", "id") > F.struct(F.col("tripped_ts"), F.col("tripped_id"))
    return joined.withColumn(
        "disabled", F.coalesce(F.when(F.col("tripped_ts").isNotNull(), later), F.lit(False))) \
        .drop("tripped_ts", "tripped_id")
