"""Streaming forms of the event-driven reports.

Aggregations stay native, so a busy key is combined map-side before it reaches its state row. Every
job runs under ``availableNow`` as well as continuously; sinks write one folder per micro-batch and
overwrite it on replay, which makes retried batches harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators.export import records
from hirelake.operators.keys import last_per
from hirelake.rules import Rules


def current_state(history: DataFrame) -> DataFrame:
    """Latest transition per application (update mode; one state row per application)."""
    newest = history.groupBy("application_id").agg(
        F.max_by(F.struct("state", "stage"), F.struct("timestamp", "id")).alias("s"))
    return newest.select("application_id", "s.state", "s.stage")


def transition_counts(history: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Transitions per tumbling window and state; windows leave memory ``delay`` after their end."""
    return history.withWatermark("timestamp", delay).groupBy(
        F.window("timestamp", width).alias("w"), "state").agg(F.count("*").alias("transitions")).select(
        F.col("w.start").alias("window_start"), "state", "transitions")


def first_seen(rows: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """First arrival per key; a key is forgotten ``delay`` after its event time (append mode)."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def breaker(log: DataFrame, rules: Rules, delay: str = "2 days") -> DataFrame:
    """Failures per run day and domain with the disabled flag (update mode).

    Counting needs no order: a domain is disabled once its failures of the day reach the limit.
    """
    failed = log.where(~F.col("ok") & (F.col("domain") != "")).withWatermark("ts", delay)
    counts = failed.groupBy(F.window("ts", "1 day").alias("w"), "domain").agg(
        F.count("*").alias("failures"))
    return counts.select(F.col("w.start").cast("date").alias("run_day"), "domain", "failures",
                         (F.col("failures") >= rules.breaker_failures).alias("disabled"))


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str,
                  prepare: Callable[[DataFrame], DataFrame] | None = None, state_store: str | None = None) -> DataFrame:
    """Process everything available, one folder per micro-batch, and return the written rows.

    The result has a ``batch`` column; :func:`newest` reduces update-mode output to final rows. ``state_store`` names
    the class that keeps the state; a checkpoint has to be gone on with the one it was begun with.
    """
    def sink(rows: DataFrame, batch: int) -> None:
        prepared = rows if prepare is None else prepare(rows)
        prepared.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    conf, setting = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(setting)
    if state_store is not None:
        conf.set(setting, state_store)
    try:
        job = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        conf.set(setting, before)
    job.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def newest(written: DataFrame, keys: list[str]) -> DataFrame:
    """Final row per key of an update-mode output."""
    return last_per(written, keys, "batch").drop("batch")


def export_new(arrived: DataFrame, parents: tuple[DataFrame, ...], out: str, checkpoint: str,
               delay: str = "30 days") -> None:
    """Export the applications of a stream that were not exported before, as JSON rows per batch.

    ``parents`` are jobs, companies, contacts and emails. The checkpoint remembers what was read, and ids for ``delay`` in terms
    of ``updated_at``, so an application delivered again is exported once; there is no manifest to read or rewrite.
    A batch that is run again overwrites its own folder.
    """
    def sink(rows: DataFrame, batch: int) -> None:
        records(rows, *parents).write.mode("overwrite").json(f"{out}/batch={batch}")

    new = first_seen(arrived, ["id"], "updated_at", delay)
    new.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True) \
        .foreachBatch(sink).start().awaitTermination()
