"""Stored-table scans: entities, the structured log, schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.sources.schemas import ENTITIES, LOG


def read_entity(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Scan one entity table with its declared schema (no inference pass over the files)."""
    return spark.read.schema(ENTITIES[entity]).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Structured log lines; absent fields are null, unreadable lines land in ``_corrupt_record``."""
    return spark.read.schema(LOG).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def scan_log(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Typed rows of log lines, and the lines that are none: broken off, no JSON object, a value of a wrong type.

    Absent fields are null, blank lines are nothing. Works on a stream of lines too.
    """
    kept = lines.where(F.trim(F.col(line)) != "")
    parsed = kept.withColumn("_row", F.from_json(F.col(line), LOG, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}))
    # One JSON object and nothing behind it, of which the typed parse alone would take no notice.
    whole = F.schema_of_variant(F.try_parse_json(F.concat(F.lit("["), F.col(line), F.lit("]")))).rlike("^ARRAY<OBJECT")
    sound = F.coalesce(whole, F.lit(False)) & F.col("_row._corrupt_record").isNull()
    marked = parsed.withColumn("_sound", sound)
    fields = [f"_row.{f.split()[0]}" for f in LOG.split(", ") if not f.startswith("_corrupt")]
    rest = [c for c in lines.columns if c != line]
    return marked.where("_sound").select(*rest, *fields), marked.where("NOT _sound").select(*rest, F.col(line).alias("line"))


def log_tail(log: DataFrame, order: list[str], lines: int = 150) -> DataFrame:
    """The last ``lines`` rows in log order (per-partition top-k, then a sort of the kept rows)."""
    newest = log.orderBy(*[F.desc(c) for c in order]).limit(lines)
    return newest.orderBy(*order)


def evolve(old: DataFrame, current: DataFrame) -> DataFrame:
    """Read files written before and after a column was added as one table."""
    return old.unionByName(current, allowMissingColumns=True)


def add_missing(df: DataFrame, column: str, kind: T.DataType | str) -> DataFrame:
    """Add a null column unless the table has it already."""
    return df if column in df.columns else df.withColumn(column, F.lit(None).cast(kind))


def stamp(ts: Column | str, style: str = "seconds") -> Column:
    """Text form of a timestamp, in the three formats the reports and file names use."""
    pattern = {
        "seconds": "yyyy-MM-dd HH:mm:ss", "file": "yyyyMMdd_HHmmss", "day": "yyyyMMdd",
    }[style]
    return F.date_format(ts, pattern)
