"""Display columns of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.text import col, filled
from hirelake.rules import DONE_STAGE, STAGE_LABELS


def stage_label(stage: Column | str, state: Column | str) -> Column:
    """Report label of a stage; rows outside the known stages show their state."""
    labels = F.create_map(*[F.lit(x) for kv in STAGE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, col(stage).cast("int")), col(state))


def stage_percent(stage: Column | str) -> Column:
    s = col(stage)
    return F.when(s <= DONE_STAGE, F.floor(s / F.lit(float(DONE_STAGE)) * 100)) \
        .otherwise(F.lit(100)).cast("int")


def age_text(ts: Column | str, as_of: str) -> Column:
    """``Just now`` / ``5m ago`` / ``3h ago`` / ``2d ago`` relative to ``as_of``."""
    seconds = F.timestamp_diff("SECOND", F.date_trunc("second", col(ts)), F.lit(as_of).cast("timestamp"))

    def ago(unit: int, mark: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{mark} ago"))

    return F.when(seconds < 60, F.lit("Just now")).when(seconds < 3600, ago(60, "m")) \
        .when(seconds < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


def age_of_text(raw: Column | str, as_of: str) -> Column:
    """As :func:`age_text` for a stored text; text that is no timestamp is shown unchanged."""
    ts = F.try_to_timestamp(F.substring_index(col(raw), ".", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(ts.isNull(), col(raw)).otherwise(age_text(ts, as_of))


def score_or_null(score: Column | str) -> Column:
    """Two decimals; a zero score counts as *no score*."""
    return F.when(col(score) != 0, F.round(col(score), 2))


def score_shown(score: Column | str) -> Column:
    """Two decimals; zero stays zero."""
    return F.round(col(score), 2)


def base_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def body_preview(body: Column | str, chars: int = 300) -> Column:
    """Opening of a message body; the dots are appended whatever its length."""
    return F.when(filled(body), F.concat(F.substring(col(body), 1, chars), F.lit("...")))
