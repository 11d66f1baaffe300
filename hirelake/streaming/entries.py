"""The TTL cache as a keyed stream: a write replaces value and expiry, timers in event time end what has expired."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hirelake.operators.cache import expiry_after
from hirelake.rules import Rules

# Tasks get this module's classes by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# State with timers is kept in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Keys are kept together by their hash, in as many buckets; a checkpoint has to be gone on with the number it was begun with.
BUCKETS = 1024
CHUNK_ROWS = 10_000


class Entries(StatefulProcessor):
    """The cache keys of one bucket: their entries, and the writes the watermark has not reached.

    Writes are applied in event-time order (then version) once the watermark has passed them, so the
    order of arrival within the allowed delay changes nothing. New writes are only put aside; a bucket has one timer, for
    its next waiting write or for the end of an entry, whichever comes first, and all that is due is then
    applied at once. Every call to the state holds columns of many keys, as a call each would cost more than
    the work. Times are microseconds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", _arrays(ENTRY))
        self.waiting = handle.getListState("waiting", _arrays(WRITE))
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        due = None
        for part in rows:
            if part["at"].isna().any():
                raise ValueError("a write without a time")
            part = part[part["at"] > reached]
            if len(part):
                self.waiting.appendList(_chunks(part))
                due = min(int(part["at"].min()), due or sys.maxsize)
        if due is not None:
            before = self.timer.get()
            if before is None or due // 1000 + 1 < before[0]:
                self._set_timer(before, due // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        writes = _frame(WRITE, self.waiting.get())
        left = writes[writes["at"] > reached]
        entries = _frame(ENTRY, [e for e in [self.entries.get()] if e is not None])
        ended, entries = lifetimes(entries, writes[writes["at"] <= reached], reached)
        if len(entries):
            self.entries.update(_row(entries))
        else:
            self.entries.clear()
        if len(left) == 0:
            self.waiting.clear()
        elif len(left) < len(writes):
            self.waiting.put(_chunks(left))
        due = min([int(c.min()) for c in (left["at"], entries["expires"]) if len(c)], default=None)
        # Fires when the watermark, in milliseconds, is beyond that moment. The timer that called is gone by itself.
        self._set_timer(None, None if due is None else max(due, reached) // 1000 + 1)
        return iter([ended.set_axis(list(ENDED), axis=1)] if len(ended) else [])

    def _set_timer(self, before: tuple | None, at: int | None) -> None:
        if before is not None:
            self.handle.deleteTimer(before[0])
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


def lifetimes(entries: pd.DataFrame, writes: pd.DataFrame, reached: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(lifetimes that are over, entries left) when ``writes`` come upon ``entries``, which are older.

    A write opens a lifetime if it is its key's first or the one before it had expired.
    """
    stored = entries.assign(at=EARLIEST, version=EARLIEST)
    rows = pd.concat([stored, writes.assign(first=writes["at"], writes=1)], ignore_index=True)
    if not len(rows):
        return entries, entries
    code = pd.factorize(rows["key"], use_na_sentinel=False)[0]
    order = np.lexsort((rows["expires"], pd.factorize(rows["value"], sort=True)[0], rows["version"], rows["at"], code))
    rows, code = rows.iloc[order], code[order]
    at, expires = rows["at"].to_numpy(), rows["expires"].to_numpy()
    changes = code[1:] != code[:-1]
    opens = np.flatnonzero(np.append(True, changes | (expires[:-1] < at[1:])))
    last = np.append(opens[1:], len(rows)) - 1
    made = rows.iloc[last][["key", "first", "expires", "value", "writes"]].assign(
        first=rows["first"].to_numpy()[opens], writes=np.add.reduceat(rows["writes"].to_numpy(), opens))
    over = ~np.append(changes, True)[last] | (expires[last] < reached)
    return made[over], made[~over]


ENTRY = {"key": "string", "first": "bigint", "expires": "bigint", "value": "string", "writes": "bigint"}
WRITE = {"key": "string", "at": "bigint", "version": "bigint", "value": "string", "expires": "bigint"}
ENDED = {"key": "string", "first_write": "bigint", "expired_at": "bigint", "value": "string", "writes": "bigint"}
EARLIEST = -1 << 63


def _arrays(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} array<{kind}>" for name, kind in columns.items())


def _row(frame: pd.DataFrame) -> tuple:
    return tuple(frame[c].tolist() for c in frame.columns)


def _chunks(writes: pd.DataFrame) -> list[tuple]:
    return [_row(writes.iloc[i:i + CHUNK_ROWS][list(WRITE)]) for i in range(0, len(writes), CHUNK_ROWS)]


def _frame(columns: dict[str, str], chunks: Iterable[tuple]) -> pd.DataFrame:
    """The rows of stored chunks, one list per column in each."""
    held = [list(chain.from_iterable(lists)) for lists in zip(*chunks, strict=True)] or [[] for _ in columns]
    return pd.DataFrame({name: pd.Series(values, dtype="int64" if kind == "bigint" else "object")
                         for (name, kind), values in zip(columns.items(), held, strict=True)})


def cache_lifetimes(writes: DataFrame, rules: Rules, delay: str = "1 hour") -> DataFrame:
    """Cache entries as they leave the cache (append mode): ``key, first_write, expired_at, value, writes``.

    ``writes(key, version, value, created_at, ttl_seconds)``. The last write sets value and expiry, also a
    shorter one; without seconds of its own it gets the rules' lifetime, and one below zero is over before it began.
    An entry that expires at the moment of a write is still there then. Its lifetime is over when the watermark
    is past the expiry, with no row needed for that. Writes behind the watermark are dropped. The state is kept by
    buckets of keys, which bounds the calls to it. The job needs :data:`STATE_STORE`.
    """
    seconds = F.coalesce("ttl_seconds", F.lit(rules.cache_ttl_seconds))
    timed = writes.withWatermark("created_at", delay).select(
        F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket"), "key", "created_at",
        F.coalesce("version", F.lit(EARLIEST)).alias("version"), "value", F.unix_micros("created_at").alias("at"),
        F.unix_micros(expiry_after("created_at", seconds)).alias("expires"))
    ended = timed.groupBy("bucket").transformWithStateInPandas(
        Entries(), ", ".join(map(" ".join, ENDED.items())), "Append", "EventTime")
    return ended.select("key", F.timestamp_micros("first_write").alias("first_write"),
                        F.timestamp_micros("expired_at").alias("expired_at"), "value", "writes")
