"""Streams fed in several micro-batches, and through several runs over one checkpoint."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hirelake.rules import Rules
from hirelake.streaming import entries, jobs

START = datetime(2024, 1, 1)
HISTORY = "id BIGINT, application_id BIGINT, stage INT, state STRING, timestamp TIMESTAMP"
LOG = "id BIGINT, domain STRING, ts TIMESTAMP, ok BOOLEAN"
WRITES = "key STRING, version BIGINT, value STRING, created_at TIMESTAMP, ttl_seconds BIGINT"


def minutes(n):
    return START + timedelta(minutes=n)


@pytest.fixture
def feed(spark, tmp_path):
    """``add`` writes one more file; ``stream`` reads them one per micro-batch."""
    source = str(tmp_path / "source")

    class Feed:
        def __init__(self):
            self.out, self.checkpoint, self.source = str(tmp_path / "out"), str(tmp_path / "cp"), source

        def add(self, data, schema):
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)

        def stream(self, schema):
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

        def run(self, stream, mode):
            return jobs.run_available(stream, self.out, self.checkpoint, mode)

    return Feed()


def test_current_state_over_batches_and_runs(feed, rows):
    feed.add([(1, 7, 3, "a", minutes(5)), (2, 8, 3, "b", minutes(6))], HISTORY)
    feed.add([(3, 7, 2, "older", minutes(1)), (4, 8, 4, "c", minutes(7))], HISTORY)
    feed.run(jobs.current_state(feed.stream(HISTORY)), "update")
    feed.add([(5, 7, 5, "d", minutes(9))], HISTORY)
    written = feed.run(jobs.current_state(feed.stream(HISTORY)), "update")
    assert rows(jobs.newest(written, ["application_id"])) == [(7, "d", 5), (8, "c", 4)]


def test_transition_counts_drop_late_rows(feed, rows):
    feed.add([(i, 1, 1, "a", minutes(i)) for i in (1, 2, 61)], HISTORY)
    for m in (600, 601):  # lateness is judged by the watermark of the batch before
        feed.add([(m, 1, 1, "a", minutes(m))], HISTORY)
    feed.add([(10, 1, 1, "a", minutes(3))], HISTORY)  # far behind the watermark
    written = feed.run(jobs.transition_counts(feed.stream(HISTORY)), "append")
    assert rows(written, "window_start", "transitions") == [(START, 2), (minutes(60), 1)]


def test_dedup_across_batches(feed, rows):
    feed.add([(1, 7, 1, "a", minutes(1)), (2, 7, 1, "a", minutes(2))], HISTORY)
    feed.add([(3, 7, 1, "a", minutes(3)), (4, 8, 1, "a", minutes(4))], HISTORY)
    kept = jobs.first_seen(feed.stream(HISTORY), ["application_id", "state"], "timestamp", "1 day")
    assert rows(feed.run(kept.select("application_id", "state"), "append"), "application_id", "state") == [(7, "a"), (8, "a")]


def test_breaker_counts_per_day(feed, rows):
    feed.add([(i, "hot", minutes(i), False) for i in range(2)] + [(9, "hot", minutes(3), True), (8, "", minutes(3), False)], LOG)
    feed.add([(3, "hot", minutes(5), False), (4, "hot", minutes(60 * 24 + 1), False)], LOG)
    written = feed.run(jobs.breaker(feed.stream(LOG), Rules()), "update")
    got = rows(jobs.newest(written, ["run_day", "domain"]).withColumn("run_day", F.col("run_day").cast("string")))
    assert got == [("2024-01-01", "hot", 3, True), ("2024-01-02", "hot", 1, False)]


def lifetimes(feed, rules=Rules()):
    stream = entries.cache_lifetimes(feed.stream(WRITES), rules)
    return jobs.run_available(stream, feed.out, feed.checkpoint, "append", state_store=entries.STATE_STORE)


SHOWN = ("key", "first_write", "expired_at", "value", "writes")


def test_the_last_write_sets_value_and_expiry(feed, rows):
    hour = 3600
    feed.add([("longer", 1, "old", minutes(0), 2 * hour), ("shorter", 2, "old", minutes(0), 9 * hour), ("zero", 3, "old", minutes(0), 9 * hour),
              ("past", 4, "old", minutes(0), 9 * hour), ("open", 5, "v", minutes(0), 500 * hour), ("again", 6, "a", minutes(0), hour)], WRITES)
    feed.add([("again", 7, "b", minutes(60), hour), ("longer", 8, "new", minutes(60), 2 * hour), ("shorter", 9, "new", minutes(60), 60),
              ("zero", 10, "new", minutes(60), 0), ("past", 11, "new", minutes(60), -hour)], WRITES)
    feed.add([("shorter", 12, "third", minutes(62), hour), ("default", 13, "d", minutes(62), None)], WRITES)
    lifetimes(feed)
    feed.add([("x", 14, "w", minutes(60 * 20), 1)], WRITES)  # brings the watermark on
    got = rows(lifetimes(feed, Rules(cache_ttl_seconds=120)), *SHOWN)
    assert got == sorted([
        ("longer", START, minutes(180), "new", 2), ("shorter", START, minutes(61), "new", 2), ("shorter", minutes(62), minutes(122), "third", 1),
        ("zero", START, minutes(60), "new", 2), ("past", START, START, "new", 2), ("again", START, minutes(120), "b", 2)], key=repr)


def test_order_of_arrival_changes_nothing_within_the_delay(feed, rows):
    feed.add([("k", 3, "c", minutes(50), 600), ("k", 1, "a", minutes(10), 600)], WRITES)
    feed.add([("k", 2, "b", minutes(15), 1200), ("far", 4, "f", minutes(300), 60)], WRITES)
    feed.add([("k", 5, "late", minutes(40), 60)], WRITES)  # behind the watermark by now
    feed.add([("end", 6, "e", minutes(600), 60)], WRITES)
    assert rows(lifetimes(feed), *SHOWN) == sorted([
        ("k", minutes(10), minutes(35), "b", 2), ("k", minutes(50), minutes(60), "c", 1), ("far", minutes(300), minutes(301), "f", 1)], key=repr)


class FakeState:
    """One state variable of a key, counting the calls made to it."""

    calls = 0

    def __init__(self):
        self.held = None

    def get(self):
        FakeState.calls += 1
        return self.held if self.held is not None or not isinstance(self, FakeList) else []

    def update(self, value):
        FakeState.calls += 1
        self.held = value

    put = update

    def clear(self):
        self.update(None)


class FakeList(FakeState):
    def appendList(self, values):
        FakeState.calls += 1
        self.held = [*(self.held or []), *values]


class FakeHandle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return FakeState()

    def getListState(self, name, schema):
        return FakeList()

    def registerTimer(self, at):
        FakeState.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        FakeState.calls += 1
        self.timers.discard(at)


class FakeTimes:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def ended_by_loop(writes, reached):
    """Lifetimes over by ``reached``, one write after the other."""
    live, over = {}, []
    for key, at, version, value, expires in sorted(writes, key=lambda w: (w[1], w[2], w[3] is not None, w[3] or "", w[4])):
        before = live.get(key)
        if before is not None and before[2] < at:
            over.append(before)
            before = None
        live[key] = (key, at if before is None else before[1], expires, value, 1 if before is None else before[4] + 1)
    return sorted([*over, *(e for e in live.values() if e[2] < reached)], key=repr)


def test_state_calls_do_not_grow_with_the_keys():
    rng = np.random.default_rng(7)
    keys = [None, *(f"k{i}" for i in range(400))]
    writes = []
    for version in range(4000):
        at = 1_000_000 * int(rng.integers(1, 300))
        writes.append((keys[int(rng.integers(len(keys)))], at, version // 2, None if version % 5 == 0 else f"v{version}",
                       at + 1_000_000 * int(rng.integers(-1, 60))))
    writes += writes[:50]
    entry, handle = entries.Entries(), FakeHandle()
    entry.init(handle)
    FakeState.calls = 0
    got, before = [], 0
    for mark in (40_000, 40_500, 200_000, 1_000_000):  # milliseconds
        arrived = [w for w in writes if before < w[1] // 1000 <= mark + 90_000]
        writes_now = pd.DataFrame(arrived, columns=list(entries.WRITE)).astype({"key": object, "value": object})
        before = mark + 90_000
        assert not list(entry.handleInputRows((3,), iter([writes_now] if len(arrived) else []), FakeTimes(0 if mark == 40_000 else last)))
        last = mark
        for at in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(at)
            for made in entry.handleExpiredTimer((3,), FakeTimes(mark), None):
                got += [tuple(None if v is None else v for v in r) for r in made.itertuples(index=False)]
    assert sorted(got, key=repr) == ended_by_loop(writes, 1_000_000_000)
    assert FakeState.calls < 60


def test_keys_of_one_bucket_stay_apart(feed, rows, monkeypatch):
    monkeypatch.setattr(entries, "BUCKETS", 1)
    feed.add([(f"k{i}", i, "a", minutes(i), 600) for i in range(20)] + [(None, 50, "n", minutes(3), 60)], WRITES)
    feed.add([(f"k{i}", 20 + i, "b", minutes(9 + i), 60) for i in range(20)], WRITES)
    feed.add([("end", 60, "e", minutes(900), 60)], WRITES)
    assert rows(lifetimes(feed), *SHOWN) == sorted(
        [(f"k{i}", minutes(i), minutes(10 + i), "b", 2) for i in range(20)] + [(None, minutes(3), minutes(4), "n", 1)], key=repr)


def test_a_replayed_batch_is_harmless(feed, rows, tmp_path):
    feed.add([("k", 1, "a", minutes(0), 60)], WRITES)
    feed.add([("x", 2, "b", minutes(600), 60)], WRITES)
    before = rows(lifetimes(feed), *SHOWN)
    commits = tmp_path / "cp" / "commits"
    last = max(int(p.name) for p in commits.glob("[0-9]*"))
    for name in (f"{last}", f".{last}.crc"):  # the run died before its last commit
        (commits / name).unlink()
    assert rows(lifetimes(feed), *SHOWN) == before == [("k", START, minutes(1), "a", 1)]


def test_a_repeat_behind_the_delay_shows_up_again(feed, rows):
    feed.add([(1, 7, 1, "a", minutes(1))], HISTORY)
    feed.add([(2, 7, 1, "a", minutes(30))], HISTORY)  # within the delay
    feed.add([(3, 8, 1, "a", minutes(600))], HISTORY)

    def kept():
        stream = jobs.first_seen(feed.stream(HISTORY), ["application_id", "state"], "timestamp", "1 hour")
        return feed.run(stream.select("application_id", "state"), "append")

    kept()
    feed.add([(4, 7, 1, "a", minutes(601)), (5, 9, 1, "a", minutes(100))], HISTORY)  # forgotten by now; too late
    assert rows(kept(), "application_id") == [(7,), (7,), (8,)]


def test_export_of_new_files(spark, feed):
    from tests_shapes import APPLICATION, COMPANY, CONTACT, EMAIL, JOB

    parents = (spark.createDataFrame([(10, 1, "Dev", None, None, None, None)], JOB),
               spark.createDataFrame([(1, "Acme", None, None, 1)], COMPANY),
               spark.createDataFrame([], CONTACT), spark.createDataFrame([], EMAIL))

    def exported():
        stream = spark.readStream.schema(APPLICATION.replace("_NTZ", "")).parquet(feed.source)
        jobs.export_new(stream, parents, feed.out, feed.checkpoint)
        return spark.read.json(feed.out).count()

    feed.add([(1, "r", 10, None, 3, "Filtering", None, None, START), (2, "r", 10, None, 3, "Filtering", None, None, START)], APPLICATION.replace("_NTZ", ""))
    assert exported() == 2
    assert exported() == 2
    feed.add([(3, "r", 10, None, 3, "Filtering", None, None, START), (1, "r", 10, None, 3, "Filtering", None, None, START)], APPLICATION.replace("_NTZ", ""))
    assert exported() == 3  # one is delivered again
