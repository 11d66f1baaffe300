import math

import numpy as np
import pytest

from hirelake.llm import vafile


def held(x):
    return max(-2**63, min(2**63 - 1, x))


def by_hand(vectors, queries, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * float(x)) for x in v]

    known = [(i, w) for i, v in vectors if i is not None and (w := whole(v)) is not None]
    asked = {}
    for i, v in queries:
        if i is not None and (w := whole(v)) is not None:
            asked[i] = min(asked.get(i, w), w)
    made = []
    for q, w in asked.items():
        scored = sorted((-held(sum(a * b for a, b in zip(w, v, strict=True))), i) for i, v in known if i != q and len(v) == len(w))
        made += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(made)


def found(spark, vectors, queries, k=10):
    schema = "vec_id bigint, embedding array<double>"
    got = vafile.top_k(spark.createDataFrame(vectors, schema), spark.createDataFrame(queries, schema), k)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vafile, "QUERY_ROWS", 8)
    monkeypatch.setattr(vafile, "STEP_QUERIES", 3)
    drawn = np.random.default_rng(12)
    vectors = [(i, drawn.normal(size=16).tolist()) for i in range(700)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(250)]  # one very common vector
    queries = [v for v in vectors if v[0] % 20 == 0]
    assert found(spark, vectors, queries) == by_hand(vectors, queries, 10)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [0.5]), (4, []), (5, []), (6, None), (7, [None, 1.0]), (8, [nan, 1.0]),
               (9, [inf, 0.0]), (None, [1.0, 1.0]), (2, [9.0, 9.0]), (2, [0.5, -0.5]), (10, [1e12, 1e12])]
    assert found(spark, vectors, vectors, 3) == by_hand(vectors, vectors, 3)
    assert found(spark, [], []) == []
    assert found(spark, vectors, []) == []


def test_integers_beyond_doubles(spark):
    vectors = [(i, [2.0**20 + i, 2.0**20 - 3 * i, 1.0]) for i in range(30)]
    assert found(spark, vectors, vectors[:3]) == by_hand(vectors, vectors[:3], 10)


@pytest.mark.parametrize("top", [3, 3000, 2**40, 2**60])
def test_bounds_hold(top):
    drawn = np.random.default_rng(13)
    values = drawn.integers(-top, top, (300, 5))
    values[:, 2] = 7
    values[5] = top
    low, high = values.min(axis=0).astype(float), values.max(axis=0).astype(float)
    centre, radius = vafile.bounds(vafile.cells_of(values, low, high), low, high, values[:40])
    true = np.array([[sum(int(a) * int(b) for a, b in zip(v, q, strict=True)) for q in values[:40]] for v in values], object)
    assert (np.abs((centre - true.astype(float))) <= radius).all()


def test_few_exact_vectors_are_left():
    drawn = np.random.default_rng(14)
    values = drawn.integers(-1000, 1000, (4000, 32))
    low, high = values.min(axis=0).astype(float), values.max(axis=0).astype(float)
    cells = vafile.cells_of(values, low, high)
    query, at, lower, upper = (np.concatenate(c) for c in vafile.scanned(
        np.arange(4000), cells, low, high, np.array([-1, 3]), values[:2], 10))
    for q, ids in ((-1, np.argsort(-(values @ values[0]))[:10]), (3, [i for i in np.argsort(-(values @ values[1])) if i != 3][:10])):
        assert set(ids) <= set(at[query == q].tolist()) and (query == q).sum() < 80
    assert (lower <= upper).all()


def test_first_shuffle_holds_cells_only(spark, monkeypatch):
    """Exact vectors are read for the candidates alone."""
    seen = []
    kept = vafile.staged
    monkeypatch.setattr(vafile, "staged", lambda df, name: (seen.append((name, df)), kept(df, name))[1])
    drawn = np.random.default_rng(15)
    vectors = [(i, drawn.normal(size=8).tolist()) for i in range(2000)]
    assert found(spark, vectors, vectors[:3]) == by_hand(vectors, vectors[:3], 10)
    plans = {name: df._jdf.queryExecution().optimizedPlan().toString() for name, df in seen}
    assert "cells" in plans["candidates"] and plans["candidates"].count("row#") > 0
    left = plans["candidates"].split("Project [octet_length(cells")[1].splitlines()[0]
    assert " v#" not in left
    assert dict(seen)["candidates"].count() < 200


def test_a_very_common_vector_is_a_few_rows(spark):
    rows = [(i % 7 if i % 2 else 100 + i, [1.0, 2.0]) for i in range(400)] + [(5000 + i, [float(i), 1.0]) for i in range(5)]
    left = vafile.contenders(vafile.scaled(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding"), 3)
    assert left.count() <= 3 * 4 + 5
    queries = [rows[0], rows[1], rows[-1]]
    assert found(spark, rows, queries, 3) == by_hand(rows, queries, 3)
