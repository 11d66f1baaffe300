import math

import numpy as np
import pytest

from hirelake.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>, id int, x string, n int"


def whole(v):
    if not v or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [math.floor(1024 * c) + 100_000 for c in v]


def by_hand(rows, k):
    """(id, component) -> row values, by a dense eigensolver; vectors of one length only."""
    known = [(i, x) for i, v in rows if (x := whole(v)) is not None]
    x = np.array([v for _, v in known], np.float64)
    n, s = len(known), [sum(c) for c in zip(*(v for _, v in known), strict=True)]
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values[:k] > 1e-12 * values.sum()
    made = c @ vectors[:, :k][:, real] / np.sqrt(values[:k][real])
    deviations = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for _, v in known]
    return [i for i, _ in known], n, deviations, made, (values / values.sum())[:k][real]


def found(spark, rows, k=8):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    return whitening.whitened(df, k=k).collect()


def check(spark, rows, k=8):
    ids, n, deviations, made, shares = by_hand(rows, k)
    got = found(spark, rows, k)
    assert len(got) == made.size
    per = {}
    for r in got:
        per.setdefault(r["component"], []).append(r)
    assert sorted(per) == list(range(1, made.shape[1] + 1))
    for j, own in per.items():
        assert {r["n"] for r in own} == {n} and max(r["identity_error"] for r in own) < 1e-9
        assert np.allclose([r["explained"] for r in own], shares[j - 1], rtol=1e-9)
    # Signs are free, one for each component; rows are matched by id where ids are unique.
    if len(set(ids)) == len(ids):
        at = {i: p for p, i in enumerate(ids)}
        for j, own in per.items():
            want = np.array([made[at[r["vec_id"]], j - 1] for r in own])
            have = np.array([r["whitened"] for r in own])
            assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
            assert [r["deviation"] for r in own] == [deviations[at[r["vec_id"]]] for r in own]
    else:
        assert sorted(r["deviation"] for r in per[1]) == sorted(deviations)


def test_against_a_dense_solver(spark, monkeypatch):
    drawn = np.random.default_rng(21)
    rows = [(i, (drawn.normal(size=20) * np.linspace(3, 0.5, 20)).tolist()) for i in range(900)]
    monkeypatch.setattr(whitening, "PACK_ROWS", 100)
    monkeypatch.setattr(whitening, "BASIS_COLUMNS", 16)  # restarts
    check(spark, rows)


def test_groups_of_partial_sums(spark, monkeypatch):
    drawn = np.random.default_rng(22)
    monkeypatch.setattr(whitening, "PARTIAL_ROWS", 2)
    check(spark, [(i, drawn.normal(size=5).tolist()) for i in range(300)], 3)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    drawn = np.random.default_rng(23)
    rows = [(i, drawn.normal(size=3).tolist()) for i in range(40)]
    odd = [(90, None), (91, []), (92, [None, 1.0, 2.0]), (93, [nan, 0.0, 0.0]), (94, [inf, 0.0, 0.0])]
    check(spark, rows + odd)
    check(spark, rows + rows[:5] + [(None, [0.5, -3.0, 0.25]), (None, [0.5, -3.0, 0.25])] + odd)
    others = [(95, [1.0]), (96, [2.0, 1.0])]  # of other lengths
    assert {r["vec_id"] for r in found(spark, rows + others)} == set(range(40))
    assert found(spark, []) == found(spark, odd) == []
    assert found(spark, [(1, [1.0, 2.0])]) == found(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    got = found(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0])])  # one direction only
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["deviation"]) for r in got) == [
        (1, 1, 1.0, 1024**2), (2, 1, 1.0, 1024**2)]


def test_exact_beyond_64_bits(spark):
    rows = [(i, [1e13 * i, -1e300, 3.0 * i]) for i in range(4)]
    assert {r["deviation"] for r in found(spark, rows, 1)} == {2**63 - 1}
    centre = whitening.Centre(3, [30, 2**61])
    assert centre.deviations(np.array([[11, 2**60]])) == [2**63 - 1]
    assert centre.deviations(np.array([[11, 2**61 // 3]])) == [9 + (2**61 // 3 * 3 - 2**61) ** 2]


@pytest.mark.parametrize("spectrum", ["falling", "flat", "pairs", "one"])
def test_jacobi_davidson_to_rounding(spectrum):
    drawn = np.random.default_rng(24)
    dims = 120
    values = {"falling": np.geomspace(1, 1e-9, dims), "flat": np.linspace(1, 0.9, dims),
              "pairs": np.repeat(np.linspace(1, 0.1, dims // 2), 2), "one": np.r_[1.0, np.zeros(dims - 1)]}[spectrum]
    q = np.linalg.qr(drawn.normal(size=(dims, dims)))[0]
    v = (q * values) @ q.T
    passes = []
    found, vectors = whitening.leading_pairs(lambda b: passes.append(b.shape[1]) or v @ b, dims, 8)
    assert np.allclose(found, np.sort(values)[::-1][:8], atol=1e-13)
    assert np.linalg.norm(v @ vectors - vectors * found, axis=0).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-13
    assert max(passes) <= 16 < dims  # a few vectors at a time, never the matrix


def test_corrections_solve_the_projected_equation():
    drawn = np.random.default_rng(25)
    v = np.diag(np.arange(1.0, 11.0))
    u = np.linalg.qr(drawn.normal(size=(10, 1)))[0]
    value = (u.T @ v @ u)[0]
    rest = v @ u - u * value
    t = whitening.corrections(lambda b: v @ b, u, value, rest, 9)
    p = np.eye(10) - u @ u.T
    assert np.abs(p @ (v - value[0] * np.eye(10)) @ p @ t + rest).max() < 1e-9
    assert abs(u.T @ t).max() < 1e-12
