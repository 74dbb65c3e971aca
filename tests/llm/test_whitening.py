"""Whitening against dense linear algebra, and the solver's parts on hard matrices."""

import math

import numpy as np
import pytest

from mediaframe.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(rows, k=32):
    """id -> (deviation, whitened), shares; straight from the definition."""
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), y @ u / np.sqrt(e), e / np.trace(cov)


def test_given_vectors_against_eigh(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, deviation, white, shares = plain(rows)
    got = {(r.vec_id, r.component): r for r in queries.op11_whitening(spark, SF).collect()}
    assert len(got) == len(rows) * 32
    for c in range(32):
        w = np.array([got[i, c + 1].whitened for i, _ in rows])
        assert min(np.abs(w - white[:, c]).max(), np.abs(w + white[:, c]).max()) < 1e-9
    for k, (i, _) in enumerate(rows):
        assert got[i, 1].deviation == deviation[k] and got[i, 1].n == n
    assert np.allclose([got[rows[0][0], c + 1].explained for c in range(32)], shares, rtol=1e-9)
    assert {r.identity_error for r in got.values()} == {next(iter(got.values())).identity_error} and got[rows[0][0], 1].identity_error < 1e-9


@pytest.mark.parametrize("d", [1, 2, 3, 30, 64])
def test_solver(d):
    rng = np.random.default_rng(d)
    plain_rows = rng.standard_normal((d + 20, d))
    repeated = np.vstack([np.eye(d) * 3, np.zeros((2, d))])
    twins = plain_rows.copy()
    twins[:, 0], twins[:, -1] = 0, twins[:, d // 2]
    for a in (plain_rows, plain_rows @ np.diag(10.0 ** -np.arange(d).clip(0, 12)), plain_rows[: max(1, d // 2)], repeated, twins,
              np.diag(1 + 1e-8 * np.arange(d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0]):
        r = np.vstack([np.linalg.qr(a, mode="r"), np.zeros((d, d))])[:d]
        s, v = whitening.right_directions(r)
        want = np.concatenate([np.linalg.svd(a, compute_uv=False), np.zeros(d)])[:d]
        top = max(want[0], 1e-300)
        assert np.abs(s - want).max() <= 1e-13 * top
        assert np.abs(v.T @ v - np.eye(d)).max() < 1e-11
        assert np.abs(v.T @ (a.T @ a) @ v - np.diag(s ** 2)).max() <= 1e-11 * top ** 2


def test_small_values_to_relative_accuracy():
    """A graded bidiagonal matrix: every squared value is right to 1e-13 of itself."""
    a, b = 10.0 ** -np.arange(0, 12, 2), np.array([1.0, 1e-3, 1e-4, 1e-6, 1e-9])
    got = whitening.dqds(a ** 2, b ** 2)
    from fractions import Fraction as Q

    q, e = [Q(float(x)) ** 2 for x in a], [Q(float(x)) ** 2 for x in b]

    def below(x):  # how many values are below x, by signs of exact pivots
        p, n = q[0] - x, 0
        for i in range(len(e)):
            n += p < 0
            p = q[i + 1] + e[i] - x - q[i] * e[i] / p
        return n + (p < 0)

    for k, x in enumerate(got[::-1]):
        assert below(Q(float(x * (1 - 1e-13)))) <= k < below(Q(float(x * (1 + 1e-13))))


def test_rows_that_do_not_count_and_repeats(spark):
    good = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, -1.0]), (3, [7.0, 0.25])]
    bad = [(4, None), (5, [None, 1.0]), (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (8, []), (9, [1.0]), (10, [1e30, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<double>, whitened string, n int")
    got = whitening.whitened_components(df).collect()
    n, deviation, white, _ = plain(good)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component, r.n, r.deviation) for r in got) == sorted((i is None, i or 0, c, n, d) for (i, _), d in zip(good, deviation.tolist()) for c in (1, 2))
    assert np.allclose(sorted(abs(r.whitened) for r in got), sorted(np.abs(white).ravel()), atol=1e-12)


def test_nothing_varies_or_nothing_is_there(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3):
        out = whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert out.columns == ["vec_id", "deviation", "component", "n", "whitened", "explained", "identity_error"] or out.count() == 0
        assert out.count() == 0
    flat = spark.createDataFrame([(i, [float(i), 3.0, 2.0 * i]) for i in range(10)], "vec_id long, embedding array<float>")
    got = whitening.whitened_components(flat).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)


def test_large_entries_are_exact(spark):
    rows = [(i, [float(2 ** 40 * i), float(i * i)]) for i in range(50)]
    got = whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)).collect()
    x = [[64 * 2 ** 40 * i + 10 ** 6, 64 * i * i + 10 ** 6] for i in range(50)]
    s = [sum(c) for c in zip(*x)]
    for r in got:
        want = sum((50 * v - t) ** 2 for v, t in zip(x[r.vec_id], s))
        assert r.deviation == (want if want < 2 ** 63 else None)


def test_tree_of_many_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(400)]
    got = whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40), components=3).collect()
    _, _, white, _ = plain(rows, 3)
    assert np.allclose(sorted(abs(r.whitened) for r in got), sorted(np.abs(white).ravel()), atol=1e-9)
