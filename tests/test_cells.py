"""Joins and searches by cells against all pairs."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from mediaframe.operators import cells
from mediaframe.operators import search as s


@pytest.fixture
def table(spark, tmp_path):
    def make(x):
        path = str(tmp_path / f"v{len(list(tmp_path.iterdir()))}.parquet")
        pq.write_table(pa.table({"asset_id": np.arange(len(x)), "vector": pa.array(list(x), pa.list_(pa.float64()))}), path, row_group_size=max(1, len(x) // 4))
        return spark.read.parquet(path)

    return make


def clustered(n, k, spread, seed=1, d=32, lengths=False):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((k, d))
    x = c[rng.integers(0, k, n)] / np.linalg.norm(c, axis=1).mean() + spread * rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x * rng.uniform(0.2, 2, n)[:, None] if lengths else x


def pairs_of(x, least):
    g = x @ x.T
    i, j = np.nonzero(np.triu(g >= least, 1))
    return set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("n, k, spread, least, lengths", [(2000, 40, 0.08, 0.92, False), (1500, 3, 0.3, 0.5, False), (1500, 400, 0.1, 0.6, True), (800, 1, 3.0, 0.3, False), (900, 5, 0.01, 0.99, True), (600, 4, 1.0, -0.2, True)])
def test_pairs(table, n, k, spread, least, lengths):
    x = clustered(n, k, spread, lengths=lengths)
    x[5] = x[6] = x[7]
    x[8] = 0
    got = [(r.a, r.b) for r in s.similarity_self_join(table(x), least, rows=128).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_of(x, least)


def test_rows_shuffled_do_not_grow_with_the_blocks(table):
    for n in (3000, 12000):
        plan = cells.plan_pairs(table(clustered(n, 60, 0.06)), 0.92, 256)
        assert len(plan.pivots) >= 50 and plan.rows < 4 * n


def test_one_crowded_cell_is_dealt_into_blocks(spark, table):
    x = np.concatenate([clustered(900, 1, 0.02), clustered(600, 30, 0.05, seed=2)])
    v = table(x)
    plan = cells.plan_pairs(v, 0.97, 100)
    dealt = cells.pairs_by_cells(v, 0.97, plan, "asset_id")
    assert plan.blocks[0].max() >= 9 and {(r.a, r.b) for r in dealt.collect()} == pairs_of(x, 0.97)


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None), (2, [])], "asset_id long, vector array<double>")
    assert s.similarity_self_join(none, 0.5).count() == 0


def best(g, k, n):
    return [np.lexsort((np.arange(n), -row))[:k].tolist() for row in g]


@pytest.mark.parametrize("k, spread, lengths", [(40, 0.08, False), (1, 3.0, False), (20, 0.2, True)])
def test_top_k(table, k, spread, lengths):
    n = 2000
    x = np.round(clustered(n, k, spread, lengths=lengths), 3)
    x[1::100] = x[2::100]  # ties
    v = table(x)
    q = v.filter("asset_id % 20 = 0").selectExpr("asset_id as query_id", "vector")
    got = {}
    for r in s.batch_topk(q, v, 5, rows=150).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.asset_id
    g = np.round(x[::20] @ x.T, 12)
    want = best(g, 5, n)
    for i in range(len(g)):
        mine = [got[i * 20][r] for r in range(1, 6)]
        assert np.allclose(g[i, mine], g[i, want[i]], atol=1e-12) and len(set(mine)) == 5
    others = s.batch_topk(q, v, 1, rows=150, others_to=0.9).collect()
    for r in others:
        row = g[r.query_id // 20].copy()
        row[(row > 0.9)] = -9
        row[r.query_id] = -9
        assert abs(row.max() - row[r.asset_id]) < 1e-12


def test_ties_go_by_id(table):
    x = np.repeat(clustered(50, 10, 0.1), 30, axis=0)
    v = table(x)
    q = v.filter("asset_id % 500 = 0").selectExpr("asset_id as query_id", "vector")
    got = sorted((r.query_id, r["rank"], r.asset_id) for r in s.batch_topk(q, v, 4, rows=100).collect())
    assert got == [(i, r, i // 30 * 30 + r - 1) for i in (0, 500, 1000) for r in (1, 2, 3, 4)]


def test_cells_are_skipped_where_vectors_cluster(table):
    x = clustered(4000, 40, 0.04)
    v = table(x)
    index = cells.fit_cells(v, "asset_id", len(x), 100)
    q = v.filter("asset_id % 100 = 0").selectExpr("asset_id as q", "vector")

    def kernel(a, b):
        b = b.sort_by("i")
        g = s.matrix(a) @ s.matrix(b).T
        row, col = s.best_of(g, 5)
        return pa.table({"q": a["q"].to_numpy()[row], "i": b["i"].to_numpy()[col], "similarity": g[row, col]})

    top, met = cells.topk_by_cells(q, index, 5, kernel, "q long, i long, similarity double")
    rows = met.collect()
    assert top.count() == 5 * 40 and len(rows) == 40
    assert sum(r.first + r.second for r in rows) < 0.2 * sum(r.cells for r in rows)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 8)) * rng.uniform(0.1, 3, 500)[:, None]
    p = cells.unit(x[:7])[0]
    u, size = cells.unit(x)
    home = np.argmax(u @ p.T, axis=1)
    angle = np.arccos(np.clip((u * p[home]).sum(1), -1, 1))
    of = lambda f, v: np.array([f(v[home == c]) for c in range(7)])
    index = cells.CellIndex(None, p, np.bincount(home, minlength=7), of(np.max, angle), of(np.min, size), of(np.max, size), 100)
    q = rng.standard_normal((50, 8))
    bound = index.bounds(q)
    for c in range(7):
        assert ((q @ x[home == c].T).max(axis=1) <= bound[:, c]).all()
