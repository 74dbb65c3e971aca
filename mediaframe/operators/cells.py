"""Cells around pivots on the unit sphere: joins and searches of vectors that look only where a bound
allows a result. Pivots are chosen on a bounded sample; that decides the work, never the result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .blocks import MOST_ROWS, Kernel, empty_table, matrix, rows_of_block, tiles

MOST_PIVOTS = 4096
SAMPLE = 20_000
SLACK = 1e-9


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one (or zero), and their lengths."""
    size = np.linalg.norm(m, axis=1)
    return m / np.where(size > 0, size, 1)[:, None], size


def choose_pivots(vectors: DataFrame, n: int, most: int, apart: float = 0.0, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Up to `most` directions of a sample of at most `sample` rows, each the farthest from those before it,
    until every one of the sample is within the angle `apart` of one."""
    share = min(1.0, 1.2 * sample / max(n, 1))
    rows = (vectors.select("vector") if share == 1.0 else vectors.select("vector").sample(share, seed)).limit(sample).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    u = unit(matrix(rows))[0]
    chosen, nearest = [0], u @ u[0]
    while len(chosen) < min(most, MOST_PIVOTS, len(u)):
        k = int(np.argmin(nearest))
        if nearest[k] >= np.cos(apart) - SLACK:
            break
        chosen.append(k)
        nearest = np.maximum(nearest, u @ u[k])
    return u[chosen]


# --- all pairs above a similarity

@dataclass(frozen=True)
class PairPlan:
    """Of each cell the blocks of its members and of its visitors, and the rows that will be shuffled."""

    pivots: np.ndarray
    longest: float
    members: np.ndarray
    visitors: np.ndarray
    rows_of_block: int

    @property
    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        return -(-self.members // self.rows_of_block), -(-self.visitors // self.rows_of_block)

    @property
    def rows(self) -> int:
        s, z = self.blocks
        return int((self.members * (s + z) + self.visitors * s).sum())


def homes_and_visits(m: np.ndarray, pivots: np.ndarray, least: float, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row (-1 if no vector can be similar enough), and which cells of smaller
    number it has to visit. A row at angle t or less to a member of another cell is within t of the half
    sphere nearer to that cell's pivot, so its distance to the border, an arc sine, is at most t."""
    u, size = unit(m)
    cos = u @ pivots.T
    home = np.argmax(cos, axis=1)
    own = cos[np.arange(len(u)), home]
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(size > 0, least / (size * longest), np.inf)
    reach = np.sqrt(np.maximum(0, 1 - np.clip(need, 0, 1) ** 2))
    apart = np.linalg.norm(pivots[home][:, None] - pivots[None], axis=2) if len(pivots) <= 64 else np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))[home]
    visits = (own[:, None] - cos <= reach[:, None] * apart + SLACK) & (np.arange(len(pivots)) < home[:, None])
    none = need > 1 + SLACK
    visits[none] = False
    return np.where(none, -1, home), visits


def plan_pairs(vectors: DataFrame, least: float, rows: int | None = None, most: int = MOST_ROWS) -> PairPlan:
    """How pairs with a dot product of `least` or more will be found. Two passes over the vectors, without
    a shuffle of them. Where cells would not save rows there is one cell, and blocks meet each other.
    Blocks have `rows` rows, or a fixed share of all (`blocks.rows_of_block`), up to `most`."""
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, longest = vectors.agg(F.count(F.lit(1)), F.max(size)).first()
    block, rows = rows or rows_of_block(n, most), rows or 4096
    one = PairPlan(np.zeros((0, 0)), longest or 0.0, np.array([n]), np.array([0]), rows)
    if n <= rows or least <= 0 or not longest:
        return replace(one, rows_of_block=block)
    pivots = choose_pivots(vectors, n, max(64, 4 * -(-n // rows)), apart=2 * float(np.arccos(min(1.0, least / longest ** 2))))
    if len(pivots) < 2:
        return replace(one, rows_of_block=block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, visitors = np.zeros(len(pivots), int), np.zeros(len(pivots), int)
        for b in batches:
            if b.num_rows:
                home, visits = homes_and_visits(matrix(pa.Table.from_batches([b])), pivots, least, longest)
                members += np.bincount(home[home >= 0], minlength=len(pivots))
                visitors += visits.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(len(pivots)), "m": members, "v": visitors})

    found = vectors.select("vector").mapInArrow(count, "cell long, m long, v long").groupBy("cell").agg(F.sum("m").alias("m"), F.sum("v").alias("v")).toArrow().sort_by("cell")
    plan = PairPlan(pivots, longest, found["m"].to_numpy(), found["v"].to_numpy(), rows)
    return replace(plan if plan.rows < one.rows else one, rows_of_block=block)


def _dealt(vectors: DataFrame, least: float, plan: PairPlan, id_col: str) -> DataFrame:
    """Rows (cell, x, y, own, i, vector), once for each pair of blocks x, y that they are in, of which own is theirs.
    A row goes to its own cell and to those that its ball touches; a cell's members and visitors are
    dealt into blocks, of which two meet in a task. A pair is found in the smaller of its two
    cells, by one pair of blocks."""
    s, z = plan.blocks
    rows = vectors.select(F.col(id_col).alias("i"), "vector", F.xxhash64(id_col).alias("h"))
    kind, vector_kind = (dict(rows.dtypes)[c] for c in ("i", "vector"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                h = np.asarray(b.column(2)).view(np.uint64)
                if len(plan.pivots):
                    home, visits = homes_and_visits(matrix(pa.Table.from_batches([b])), plan.pivots, least, plan.longest)
                else:
                    home, visits = np.zeros(b.num_rows, int), np.zeros((b.num_rows, 1), bool)
                guest, cell = np.nonzero(visits)
                own = np.flatnonzero(home >= 0)
                row, cell = np.concatenate([own, guest]), np.concatenate([home[own], cell])
                inside = np.arange(len(row)) < len(own)
                block = np.where(inside, h[row] % np.maximum(s[cell], 1).astype(np.uint64), s[cell] + (h[row] % np.maximum(z[cell], 1).astype(np.uint64)).astype(int)).astype(int)
                others = np.where(inside, s[cell] + z[cell], s[cell])
                k = np.repeat(np.arange(len(row)), others)
                other = np.arange(len(k)) - np.repeat(np.cumsum(others) - others, others)
                out = b.take(pa.array(row[k]))
                yield pa.RecordBatch.from_arrays([pa.array(cell[k], pa.int32()), pa.array(np.minimum(block[k], other), pa.int32()), pa.array(np.maximum(block[k], other), pa.int32()), pa.array(block[k], pa.int32()), out.column(0), out.column(1)],
                                                 names=["cell", "x", "y", "own", "i", "vector"])

    return rows.mapInArrow(deal, f"cell int, x int, y int, own int, i {kind}, vector {vector_kind}")


def _hits(g: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the two blocks of a group, tile by tile: rows left and right, dot products and which of them reach `least`."""
    m, side = matrix(g), g["own"].to_numpy()
    left, right = np.flatnonzero(side == g["x"][0].as_py()), np.flatnonzero(side == g["y"][0].as_py())
    other = m[right].T
    for now in tiles(len(left), len(right)):
        dots = m[left[now]] @ other
        yield left[now], right, dots, dots >= least


def pairs_by_cells(vectors: DataFrame, least: float, plan: PairPlan, id_col: str) -> DataFrame:
    """a, b, similarity of all pairs a < b with dot >= least."""
    kind = dict(vectors.dtypes)[id_col]

    def product(g: pa.Table) -> pa.Table:
        ids, same = g["i"].to_numpy(), g["x"][0].as_py() == g["y"][0].as_py()
        out = [(ids[:0], ids[:0], np.zeros(0))]
        for left, right, dots, hit in _hits(g, least):
            i, j = np.nonzero(hit)
            a, b, v = ids[left[i]], ids[right[j]], dots[i, j]
            keep = a < b if same else a != b  # within a block each pair comes twice, and each row meets itself
            out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], v[keep]))
        a, b, v = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"a": a, "b": b, "similarity": v})

    return _dealt(vectors, least, plan, id_col).groupBy("cell", "x", "y").applyInArrow(product, f"a {kind}, b {kind}, similarity double")


def degrees_by_cells(vectors: DataFrame, least: float, plan: PairPlan, id_col: str) -> DataFrame:
    """i, n: how many others each vector has a dot product of `least` or more with, if any. No pair is a row: two
    blocks return one row for each of their vectors."""
    kind = dict(vectors.dtypes)[id_col]

    def product(g: pa.Table) -> pa.Table:
        ids, same = g["i"].to_numpy(), g["x"][0].as_py() == g["y"][0].as_py()
        n = np.zeros(len(ids), np.int64)
        for left, right, _, hit in _hits(g, least):
            if same or np.isin(ids[left], ids[right]).any():
                hit &= ids[left][:, None] != ids[right]
            n[left] += hit.sum(1)
            if not same:
                n[right] += hit.sum(0)
        some = np.flatnonzero(n)
        return pa.table({"i": ids[some], "n": n[some]})

    found = _dealt(vectors, least, plan, id_col).groupBy("cell", "x", "y").applyInArrow(product, f"i {kind}, n long")
    return found.groupBy("i").agg(F.sum("n").alias("n"))


# --- the largest of a query

@dataclass(frozen=True)
class CellIndex:
    """Vectors (i, vector, cell) in a written table, and of each cell its pivot, members, the largest angle
    of a member to the pivot, and the least and largest length."""

    table: DataFrame
    pivots: np.ndarray
    members: np.ndarray
    radius: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    rows_of_block: int

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and cell a number that no dot product with a member is above."""
        u, size = unit(queries)
        angle = np.arccos(np.clip(u @ self.pivots.T, -1, 1)) - self.radius
        cos = np.cos(np.clip(angle, 0, np.pi))
        return np.where(self.members > 0, size[:, None] * cos * np.where(cos >= 0, self.longest, self.shortest) + SLACK * (1 + size[:, None] * self.longest), -np.inf)


def fit_cells(vectors: DataFrame, id_col: str, n: int, rows: int = 8192, pivots: int | None = None) -> CellIndex:
    """An index of all vectors, with as many cells as blocks of `rows` rows (4,096 at most), which it writes out."""
    p = choose_pivots(vectors, n, pivots or -(-n // rows))
    v = vectors.select(F.col(id_col).alias("i"), "vector")
    kinds = dict(v.dtypes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                u, size = unit(matrix(pa.Table.from_batches([b])))
                cos = u @ p.T
                cell = np.argmax(cos, axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))), pa.array(size)], names=["i", "vector", "cell", "angle", "size"])

    table = staged(v.mapInArrow(assign, f"i {kinds['i']}, vector {kinds['vector']}, cell int, angle double, size double"), "cells")
    told = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r"), F.min("size").alias("low"), F.max("size").alias("high")).toArrow()
    stats = np.zeros((4, len(p)))
    for k, name in enumerate(("n", "r", "low", "high")):
        stats[k, told["cell"].to_numpy()] = told[name].to_numpy()
    return CellIndex(table.select("i", "vector", "cell"), p, stats[0].astype(int), stats[1], stats[2], stats[3], rows)


def _cells_of(queries: DataFrame, index: CellIndex, k: int, above: bool) -> DataFrame:
    """queries with `cells`: those that a search has to look at. First the best by their bounds until they
    hold k vectors (in column cells); then, given the k-th similarity so far (column least, null if fewer
    were found) and the cells seen, all others whose bound reaches it."""
    kinds = dict(queries.dtypes)
    # What tasks need, without the table.
    bounds, members = _Bounds(index), index.members

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = pa.Table.from_batches([whole.slice(at, 1024)])
                bound = bounds(matrix(b))
                if above:
                    least = b["least"].to_numpy()
                    bound[~(bound >= np.where(np.isnan(least), -np.inf, least)[:, None])] = -np.inf
                    for row, seen in enumerate(b["seen"].to_pylist()):
                        bound[row, seen] = -np.inf
                    cells = [np.flatnonzero(x > -np.inf) for x in bound]
                else:
                    order = np.argsort(-bound, axis=1, kind="stable")
                    enough = np.argmax(np.cumsum(members[order], axis=1) >= min(k, members.sum()), axis=1)
                    cells = [o[:e + 1] for o, e in zip(order, enough, strict=True)]
                yield pa.RecordBatch.from_arrays([b["q"].combine_chunks(), b["vector"].combine_chunks(), pa.array(cells, pa.list_(pa.int32()))], names=["q", "vector", "cells"])

    return queries.mapInArrow(pick, f"q {kinds['q']}, vector {kinds['vector']}, cells array<int>")


class _Bounds:
    def __init__(self, index: CellIndex) -> None:
        self.pivots, self.members, self.radius, self.shortest, self.longest = index.pivots, index.members, index.radius, index.shortest, index.longest

    __call__ = CellIndex.bounds


def _search(told: DataFrame, index: CellIndex, kernel: Kernel, schema: str) -> DataFrame:
    """kernel(queries, vectors) for each block of a cell's members and of the queries that look at it."""
    met = told.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()
    asked = np.zeros(len(index.pivots), int)
    asked[met["cell"].to_numpy()] = met["n"].to_numpy()
    s, z = np.maximum(1, -(-index.members // index.rows_of_block)), -(-asked // index.rows_of_block)
    number = lambda values, of: F.element_at(F.array(*[F.lit(int(x)) for x in values]), of + 1)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    a = (told.select("q", "vector", F.explode("cells").alias("cell")).withColumn("qb", dealt("q", number(z, F.col("cell"))))
         .withColumn("vb", F.explode(F.sequence(F.lit(0), number(s, F.col("cell")) - 1))))
    blocks = number(z, F.col("cell"))
    b = (index.table.filter(blocks > 0).withColumn("vb", dealt("i", number(s, F.col("cell")))).withColumn("qb", F.explode(F.sequence(F.lit(0), blocks - 1))))
    none = empty_table(told, schema)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return kernel(x, y) if x.num_rows and y.num_rows else none

    return a.groupBy("cell", "qb", "vb").cogroup(b.groupBy("cell", "qb", "vb")).applyInArrow(run, schema)


def topk_by_cells(queries: DataFrame, index: CellIndex, k: int, kernel: Kernel, schema: str) -> tuple[DataFrame, DataFrame]:
    """The k largest of each query (q, vector), ties by i, exactly, and for each query how many cells it
    met. First each query looks into its best cells; the k-th similarity there is what a cell's bound
    has to reach for a second look. Repeated query ids are one query only if their vectors are equal."""
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "i"))).filter(F.col("rank") <= k)
    first = staged(_cells_of(queries, index, k, False), "first-cells")
    top = staged(ranked(_search(first, index, kernel, schema)), "first-best")
    least = top.filter(F.col("rank") == k).select("q", F.col("similarity").alias("least"))
    again = first.withColumnRenamed("cells", "seen").join(least.hint("merge"), "q", "left")
    second = staged(_cells_of(again, index, k, True), "second-cells")
    every = top.drop("rank").unionByName(_search(second, index, kernel, schema))
    met = first.select("q", F.size("cells").alias("first")).join(second.select("q", F.size("cells").alias("second")).hint("merge"), "q").withColumn("cells", F.lit(len(index.pivots)))
    return ranked(every), met


