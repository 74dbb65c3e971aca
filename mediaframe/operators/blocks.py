"""All-against-all work on vectors: blocks of a fixed number of rows meet as matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

Kernel = Callable[[pa.Table, pa.Table], pa.Table]


def matrix(table: pa.Table, name: str = "vector") -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = table[name].combine_chunks()
    values = np.asarray(flat.flatten(), np.float64)
    return values.reshape(len(flat), -1)


#: Blocks that a table is dealt into, so that the rows shuffled are a fixed multiple of its rows, and the most rows of one.
BLOCKS, MOST_ROWS = 12, 65_536


def rows_of_block(n: int, most: int = MOST_ROWS) -> int:
    """A twelfth of n rows, 512 at least and `most` at most: beyond 12 * most rows a task's memory stays
    as it is and the number of blocks grows."""
    return min(most, max(512, -(-n // BLOCKS)))


def tiles(left: int, right: int, numbers: int = 1 << 21) -> Iterator[slice]:
    """Ranges of left rows whose products with all right rows are about `numbers` numbers."""
    step = min(512, max(16, numbers // max(right, 1)))
    return (slice(at, min(at + step, left)) for at in range(0, left, step))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed from the first number to the last as `functions.vectors.dot` does."""
    s = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        s = s + x * y
    return s


def _dealt(rows: DataFrame, own: str, other: str, key: Column, blocks: int, others: int) -> DataFrame:
    return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def block_product(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str, left_key: str, right_key: str, rows: int | None = None) -> DataFrame:
    """kernel(block of left, block of right) for every pair of blocks. A block has about `rows` rows
    (`rows_of_block`), so that a task's memory has a bound, and all rows of one key. Each side is
    repeated once for each block of the other: neither is broadcast, and no pair of rows is a row."""
    nl, nr = (max(1, -(-n // (rows or rows_of_block(n)))) for n in (left.count(), right.count()))
    a = _dealt(left, "_lb", "_rb", F.col(left_key), nl, nr)
    b = _dealt(right.select(*[F.col(c).alias(c) for c in right.columns]), "_rb", "_lb", F.col(right_key), nr, nl)  # new columns, if both sides are one table

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return kernel(x, y) if x.num_rows and y.num_rows else empty

    empty = empty_table(left, schema)
    return a.groupBy("_lb", "_rb").cogroup(b.groupBy("_lb", "_rb")).applyInArrow(run, schema)


def block_pairs(table: DataFrame, kernel: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, key: str, rows: int | None = None) -> DataFrame:
    """kernel(block, block, whether they are one) for every two blocks of one table, and each with itself, once."""
    n = table.count()
    blocks = max(1, -(-n // (rows or rows_of_block(n))))
    dealt = _dealt(table, "_own", "_other", F.col(key), blocks, blocks).select(*table.columns, "_own", F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y"))
    none = empty_table(table, schema)

    def run(g: pa.Table) -> pa.Table:
        own, x, y = g["_own"].to_numpy(), g["_x"][0].as_py(), g["_y"][0].as_py()
        if x == y:
            return kernel(g, g, True)
        a, b = g.filter(pa.array(own == x)), g.filter(pa.array(own == y))
        return kernel(a, b, False) if a.num_rows and b.num_rows else none

    return dealt.groupBy("_x", "_y").applyInArrow(run, schema)


def empty_table(df: DataFrame, schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema).empty_table()


def best_of(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest numbers of each row, ties by column; -inf never counts."""
    n = s.shape[1]
    if n > k:
        limit = np.partition(s, n - k, axis=1)[:, n - k]
        hit = s >= limit[:, None]
    else:
        hit = np.ones(s.shape, bool)
    row, col = np.nonzero(hit & (s > -np.inf))
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _in_ranges(rows: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """rows, written, with the range of rows (_part) that each is in."""
    return staged(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))


def _same(by: list[str]) -> list[Column]:
    return [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_part", *by)]


def running_total(rows: DataFrame, by: list[str], order: list[str | Column], value: str, name: str = "upto") -> DataFrame:
    """rows with the sum of `value` over the rows of its group (of `by`; none: all rows) up to its own, in order.
    A group need not fit into a task: rows are dealt by ranges, summed in each range, and moved on by the
    sums of the group's earlier ranges. The rows are written, and dealt by a sample of them, when this is
    called; a range and group in it is one row of what a window then sums."""
    ranged = _in_ranges(rows, by, order)
    upto = (Window.unboundedPreceding, Window.currentRow)
    inside = ranged.withColumn("_in", F.sum(value).over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(*upto)))
    sums = ranged.groupBy("_part", *by).agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    facts = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    joined = inside.alias("a").join(facts.hint("merge").alias("b"), _same(by))
    return joined.select("a.*", (F.col("b._before") + F.coalesce("a._in", F.lit(0))).alias(name)).drop("_part", "_in")


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "rn") -> DataFrame:
    """Row numbers from 1 in each group of `by`, in order; groups need not fit into a task (`running_total`)."""
    return running_total(rows.withColumn("_one", F.lit(1)), by, order, "_one", name).drop("_one")


def quantiles(rows: DataFrame, by: list[str], value: str, at: list[float], interpolate: bool = True) -> DataFrame:
    """by, q (the quantiles `at`, in order): exact, and no group is gathered. Equal values are counted first;
    running totals of the counts then tell which values have the wanted ranks. Linear between the two
    nearest ranks of n - 1, or the upper of those nearest to it (ties to even). Nulls do not count."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_total(counts, by, [value], "_n", "_upto")
    sizes = staged(counts.groupBy(*by).agg(F.sum("_n").alias("_all")))
    told = upto.alias("a").join(F.broadcast(sizes).alias("b")) if not by else upto.alias("a").join(sizes.hint("merge").alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
    ranked = told.select("a.*", "b._all")
    place = lambda q: F.lit(q) * (F.col("_all") - 1)
    least = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    if interpolate:
        ends = [c for k, q in enumerate(at) for c in (least(F.floor(place(q))).alias(f"_l{k}"), least(F.ceil(place(q))).alias(f"_h{k}"), F.max(place(q) - F.floor(place(q))).alias(f"_f{k}"))]
        found = ranked.groupBy(*by).agg(*ends)
        return found.select(*by, F.array(*[F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * F.col(f"_f{k}") for k in range(len(at))]).alias("q"))
    return ranked.groupBy(*by).agg(F.array(*[least(F.bround(place(q))) for q in at]).alias("q"))


def carried(rows: DataFrame, by: list[str], order: list[str], forward: dict[str, Column], back: dict[str, Column]) -> DataFrame:
    """rows with the last non-null value of each column of `forward` among the rows of its group up to its own,
    and the first one of each of `back` from its own on, in rising order. Groups go by ranges; what a
    range's rows lack comes from the nearest range that has it."""
    back_order = [F.desc(c) for c in order]
    ranged = _in_ranges(rows, by, order)
    for columns, sequence in ((forward, order), (back, back_order)):
        w = Window.partitionBy("_part", *by).orderBy(*sequence).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranged = ranged.select("*", *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in columns.items()])
    ranged = staged(ranged)
    ends = []
    for columns, sequence in ((forward, order), (back, back_order)):
        last = Window.partitionBy("_part", *by).orderBy(*sequence)
        ends.append(ranged.withColumn("_k", F.lead(F.lit(1)).over(last)).filter("_k is null").select("_part", *by, *columns))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged
    for facts, columns, w in ((ends[0], forward, earlier), (ends[1], back, later)):
        own = facts.select("_part", *by, *[F.last(n, ignorenulls=True).over(w).alias(f"_{n}") for n in columns])
        names = [c for c in out.columns if c not in columns]
        out = out.alias("a").join(own.hint("merge").alias("b"), _same(by)).select(*[F.col(f"a.{c}") for c in names], *[F.coalesce(f"a.{n}", f"b._{n}").alias(n) for n in columns])
    return out.drop("_part")
