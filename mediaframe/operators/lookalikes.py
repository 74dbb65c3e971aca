"""Groups of look-alikes: greedy stars over a similarity graph, best shots, budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import cells
from .blocks import matrix, running_total, tiles
from .graph import components


#: Fixed levels of likeness: the least cosine similarity.
LEVELS = {"strict": 0.95, "normal": 0.92, "loose": 0.90}

STAR = "leader {id}, member {id}, similarity double"


def _greedy(group: pa.Table) -> pa.Table:
    """Stars of whole components, photo by photo."""
    a, b, x = (group[c].to_numpy() for c in ("a", "b", "similarity"))
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, x = np.concatenate([ends[: len(a)], ends[len(a):]]), np.concatenate([ends[len(a):], ends[: len(a)]]), np.concatenate([x, x])
    order = np.argsort(u, kind="stable")
    v, x, at = v[order], x[order], np.searchsorted(u[order], np.arange(len(ids) + 1))
    free, out = np.ones(len(ids), bool), []
    for k in np.lexsort((np.arange(len(ids)), -np.diff(at))):
        if free[k]:
            near = np.arange(at[k], at[k + 1])
            near = near[free[v[near]]]
            free[k] = free[v[near]] = False
            out.append((np.full(len(near), k), v[near], x[near]))
    lead, member, sim = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"leader": ids[lead], "member": ids[member], "similarity": np.round(sim, 5)})


def stars(pairs: DataFrame, spark: SparkSession, small: int = 100_000, most_rounds: int = 1000) -> DataFrame:
    """leader, member, similarity. Photos are visited by falling degree, then id; a free photo leads
    its free neighbours. A component of up to `small` pairs is visited whole in one task, many to a task;
    a larger one by rounds (`_stars_by_rounds`). pairs: a < b, similarity, each once."""
    pairs = staged(pairs)  # the join that finds them runs once
    kind = dict(pairs.dtypes)["a"]
    comps = components(pairs)
    told = staged(pairs.join(comps.select(F.col("node").alias("a"), "comp").hint("merge"), "a"))
    sizes = staged(told.groupBy("comp").agg(F.count(F.lit(1)).alias("n")))
    tasks = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // small + 1)
    giant = sizes.filter(F.col("n") > small)
    few = told.join(giant.select("comp").hint("merge"), "comp", "left_anti").groupBy(F.pmod(F.xxhash64("comp"), F.lit(tasks)).alias("task"))
    found = few.applyInArrow(lambda g: _greedy(g), STAR.format(id=kind))
    if giant.isEmpty():
        return found
    return found.unionByName(_stars_by_rounds(told.join(giant.select("comp").hint("merge"), "comp", "left_semi").select("a", "b", "similarity"), most_rounds))


def _stars_by_rounds(pairs: DataFrame, most: int) -> DataFrame:
    """The same stars as the first maximal independent set in the order of visits: each round, a photo with
    an earlier leader next to it is out, and one whose earlier neighbours are all out leads. A member
    joins its earliest leader. More than `most` rounds are an error."""
    pairs = staged(pairs)
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "similarity").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "similarity"))
    degree = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("n")).alias("neg"), F.col("u").alias("id"))
    nodes = staged(degree.select("u", order.alias("o"), F.lit("open").alias("state")))
    neighbours = staged(edges.join(nodes.select("u", F.col("o").alias("ou")), "u").join(nodes.select(F.col("u").alias("v"), F.col("o").alias("ov")), "v").filter("ov < ou").select("u", "v"))
    for _ in range(most):
        if not nodes.filter("state = 'open'").limit(1).count():
            break
        seen = (neighbours.join(nodes.select(F.col("u").alias("v"), F.col("state").alias("sv")), "v").groupBy("u")
                .agg(F.bool_or(F.col("sv") == "lead").alias("led"), F.bool_and(F.col("sv") == "out").alias("clear")))
        state = F.when(F.col("state") != "open", F.col("state")).when(F.col("led"), "out").when(F.coalesce("clear", F.lit(True)), "lead").otherwise("open")
        nodes = staged(nodes.join(seen, "u", "left").select("u", "o", state.alias("state")))
    else:
        raise RuntimeError(f"a component of look-alikes is not done in {most} rounds")
    lead = nodes.filter("state = 'lead'").select(F.col("u").alias("v"), F.col("o").alias("ov"))
    out = nodes.filter("state = 'out'").select("u")
    joined = edges.join(lead, "v").join(out, "u", "left_semi")
    first = joined.groupBy("u").agg(F.min_by(F.struct("v", "similarity"), "ov").alias("l"))
    return first.select(F.col("l.v").alias("leader"), F.col("u").alias("member"), F.round("l.similarity", 5).alias("similarity"))


def _leaders(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (i, vector) in order those that are near no earlier one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if not rows or not rows.num_rows:
            return
        m, lead = matrix(rows), np.zeros(0, int)
        for at in range(0, len(m), 256):
            some = m[at: at + 256]
            free = ~(some @ m[lead].T >= least).any(1)
            near, new = some @ some.T >= least, []
            for k in np.flatnonzero(free):
                if free[k]:
                    new.append(at + k)
                    free &= ~near[k]
            lead = np.concatenate([lead, np.array(new, int)])
        yield from rows.take(pa.array(lead)).combine_chunks().to_batches()

    return run


def _led(lead: pa.Table, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (i, vector, n) with the first leader that they are near; only those that stay free keep their vector."""
    heads, names = matrix(lead), lead["i"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m, ids = matrix(pa.Table.from_batches([b])), b.column("i").to_numpy(zero_copy_only=False)
            first, dots = np.zeros(len(m), int), np.full(len(m), np.nan)
            for now in tiles(len(m), len(heads)):
                x = m[now] @ heads.T
                first[now] = np.argmax(x >= least, axis=1)
                dots[now] = x[np.arange(len(x)), first[now]]
            leads = np.isin(ids, names)
            near = (dots >= least) & ~leads
            yield pa.RecordBatch.from_arrays([b.column("i"), pc.if_else(pa.array(near | leads), None, b.column("vector")), b.column("n"), pa.array(names[first], b.column("i").type, mask=~near), pa.array(np.round(dots, 5), mask=~near)],
                                             names=["i", "vector", "n", "leader", "similarity"])

    return run


def stars_of(vectors: DataFrame, least: float, spark: SparkSession, id_col: str = "asset_id", pairs: int = 32, batch: int = 16_384) -> DataFrame:
    """leader, member, similarity: the `stars` of all pairs with a dot product of `least` or more. The neighbours
    of each vector are counted first. If they are up to `pairs` a vector, pairs are made. More are never
    rows: each round the first `batch` free photos in order are visited in one task, and their leaders,
    which are as many at most, go to all that are free, each of which joins the first that it is near.
    In a dense graph few leaders are near to nearly all. Runs when called."""
    some = staged(vectors.filter(F.size("vector") > 0).select(F.col(id_col).alias("i"), "vector"))
    degrees = staged(cells.degrees_by_cells(some, least, cells.plan_pairs(some, least), "i"))
    n, ends = degrees.agg(F.count(F.lit(1)), F.sum("n")).first()
    if (ends or 0) <= 2 * pairs * n:
        from .search import similarity_self_join

        return stars(similarity_self_join(some, least, "i"), spark)
    kinds = dict(some.dtypes)
    free, found = staged(some.join(degrees.hint("merge"), "i")), None
    while (lead := free.orderBy(F.desc("n"), "i").limit(batch).select("i", "vector").mapInArrow(_leaders(least), f"i {kinds['i']}, vector {kinds['vector']}").toArrow()).num_rows:
        told = staged(free.mapInArrow(_led(lead, least), f"i {kinds['i']}, vector {kinds['vector']}, n long, leader {kinds['i']}, similarity double"))
        free = told.filter("vector is not null").select("i", "vector", "n")
        joined = told.filter("leader is not null").select("leader", F.col("i").alias("member"), "similarity")
        found = joined if found is None else found.unionByName(joined)
    return found


def best_shot(shots: DataFrame) -> DataFrame:
    """Of each group the sharpest, or among those within a tenth of it the one with most pixels."""
    top = F.max("sharpness").over(Window.partitionBy("grp"))
    w = Window.partitionBy("grp").orderBy(F.desc("pixels"), F.desc("sharpness"), "id")
    return shots.withColumn("top", top).filter("sharpness >= 0.9 * top").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "top")


def group_budget(groups: DataFrame, limit: int) -> DataFrame:
    """Whole groups (n, first), largest first, up to `limit` members in total; stops at the first that does
    not fit. Totals go by ranges of groups."""
    return running_total(groups, [], [F.desc("n"), F.asc("first")], "n", "total").filter(F.col("total") <= limit)


def groups(stars: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """leader, member, best, identical, size: whole groups, the largest first, up to `limit` photos;
    facts: asset_id, content_hash, sharpness, pixels. Photos without facts have no hash and no best shot."""
    every = stars.select("leader", "member").unionByName(stars.select("leader", F.col("leader").alias("member")).distinct())
    fit = group_budget(every.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.col("leader")), limit).select("leader", F.col("n").alias("size"))
    rows = staged(every.join(fit.hint("merge"), "leader").join(facts.withColumnRenamed("asset_id", "member").hint("merge"), "member", "left"))
    best = best_shot(rows.filter("sharpness is not null").select(F.col("leader").alias("grp"), F.col("member").alias("id"), "sharpness", "pixels")).select(F.col("grp").alias("leader"), F.col("id").alias("keeper"))
    same = rows.groupBy("leader").agg(((F.count_distinct("content_hash") == 1) & (F.count("content_hash") == F.count(F.lit(1)))).alias("identical"))
    out = rows.join(best.hint("merge"), "leader", "left").join(same.hint("merge"), "leader")
    return out.select("leader", "member", F.coalesce(F.col("member") == F.col("keeper"), F.lit(False)).alias("best"), "identical", "size")


def review(stars: DataFrame, facts: DataFrame, limit: int = 1000) -> DataFrame:
    """What a reviewer sees: rank, grp, size, identical, member, best, similarity (to the group's leader, null
    for the leader). Whole groups, the largest first, up to `limit` photos (2 to 5,000); in each the shot
    to keep, then the leader, then members by falling similarity."""
    rows = groups(stars, facts, max(2, min(limit, 5000)))  # a bounded number of rows
    told = rows.join(stars.select("leader", "member", "similarity").hint("merge"), ["leader", "member"], "left")
    order = [F.desc("size"), F.asc("leader"), F.desc("best"), F.desc_nulls_first("similarity"), F.asc("member")]
    w = Window.partitionBy(F.lit(1))
    return told.select(F.row_number().over(w.orderBy(*order)).alias("rank"), F.dense_rank().over(w.orderBy(F.desc("size"), F.asc("leader"))).alias("grp"), "size", "identical", "member", "best", "similarity")


def level_summary(vectors: DataFrame, spark: SparkSession) -> DataFrame:
    """level, threshold, groups, photos of each level. The pairs of the loosest level hold those of the others,
    so vectors are joined once."""
    from .search import similarity_self_join

    pairs = staged(similarity_self_join(vectors, min(LEVELS.values())))
    out = None
    for level, least in LEVELS.items():
        found = stars(pairs.filter(F.col("similarity") >= least), spark)
        one = found.agg(F.count_distinct("leader").alias("groups"), (F.count_distinct("leader") + F.count(F.lit(1))).alias("photos"))
        one = one.select(F.lit(level).alias("level"), F.lit(least).alias("threshold"), "groups", "photos")
        out = one if out is None else out.unionByName(one)
    return out
