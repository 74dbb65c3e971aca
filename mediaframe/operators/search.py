"""Exact vector retrieval: scores, top k, windows of a file, ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, is_valid
from . import cells
from ..sources.staging import staged
from .blocks import best_of, block_pairs, block_product, carried, in_order, matrix, tiles


def restrict(rows: DataFrame, only: DataFrame, key: str = "asset_id") -> DataFrame:
    return rows.join(only.select(key).distinct(), key, "left_semi")


def exclude(rows: DataFrame, ids: DataFrame, key: str = "asset_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def searchable(vectors: DataFrame, assets: DataFrame, libraries: list | None = None, key: str = "asset_id") -> DataFrame:
    """Vectors of indexed assets; vectors of more than one dimension are an error (when the result is
    computed). The dimension is that of the first vector, so the check needs no pass of its own."""
    kept = assets.filter(F.col("status") == "indexed")
    if libraries is not None:
        kept = kept.filter(F.col("library_id").isin(libraries))
    found = vectors.join(kept.select(key), key, "left_semi")
    some = found.select(F.size("vector")).first()
    if some is None:
        return found
    same = F.assert_true(F.size("vector") == F.lit(some[0]), F.lit("vectors of more than one dimension"))
    return found.filter(same.isNull())


def score(vectors: DataFrame, query: list[float] | Column | DataFrame, name: str = "similarity") -> DataFrame:
    """vectors with the dot product with a query: numbers, a column, or the first column of a one-row table,
    which is broadcast; no row gives no result."""
    if isinstance(query, DataFrame):
        one = query.select(F.col(query.columns[0]).alias("_query")).limit(1)
        return score(vectors.crossJoin(F.broadcast(one)), F.col("_query"), name).drop("_query")
    q = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    same = F.assert_true(F.size("vector") == F.size(q), F.lit("vector and query differ in dimension"))
    return vectors.filter(same.isNull()).withColumn(name, dot("vector", q))


def cosine_topk(vectors: DataFrame, query: list[float] | DataFrame, k: int, id_col: str = "asset_id") -> DataFrame:
    """Exact top k by dot product, ties by id; Spark keeps k rows of each partition."""
    return score(vectors, query).orderBy(F.desc("similarity"), id_col).limit(k)


def batch_topk(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", id_col: str = "asset_id", rows: int = 8192, others_to: float | None = None) -> DataFrame:
    """Top k of every query against all vectors, ties by id; with others_to, only among those of
    another id and a similarity of others_to or less. Vectors of one block are compared with all
    queries at once; more go into cells, of which a query meets those whose bound reaches its k-th
    similarity (`cells.topk_by_cells`; the index is written and the first look runs when this is
    called). Query ids are distinct."""
    q, v = queries.select(F.col(query_id).alias("q"), "vector"), vectors.select(F.col(id_col).alias("i"), "vector")
    kinds = dict(q.dtypes)["q"], dict(v.dtypes)["i"]

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("i")
        right, ids, names = matrix(b).T, b["i"].to_numpy(), a["q"].to_numpy()
        left, out = matrix(a), []
        for now in tiles(len(left), len(ids)):
            s, own = left[now] @ right, names[now]
            if others_to is not None:
                s[(s > others_to) | (own[:, None] == ids)] = -np.inf
            row, col = best_of(s, k)
            out.append((own[row], ids[col], s[row, col]))
        x, y, z = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"q": x, "i": y, "similarity": z})

    schema = f"q {kinds[0]}, i {kinds[1]}, similarity double"
    n = v.count()
    if n <= rows:
        w = Window.partitionBy("q").orderBy(F.desc("similarity"), "i")
        ranked = block_product(q, v, kernel, schema, "q", "i", rows).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    else:
        ranked, _ = cells.topk_by_cells(q, cells.fit_cells(v, "i", n, rows), k, kernel, schema)
    return ranked.select(F.col("q").alias(query_id), F.col("i").alias(id_col), "similarity", "rank")


#: Most rows of a block that returns pairs, whose number a task holds.
PAIR_ROWS = 16_384


def similarity_self_join(vectors: DataFrame, least: float, id_col: str = "asset_id", rows: int | None = None) -> DataFrame:
    """All pairs a < b with dot >= least, exactly. Vectors go to cells around pivots, and to other cells
    only where their ball of that similarity touches them (`cells.plan_pairs`, which runs two passes when
    this is called); blocks of `rows` rows of a cell (a share of all, up to PAIR_ROWS) meet as matrix
    products. Rows out are the pairs found. Null and empty vectors are left out, as is a pair of rows of one id."""
    some = vectors.filter(F.size("vector") > 0)
    return cells.pairs_by_cells(some, least, cells.plan_pairs(some, least, rows, PAIR_ROWS), id_col)


def best_by_group(vectors: DataFrame, group: str, id_col: str = "asset_id", rows: int | None = None) -> DataFrame:
    """id, same, other: the largest similarity to another vector of the same group, and to one of
    another group (null if there is none). Two blocks meet once, for the rows of both, and return a row
    for each vector, never pairs."""
    v = vectors.select(F.col(id_col).alias("i"), F.col(group).alias("g"), "vector")
    kind = dict(v.dtypes)["i"]

    def kernel(a: pa.Table, b: pa.Table, one: bool) -> pa.Table:
        a, b = a.sort_by("g"), b.sort_by("g")
        left, right, ia, ib, ga, gb = matrix(a), matrix(b), a["i"].to_numpy(), b["i"].to_numpy(), a["g"].to_numpy(), b["g"].to_numpy()
        starts = lambda g: np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        first = starts(gb)
        best, back = np.full((2, len(left)), -np.inf), np.full((2, len(right)), -np.inf)
        for now in tiles(len(left), len(right)):
            s = left[now] @ right.T
            if one:
                s[ia[now][:, None] == ib] = -np.inf
            m = np.maximum.reduceat(s, first, axis=1)
            like = ga[now][:, None] == gb[first]
            best[0, now], best[1, now] = np.where(like, m, -np.inf).max(1), np.where(like, -np.inf, m).max(1)
            if not one:
                rows_of = starts(ga[now])
                for at, end in zip(rows_of, [*rows_of[1:], len(s)], strict=True):
                    m, like = s[at:end].max(0), gb == ga[now][at]
                    back[0] = np.maximum(back[0], np.where(like, m, -np.inf))
                    back[1] = np.maximum(back[1], np.where(like, -np.inf, m))
        if one:
            return pa.table({"i": ia, "same": best[0], "other": best[1]})
        return pa.table({"i": np.concatenate([ia, ib]), "same": np.concatenate([best[0], back[0]]), "other": np.concatenate([best[1], back[1]])})

    found = block_pairs(v, kernel, f"i {kind}, same double, other double", "i", rows)
    best = lambda c: F.max(F.when(F.col(c) > F.lit(float("-inf")), F.col(c))).alias(c)
    return found.groupBy(F.col("i").alias(id_col)).agg(best("same"), best("other"))


def rank_of_truth(queries: DataFrame, windows: DataFrame, rows: int | None = None, slack: float = 1e-9) -> DataFrame:
    """query, rank: of each query (query, truth, vector) 1 + the groups that are strictly better than
    its true one, by the best window (grp, vector) of a group. The score of the truth comes by an
    equi-join; blocks that hold whole groups then count the better ones. A query whose group has no
    window has no rank. Scores within `slack` of the truth's are summed once more in the order in which
    that was, so that equal vectors are equal and any difference counts."""
    own = queries.join(windows.select(F.col("grp").alias("truth"), F.col("vector").alias("w")).hint("merge"), "truth").groupBy("query", "truth").agg(F.max(dot("vector", "w")).alias("x"))
    asked = queries.select("query", "vector").join(own.hint("merge"), "query").select("query", "truth", "x", "vector")
    kind = dict(asked.dtypes)["query"]

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("grp")
        groups, right = b["grp"].to_numpy(), matrix(b)
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        left, x, truth, better = matrix(a), a["x"].to_numpy(), a["truth"].to_numpy(), []
        for now in tiles(len(left), len(right)):
            s = left[now] @ right.T
            above = s > x[now][:, None] + slack
            i, j = np.nonzero((s >= x[now][:, None] - slack) & ~above & (groups != truth[now][:, None]))
            for at in range(0, len(i), 1 << 16):
                few, those = i[at: at + (1 << 16)], j[at: at + (1 << 16)]
                above[few, those] = in_order(left[now][few], right[those]) > x[now][few]
            best = np.logical_or.reduceat(above, first, axis=1)
            better.append((best & (groups[first] != truth[now][:, None])).sum(1))
        return pa.table({"query": a["query"], "better": np.concatenate(better)})

    return block_product(asked, windows.select("grp", "vector"), kernel, f"query {kind}, better long", "query", "grp", rows).groupBy("query").agg((1 + F.sum("better")).alias("rank"))


def best_window_per_asset(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """First hit of each asset, in order of similarity."""
    w = Window.partitionBy("asset_id").orderBy(F.desc("similarity"), "embedding_id")
    best = hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").orderBy(F.desc("similarity"), "embedding_id")
    return best.limit(limit) if limit else best


def overlap_fraction(a: Column, b: Column) -> Column:
    """Overlap of two windows (struct with start_s, end_s) over the shorter; no start gives 0."""
    inter = F.greatest(F.lit(0.0), F.least(a["end_s"], b["end_s"]) - F.greatest(a["start_s"], b["start_s"]))
    shorter = F.greatest(F.lit(1e-9), F.least(a["end_s"] - a["start_s"], b["end_s"] - b["start_s"]))
    return F.when(a["start_s"].isNull() | b["start_s"].isNull(), 0.0).otherwise(inter / shorter)


def group_hits(hits: DataFrame, limit: int, max_extra: int = 5, max_overlap: float = 0.5) -> DataFrame:
    """asset_id, best, others, suppressed: windows of a file in order of similarity; one more is kept
    if it overlaps all kept ones by less than max_overlap, until max_extra are kept; those that do
    not count as suppressed. A file has few windows, which are folded in one expression."""
    hit = "struct<similarity:double,embedding_id:bigint,start_s:double,end_s:double>"
    listed = hits.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("neg"), "embedding_id", "similarity", "start_s", "end_s"))).alias("hits"))
    plain = F.transform("hits", lambda h: F.struct(h["similarity"].alias("similarity"), h["embedding_id"].cast("long").alias("embedding_id"), h["start_s"].alias("start_s"), h["end_s"].alias("end_s")))

    def step(acc: Column, h: Column) -> Column:
        free = F.forall(acc["kept"], lambda k: overlap_fraction(h, k) < max_overlap)
        full = F.size(acc["kept"]) > max_extra
        return F.struct(F.when(~full & free, F.concat(acc["kept"], F.array(h))).otherwise(acc["kept"]).alias("kept"),
                        F.when(~full & ~free, acc["suppressed"] + 1).otherwise(acc["suppressed"]).alias("suppressed"))

    start = F.struct(F.expr(f"cast(array() as array<{hit}>)").alias("kept"), F.lit(0).alias("suppressed"))
    folded = listed.select("asset_id", F.aggregate(plain, start, step).alias("g"))
    return (folded.select("asset_id", F.col("g.kept")[0].alias("best"), F.slice("g.kept", 2, max_extra).alias("others"), F.col("g.suppressed").alias("suppressed"))
            .orderBy(F.desc("best.similarity"), "best.embedding_id").limit(limit))


def window_at(segments: DataFrame, moments: DataFrame) -> DataFrame:
    """For each different (asset_id, t) the window that contains t and starts nearest to it, else the one that
    starts nearest; ties by index; null for an asset without windows. Windows without a start are none.

    Window starts and moments are one sorted stream, dealt by ranges (`blocks.carried`), in which each
    moment has the last start before it, the first one after it and the latest end so far. The last
    start decides unless its window is over while an earlier one goes on; only such moments are joined
    with the windows that go on after their successor has ended."""
    windows = segments.filter("start_s is not null").select("asset_id", F.col("start_s").cast("double").alias("at"), F.lit(0).alias("kind"), (-F.col("segment_index")).alias("neg"), F.col("end_s").cast("double").alias("end"))
    asked = moments.select("asset_id", F.col("t").cast("double").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("neg"), F.lit(None).cast("double").alias("end")).distinct()
    start = F.col("kind") == 0
    stream = carried(windows.unionByName(asked), ["asset_id"], ["at", "kind", "neg"], {"before": F.when(start, F.struct("at", "neg", "end"))}, {"after": F.when(start, F.col("at"))})
    firsts = windows.groupBy("asset_id", F.col("at").alias("after")).agg(F.min(-F.col("neg")).alias("first"))
    told = staged(stream.filter("kind = 1").select("asset_id", F.col("at").alias("t"), "before", "after").join(firsts.hint("merge"), ["asset_id", "after"], "left"))
    gap = F.struct((F.col("t") - F.col("before.at")).alias("gap"), (-F.col("before.neg")).alias("segment_index"))
    later = F.struct((F.col("after") - F.col("t")).alias("gap"), F.col("first").alias("segment_index"))
    nearest = F.when(F.col("before").isNull(), F.col("first")).when(F.col("after").isNull() | (gap <= later), -F.col("before.neg")).otherwise(F.col("first"))
    over = F.coalesce(F.col("before.end") <= F.col("t"), F.lit(False))
    by_start = Window.partitionBy("asset_id", "_part").orderBy("at", "neg")
    ranged = staged(windows.repartitionByRange("asset_id", "at").withColumn("_part", F.spark_partition_id()))
    following = F.lead("end").over(by_start)
    going_on = ranged.withColumn("next", following).filter("next is null or end > next").select("asset_id", "at", "neg", "end")
    hit = (told.filter(over).select("asset_id", "t").join(going_on.hint("merge"), "asset_id").filter("at <= t and t < end")
           .groupBy("asset_id", "t").agg((-F.max(F.struct("at", "neg"))["neg"]).alias("inside")))
    out = told.join(hit.hint("merge"), ["asset_id", "t"], "left")
    return out.select("asset_id", "t", F.coalesce("inside", F.when(~over & F.col("before").isNotNull(), -F.col("before.neg")), nearest).alias("segment_index"))


def rank_results(hits: DataFrame, id_col: str = "asset_id", by: str | None = None, keep: int | None = None) -> DataFrame:
    """1-based rank by similarity, over all (few, after a top k) or in each group of `by`."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(1))).orderBy(F.desc("similarity"), id_col)
    ranked = hits.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= keep) if keep else ranked


def object_first(ranked: DataFrame, found: DataFrame, checked: DataFrame, limit: int) -> DataFrame:
    """Found by the detector first, then the rest (not checked or not found), each in its order."""
    f = found.select("asset_id").distinct().withColumn("_f", F.lit(True))
    c = checked.select("asset_id").distinct().withColumn("_c", F.lit(True))
    state = F.when(F.col("_f"), "found").when(F.col("_c"), "not found").otherwise("not checked")
    marked = ranked.join(f, "asset_id", "left").join(c, "asset_id", "left").withColumn("object_check", state)
    w = Window.partitionBy(F.lit(1)).orderBy(F.when(F.col("_f"), 0).otherwise(1), "rank")
    return marked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("_f", "_c")


def by_media_type(assets: DataFrame, search: dict, rank) -> DataFrame:
    """One ranking of several: search names a function of (assets of the type) for each media type, and
    rank orders what they return together."""
    parts = [fn(assets.filter(F.col("media_type") == name)).withColumn("media_type", F.lit(name)) for name, fn in search.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return rank(every)


#: Fixed: how many are ranked for a limit when found photos can come up, and windows of one file can merge.
ROOM = 200


def search_grouped(assets: DataFrame, segments: DataFrame, query: list[float] | DataFrame, when, limit: int, found: DataFrame | None = None, checked: DataFrame | None = None) -> DataFrame:
    """asset_id, similarity, rank (and object_check): photos in scope by their best window. Where the detector
    can bring photos up, four times as many as asked for are ranked, 200 at least, and those with the
    object come first."""
    from .catalog import scope

    hits = score(searchable(segments, scope(assets, when=when)), query)
    top = best_window_per_asset(hits, max(4 * limit, ROOM) if found is not None else limit)
    ranked = rank_results(top.select("asset_id", "similarity"))
    return object_first(ranked, found, checked, limit) if found is not None else ranked


#: Modality of the vectors that are searched for each media type; of videos one of three signals.
MODALITIES = {"image": "image", "audio": "audio", "video": "video-visual"}
VIDEO_SIGNALS = {"visual": "video-visual", "audio": "video-audio", "joint": "video-joint"}


def modalities_for(media_types: list[str], video_signal: str = "visual") -> list[str]:
    """The modalities to search, in order and each once; an unknown type or signal is an error."""
    return list(dict.fromkeys(VIDEO_SIGNALS[video_signal] if t == "video" else MODALITIES[t] for t in media_types))


def refuse_incompatible(assets: DataFrame, vectors: DataFrame, profile: str, rows: DataFrame) -> DataFrame:
    """rows with index_state over all assets of the search; an error when the result is computed if they only
    have vectors of other profiles. Vectors of different profiles are never ranked together."""
    from .catalog import index_state

    state = index_state(assets.withColumn("_all", F.lit(1)), vectors, profile, "_all").select("state")
    refused = F.when(F.col("state") == "incompatible", F.raise_error(F.lit("indexed with another profile: import again"))).otherwise(F.col("state"))
    one = state.select(refused.alias("index_state"))
    return rows.crossJoin(F.broadcast(one))  # one row, or none without assets


def search(assets: DataFrame, vectors: DataFrame, query: list[float] | DataFrame, profile: str, limit: int, media_types: list[str] | None = None, video_signal: str = "visual",
           libraries: list | None = None, when=None, hydrate: list[str] | None = None, grouped: bool = True) -> DataFrame:
    """The whole search of one query: rank, asset_id, similarity, modality, start_s, end_s, others (windows of
    the same file that overlap little), suppressed, index_state, and the columns `hydrate` of the assets.

    assets in scope (types, libraries, time and place) and vectors (asset_id, embedding_id, profile_key,
    modality, start_s, end_s, vector) of the profile and of the modalities of these types; an index
    of other profiles only is an error. Files of windows are grouped, from 12 times the limit."""
    from .catalog import scope

    types = media_types or ["image"]
    wanted = modalities_for(types, video_signal)
    kept = scope(assets, libraries, when, media=tuple(types))
    own = vectors.filter((F.col("profile_key") == profile) & F.col("modality").isin(wanted))
    hits = score(searchable(own, kept), query)
    if grouped and wanted != ["image"]:
        top = hits.orderBy(F.desc("similarity"), "embedding_id").limit(max(12 * limit, ROOM))
        found = group_hits(top, limit).select("asset_id", F.col("best.similarity").alias("similarity"), F.col("best.embedding_id").alias("embedding_id"), F.col("best.start_s").alias("start_s"), F.col("best.end_s").alias("end_s"), "others", "suppressed")
        found = found.join(top.select("embedding_id", "modality"), "embedding_id")
    else:
        top = hits.orderBy(F.desc("similarity"), "embedding_id").limit(limit)
        found = top.select("embedding_id", "asset_id", "similarity", "modality", "start_s", "end_s", F.array().cast("array<struct<similarity:double,embedding_id:bigint,start_s:double,end_s:double>>").alias("others"), F.lit(0).alias("suppressed"))
    ranked = rank_results(found, "embedding_id").join(assets.select("asset_id", *(hydrate or [])), "asset_id")
    in_scope = assets.filter(F.col("media_type").isin(types))
    return refuse_incompatible(in_scope if libraries is None else in_scope.filter(F.col("library_id").isin(libraries)), vectors, profile, ranked)


def rank_within(ids: DataFrame, vectors: DataFrame, query: list[float] | DataFrame) -> DataFrame:
    """Scores of a set of ids; an id without a vector scores -2."""
    return ids.join(score(vectors, query).select("asset_id", "similarity"), "asset_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(-2.0)))


def valid_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.filter(is_valid("vector", dim))


def encode(rows: DataFrame, encoder, text_col: str, id_col: str, batch: int = 32) -> DataFrame:
    """id, vector, error: a batch encoder made once a task by encoder(); where a batch fails its
    items go one by one, and an item that fails becomes a row with its error. Vectors are unit."""
    kind = dict(rows.dtypes)[id_col]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = encoder()
        for part in parts:
            for at in range(0, len(part), batch):
                few = part.iloc[at: at + batch]
                items, vectors, errors = few[text_col].tolist(), [], []
                try:
                    vectors, errors = list(fn(items)), [None] * len(items)
                except Exception:  # the batch fails: each on its own
                    for item in items:
                        try:
                            vectors.append(fn([item])[0])
                            errors.append(None)
                        except Exception as e:
                            vectors.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                unit = [None if v is None else (np.asarray(v, np.float64) / np.linalg.norm(v)).tolist() for v in vectors]
                yield pd.DataFrame({id_col: few[id_col].tolist(), "vector": unit, "error": errors})

    return rows.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, vector array<double>, error string")


def hash_encoder(dim: int = 64):
    """A stand-in encoder: a unit vector from the SHA-256 of the text."""
    import hashlib

    def fn(items: list) -> list[np.ndarray]:
        out = []
        for x in items:
            seed = int.from_bytes(hashlib.sha256((x or "").encode()).digest()[:8], "little")
            out.append(np.random.default_rng(seed).standard_normal(dim))
        return out

    return fn
