import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.llm import decontaminate, exact_dedup, jaccard_join


def test_exact_dedup_edge_cases(docs, no_docs):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == docs.count()
    cat = [r for r in rows if r.doc_id in (1, 2)]
    assert {(r.keep_id, r.group_size) for r in cat} == {(2, 3)} and sum(r.kept for r in cat) == 1
    assert {r.doc_id: r.keep_id for r in rows if r.doc_id in (3, 4)} == {3: 4, 4: 4}  # null counts as empty
    assert [r.kept for r in rows if r.doc_id is None] == [True]
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 8, 9]  # one of the repeated rows


def test_exact_dedup_many_runs(spark):
    df = spark.range(600).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 50)) as text")
    want = {}
    for r in df.collect():
        want.setdefault(r.text, []).append(r.doc_id)
    for keep, pick in (("max", max), ("min", min)):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, keep=keep, fan_in=2, rows_per_run=20).collect()}
        assert got == {i: (pick(ids), len(ids)) for ids in want.values() for i in ids}


def brute_windows(text, items, window=13):
    words = decontaminate.words_of(text.encode())
    hit, names = set(), set()
    for name, item in items:
        w = decontaminate.words_of(item.encode())
        k = min(window, len(w))
        for a in range(len(w) - k + 1):
            for b in range(len(words) - k + 1):
                if k and words[b: b + k] == w[a: a + k]:
                    hit.update(range(b, b + k))
                    names.add(name)
    return len(words), hit, names


def test_suffix_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        vocab = "a b c d".split()[: rng.randint(1, 4)]
        items = [(str(i), " ".join(rng.choices(vocab, k=rng.randint(0, 9)))) for i in range(rng.randint(0, 5))]
        text = " ".join(rng.choices([*vocab, "z"], k=rng.randint(0, 25)))
        auto = decontaminate.ItemAutomaton([(n, decontaminate.words_of(t.encode())) for n, t in items], 4)
        n, spans, names = auto.scan(text.encode())
        assert (n, {i for a, b in spans for i in range(a, b)}, names) == brute_windows(text, items, 4)


def test_suffix_automaton_is_compact_and_linear():
    """50 bytes of arrays a word at most; repeated words and items cost no more than others."""
    rng = np.random.default_rng(5)
    words = [b"w%d" % x for x in np.minimum(rng.zipf(1.2, 60_000), 20_000)]
    items = [(str(k), words[100 * k: 100 * k + 100]) for k in range(600)] + [(f"copy {k}", words[:100]) for k in range(300)]
    auto = decontaminate.ItemAutomaton(items, 13)
    assert auto.size() <= 50 * 90_000
    n, spans, names = auto.scan(b" ".join(words[50:350]))
    assert (n, spans) == (300, [(0, 300)]) and {"0", "1", "2", "3", "copy 0", "copy 299"} <= names
    same = decontaminate.ItemAutomaton([("one", [b"x"] * 100_000), ("short", [b"x"] * 3)], 13)
    assert len(same.length) == 100_001 and len(same.owner_state) == 2
    assert same.scan(b"y " + b"x " * 50_000) == (50_001, [(1, 50_001)], {"one", "short"})
    assert same.scan(b"x x") == (2, [], set()) and same.scan(b"x x x") == (3, [(0, 3)], {"short"})


def test_contamination_in_several_passes(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "word " * 20), (5, "THE CAT sat on the mat!")], "item_id long, text string")
    one = decontaminate.judge(decontaminate.find_contamination(docs, items)).collect()
    many = decontaminate.judge(decontaminate.find_contamination(docs, items, max_words=4)).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == docs.count()
    clean = [sorted(map(str, decontaminate.remove_contaminated(docs, items, max_words=m).collect())) for m in (4, 1000)]
    assert clean[0] == clean[1] and 0 < len(clean[0]) < docs.count()
    assert {(r.n_hit, r.n_items, r.contaminated) for r in one if r.doc_id == 1} == {(6, 2, True)}
    assert {(r.n_words, r.n_hit) for r in one if r.doc_id in (3, 4)} == {(0, 0)}
    assert {r.n_hit for r in one if r.doc_id == 7} == {5000}
    assert decontaminate.find_contamination(no_docs, items).count() == 0
    assert decontaminate.remove_contaminated(docs, items).columns == docs.columns
    assert decontaminate.cut_spans("A the cat, B!", [(1, 3)]) == "A , B!"


def brute_components(rows, num=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {i: (len(sets[i]), low[i]) for i in sets}


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(99)}" for _ in range(rng.choice([30, 60, 90]))]
        for _ in range(40):
            x = list(base)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = f"w{rng.randrange(99)}"
            texts.append(" ".join(x))
    texts += [" ".join(rng.choices("ab", k=rng.randint(0, 12))) for _ in range(60)] + [None, "", " ", "one", "one two", "ONE two"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    # With and without combinations of frequent tokens, deeper ones, tiles, and hot signatures.
    for more in ({"least": 2}, {"least": 32}, {"least": 2, "bucket": 2, "hot_rows": 4}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, **more).collect()}
        assert got == want


def test_sets_that_link_share_a_signature():
    rng = np.random.default_rng(8)
    for k in (2, 4):
        for _ in range(300):
            n = int(rng.integers(4, 90))
            x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            y = np.unique(np.append(x[rng.permutation(len(x))[: len(x) - rng.integers(0, 1 + len(x) // 8)]], rng.integers(0, 1 << 62, rng.integers(0, 1 + n // 8)).astype(np.uint64)))
            both = len(np.intersect1d(x, y))
            if len(x) and len(y) and 100 * both >= 80 * (len(x) + len(y) - both) and min(len(x), len(y)) >= 4:
                a, b = (np.concatenate(jaccard_join.deep_signatures(s, len(s), len(s) - -(-80 * len(s) // 100) + 1, 80, k)) for s in (x, y))
                assert len(np.intersect1d(a, b)) or max(len(x), len(y)) < 5
                bound = (set(jaccard_join.size_classes(len(x), len(x) * 5 // 4)) & set(jaccard_join.size_classes(len(y), len(y) * 5 // 4)))
                (a, need), (b, _) = (jaccard_join.group_signatures(s, min(bound), 80) for s in (x, y))
                order = {s: rng.random() for s in np.union1d(a, b).tolist()}  # any order that all sets share
                assert set(sorted(a.tolist(), key=order.get)[:need]) & set(sorted(b.tolist(), key=order.get)[:need])


def test_common_tokens_and_joining_edges():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(70)]
    left, right = np.arange(0, 50), np.arange(30, 70)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    for often in (2, 8, 100):
        assert (jaccard_join.common_tokens(sets, left, right, often, 16) == want).all()
    x, y = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
    few = jaccard_join.joining(x, y)
    groups = lambda a, b: {frozenset(k for k in range(40) if roots[k] == r) for r in set(roots)} if (roots := _roots(a, b)) else set()
    assert groups(x[few], y[few]) == groups(x, y) and len(few) <= 80


def _roots(a, b):
    root = list(range(40))
    for _ in range(40):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components_of_paths_hubs_and_nothing(spark, monkeypatch, most):
    told = jaccard_join._told
    monkeypatch.setattr(jaccard_join, "_told", lambda edges, facts, key: told(edges, facts, key, most))  # salted, and broadcast
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(200, 201), (201, 203), (200, 203), (202, 203)]
    got = dict(jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 180)}, 201: 200, 202: 200, 203: 200}
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_bucket_is_finished_by_tiles(spark):
    """A chain of sets through one bucket: neighbours link, the ends do not."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[i // 2: i // 2 + 120])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, least=1).collect()}
    assert set(got.values()) == {0}


def met_pairs(rows):
    """Pairs of entities that meet, by the tiles of both sides."""
    at = {}
    for r in rows:
        at.setdefault((r.fam, r.t1, r.t2), {}).setdefault(r.side, []).append(r.ent)
    out = []
    for sides in at.values():
        both = sides.get(-1, [])
        out += [(min(a, b), max(a, b)) for k, a in enumerate(both) for b in both[k + 1:]]
        out += [(min(a, b), max(a, b)) for a in sides.get(0, []) for b in sides.get(1, [])]
    return out


@pytest.mark.parametrize("ta, tb", [(1, 1), (2, 1), (1, 4), (3, 5), (7, 3), (5, 6), (20, 2)])
def test_tiles_meet_once(spark, ta, tb):
    rows = [(i, 1, -1 - i % ta, ta, tb) for i in range(2 * ta)] + [(1000 + i, 1, i % tb, ta, tb) for i in range(3 * tb)]
    placed = spark.createDataFrame(rows, "ent long, fam long, own int, ta int, tb int")
    found = [p for first in range(0, tb, 2) for p in met_pairs(jaccard_join._tile_pairs(placed, first, first + 2).collect())]
    main, others = [r[0] for r in rows if r[2] < 0], [r[0] for r in rows if r[2] >= 0]
    want = {(a, b) for a in main for b in others} | {(a, b) for a in others for b in others if a < b}
    assert len(found) == len(set(found)) and set(found) == want


def test_rows_of_a_step_grow_with_the_family(spark):
    """30,000 and 60,000 unlinked members: a step's rows double."""
    made = []
    for n in (30_000, 60_000):
        ids = spark.range(n).select(F.col("id").alias("b"), F.lit(-1).cast("long").alias("a")).select("a", "b")
        sizes = spark.range(-1, n).select(F.col("id").alias("ent"), F.lit(100).alias("n"))
        none = spark.createDataFrame([], "node long, comp long")
        placed = jaccard_join._family_tiles(ids, sizes, none)
        assert placed.count() == n + 1
        made.append(jaccard_join._tile_pairs(placed, 0, jaccard_join.ROUNDS).count())
    assert made[0] <= 17 * 30_000 and made[1] <= 2.2 * made[0]
    long = jaccard_join._family_tiles(ids, sizes.withColumn("n", F.lit(20_000)), none)
    assert jaccard_join._tile_pairs(long, 0, jaccard_join.ROUNDS).count() <= 17 * 60_000


def test_families_over_many_tiles(spark, monkeypatch):
    """Texts of one passage with ends of their own, some of which link: more tiles than rounds at a time."""
    whole = jaccard_join._family_tiles
    steps, pairs = [], jaccard_join._tile_pairs
    monkeypatch.setattr(jaccard_join, "_family_tiles", lambda *a: whole(*a, most=4))
    monkeypatch.setattr(jaccard_join, "_tile_pairs", lambda *a: steps.append(a[1:]) or pairs(*a))
    monkeypatch.setattr(jaccard_join, "ROUNDS", 2)
    passage = " ".join(f"p{k}" for k in range(60))
    own = [[f"o{i // 2}x{k}" for k in range(24)] for i in range(60)]
    rows = [(i, f"{passage} {' '.join(w[:23] + [f'e{i}'])}") for i, w in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, least=1, bucket=2).collect()}
    assert got == {i: i // 2 * 2 for i in range(60)} and len(steps) > 2


def shuffled_bytes(spark):
    """All that the local executor has written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_sets_of_others_stay_where_a_family_is_compared(spark):
    """Long texts in links of two and a family of short ones: the long sets are shuffled to be fetched and
    verified, not in each step that compares the family again."""
    rng = random.Random(4)
    rows = []
    for i in range(100):
        words = [f"l{rng.randrange(10**9)}" for _ in range(1000)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:990]))]
    passage = " ".join(f"p{k}" for k in range(60))
    own = [[f"o{i // 2}x{k}" for k in range(24)] for i in range(60)]
    rows += [(1000 + i, f"{passage} {' '.join(w[:23] + [f'e{i}'])}") for i, w in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    df.count()
    before = shuffled_bytes(spark)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, least=64, bucket=2).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}
    ratio = (shuffled_bytes(spark) - before) / (200 * 990 * 8)
    assert 2 < ratio < 6.5, ratio


def test_a_set_goes_to_a_block_once(spark):
    """120 sets in all their 7,140 pairs: rows with tokens are few for each set, and links are those of brute force."""
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 62, 40).astype(np.uint64))
    sets = [np.unique(np.append(base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 62, 2).astype(np.uint64))) for _ in range(120)]
    names = rng.integers(-(1 << 62), 1 << 62, 120).tolist()
    held = spark.createDataFrame([(e, bytearray(s.tobytes())) for e, s in zip(names, sets, strict=True)], "ent long, tokens binary")
    every = [(min(names[i], names[j]), max(names[i], names[j])) for i in range(120) for j in range(i)]
    of = dict(zip(names, sets, strict=True))
    want = {(a, b) for a, b in every if 100 * (n := len(np.intersect1d(of[a], of[b]))) >= 80 * (len(of[a]) + len(of[b]) - n)}
    pairs = spark.createDataFrame(every, "a long, b long")
    for most, tokens in ((1 << 16, 1 << 21), (1000, 1 << 21), (1 << 16, 1000)):
        found = jaccard_join._linked_in_blocks(pairs, held, 80, most, tokens).collect()
        assert len(found) == len(want) and set(map(tuple, found)) == want
    assert 0 < len(want) < len(every) and jaccard_join._blocks(pairs, held, 4)[1].count() <= 4 * 120


def test_bitmaps_and_token_bits_grow_with_the_corpus(spark):
    ids = spark.range(0, 30_000_000, 1000).select(F.xxhash64("id").alias("k"))
    bitmap = jaccard_join.bitmap_of(ids, "k", 30_000)
    assert jaccard_join.in_bitmap(bitmap, np.array([r.k for r in ids.collect()])).all()
    others = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 100_000)
    assert jaccard_join.in_bitmap(bitmap, others).mean() < 0.01
    assert [jaccard_join.slots_for(n) for n in (0, 1, 8192, 1_000_000, 10**9)] == [1 << 20, 1 << 20, 1 << 21, 1 << 27, 1 << 27]
    for bits in range(0, 42):
        ranges, low = jaccard_join.token_bits(1 << bits)
        assert (1 << bits) >> ranges <= 1 << 20 and 24 <= low <= 32 and low >= jaccard_join.SEEN_BITS - ranges
        assert bits > 40 or (1 << bits) / (1 << (ranges + low)) <= 1 / 128


def test_limit_of_frequent_tokens_is_told_from_their_counts(spark):
    """A large corpus does not raise the limit while few tokens are above it: tokens in as many documents as
    a bucket has room for, and more, would be indexed alone. More of them than `most` raise it."""
    rows = [(i, " ".join([f"o{i}", *(f"t{k}" for k in range(6) if i < 10 * (k + 1))])) for i in range(60)]
    df = spark.createDataFrame(rows, "_id long, text string").select("_id", F.col("text").cast("binary").alias("_text"), F.lit(0).alias("_slot"), F.lit(1).alias("_width"))
    total = 1 << 30
    classes = jaccard_join.count_tokens(df, total, 8)
    assert classes.least == 8 and len(classes.often) == 6
    few = jaccard_join.count_tokens(df, total, 8, most=2)
    assert 40 <= few.least < 50 and len(few.often) == 2 and set(few.often) <= set(classes.often)
    none = jaccard_join.count_tokens(df.limit(0), 0, 8)
    assert none.least == 8 and not len(none.often)


def test_group_signatures_of_one_set_are_not_rows(spark):
    """300 sets that share a tenth and two that link: rows are few for each set, and the two still meet."""
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    passage, two = draw(30), draw(270)
    sets = [np.unique(np.concatenate([passage, draw(270)])) for _ in range(300)] + [np.unique(np.concatenate([passage, two[k: 268 + k]])) for k in range(2)]
    held = jaccard_join.stage(spark.createDataFrame([(i, bytearray(h.tobytes())) for i, h in enumerate(sets)], "ent long, tokens binary"), "sets")
    every = sum(len(x[0]) for x in jaccard_join._deep_of(held.toArrow().to_batches(), 80))
    deep = jaccard_join._deep_signatures(held, 80)
    assert every > 300 * 200 and deep.count() < every / 20
    met = jaccard_join._rarest(deep).groupBy("sig").agg(F.collect_set("ent").alias("e"), F.max(F.col("ent")).alias("top")).filter("top >= 300")
    assert [300, 301] in [sorted(r.e) for r in met.collect()]


def test_jaccard_edge_cases(docs, no_docs):
    rows = jaccard_join.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id in (1, 2, 3)} == {(1, 2, 1), (2, 2, 1), (3, 0, 3)}
    assert jaccard_join.jaccard_components(no_docs).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]


def test_pipeline_does_not_compare_documents_of_a_passage_in_a_large_corpus(spark, monkeypatch):
    """70 unlike documents with one passage, counted as part of 2^30 tokens: they do not fill large
    buckets, so nothing is indexed again; two that link are one."""
    import corpus_pipeline

    labels, counted, staged = [], jaccard_join.count_tokens, jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "count_tokens", lambda slim, total, least: counted(slim, 1 << 30, least))
    monkeypatch.setattr(jaccard_join, "stage", lambda df, label: labels.append(label) or staged(df, label))
    passage = " ".join(f"p{k}" for k in range(16))
    rows = [(i, f"{' '.join(f'd{i}x{k}' for k in range(90))} {passage}") for i in range(70)]
    df = spark.createDataFrame([*rows, (70, rows[0][1] + " more")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == list(range(70))
    assert "links" in labels and "rarest" not in labels


def test_pipeline_keeps_unlike_texts_under_one_id(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{w}{k}" for k in range(30)) for w in "abcd")
    rows = [(None, a), (None, b), (None, b), (None, None), (3, a), (5, c), (5, d), (5, d), (6, c + " more"), (7, ""), (7, "")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    order = lambda found: sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    exact = corpus_pipeline.exact_duplicates(spark, df, "")
    assert order(exact) == sorted([(None, b), (3, a), (5, c), (5, d), (6, c + " more"), (7, "")], key=str)
    near = corpus_pipeline.near_duplicates(spark, df, "")
    assert order(near) == sorted([(None, b), (None, None), (3, a), (5, c), (5, d), (7, "")], key=str)
    assert near.columns == exact.columns == df.columns


def test_pipeline_stages_on_edge_cases(spark, docs, no_docs):
    """Clashing columns, nulls, repeats, empty and long texts, and an empty table go through each stage."""
    import corpus_pipeline

    many = docs
    for name in ("_k", "_kid", "_dsha", "_hits", "_hits0", "row", "key", "k1", "id", "_hash"):
        many = many.withColumn(name, F.lit(name))
    items = spark.createDataFrame([("a", "alpha beta gamma")], "item_id string, text string")
    for df in (many, many.limit(0)):
        exact, near = exact_dedup.keep_first(df), jaccard_join.keep_one(df)
        clean = decontaminate.remove_contaminated(df, items)
        for out in (exact, near, clean):
            assert out.columns == df.columns
            assert all(r["_k"] == "_k" and r["_hits"] == "_hits" and r["row"] == "row" for r in out.collect())
    assert clean.count() == 0 and decontaminate.remove_contaminated(many, items).count() == many.count()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: items)
        for df in (docs, no_docs):
            for name, step in corpus_pipeline.STAGES[1:]:
                out = step(spark, df, "")
                assert out.count() <= df.count() and (name == "sentencepiece" or out.columns == df.columns)


def test_repeated_rows_are_one_a_task_before_the_shuffle(spark):
    """40,000 rows of one document without an id: no more than one a task is shuffled with its text."""
    rows = spark.range(0, 40_000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words again and again").alias("text"), F.lit("x").alias("k1"))
    others = spark.createDataFrame([(1, "another text", "y"), (1, "another text", "y")], "doc_id long, text string, k1 string")
    for keep in (exact_dedup.keep_first, jaccard_join.keep_one):
        left = keep(rows.unionByName(others))
        assert sorted(map(tuple, left.collect()), key=str) == [(1, "another text", "y"), (None, "the same words again and again", "x")]
        plan = left._jdf.queryExecution().executedPlan().toString()
        texts = plan[plan.index("SortMergeJoin"):]
        assert "partial_first(row" in texts and texts.index("first(row") < texts.index("partial_first(row")
