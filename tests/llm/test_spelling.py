"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

from mediaframe.llm import queries, spelling

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(rows, least=7, count=2, modulus=31):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % modulus else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= count}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_variants(n):
    shared, near = defaultdict(set), defaultdict(set)
    for w in n:
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            shared[x].add(w)
    for ws in shared.values():
        for a in ws:
            near[a].update(b for b in ws if one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def got(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op13_spelling_variants(spark, SF)) == plain_variants(plain_counts(rows))


def random_words(rng, letters, sizes, n):
    words = ["".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n)]
    for w in list(words):
        i = rng.randrange(len(w))
        words += [w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]]
    return words


def test_crowded_lists_and_long_words(spark):
    """Few letters, so that lists overflow and are told apart by single letters; words of 300 letters."""
    rng = random.Random(7)
    words = random_words(rng, "abé", [7, 8, 9], 150) + random_words(rng, "xyzÿ", [40, 300], 20) + ["prefixes" + a + b + "suffix" for a in "abcdefghijk" for b in "lmnopqrstuv"]
    words += [w for w in words if rng.random() < 0.1] * 20
    rows = [(i, " ".join(rng.sample(words, len(words)))) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for longest in (4, 64):
        assert got(spelling.variants(docs, longest_list=longest)) == plain_variants(plain_counts(rows))


def test_dropped_letters_and_chains(spark):
    """Every modulus that divides; forms of forms up to the last; case only for A-Z."""
    text = "keyboard " * 1000 + "keyboarx " * 60 + "keyboaxx " * 3 + "Ärzteblatt ärzteblatt ÄRZTEBLATT " * 2
    rows = [(1, text), (None, "keyboaxx keyboard"), (2, text.upper())]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    for modulus in (1, 3, 31):
        assert got(spelling.variants(docs, modulus=modulus)) == plain_variants(plain_counts(rows, modulus=modulus))
    roots = {r.word: (r.form, r.root) for r in spelling.variants(docs, modulus=10 ** 9).collect()}
    assert roots["keyboaxx"] == ("keyboarx", "keyboard") and roots["keyboard"] == (None, "keyboard")


def test_edge_rows(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(spelling.variants(docs)) == plain_variants(plain_counts(rows))
    assert got(spelling.variants(docs, least_length=2, least_count=1)) == plain_variants(plain_counts(rows, 2, 1))
    assert spelling.variants(no_docs).collect() == []


def test_chunks_are_whole(spark, monkeypatch):
    import pyarrow as pa

    rows = [(i, "größere Wörter zusammen " * (i % 5) or None) for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i, _ in rows], "text": [t for _, t in rows]})
    monkeypatch.setattr(spelling, "CHUNK", 50)
    n = Counter()
    for b in spelling._count_words(iter([batch]), 7, 31):
        for w, k in zip(*(b.column(i).to_pylist() for i in range(2))):
            n[w] += k
    assert n == plain_counts(rows, count=1)


def test_keys_grow_with_the_logarithm():
    assert len(spelling.affected("ab" * 5000, set(), set())) < 120
    w = "strasse"
    sets = spelling.affected(w, {"st"}, {"es"})
    for i in range(len(w)):
        assert sum(a <= i < b for _, _, a, b, _, _ in sets) == 1
    for i in range(len(w) + 1):
        assert sum(c <= i < d for *_, c, d in sets) == 1
