"""Registered queries and the pipeline on the smallest tables, against plain versions."""

import hashlib
import html
import re
import zlib

import pytest

from mediaframe.llm import decontaminate, langid, piece_transducer, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_secret_spans(spark, texts):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rows = queries.op3_credential_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 24]
        base = [s for _, _, s in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))


def test_main_text_of_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_html_main(spark, SF).collect():
        page = pages[r.page_id]
        inside = page[page.index("<article>"): page.index("</article>")]
        parts = re.split(r"<[^>]*>", re.sub(r"</?b>", "", inside).replace("<br>", " "))
        want = " ".join(x for x in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts) if x)
        assert r.text == want and r.n_chars == len(want)


def components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
        sets[i] = frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    low, at = {i: i for i in sets}, {}
    for i, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(i)
    links = {(a, b) for ids in at.values() for a in ids for b in ids if a < b}
    links = {(a, b) for a, b in links if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return {i: (len(sets[i]), low[i]) for i in sets}


def test_near_duplicates(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_jaccard_join(spark, SF).collect()}
    assert got == components(texts)


def test_folds(spark, texts):
    for name, n, part in (("op4_langid", 4, 2), ("op5_toxicity", 3, 1), ("op9_quality", 4, 2)):
        rows = queries.QUERIES[name](spark, SF).collect()
        assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % n == part for i in texts}
        assert all(0 <= r.score <= 1 for r in rows)


def test_pieces(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.MODEL)
    for r in queries.op7_sentencepiece(spark, SF).collect():
        assert r.ids == model.encode(texts[r.doc_id]) and r.round_trip


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    known = model.classify(list(rows.values())).rejected
    rows = {i: t for (i, t), gone in zip(rows.items(), known, strict=True) if not gone}
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for i, t in rows.items() if last[t] == i}
    rows = {i: rows[i] for i, (_, low) in components(rows).items() if low == i}
    items = [decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k: k + 13]) for w in items for k in range(max(1, len(w) - 12))}
    kept = {}
    for i, t in rows.items():
        w = decontaminate.words_of(t.encode())
        hit = {p for size in {len(g) for g in grams} for k in range(len(w) - size + 1) if tuple(w[k: k + size]) in grams for p in range(k, k + size)}
        if not (hit and 20 * len(hit) >= len(w)):
            kept[i] = t
    pieces = piece_transducer.PieceTransducer(*piece_transducer.read_pieces())
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: pieces.encode(t) for i, t in kept.items()}
