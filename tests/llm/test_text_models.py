import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediaframe.llm import langid, lattice_lm, piece_transducer, quality, toxicity

EN, DE = "the cat and the dog of that house with this thing", "der hund und die katze mit dem haus ist nicht schön"


@pytest.fixture(scope="module")
def languages():
    return langid.train(pd.DataFrame({"text": [EN, DE] * 3, "lang": ["en", "de"] * 3}))


def test_kneser_ney_sums_to_one(languages):
    for lang, history in itertools.product(range(2), ("", "the c", "und d", "q")):
        total = 0.0
        for code in np.unique(languages.alphabet):
            letter = np.array([0 if code == langid.SPACE else np.flatnonzero(languages.alphabet == code)[-1]])
            cps = np.concatenate([np.array([ord(c) if c != " " else 0 for c in history], np.int64), letter])
            codes = languages.alphabet[cps]
            carry, p = 0.0, None
            for k in range(len(languages.tables), 0, -1):
                key = langid._keys(codes, k)[-1:]
                at = languages.tables[k - 1].find(key)[0]
                if at >= 0:
                    p = carry + languages.logp[k - 1][at, lang]
                    break
                if k > 1:
                    context = langid._keys(codes[:-1], k - 1)[-1:] if len(codes) > 1 else langid._keys(np.full(1, langid.SPACE, codes.dtype), k - 1)[-1:]
                    c = languages.tables[k - 2].find(context)[0]
                    carry += languages.backoff[k - 2][c, lang] if c >= 0 else 0.0
            total += 10 ** (p if p is not None else carry + languages.unseen[lang])
        assert math.isclose(total, 1, abs_tol=1e-4)


def plain_kneser_ney(languages, texts, discount=0.75, order=4):
    """Probability of a code after a context, by counts in dictionaries."""
    codes = languages.alphabet[langid.letters_of(texts)[0]].tolist()
    padded = [langid.SPACE] * order + codes
    grams = [Counter(tuple(padded[order + i - k + 1: order + i + 1]) for i in range(len(codes))) for k in range(1, order + 1)]
    for k in range(order - 1):  # lower orders count the distinct letters in front
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    size = len(np.unique(languages.alphabet))

    def p(context, code, k):
        if not k:
            return 1 / size
        after = {g[-1]: n for g, n in grams[k - 1].items() if g[:-1] == context}
        below = p(context[1:], code, k - 1)
        if not after:
            return below
        total = sum(after.values())
        return max(after.get(code, 0) - discount, 0) / total + discount * len(after) / total * below

    return lambda context, code: p(tuple(context), code, order)


def test_entropies_equal_plain_kneser_ney(languages):
    asked = ["the dog", "der hund und the", "zzz q", "Éa", "日本"]
    got, _ = languages.entropy(asked)
    for j, lang in enumerate(languages.langs):
        p = plain_kneser_ney(languages, [{"en": EN, "de": DE}[lang]] * 3)
        letters, owner, _ = langid.letters_of(asked)
        codes = languages.alphabet[letters].tolist()
        padded = [langid.SPACE] * 3 + codes
        bits = np.array([-math.log2(p(padded[i: i + 3], codes[i])) for i in range(len(codes))])
        for k in range(len(asked)):
            mine = [b for i, b in enumerate(bits) if i and owner[i] == k]
            assert math.isclose(got[k, j], np.mean(mine), rel_tol=1e-4)


def test_every_letter_has_a_code():
    many = "".join(chr(0x4E00 + k) for k in range(3000))
    model = langid.train(pd.DataFrame({"text": [many, "abc"], "lang": ["zh", "en"]}))
    assert len(np.unique(model.alphabet)) == 3000 + 3 + 2 and model.classify([many[2000:2040]]).lang_pred[0] == "zh"


def test_language_edge_cases(docs, no_docs, languages):
    rows = {r.doc_id: r for r in langid.identify(docs, languages).collect()}
    assert rows[1].lang_pred == "en" and rows[5].lang_pred == "de"
    assert all((rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True) for i in (3, 4, 6))
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.identify(no_docs, languages).count() == 0
    assert langid.fit(no_docs).langs == ["und"]
    assert langid.keep_known(docs, languages).columns == docs.columns


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    got = langid.identify(docs, langid.fit(docs.filter(fold != 2))).join(docs.select("doc_id", "lang"), "doc_id").filter(fold == 2)
    assert got.filter("lang_pred = lang").count() >= 0.95 * got.count()


def brute_log_likelihood(lattice, word):
    pieces = {}
    names, scores, _ = piece_transducer.read_pieces()
    kept = [n.replace("▁", " ").encode() for n in names if n and "▁" not in n[1:]]
    for k, p in enumerate(kept):
        pieces[p] = lattice.logp[k]
    text = b" " + word
    total = 0.0
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        parts, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[start:i])
                start = i
        parts.append(text[start:])
        p = 1.0
        for i, x in enumerate(parts):
            ways = math.exp(pieces[x]) if x in pieces else 0.0
            if len(x) == 1 and i:
                ways += math.exp(lattice.logp[lattice.size + x[0]])
            p *= ways
        total += p
    return math.log(total) + lattice.logp[-1]


def test_lattice_sums_all_segmentations():
    lattice = lattice_lm.Lattice.load()
    words = [b"the", b"cat", b"qz", "é".encode(), b"ofthe", b"a"]
    assert np.allclose(lattice.log_likelihood(words), [brute_log_likelihood(lattice, w) for w in words])
    long = b"ab" * 120
    assert np.isclose(lattice._long(np.frombuffer(b" " + long[:40], np.uint8), None), lattice.log_likelihood([long[:40]])[0])
    counts = lattice.expected([b"the", b"cat"], np.array([1.0, 2.0]))
    assert np.isclose(counts[-1], 3) and np.isclose(counts[: lattice.size][lattice.first].sum(), 3)
    out = np.zeros(len(lattice.logp) + 1)
    lattice._long(np.frombuffer(b" cat", np.uint8), (out, 2.0))
    assert np.allclose(out[:-2], lattice.expected([b"cat"], np.array([2.0]))[:-1])


def test_log_gamma():
    x = np.array([1, 1.5, 2, 10, 1e4])
    assert np.allclose(lattice_lm.log_gamma(x), [math.lgamma(v) for v in x], atol=1e-9)


def test_scores_of_texts(docs, no_docs):
    train = F.col("doc_id") != 9
    rows = lattice_lm.score_texts(docs, train, F.col("doc_id") == 9, class_col="lang", rounds=1, block_tokens=50).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen, n, ends = {}, 0, 0
    for r in docs.collect():
        if r.doc_id is not None and r.doc_id != 9:
            for w in lattice_lm.tokens((r.text or "").encode()):
                seen[w] = seen.get(w, 0) + 1
                n += 1
            ends += 1
    kinds = len(seen) + 1
    for r in rows:
        words = lattice_lm.tokens((texts[r.doc_id] or "").encode())
        base = sum(math.log10((seen.get(w, 0) + 1) / (n + ends + kinds + 1)) for w in words) + math.log10((ends + 1) / (n + ends + kinds + 1))
        assert r.n_tokens == len(words) + 1 and r.train_tokens == n + ends and r.held_out == (r.doc_id == 9)
        assert r.n_known == sum(w in seen for w in words) + 1 and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    assert lattice_lm.score_texts(no_docs, train, ~train, rounds=1).count() == 0


def plain_score(words, q, end, spread=3000.0):
    """Words from an urn whose balls return doubled; after each the text ends or goes on."""
    p, seen = 1.0, Counter()
    for i, w in enumerate(words):
        p *= (1 - end) * (spread * q(w) + seen[w]) / (spread + i)
        seen[w] += 1
    return p * end


def test_scores_equal_a_plain_version(spark):
    lattice = lattice_lm.Lattice.load()
    train = ["the cat the dog", "the cat sat", "", "a dog a dog a dog"]
    asked = ["the the zebra", "cat", "", "a dog sat sat sat"]
    df = spark.createDataFrame(list(enumerate(train + asked)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lattice_lm.score_texts(df, F.col("doc_id") < 4, F.col("doc_id") >= 4, rounds=0).collect()}
    counts = Counter(w for t in train for w in t.split())
    n, once, twice = sum(counts.values()), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    d = min(0.95, max(0.3, once / (once + 2 * twice)))
    end = (len(train) + 0.5) / (n + len(train) + 1)
    q = lambda w: max(counts[w] - d, 0) / n + d * len(counts) / n * math.exp(lattice.log_likelihood([w.encode()])[0]) if w in counts else d * len(counts) / n * math.exp(lattice.log_likelihood([w.encode()])[0])
    for k, text in enumerate(train + asked):
        assert math.isclose(got[k], math.log10(plain_score(text.split(), q, end)), rel_tol=1e-5)


@pytest.mark.parametrize("spread", [2.0, 3000.0])
def test_all_texts_have_a_probability_of_one_at_most(spread):
    q = {"a": 0.6, "b": 0.3, "c": 0.1}.__getitem__
    total = [sum(plain_score(t, q, 0.2, spread) for t in itertools.product("abc", repeat=n)) for n in range(8)]
    assert np.allclose(total, [0.2 * 0.8**n for n in range(8)])
    lattice = lattice_lm.Lattice.load()
    short = [bytes(w) for n in (1, 2) for w in itertools.product(range(33, 127), repeat=n)]
    assert np.exp(lattice.log_likelihood(short)).sum() < 1


@pytest.fixture(scope="module")
def pieces():
    return piece_transducer.PieceTransducer(*piece_transducer.read_pieces())


def test_encoding_equals_the_library(pieces):
    import random

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.MODEL)
    rng = random.Random(4)
    cases = ["", " ", "a", " a", "a ", "Hello  world", "\n", " \n\n x", "\tx\u0000", "日本語 😀 é", "  日本", "x" * 100, "=" * 70, "▁ mark", "hahahaha" * 9]
    cases += [" " * n + "the" for n in range(70)] + [" " * n for n in range(1, 70)] + [a + " " * n + b for n in (199, 200, 201, 255, 256, 511, 512, 513, 700, 1024, 3000) for a in ("", "a") for b in ("", "x")]
    cases += ["".join(rng.choices("aehinort thes.,日é\n", k=rng.randint(1, 50))) for _ in range(1500)]
    for text in cases:
        ids = pieces.encode(text)
        assert ids == model.encode(text), text
        assert pieces.decode(ids) == text.replace("▁", " ")
    small = piece_transducer.PieceTransducer(*piece_transducer.read_pieces())
    assert all(small._finite_path("▁" + w) == small._path("▁" + w) for w in ("thehouse", "日x", "aaaa", "étrange", "xyzzy"))


def test_unigram_path_is_the_cheapest():
    t = piece_transducer.PieceTransducer(["▁", "a", "b", "ab", "▁a", *[""] * 256], [-2.0, -1.0, -1.0, -1.4, -2.5, *[0.0] * 256], list(range(5, 261)), "unigram")
    assert t.encode("ab") == [0, 3] and t.decode([0, 3]) == "ab"
    assert t.decode(t.encode("aéb")) == "aéb"


def test_tokenize_edge_cases(docs, no_docs):
    rows = piece_transducer.tokenize(docs).collect()
    assert len(rows) == docs.count() and all(r.round_trip and len(r.ids) == r.n_pieces for r in rows)
    back = piece_transducer.detokenize(piece_transducer.tokenize(docs.filter("doc_id > 4"))).collect()
    assert {r.doc_id: r.text for r in back} == {r.doc_id: r.text for r in docs.filter("doc_id > 4").collect()}
    assert piece_transducer.tokenize(no_docs).count() == 0


def test_classifiers_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for module, label, parts, part, least in ((quality, "quality", 4, 2, 0.95), (toxicity, "toxic", 3, 1, 0.9)):
        fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))
        model = module.fit(docs.filter(fold != part), labels)
        got = quality.score(docs, model).join(labels, "doc_id").filter(fold == part).toPandas()
        assert (got.predicted == got[label]).mean() >= least and got.score.between(0, 1).all()


def test_classifier_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, 1, 0), (99, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for some in (labels, labels.limit(0)):
            rows = quality.score(docs, module.fit(docs, some)).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert quality.score(no_docs, module.fit(no_docs, labels)).count() == 0


def test_training_follows_the_gradient():
    """Two steps by plain loops: averages of feature vectors, softmax, gradients by differences."""
    texts, labels, buckets, dim, rate = ["aa bb aa", "cc cc"], np.array([1, 0]), 97, 3, 0.5
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    feats = []
    for t in texts:
        words, at, sizes = quality.numbered([t])
        b, of = quality.word_features(words, buckets)
        feats.append([x for place in at for x, w in zip(b, of, strict=True) if w == place] + quality.pair_features(words, at, sizes, buckets)[0].tolist())

    def loss(v, o, c, k):
        z = np.mean([v[f] for f in feats[k]], axis=0) @ o + c
        return -(z[labels[k]] - np.log(np.exp(z).sum()))

    def slope(k, x, f):
        g = np.zeros_like(x)
        for i in np.ndindex(x.shape):
            up, down = x.copy(), x.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            g[i] = (f(up) - f(down)) / 2e-6
        return g

    for step, k in enumerate(rng.permutation(2)):
        lr = rate * (1 - step / 2)
        gv, go, gc = slope(k, vectors, lambda v: loss(v, out, bias, k)), slope(k, out, lambda o: loss(vectors, o, bias, k)), slope(k, bias, lambda c: loss(vectors, out, c, k))  # noqa: B023
        vectors, out, bias = vectors - lr * gv, out - lr * go, bias - 0.1 * lr * gc
    got = quality.train(texts, labels, buckets, dim, 2, rate)
    assert np.allclose(got.weight, vectors @ (out[:, 1] - out[:, 0]), atol=1e-6) and math.isclose(got.bias, bias[1] - bias[0], abs_tol=1e-6)


def test_posterior_of_independent_voters_is_bayes_rule():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.3
    v = np.stack([(truth & (rng.random(4000) < a)) | (~truth & (rng.random(4000) < b)) for a, b in ((0.7, 0.05), (0.5, 0.02), (0.3, 0.1))] + [np.zeros(4000)], 1).astype(np.int8)
    v[:, -1] = np.where(v[:, :3].any(1), 0, -1)
    model = toxicity.fit_label_model(v, 0.3)
    for row, p in zip(v[:50], model.posterior(v[:50]), strict=True):
        odds = model.prior / (1 - model.prior)
        for k, vote in enumerate(row):
            if vote:
                odds *= (model.p_toxic[k] / model.p_clean[k]) ** model.strength[k]
        assert math.isclose(p, odds / (1 + odds), rel_tol=1e-9)
    assert abs(model.p_toxic[0] - 0.7) < 0.12 and model.p_clean[0] < 0.1


def test_label_model_weighs_correlated_voters_less():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.3
    a, b = (truth & (rng.random(3000) < 0.6)) | (rng.random(3000) < 0.02), (truth & (rng.random(3000) < 0.6)) | (rng.random(3000) < 0.02)
    v = np.stack([a, a, a, b, np.zeros(3000)], 1).astype(np.int8)
    v[:, -1] = np.where(v.any(1), 0, -1)
    model = toxicity.fit_label_model(v, 0.3)
    assert model.strength[0] < model.strength[3]
    assert ((model.posterior(v) > 0.5) == truth).mean() > 0.85


def test_patterns_alone_are_evidence(spark, docs):
    only = ["what a l0ser he is", "such a st*pid thing", "1d10t", "drop dead now", "nobody likes you here", "you idiots", "you morons"]
    clean = ["a walk in the park", "the report is due", "we ate bread", "rain and wind"]
    texts = [f"{t} {k}" for k in range(40) for t in (*clean, "you are an idiot", "drop dead now", "what a l0ser he is")]
    fitted = toxicity.train(texts, np.array([int(t.startswith(("you", "drop", "what"))) for t in texts]))
    texts = [f"{t} {k}" for k in range(40) for t in (*clean, "an idiot wrote it")]
    unlike = toxicity.train(texts, np.array([int(t.startswith("an")) for t in texts]))
    bare = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    for model in (fitted, bare):
        assert (model.score(only) > 0.5).all() and (model.score(clean) < 0.5).all()
    assert unlike.score(only).min() > unlike.score(clean).max()


def test_calibration_does_not_switch_for_a_rare_language(spark, monkeypatch):
    common = [(i, f"{text} {i} {'abcdefghij'[i % 10] * 3}", lang) for i, (text, lang) in enumerate([(EN, "en"), (DE, "de")] * 30)]
    seen = []
    monkeypatch.setattr(langid, "calibrate", lambda model, held: seen.append((model, held)) or model)
    for rare in ([], [(100, "um gato e um cão na casa", "pt")], [(100 + i, f"um gato e um cão na casa {i}", "pt") for i in range(3)]):
        langid.fit(spark.createDataFrame(common + rare, "doc_id long, text string, lang string"))
        assert set(seen[-1][0].langs) == {r[2] for r in common + rare}
    assert all(set(held.lang) == {"en", "de"} and len(held) == 12 for _, held in seen)
    langid.fit(spark.createDataFrame(common[:4], "doc_id long, text string, lang string"))
    assert set(seen[-1][0].langs) == {"en", "de"} == set(seen[-1][1].lang) and len(seen[-1][1]) == 2
