"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, OTHER = 1, 2  # codes of the alphabet; letters seen in training come after them
BITS = 16  # of a letter's code; four letters are one key
MIX = np.uint64(0x9E3779B97F4A7C15)
_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter, or 0 for all that is no letter."""
    if not _fold:
        t = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                t[cp] = ord(low) if len(low) == 1 else cp
        _fold.append(t)
    return _fold[0]


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters with runs of all else as one 0, each text between zeros; the text that
    each place belongs to; letters by text."""
    joined = "\x00".join(["", *(t or "" for t in texts), ""])
    cps = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths)])[: len(cps)]
    letters = fold_table()[cps]
    keep = (letters > 0) | (np.concatenate([[1], letters[:-1]]) > 0)
    letters, owner = letters[keep], owner[keep]
    return letters, owner, np.bincount(owner[letters > 0], minlength=len(texts))


def _keys(codes: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams that end at each place; places before the n-th hold spaces in front."""
    key = np.zeros(len(codes), np.uint64)
    for back in range(order - 1, -1, -1):
        part = codes if not back else np.concatenate([np.full(min(back, len(codes)), SPACE, codes.dtype), codes[:-back]])
        key = (key << np.uint64(BITS)) | part[: len(codes)].astype(np.uint64)
    return key


class SortedHashes:
    """Rows found by key: hashes in order, with the first place of each range of their top bits."""

    def __init__(self, keys: np.ndarray):
        h = keys * MIX
        self.order = np.argsort(h, kind="stable")
        self.h = h[self.order]
        self.bits = max(1, int(np.ceil(np.log2(2 * max(1, len(h))))))
        slots = (self.h >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index into the sorted rows, or -1."""
        h = keys * MIX
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -1, np.int32)
        todo = np.flatnonzero(at < end)
        for step in range(self.most):
            place = at[todo] + step
            hit = self.h[place] == h[todo]
            out[todo[hit]] = place[hit]
            todo = todo[~hit]
            todo = todo[at[todo] + step + 1 < end[todo]]
            if not len(todo):
                break
        return out


@dataclass
class LanguageModel:
    langs: list[str]
    alphabet: np.ndarray  # code point -> code
    tables: list[SortedHashes]  # for orders 1..n, over the n-grams of all languages
    logp: list[np.ndarray]  # rows of log10 probability, one column for each language
    backoff: list[np.ndarray]  # the same rows as contexts
    unseen: np.ndarray  # log10 probability of an unknown letter
    scale: float = 1.0
    reject_above: float = np.inf

    def codes(self, letters: np.ndarray) -> np.ndarray:
        return self.alphabet[letters]

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a letter (texts x languages), and letters by text."""
        letters, owner, n = letters_of(texts)
        codes, top = self.codes(letters), len(self.tables)
        logp = np.empty((len(codes), len(self.langs)), np.float32)
        todo, carry = np.arange(len(codes)), np.zeros((len(codes), len(self.langs)), np.float32)
        for k in range(top, 0, -1):
            keys = _keys(codes, k)[todo]
            at = self.tables[k - 1].find(keys)
            hit = at >= 0
            logp[todo[hit]] = carry[hit] + self.logp[k - 1][at[hit]]
            miss = ~hit
            todo, carry = todo[miss], carry[miss]
            if not len(todo):
                break
            if k > 1:  # the context is the n-gram of the order below that ends one place earlier
                c = self.tables[k - 2].find(keys[miss] >> np.uint64(BITS))
                carry[c >= 0] += self.backoff[k - 2][c[c >= 0]]
        if len(todo):
            logp[todo] = carry + self.unseen
        # Spaces count where they end a word.
        use = np.arange(len(codes)) > 0
        total = np.stack([np.bincount(owner[use], logp[use, j], len(texts)) for j in range(len(self.langs))], 1)
        places = np.maximum(1, np.bincount(owner[use], minlength=len(texts)))
        return -total / places[:, None] / np.log10(2), n

    def classify(self, texts: list[str | None]) -> pd.DataFrame:
        h, n = self.entropy(texts)
        # Evidence grows with the length, but letters are not independent: scale is fitted.
        weight = self.scale * np.sqrt(np.maximum(n, 1))[:, None]
        z = np.exp(-(h - h.min(1, keepdims=True)) * weight)
        best = h.argmin(1)
        score = np.where(n > 0, (z / z.sum(1, keepdims=True)).max(1), 0.0)
        lang = np.where(n > 0, np.array(self.langs, object)[best], "und")
        return pd.DataFrame({"lang_pred": lang, "score": score, "bits": np.where(n > 0, h.min(1), np.nan),
                             "rejected": (n == 0) | (h.min(1) > self.reject_above)})


def train(samples: pd.DataFrame, order: int = 4, discount: float = 0.75) -> LanguageModel:
    """samples: text, lang; order is 4 at most. One interpolated Kneser-Ney model for each language: highest order by
    counts, lower orders by the number of distinct letters in front; absolute discounting. All
    n-grams share one table for each order, and a row holds what each language makes of them. Every
    letter of the samples has its own code (65,533 at most; the rarest beyond that, and letters that
    come later, count as one unknown letter)."""
    langs = sorted(samples.lang.unique())
    texts = {l: samples.text[samples.lang == l].tolist() for l in langs}
    runs = {l: letters_of(t)[0] for l, t in texts.items()}
    seen, counts = np.unique(np.concatenate(list(runs.values())), return_counts=True)
    best = seen[np.argsort(-counts, kind="stable")]
    best = best[best > 0][: (1 << BITS) - 3]
    alphabet = np.full(0x110000, OTHER, np.uint16)
    alphabet[0] = SPACE
    alphabet[best] = np.arange(len(best)) + OTHER + 1
    size = len(best) + 2
    codes = {l: alphabet[r] for l, r in runs.items()}
    grams = [{l: np.unique(_keys(c, k), return_counts=True) for l, c in codes.items()} for k in range(1, order + 1)]
    union = [np.unique(np.concatenate([g[l][0] for l in langs])) for g in grams]
    tables = [SortedHashes(u) for u in union]
    union = [u[t.order] for u, t in zip(union, tables, strict=True)]
    logp, backoff, unseen = [], [], np.empty(len(langs))
    low = np.uint64(BITS)
    for k in range(1, order + 1):
        mask = (np.uint64(1) << np.uint64(BITS * (k - 1))) - np.uint64(1)
        body = union[k - 1]
        p = np.empty((len(body), len(langs)))
        gamma = np.ones((len(union[k - 2]) if k > 1 else 0, len(langs)))
        for j, l in enumerate(langs):
            n = np.zeros(len(body))
            if k == order:
                keys, c = grams[k - 1][l]
                n[tables[k - 1].find(keys)] = c
            else:  # distinct letters in front of the n-gram
                inner, c = np.unique(grams[k][l][0] & ((np.uint64(1) << np.uint64(BITS * k)) - np.uint64(1)), return_counts=True)
                n[tables[k - 1].find(inner)] = c
            if k == 1:
                total = max(n.sum(), 1)
                unseen[j] = discount * (n > 0).sum() / total / size if n.sum() else 1 / size  # what the discounts leave, over all codes alike
                p[:, j] = np.maximum(n - discount, 0) / total + unseen[j]
                continue
            context, lower = tables[k - 2].find(body >> low), tables[k - 2].find(body & mask)
            total = np.bincount(context, n, len(gamma))
            kinds = np.bincount(context, n > 0, len(gamma))
            gamma[:, j] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            below = 10.0 ** logp[k - 2][lower, j]
            p[:, j] = np.maximum(n - discount, 0) / np.maximum(total[context], 1) + gamma[context, j] * below
        logp.append(np.log10(p).astype(np.float32))
        if k > 1:
            backoff.append(np.log10(gamma).astype(np.float32))
    return LanguageModel(langs, alphabet, tables, logp, backoff, np.log10(unseen).astype(np.float32))


def calibrate(model: LanguageModel, held: pd.DataFrame, tail_bits: float = 1.5) -> LanguageModel:
    """The score's scale by likelihood over rows that the model has not seen; texts are rejected
    whose cross-entropy is more than tail_bits above the 99.9th percentile of these rows."""
    if len(held):
        h, n = model.entropy(held.text.tolist())
        truth = held.lang.map({l: i for i, l in enumerate(model.langs)}).to_numpy()
        ok = (n > 0) & ~pd.isna(truth)
        h, n, truth = h[ok], n[ok], truth[ok].astype(int)
        if len(h):
            def loss(s: float) -> float:
                z = -(h - h.min(1, keepdims=True)) * s * np.sqrt(n)[:, None]
                return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]))

            model.scale = min((0.05 * 1.5**i for i in range(16)), key=loss)
            model.reject_above = float(np.quantile(h.min(1), 0.999) + tail_bits)
    return model


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 600,
        max_langs: int = 200, order: int = 4) -> LanguageModel:
    """A model from a bounded sample: at most per_lang documents, whole, of each of the max_langs
    most frequent languages, chosen by a hash of id and text; a fifth of them calibrates the score.
    Rarer languages than these are not learned: a bound of the model, which is broadcast."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).alias("l")).count().orderBy(F.desc("count"), "l").limit(max_langs).collect()}
    if not sizes:
        return train(pd.DataFrame({"text": [" "], "lang": ["und"]}), order)
    share = F.create_map(*[x for l, n in sizes.items() for x in (F.lit(l), F.lit(1.3 * per_lang / n))])
    # By id and text: copies of one text must not all be picked.
    u = F.pmod(F.xxhash64(F.lit("langid"), id_col, text_col), F.lit(1 << 30)) / (1 << 30)
    picked = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), u.alias("u")).filter(F.col("lang").isin(list(sizes)) & (F.col("u") < share[F.col("lang")])).limit(3 * per_lang * len(sizes)).toPandas()
    picked = picked.sort_values(["lang", "u", "text"]).groupby("lang").head(per_lang).reset_index(drop=True)
    # Each language keeps rows to train on; one of few rows holds none back if others do.
    place = picked.groupby("lang").cumcount() % 5
    part = place == 4 if (place == 4).any() else place == 1
    return calibrate(train(picked[~part], order), picked[part])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (0 to 1), bits (cross-entropy of a letter) and rejected, one row for
    each row of docs, by the whole text.

    The language with the lowest cross-entropy wins. Null texts and texts without letters are
    `und`, score 0, rejected. The model is broadcast; its size is bounded by the sample of `fit`.
    Ids may repeat or be null; other columns are ignored; there is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in chunks(texts):
                out = shared.value.classify(part)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), *[pa.array(out[c], from_pandas=True) for c in ("lang_pred", "score", "bits", "rejected")]],
                                                 names=["_id", "lang_pred", "score", "bits", "rejected"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(slim.dtypes)["_id"]
    return slim.mapInArrow(run, f"_id {kind}, lang_pred string, score double, bits double, rejected boolean").withColumnRenamed("_id", id_col)


def chunks(texts: list[str | None], most: int = 400_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about `most` characters, so that a batch of long texts stays small in memory."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, texts[start:]


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs without the documents whose language the model rejects; columns as in docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        parts = [~shared.value.classify(part).rejected.to_numpy(bool) for _, part in chunks(texts.to_pylist())]
        return pa.array(np.concatenate(parts) if parts else [], pa.bool_())

    return docs.filter(known(F.col(text_col)))
