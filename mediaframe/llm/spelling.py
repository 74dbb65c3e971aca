"""Spelling variants: words one edit apart, by an index of variable-length grams.

A word is cut into grams twice, from its start and from its end. A gram grows while it is in a
dictionary of frequent grams, so the cut at a place depends only on what comes before it (or after
it, from the end). An edit at place i leaves all grams of the start that end by i, and all grams of
the end that begin after i, as they are: these are what the affected-gram bound of the word at i
leaves. Two words one edit apart at i agree in all of them, so the lists of these grams are merged
under one key, and a word has as many keys as it has different sets of untouched grams (some six),
not one a letter. Lists of a key are then verified letter by letter. A key with more words than a
list may have is told apart by its single letters, after which no list is longer than the alphabet.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

CHUNK = 8 << 20  # bytes of text that are taken apart at a time
LIST = 64  # the most words that one key's list may hold before its letters tell it apart


# --- words and their counts

def _zero_tables(most: int = 64) -> np.ndarray:
    """CRC-32 of a text is that of its head, moved on by the length of its tail, plus that of the tail.
    Row n moves a value on by n zero bytes, as four tables for its four bytes."""
    one = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(256):
            v = b << (8 * k)
            for _ in range(8):
                v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
            one[k, b] = v
    step = lambda v: one[0][v & 255] ^ one[1][v >> 8 & 255] ^ one[2][v >> 16 & 255] ^ one[3][v >> 24]
    out = [np.array([[b << (8 * k) for b in range(256)] for k in range(4)], np.uint32)]
    for _ in range(most):
        out.append(step(out[-1]))
    return np.stack(out)


_tables: list[np.ndarray] = []


def _crc_of_pairs(heads: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of head + tail from those of both, for tails of up to 64 bytes."""
    if not _tables:
        _tables.append(_zero_tables())
    t, h = _tables[0], heads.astype(np.uint32)
    moved = t[sizes, 0, h & 255] ^ t[sizes, 1, h >> 8 & 255] ^ t[sizes, 2, h >> 16 & 255] ^ t[sizes, 3, h >> 24]
    return moved ^ tails


def _count_words(batches: Iterator[pa.RecordBatch], least: int, modulus: int) -> Iterator[pa.RecordBatch]:
    def chunks() -> Iterator[tuple[pa.Array, pa.Array]]:
        for b in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), np.int64)
            at = 0
            while at < len(sizes):
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, "right")))
                yield b.column(0).slice(at, n), b.column(1).slice(at, n)
                at += n

    for ids, texts in chunks():
        texts = pc.ascii_lower(pc.fill_null(texts, ""))
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, "[^a-zÀ-ÿ]+", " "))
        runs, owner = lists.flatten(), pc.list_parent_indices(lists)
        keep = pc.greater_equal(pc.utf8_length(runs), least)
        runs, owner = runs.filter(keep), np.asarray(owner.filter(keep))
        if not len(runs):
            continue
        coded = runs.dictionary_encode()
        codes, words = np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()
        raw = [w.encode() for w in words]
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
        sizes = np.array([len(r) for r in raw], np.int64)[codes]
        tails = np.array([zlib.crc32(r) for r in raw], np.uint32)[codes]
        short = sizes <= 64
        h = np.zeros(len(codes), np.uint32)
        h[short] = _crc_of_pairs(heads[owner[short]], tails[short], sizes[short])
        for k in np.flatnonzero(~short):
            h[k] = zlib.crc32(raw[codes[k]], int(heads[owner[k]]))
        cut = h % np.uint32(modulus) == 0 if modulus else np.zeros(len(h), bool)
        counts = np.bincount(codes[~cut], minlength=len(words))
        found = Counter({w: int(n) for w, n in zip(words, counts, strict=True) if n})
        for c, x in zip(codes[cut].tolist(), h[cut].tolist(), strict=True):
            w = words[c]
            if len(w) > least:
                found[w[:x % len(w)] + w[x % len(w) + 1:]] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, modulus: int = 31) -> DataFrame:
    """word, n: the runs of letters A-Z, a-z and U+00C0 to U+00FF of all whole texts, A-Z in lower case,
    with at least `least_length` letters and `least_count` occurrences. Where modulus divides the CRC-32
    of '<id>:<run>', the letter at CRC modulo length is left out (0: never; a null id counts as empty).
    Null and empty texts have no words; other columns of docs are not looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_words(batches, least_length, modulus)

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


# --- grams

def gram_dictionary(words: DataFrame, rarity: int = 4096, most: int = 4) -> set[str]:
    """The grams of 2 to most - 1 letters in more than one of `rarity` words. They are pruned from the
    ends of grams: a gram grows on over them. At most 2 * length * rarity of them can be."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                seen.update({w[i:i + q] for q in range(2, most) for i in range(len(w) - q + 1)})
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_pydict({"gram": list(seen), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_pydict({"gram": list(seen), "n": list(seen.values())})

    total = words.count()
    grams = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram for r in grams.filter(F.col("n") * F.lit(rarity) > F.lit(total)).select("gram").collect()}


def cuts(word: str, frequent: set[str], most: int = 4) -> list[int]:
    """Where grams end, from the start: a gram has two letters at least (a quarter of what is before it,
    in long words) and grows up to `most` while it is frequent. A cut depends on letters before it only."""
    ends, p = [0], 0
    while p < len(word):
        q = max(2, p // 4)
        while q < most and word[p:p + q] in frequent:
            q += 1
        p += q
        if p <= len(word):
            ends.append(p)
    return ends


def _below(ends: list[int], n: int) -> list[int]:
    """For each i up to n the largest end that is not above i."""
    out, k = [], 0
    for i in range(n + 1):
        while k + 1 < len(ends) and ends[k + 1] <= i:
            k += 1
        out.append(ends[k])
    return out


def affected(word: str, frequent: set[str], back: set[str], most: int = 4) -> list[tuple[int, int, int, int, int, int]]:
    """The sets of grams that an edit can leave untouched: (start, end, a, b, c, d), the grams of the
    start up to `start` and those of the end from `end` on, for an edit of the letters a to b - 1 and
    for an insertion before the letters c to d - 1. back: the dictionary with its grams reversed."""
    n = len(word)
    left = _below(cuts(word, frequent, most), n)
    right = [n - x for x in _below(cuts(word[::-1], back, most), n)][::-1]
    found: dict[tuple[int, int], list[int]] = {}
    for i in range(n + 1):
        if i < n:
            e = found.setdefault((left[i], right[i + 1]), [i, i, 0, 0])
            if e[0] == e[1]:
                e[0] = i
            e[1] = i + 1
        e = found.setdefault((left[i], right[i]), [0, 0, i, i])
        if e[2] == e[3]:
            e[2] = i
        e[3] = i + 1
    return [(s, t, *e) for (s, t), e in found.items()]


ENTRY = pa.schema([("head", pa.string()), ("tail", pa.string()), ("word", pa.string()), ("n", pa.int64()), *((x, pa.int32()) for x in "abcd")])


def _entries(words: DataFrame, frequent: set[str], most: int) -> DataFrame:
    told = words.sparkSession.sparkContext.broadcast((frequent, {g[::-1] for g in frequent}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, len(batch), 4096):
                rows = []
                for w, n in zip(batch.column(0).slice(part, 4096).to_pylist(), batch.column(1).slice(part, 4096).to_pylist(), strict=True):
                    rows += [(w[:s], w[t:], w, n, *e) for s, t, *e in affected(w, *told.value, most)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ENTRY, strict=True)], schema=ENTRY)

    made = words.select("word", "n").mapInArrow(run, "head string, tail string, word string, n long, a int, b int, c int, d int")
    return made.select(F.xxhash64("head", F.length("head"), "tail").alias("key"), "word", "n", *"abcd")


def _letters(entries: DataFrame) -> DataFrame:
    """One entry for each single letter that an entry covers; the key is the word without it."""
    edits = entries.filter("b > a").select("word", "n", F.explode(F.sequence("a", F.col("b") - 1)).alias("a")).select(
        F.xxhash64("a", F.concat(F.expr("substring(word, 1, a)"), F.expr("substring(word, a + 2)"))).alias("key"), "word", "n", "a", (F.col("a") + 1).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"))
    gaps = entries.filter("d > c").select("word", "n", F.explode(F.sequence("c", F.col("d") - 1)).alias("c")).select(
        F.xxhash64("c", "word").alias("key"), "word", "n", F.lit(0).alias("a"), F.lit(0).alias("b"), "c", (F.col("c") + 1).alias("d"))
    return edits.unionByName(gaps)


# --- lists

def common_start(x: str, y: str) -> int:
    """How many letters x and y begin with in common."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def merge_list(members: list[dict]) -> Iterator[tuple[str, str, int]]:
    """word, other, n of other for the pairs of one list that are one edit apart at a place which the
    list is for. The place is the end of what both begin with, so a pair comes from one list only."""
    by_size: dict[int, list[dict]] = {}
    for m in members:
        by_size.setdefault(len(m["word"]), []).append(m)
    for size, group in by_size.items():
        for k, x in enumerate(group):
            w = x["word"]
            if x["a"] == x["b"]:
                continue
            for y in group[k + 1:]:
                i = common_start(w, y["word"])
                if x["a"] <= i < x["b"] and y["a"] <= i < y["b"] and w[i + 1:] == y["word"][i + 1:]:
                    yield w, y["word"], y["n"]
                    yield y["word"], w, x["n"]
            for y in by_size.get(size - 1, ()):
                i = common_start(w, y["word"])
                if x["a"] <= i < x["b"] and y["c"] <= i < y["d"] and w[i + 1:] == y["word"][i:]:
                    yield w, y["word"], y["n"]
                    yield y["word"], w, x["n"]


NEAR = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


def _verified(entries: DataFrame) -> DataFrame:
    """Near words from entries of which no key has more than LIST (or an alphabet) of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, len(b), 1024):
                rows = [r for members in b.column(0).slice(part, 1024).to_pylist() for r in merge_list(members)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NEAR, strict=True)], schema=NEAR)

    lists = entries.groupBy("key").agg(F.collect_list(F.struct("word", "n", *"abcd")).alias("members")).filter(F.size("members") > 1)
    return lists.select("members").mapInArrow(run, "word string, other string, other_n long")


def near_words(words: DataFrame, rarity: int = 4096, most: int = 4, longest_list: int = LIST) -> DataFrame:
    """word, other, other_n: each pair of different words (column word, with n) that one inserted, deleted
    or replaced code point tells apart, in both directions, once. Words must not repeat."""
    frequent = gram_dictionary(words, rarity, most)
    entries = stage(_entries(words, frequent, most), "grams")
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    full = stage(counts.filter(F.col("size") > longest_list).select("key"), "full-keys").hint("merge")
    short = entries.join(full, "key", "left_anti")
    return stage(_verified(short).unionByName(_verified(_letters(entries.join(full, "key", "left_semi")))), "near")


def follow(forms: DataFrame) -> DataFrame:
    """word, root from word, form: the end of the chain of forms from each word, by doubling. Each form must
    be more frequent than its word, so chains end; rounds are the logarithm of the longest chain."""
    chains = stage(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        on = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chains = stage(chains.select("word", "root").join(on.hint("merge"), "root", "left")
                       .select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "chains")
        if not chains.filter("moved").limit(1).count():
            return chains.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2,
             ratio: int = 10, modulus: int = 31, longest_list: int = LIST) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of the texts (`count_words`).

    A word's form is the near word with the largest n (ties: the first in code-point order) if that n is
    `ratio` times its own or more, else null; root is the end of the chain of forms, the word itself if
    it has none. Null and empty texts, repeated rows (their words count again), null ids (as empty ids)
    and other columns of docs are ordinary; an empty table has no words. Words of any length are whole:
    grams grow with the distance from the end, so a word has keys by the logarithm of its length.
    """
    words = stage(count_words(docs, id_col, text_col, least_length, least_count, modulus), "words")
    near = near_words(words, longest_list=longest_list)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    told = words.join(best.hint("merge"), "word", "left")
    form_n = -F.col("best.less")
    has = F.coalesce(form_n >= F.lit(ratio) * F.col("n"), F.lit(False))
    told = stage(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, form_n).alias("form_n")), "forms")
    roots = follow(told.filter("form is not null"))
    return told.join(roots.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

