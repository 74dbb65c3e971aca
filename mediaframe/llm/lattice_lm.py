"""Language-model scores: the marginal likelihood of a text over all its subword segmentations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .hashing import BASE, mix
from .langid import SortedHashes
from .piece_transducer import MARK, MODEL, read_pieces

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LN10 = math.log(10)
LONG = 160  # words of more bytes are handled one by one


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-case words between ASCII white space (what bytes.split splits at)."""
    return text.translate(LOWER).split() if text else []


@dataclass
class Lattice:
    """Subword pieces as byte strings, a space standing for the mark in front of a word, and the
    log probability of each. A word is a piece that starts with the mark, then any number of other
    pieces or single bytes, then a stop. First pieces sum to one; so do all that may come after."""

    keys: SortedHashes
    piece_of: np.ndarray  # sorted row -> piece
    longest: int
    first: np.ndarray  # whether a piece starts a word
    logp: np.ndarray  # pieces, then 256 bytes, then the stop

    @classmethod
    def load(cls, model: str = MODEL) -> Lattice:
        """From an existing vocabulary. Its scores give the first weights: a score of minus the
        rank, as merges have, counts as Zipf's law; pieces with log probabilities keep them."""
        names, scores, _ = read_pieces(model)
        pieces = [(n.replace(MARK, " ").encode(), s) for n, s in zip(names, scores, strict=True) if n and MARK not in n[1:]]
        if not any(p == b" " for p, _ in pieces):
            pieces.append((b" ", min(s for _, s in pieces)))
        ranked = min(s for _, s in pieces) < -100
        weight = np.array([1 / (3 - s) if ranked else math.exp(s) for _, s in pieces])
        hashes = np.array([hash_of(p) for p, _ in pieces], np.uint64)
        assert len(np.unique(hashes)) == len(hashes)
        keys = SortedHashes(hashes)
        first = np.array([p[:1] == b" " for p, _ in pieces])
        counts = np.concatenate([weight, np.full(256, weight.min()), [weight[~first].sum() / 2]])
        return cls(keys, keys.order, max(len(p) for p, _ in pieces), first, log_shares(counts, first))

    @property
    def size(self) -> int:
        return len(self.first)

    def arcs(self, words: np.ndarray) -> list[np.ndarray]:
        """words: one row of bytes for each, all of one length. For each piece length, the piece
        that starts at each place (or the index after all, which weighs nothing)."""
        h = np.zeros(words.shape, np.uint64)
        out = []
        for n in range(1, min(self.longest, words.shape[1]) + 1):
            keep = words.shape[1] - n + 1
            h = h[:, :keep] * BASE + words[:, n - 1:].astype(np.uint64) + np.uint64(1)
            at = self.keys.find(mix(h + np.uint64(n)).ravel()).reshape(h.shape)
            out.append(np.where(at >= 0, self.piece_of[at], self.size + 257).astype(np.int32))
        return out

    def forward(self, words: np.ndarray, arcs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Log probability of all ways to each place; weights of arcs; weights of single bytes."""
        padded = np.append(self.logp, -np.inf)
        weights = [padded[a] for a in arcs]
        single = self.logp[self.size + words.astype(np.int64)]
        single[:, 0] = -np.inf
        alpha = np.full((len(words), words.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for end in range(1, words.shape[1] + 1):
            total = alpha[:, end - 1] + single[:, end - 1]
            for n in range(1, min(len(arcs), end) + 1):
                total = np.logaddexp(total, alpha[:, end - n] + weights[n - 1][:, end - n])
            alpha[:, end] = total
        return alpha, weights, single

    def log_likelihood(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the marginal probability of each word."""
        out = np.empty(len(words))
        for rows, matrix in by_length(words):
            if matrix.shape[1] > LONG:
                out[rows] = [self._long(m, None) for m in matrix]
                continue
            alpha, _, _ = self.forward(matrix, self.arcs(matrix))
            out[rows] = alpha[:, -1] + self.logp[-1]
        return out

    def expected(self, words: list[bytes], weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, byte and stop over all segmentations, weighted by word."""
        out = np.zeros(len(self.logp) + 1)
        for rows, matrix in by_length(words):
            w = weight[rows]
            out[len(self.logp) - 1] += w.sum()
            if matrix.shape[1] > LONG:
                for m, x in zip(matrix, w, strict=True):
                    self._long(m, (out, x))
                continue
            arcs = self.arcs(matrix)
            alpha, weights, single = self.forward(matrix, arcs)
            size = matrix.shape[1]
            beta = np.full_like(alpha, -np.inf)
            beta[:, size] = 0
            for start in range(size - 1, -1, -1):
                total = beta[:, start + 1] + single[:, start]
                for n in range(1, min(len(arcs), size - start) + 1):
                    total = np.logaddexp(total, beta[:, start + n] + weights[n - 1][:, start])
                beta[:, start] = total
            for n, (a, s) in enumerate(zip(arcs, weights, strict=True), 1):
                g = np.exp(alpha[:, : size - n + 1] + s + beta[:, n:] - alpha[:, -1:]) * w[:, None]
                hit = g > 0
                out += np.bincount(a[hit], g[hit], len(out))
            g = np.exp(alpha[:, :-1] + single + beta[:, 1:] - alpha[:, -1:]) * w[:, None]
            out += np.bincount((self.size + matrix.astype(np.int64)).ravel(), g.ravel(), len(out))
        return out[:-1]

    def _long(self, word: np.ndarray, add: tuple[np.ndarray, float] | None) -> float:
        """The same for one long word, place by place along the arcs that exist."""
        size = len(word)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        for n, a in enumerate(self.arcs(word[None]), 1):
            for start in np.flatnonzero(a[0] < self.size).tolist():
                ends[start + n].append((start, int(a[0, start])))
        for end in range(2, size + 1):
            ends[end].append((end - 1, self.size + int(word[end - 1])))
        logp = self.logp.tolist()
        alpha = [0.0] + [-math.inf] * size
        for end in range(1, size + 1):
            found = [alpha[s] + logp[p] for s, p in ends[end]]
            top = max(found, default=-math.inf)
            alpha[end] = top + math.log(sum(math.exp(x - top) for x in found)) if top > -math.inf else top
        if add:
            out, weight = add
            share = [0.0] * size + [weight]  # probability of passing each place
            for end in range(size, 0, -1):
                for s, p in ends[end]:
                    g = share[end] * math.exp(alpha[s] + logp[p] - alpha[end]) if share[end] else 0.0
                    share[s] += g
                    out[p] += g
        return alpha[size] + logp[-1]

    def refit(self, counts: np.ndarray, smooth: float = 0.05) -> Lattice:
        return Lattice(self.keys, self.piece_of, self.longest, self.first, log_shares(counts + smooth, self.first))


def log_shares(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    start = np.concatenate([first, np.zeros(257, bool)])
    return np.log(counts / np.where(start, counts[start].sum(), counts[~start].sum()))


def hash_of(piece: bytes) -> int:
    h = np.zeros(1, np.uint64)
    for b in piece:
        h = h * BASE + np.uint64(b + 1)
    return int(mix(h + np.uint64(len(piece)))[0])


def by_length(words: list[bytes], most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words of the same length, with the mark in front, and their bytes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        size = int(sizes[group[0]]) + 1
        step = max(1, most * 8 // size)
        for k in range(0, len(group), step):
            rows = group[k: k + step]
            yield rows, np.frombuffer(b"".join(b" " + words[r] for r in rows), np.uint8).reshape(len(rows), size)


# Corpus counts, by blocks of documents.


def _blocks(max_tokens: int, classes: int, max_docs: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        docs, total, numbers = [], 0, _Numbers()
        for batch in batches:
            for i, k, h, text in zip(*(batch.column(c) for c in ("_id", "class", "held", "_text")), strict=True):
                words = tokens(text.as_py())
                docs.append((i.as_py(), k.as_py(), h.as_py(), np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                total += len(words)
                if total >= max_tokens or len(docs) >= max_docs:
                    yield from _block(part << 32 | number, docs, numbers, classes, batch.schema.field("_id").type)
                    docs, total, numbers, number = [], 0, _Numbers(), number + 1
        if docs:
            yield from _block(part << 32 | number, docs, numbers, classes, batch.schema.field("_id").type)

    return run


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _block(block: int, docs: list[tuple], numbers: dict[bytes, int], classes: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word with its training counts by class and its postings (place of
    the document times 4096 plus the count in it), and a row with the documents of the block."""
    ids, klass, held, found = zip(*docs, strict=True)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    pairs, count = np.unique(np.concatenate(found).astype(np.int64) * len(found) + np.repeat(np.arange(len(found)), sizes), return_counts=True)
    word, doc = pairs // len(found), pairs % len(found)
    of = np.array(klass)[doc]  # -1: not for training
    n = [np.bincount(word, count * (of == k), len(numbers)).astype(np.int32) for k in range(classes)]
    if count.max(initial=0) >= 4096:  # larger counts take several postings
        times = -(-count // 4095)
        at = np.repeat(np.arange(len(count)), times)
        left = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        word, doc, count = word[at], doc[at], np.minimum(4095, count[at] - 4095 * left)
    posts = (doc * 4096 + count).astype(np.int32)
    offsets = np.searchsorted(word, np.arange(len(numbers) + 1))
    names = list(numbers)
    schema = pa.schema([("block", pa.int64()), ("word", pa.binary()), *((f"n{k}", pa.int32()) for k in range(classes)), ("posts", pa.binary()), ("docs", pa.binary())])
    for a in range(0, len(names), 20_000):
        b = min(len(names), a + 20_000)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, block)), pa.array(names[a:b], pa.binary()), *(pa.array(c[a:b]) for c in n),
                                          _packed(posts[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]), pa.nulls(b - a, pa.binary())], schema=schema)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(klass, pa.int32()), pa.array(held, pa.bool_()), pa.array(sizes)], names=["ids", "class", "held", "sizes"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    last = {"block": block, "docs": sink.getvalue().to_pybytes(), **{f"n{k}": int(np.sum(np.array(klass) == k)) for k in range(classes)}}
    yield pa.RecordBatch.from_arrays([pa.array([last.get(f.name)], f.type) for f in schema], schema=schema)


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
    """Runs of 32-bit numbers as bytes. (Spark writes lists to grouped functions much more slowly.)"""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _expect(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value
        total = np.zeros(len(lattice.logp))
        for batch in batches:
            total += lattice.expected(batch.column(0).to_pylist(), np.ones(batch.num_rows))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "uses"])

    return run


def train_lattice(seen: DataFrame, lattice: Lattice, rounds: int = 3) -> Lattice:
    """Expectation maximisation over the distinct words (column 0) of the training texts. Each
    word counts once: the pieces have to explain the words that the counts do not know. A round
    returns at most a number for each piece to the driver."""
    for _ in range(rounds):
        shared = seen.sparkSession.sparkContext.broadcast(lattice)
        uses = seen.mapInArrow(_expect(shared), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        counts = np.zeros(len(lattice.logp))
        for r in uses:
            counts[r.piece] = r.uses
        if not counts.any():
            break
        lattice = lattice.refit(counts)
    return lattice


@dataclass
class Corpus:
    """Of each class: training documents, words without ends, and kinds of words: all, seen once, twice."""

    docs: np.ndarray
    words: np.ndarray
    kinds: np.ndarray
    once: np.ndarray
    twice: np.ndarray
    all_kinds: int

    @property
    def tokens(self) -> int:
        return int(self.words.sum() + self.docs.sum())

    @property
    def base(self) -> float:
        return float(self.tokens + self.all_kinds + (self.docs.sum() > 0) + 1)

    def end(self) -> float:
        return (float(self.docs.sum()) + 0.5) / (self.tokens + 1)

    def log_word(self, counts: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Natural log of a word's probability in each class; all words sum to one. The whole word is one more arc of
        the lattice where the class knows the word: its count less a discount, as a share of the
        class. What the discounts leave goes to the segmentations into pieces."""
        d = np.clip(self.once / np.maximum(1, self.once + 2 * self.twice), 0.3, 0.95)
        n = np.maximum(1, self.words)
        left = np.where(self.words > 0, d * self.kinds / n, 1.0)
        whole = np.log(np.maximum(counts - d, 1e-300) / n)
        return np.logaddexp(whole, inside[:, None] + np.log(left))


def _inside(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = shared.value.log_likelihood(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside.astype(np.float32))], names=[*batch.schema.names, "inside"])

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1, by Stirling's series eight places further on."""
    y = x + 8
    shift = np.log(x)
    for k in range(1, 8):
        shift = shift + np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_rising(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log(a (a + 1) ... (a + n - 1)), n >= 1, given a > 0."""
    out = np.log(a)
    more = np.flatnonzero(n > 1)  # most words occur once in a text
    out[more] += log_gamma(a[more] + n[more]) - log_gamma(a[more] + 1)
    return out


def _sum_block(group: pa.Table, corpus: Corpus, spread: float) -> pa.Table:
    """Scores of the documents of a block. After each word a text ends or goes on; words come from an
    urn of the class, of size `spread`, whose balls return doubled: a word that a text has used is
    likelier there from then on. All texts together have a probability of one at most."""
    packed = group["docs"].drop_null()[0].as_py()
    docs = pa.ipc.open_stream(packed).read_all().combine_chunks()
    facts = group.filter(pa.compute.is_valid(group["posts"])).combine_chunks()
    ids, sizes = docs["ids"], docs["sizes"].to_numpy()
    n, classes = len(ids), len(corpus.docs)
    known, base, score = np.zeros(n), np.zeros(n), np.zeros((n, classes))
    if facts.num_rows:
        rows = np.repeat(np.arange(facts.num_rows), pa.compute.binary_length(facts["posts"]).to_numpy() // 4)
        flat = np.frombuffer(b"".join(facts["posts"].to_pylist()), np.int32)
        doc, count = flat // 4096, flat % 4096
        counts = np.stack([facts[f"n{k}"].to_numpy().astype(float) for k in range(classes)], 1)
        total = counts.sum(1)
        known = np.bincount(doc, (total > 0)[rows] * count, n)
        base = np.bincount(doc, np.log10((total + 1) / corpus.base)[rows] * count, n)
        log_q = corpus.log_word(counts, facts["inside"].to_numpy().astype(float))
        for k in range(classes):
            score[:, k] = np.bincount(doc, log_rising(spread * np.exp(log_q[:, k])[rows], count), n)
    score -= (log_gamma(spread + sizes.astype(float)) - log_gamma(np.full(n, spread)))[:, None]
    score += (sizes * math.log(1 - corpus.end()))[:, None]  # after each word the text goes on
    score += np.log((corpus.docs + 0.5) / (corpus.docs.sum() + 0.5 * classes))
    top = score.max(1)
    mixed = top + np.log(np.exp(score - top[:, None]).sum(1)) + math.log(corpus.end())
    d = float(corpus.docs.sum())
    return pa.table({"_id": ids, "held_out": docs["held"], "n_tokens": pa.array(sizes + 1), "n_known": pa.array(np.rint(known).astype(np.int64) + (d > 0)),
                     "train_tokens": pa.array(np.full(n, corpus.tokens)), "base_score": pa.array(base + math.log10((d + 1) / corpus.base)), "score": pa.array(mixed / LN10)})


def score_texts(docs: DataFrame, train: F.Column, held: F.Column, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None,
                model: str = MODEL, rounds: int = 3, spread: float = 3000.0, max_classes: int = 8, block_tokens: int = 2_500_000) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probability of each
    whole text, one row for each row of docs; the model learns from the rows where `train` holds.

    A text is its lower-case words between white space, then an end. A word's probability is the
    marginal over its segmentations into pieces of an existing vocabulary, by forward recursion in
    log space; the weights of pieces are fitted to the distinct words of the training texts, and
    known words are pieces of their own. A text is a mixture over the max_classes most frequent
    values of class_col in training rows (all else is one class); the class of a scored text is
    never looked at. base_score is the add-one unigram model. Null and empty texts are an end
    only. Ids may repeat or be null; other columns are ignored.

    Corpus counts are exact and distributed. One pass turns the texts into blocks of about
    block_tokens tokens (a longer text is a block of its own), of which only distinct words with postings are kept; these meet the
    counts by word, and the scores return to the block, where they are added up by document. No
    word's group is larger than the number of blocks, and texts are read once. The vocabulary of
    pieces is broadcast; its size is fixed.
    """
    learn = F.coalesce(train, F.lit(False))
    names = [r[0] for r in docs.filter(learn).groupBy(F.col(class_col).alias("c")).count().filter("c is not null").orderBy(F.desc("count"), "c").limit(max_classes).collect()] if class_col else []
    classes = len(names) + 1
    klass = F.lit(classes - 1)
    for k, name in enumerate(names):
        klass = F.when(F.col(class_col) == F.lit(name), k).otherwise(klass)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), F.when(learn, klass).otherwise(-1).cast("int").alias("class"), F.coalesce(held, F.lit(False)).alias("held"))
    kind, counted = dict(slim.dtypes)["_id"], [f"n{k}" for k in range(classes)]
    blocks = stage(slim.mapInArrow(_blocks(block_tokens, classes), f"block long, word binary, {', '.join(f'{c} int' for c in counted)}, posts binary, docs binary"), "blocks")
    words = blocks.filter("word is not null")
    vocab = stage(words.groupBy("word").agg(*[F.sum(c).alias(c) for c in counted]), "vocabulary")
    row = vocab.agg(*[f(F.col(c)).alias(f"{name}{k}") for k, c in enumerate(counted)
                      for name, f in (("words", F.sum), ("kinds", lambda x: F.count_if(x > 0)), ("once", lambda x: F.count_if(x == 1)), ("twice", lambda x: F.count_if(x == 2)))],
                    F.count_if(sum((F.col(c) for c in counted), F.lit(0)) > 0).alias("all")).first()
    in_class = blocks.filter("word is null").agg(*[F.sum(c) for c in counted]).first()
    corpus = Corpus(np.array([x or 0 for x in in_class], float), *(np.array([row[f"{name}{k}"] or 0 for k in range(classes)], float) for name in ("words", "kinds", "once", "twice")), int(row["all"]))
    lattice = train_lattice(vocab.filter(" + ".join(counted) + " > 0").select("word"), Lattice.load(model), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(lattice)
    scored = vocab.mapInArrow(_inside(shared), f"word binary, {', '.join(f'{c} long' for c in counted)}, inside float")
    facts = words.select("word", "block", "posts").join(scored.hint("merge"), "word").drop("word")
    both = facts.unionByName(blocks.filter("word is null").select("block", "docs"), allowMissingColumns=True)
    return (both.groupBy("block").applyInArrow(lambda t: _sum_block(t, corpus, spread), f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
            .withColumnRenamed("_id", id_col))
