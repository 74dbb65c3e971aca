"""SentencePiece encoding and decoding by shortest paths of a weighted transducer."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
Arc = tuple[int, ...]


def read_pieces(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """Pieces and scores by id, and the ids of the pieces for bytes 0 to 255. Ids that stand for
    no text (unknown, control) have the piece "". The size of the vocabulary bounds the result."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    silent = [model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i) for i in ids]
    return (["" if s else model.id_to_piece(i) for i, s in zip(ids, silent, strict=True)], [model.get_score(i) for i in ids],
            [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class _Paths(dict):
    """Outputs of words, found when first asked for; emptied when it holds `limit` of them."""

    def __init__(self, path, mark: str, limit: int):
        super().__init__()
        self.path, self.mark, self.limit = path, mark, limit

    def __missing__(self, word: str) -> Arc:
        if len(self) >= self.limit:
            self.clear()
        ids = self.path(self.mark + word)
        if len(word) < 64:
            self[word] = ids
        return ids


class PieceTransducer:
    """normaliser . pieces . byte fallback, to be composed with a text.

    Normaliser: a space is written as the mark, and one mark goes in front of a text that is not
    empty. Pieces: one arc for each piece, from the place where it starts to the place where it
    ends. Byte fallback: a character that is no piece has one arc whose output is its bytes.

    Weights are of the tropical semiring. kind "unigram": an arc weighs minus its score. kind
    "bpe": a state also remembers the last piece, and an arc weighs 0 if merging by score leaves
    the two neighbours apart, else infinity. A sequence of pieces is what merging makes of its text
    exactly if that holds for all neighbours, so one path has finite weight and it is the
    encoding by merges. No piece spans the start of a word, so words are composed one by one.
    """

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], kind: str = "bpe", cache: int = 600_000):
        self.kind, self.scores, self.byte_ids, self.limit = kind, scores, byte_ids, cache
        self.id_of = {p: i for i, p in enumerate(pieces) if p}
        self.longest = max(map(len, self.id_of), default=1)
        self.out = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.out[i] = bytes([b])
        self.byte_set = frozenset(byte_ids)
        self.runs: dict[int, Arc] = {}
        if kind == "bpe":
            self._compile_merges(pieces)
        self._compile_prefixes()
        self._forget()

    def _forget(self) -> None:
        path = self._finite_path if self.kind == "bpe" else self._path
        self.words, self.inner = _Paths(path, MARK, self.limit), _Paths(path, "", self.limit // 8)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "inner")} | {"runs": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _compile_prefixes(self) -> None:
        """For each beginning of a piece, the longest piece that begins it (-1: none); for each
        piece the next shorter one that begins it."""
        self.begun: dict[str, int] = {}
        self.shorter: dict[int, int] = {}
        self.size_of = {i: len(p) for p, i in self.id_of.items()}
        for p, i in sorted(self.id_of.items(), key=lambda x: len(x[0])):
            below = -1
            for k in range(1, len(p) + 1):
                if k == len(p):
                    self.shorter[i] = below
                    self.begun[p] = i
                else:
                    below = self.begun.setdefault(p[:k], below)

    # Merging, for the neighbours that may stand.

    def _merge(self, symbols: list[str]) -> list[list[str]]:
        """The stages of merging the best-scored neighbours, leftmost first, until none is left."""
        stages = [symbols]
        while True:
            pairs = [(-self.scores[self.id_of[a + b]], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.id_of]
            if not pairs:
                return stages
            k = min(pairs)[1]
            symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2:]]
            stages.append(symbols)

    def _compile_merges(self, pieces: list[str]) -> None:
        """For each piece its rank and the two parts of its last merge; pieces that merging never
        makes get no arc."""
        order = sorted((i for p, i in self.id_of.items() if len(p) > 1), key=lambda i: (-self.scores[i], i))
        self.rank = {i: n for n, i in enumerate(order, 1)} | {i: 0 for p, i in self.id_of.items() if len(p) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        for i in order:
            stages = self._merge(list(pieces[i]))
            if len(stages[-1]) == 1 and len(stages[-2]) == 2 and all(s in self.id_of for s in stages[-2]):
                a, b = stages[-2]
                self.parts[i] = (self.id_of[a], self.id_of[b])
            elif pieces[i].strip(MARK):
                del self.id_of[pieces[i]]
        self.joined = {ab: i for i, ab in self.parts.items()}
        self.joins = {(self.id_of[p[:k]], self.id_of[p[k:]]): i for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of}
        self.apart: dict[tuple[int, int], bool] = {}

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging never joins across the border of two neighbours: undo their merges from
        the latest to the earliest, and see that no join across would have come sooner."""
        known = self.apart.get((a, b))
        if known is None:
            known = self.apart[a, b] = self._never_joined(a, b)
            if len(self.apart) > 4 * self.limit:
                self.apart.clear()
        return known

    def _never_joined(self, a: int, b: int) -> bool:
        rank, parts, joins = self.rank, self.parts, self.joins
        before = math.inf  # only joins that rank before this can still come
        while True:
            joined = joins.get((a, b))
            if joined is not None and rank[joined] < before:
                return False
            # Of the two last merges the later is undone; among equals the left one came first.
            if a in parts and (b not in parts or rank[a] > rank[b]):
                before, a = rank[a], parts[a][1]
            elif b in parts:
                before, b = rank[b] + 1, parts[b][0]
            else:
                return True

    # Composition and shortest path.

    def _finite_path(self, word: str) -> Arc:
        """Output of the only path of finite weight, depth first: the longest piece at each place
        that may stand beside the last one, then shorter ones, then back. A place that was left
        by going back is on no finite path."""
        n, begun, shorter, size_of, apart = len(word), self.begun, self.shorter, self.size_of, self.apart
        dead: set[int] = set()
        path: list[tuple[int, int]] = []  # start and piece; -1 is one character in bytes
        pos, piece, last = 0, -2, -1
        while pos < n:
            if piece == -2:  # the longest piece that starts here
                piece, k = -1, pos + 1
                while k <= n and (p := begun.get(word[pos:k])) is not None:
                    piece, k = p, k + 1
                fallback = piece == -1
            while piece >= 0:
                if pos + size_of[piece] not in dead:
                    ok = True if last < 0 else apart.get((last, piece))
                    if ok or ok is None and self._stay_apart(last, piece):
                        break
                piece = shorter[piece]
            if piece >= 0 or fallback:
                path.append((pos, piece))
                pos, last, piece, fallback = pos + (size_of[piece] if piece >= 0 else 1), piece, -2, False
            else:
                dead.add(pos)
                pos, piece = path.pop()
                last = path[-1][1] if path else -1
                piece, fallback = (shorter[piece] if piece >= 0 else -1), False
        ids: list[int] = []
        for start, piece in path:
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.byte_ids[b] for b in word[start].encode("utf-8", "replace")]
        return tuple(ids)

    def _path(self, word: str) -> Arc:
        """Output of the shortest path through the word."""
        n, id_of = len(word), self.id_of
        best: list[tuple[float, int, int]] = [(0.0, -1, -1)]  # weight, last id (-1: none or bytes), start
        for end in range(1, n + 1):
            found = (math.inf, -1, end - 1)
            for start in range(max(0, end - self.longest), end):
                piece = id_of.get(word[start:end])
                if piece is None:
                    if start < end - 1 or word[start:end] in id_of:
                        continue
                    found = min(found, (best[start][0] + (0.0 if self.kind == "bpe" else 1e6), -1, start))
                    continue
                weight, last, _ = best[start]
                if self.kind == "bpe":
                    if weight == math.inf or last >= 0 and not self._stay_apart(last, piece):
                        continue
                    found = (weight, piece, start)
                    break  # there is one finite path at most
                found = min(found, (weight - self.scores[piece], piece, start))
            best.append(found)
        out: list[tuple[int, ...]] = []
        end = n
        while end:
            _, piece, start = best[end]
            out.append((piece,) if piece >= 0 else tuple(self.byte_ids[b] for b in word[start:end].encode("utf-8", "replace")))
            end = start
        return tuple(chain.from_iterable(reversed(out)))

    def _run(self, n: int) -> Arc:
        """Marks that no word has taken."""
        if n not in self.runs:
            self.runs[n] = tuple(self.id_of[s] for s in self._merge([MARK] * n)[-1]) if self.kind == "bpe" and n < 200 else self._long_run(n)
        return self.runs[n]

    def _long_run(self, n: int) -> Arc:
        if self.kind == "unigram":
            return self._path(MARK * n)
        most = self._run(64)[0]  # equal merges go from left to right
        size = len(self.out[most])
        return (most,) * (n // size - 4) + self._run(n % size + 4 * size)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[Arc] = []
        spaces = 1  # the mark in front of the text
        for k, line in enumerate(text.replace(MARK, " ").split("\n")):
            if k:  # a line end is no piece, so nothing merges across it
                if spaces:
                    out.append(self._run(spaces))
                out.append((self.byte_ids[10],) if "\n" not in self.id_of else (self.id_of["\n"],))
                spaces = 0
            parts = line.split(" ")
            if "" not in parts:
                out.append(self.words[parts[0]] if spaces else self.inner[parts[0]])
                out += map(self.words.__getitem__, parts[1:])
                spaces = 0
                continue
            first = True
            for word in parts:
                if not first:
                    spaces += 1
                first = False
                if not word:
                    continue
                if not spaces:
                    out.append(self.inner[word])
                    continue
                ids = self.words[word]
                if spaces > 1:  # merges of marks come last: a word takes its mark first
                    if len(self.out[ids[0]]) == 1 and self.out[ids[0]] == b" " and ids[0] not in self.byte_set:
                        out += [self._run(spaces), ids[1:]]
                    else:
                        out += [self._run(spaces - 1), ids]
                else:
                    out.append(ids)
                spaces = 0
        if spaces:
            out.append(self._run(spaces))
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.out.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """id, ids (array of piece ids), n_pieces, n_byte_pieces, round_trip (decoding gives the text,
    in which a mark reads as a space), one row for each row of docs.

    The vocabulary is read on the driver and broadcast. Null and empty texts have no pieces. Ids
    may repeat or be null; other columns are ignored; there is no shuffle. Words of a task are
    remembered up to a fixed number, so memory is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PieceTransducer(*read_pieces(model), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        in_bytes = np.zeros(len(t.out), bool)
        in_bytes[t.byte_ids] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                coded = [t.encode(x) for x in texts]
                sizes = np.fromiter(map(len, coded), np.int64, len(coded))
                flat = np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum()))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                byte_sum = np.concatenate([[0], np.cumsum(in_bytes[flat])])
                same = [t.decode(c) == (x or "").replace(MARK, " ") for x, c in zip(texts, coded, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(sizes),
                     pa.array(byte_sum[ends[1:]] - byte_sum[ends[:-1]], pa.int64()), pa.array(same, pa.bool_())],
                    names=["_id", "ids", "n_pieces", "n_byte_pieces", "round_trip"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind_of_id = dict(slim.dtypes)["_id"]
    return slim.mapInArrow(run, f"_id {kind_of_id}, ids array<int>, n_pieces long, n_byte_pieces long, round_trip boolean").withColumnRenamed("_id", id_col)


def detokenize(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """id and text of rows with piece ids; null and empty lists give an empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(PieceTransducer(*read_pieces(model), "unigram"))

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return pa.array([shared.value.decode(x or []) for x in ids.to_pylist()], pa.string())

    return coded.select(id_col, text(F.col(ids_col)).alias("text"))
