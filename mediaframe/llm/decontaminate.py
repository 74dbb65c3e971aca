"""Benchmark decontamination with a generalised suffix automaton over the words of test items."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: A-Z become a-z; all ASCII that is neither digit nor letter separates words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences. A state stands for a set of factors with the
    same ends; `walk` yields for each position the longest factor that ends there.

    It is built with the first edge of a state in arrays and only further ones in dicts, and kept
    as arrays: edges sorted by state and word, links, lengths, and the items of a state. Building
    and walking are linear in the words, repeated ones too."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        coded = [(name, array("i", [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words])) for name, words in items if words]
        self.names = sorted({name for name, _ in coded})
        self.shortest = min((len(seq) for _, seq in coded if len(seq) < window), default=window)
        built = _Building()
        for _, seq in coded:
            last = 0
            for w in seq:
                last = built.extend(last, w)
        self.link, self.length = np.array(built.link, np.int32), np.array(built.length, np.int32)
        self._freeze_edges(built)
        del built
        up = np.maximum(self.link, 0)
        # State of the window-long suffix, for states that are at least so long.
        self.at_window = _resolve(np.where(self.length[up] >= window, up, np.arange(len(up), dtype=np.int32)))
        self._own_items(coded)
        # The nearest whole short item among the suffixes of what a state stands for; 0 for none.
        # An item begins nothing longer, so that it is the longest factor of its state.
        short = np.zeros(len(up), bool)
        short[self.owner_state[self.length[self.owner_state] < window]] = True
        self.short_at = _resolve(np.where(short, np.arange(len(up), dtype=np.int32), up))

    def _freeze_edges(self, built: _Building) -> None:
        """edge_from (start of a state's edges), edge_word (sorted within a state) and edge_to; root_to by word."""
        first = np.flatnonzero(np.array(built.word, np.int32)).astype(np.int32)
        rest = [(v, w, to) for v, edges in built.more.items() if v for w, to in edges.items()]
        built.more = {0: built.more.get(0, {})}
        more = np.array(rest, np.int32).reshape(-1, 3)
        del rest
        state = np.concatenate([first, more[:, 0]])
        word = np.concatenate([np.array(built.word, np.int32)[first], more[:, 1]])
        to = np.concatenate([np.array(built.to, np.int32)[first], more[:, 2]])
        order = np.lexsort((word, state))
        self.edge_word, self.edge_to = word[order], to[order]
        self.edge_from = np.searchsorted(state[order], np.arange(len(self.length) + 1)).astype(np.int32)
        self.root_to = np.zeros(len(self.vocab) + 1, np.int32)
        for w, target in built.more[0].items():
            self.root_to[w] = target

    def _own_items(self, coded: list[tuple[str, array]]) -> None:
        """owner_state and owner_item, sorted pairs: items with a window (or a whole short item) in a state."""
        number = {name: k for k, name in enumerate(self.names)}
        pairs = [np.zeros(0, np.int64)]
        for name, seq in coded:
            states = np.fromiter(self._states(seq), np.int64, len(seq))
            ends = states[-1:] if len(seq) < self.window else self.at_window[states[self.window - 1:]].astype(np.int64)
            pairs.append(np.unique(ends << 32 | number[name]))
        own = np.unique(np.concatenate(pairs))
        self.owner_state, self.owner_item = (own >> 32).astype(np.int32), (own & 0xFFFFFFFF).astype(np.int32)

    def _states(self, seq: array) -> Iterator[int]:
        edge_from, edge_word, edge_to, root_to = map(memoryview, (self.edge_from, self.edge_word, self.edge_to, self.root_to))
        v = 0
        for w in seq:
            v = root_to[w] if v == 0 else edge_to[bisect_left(edge_word, w, edge_from[v], edge_from[v + 1])]
            yield v

    def items_of(self, states: set[int]) -> set[str]:
        """Names of the items that own one of the states."""
        asked = np.fromiter(states, np.int32, len(states))
        first, n = np.searchsorted(self.owner_state, asked), np.searchsorted(self.owner_state, asked, "right")
        n -= first
        rows = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return {self.names[k] for k in np.unique(self.owner_item[rows]).tolist()}

    def size(self) -> int:
        """Bytes of the arrays."""
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def walk(self, codes: list[int], start: int) -> Iterator[tuple[int, int, int]]:
        """(first word, end, state of the items) of each hit that ends at a word; codes are known words."""
        # Items of memoryviews are read faster one by one than those of the arrays.
        edge_from, edge_word, edge_to, root_to = map(memoryview, (self.edge_from, self.edge_word, self.edge_to, self.root_to))
        link, length, at_window, short_at = map(memoryview, (self.link, self.length, self.at_window, self.short_at))
        v = n = 0
        window = self.window
        for i, w in enumerate(codes, start + 1):
            while v:
                a, b = edge_from[v], edge_from[v + 1]
                at = a if b - a == 1 else bisect_left(edge_word, w, a, b)
                if at < b and edge_word[at] == w:
                    v, n = edge_to[at], n + 1
                    break
                v = link[v]
                n = length[v]
            else:
                v, n = root_to[w], 1
            if n >= window:
                yield i - n, i, at_window[v]
            u = short_at[v]
            while u:
                if length[u] <= n:
                    yield i - length[u], i, u
                u = short_at[link[u]]

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, its hit spans of words (merged), and the items with windows in it."""
        words = words_of(text)
        if len(words) < self.shortest:
            return len(words), [], set()
        codes = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            for s, e, state in self.walk(codes[a:b].tolist(), a):
                states.add(state)
                while spans and s <= spans[-1][1]:
                    s = min(s, spans.pop()[0])
                spans.append((s, e))
        return len(words), spans, self.items_of(states)


class _Building:
    """An automaton that grows word by word. word and to are the first edge of a state (0: none),
    further edges are in more; those of the root are all there."""

    def __init__(self) -> None:
        self.word, self.to, self.link, self.length = array("i", [0]), array("i", [0]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {0: {}}

    def new(self, length: int, link: int) -> int:
        for column, x in ((self.word, 0), (self.to, 0), (self.link, link), (self.length, length)):
            column.append(x)
        return len(self.length) - 1

    def target(self, v: int, w: int) -> int:
        """Where the edge goes; 0, the root, to which no edge leads, for none."""
        if self.word[v] == w:
            return self.to[v]
        edges = self.more.get(v)
        return edges.get(w, 0) if edges else 0

    def lead(self, v: int, w: int, to: int) -> None:
        if v and self.word[v] in (0, w):
            self.word[v], self.to[v] = w, to
        else:
            self.more.setdefault(v, {})[w] = to

    def split(self, p: int, w: int, q: int) -> int:
        clone = self.new(self.length[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        while p >= 0 and self.target(p, w) == q:
            self.lead(p, w, clone)
            p = self.link[p]
        self.link[q] = clone
        return clone

    def extend(self, last: int, w: int) -> int:
        q = self.target(last, w)
        if q:  # the factor is known from another item
            return q if self.length[q] == self.length[last] + 1 else self.split(last, w, q)
        cur, p = self.new(self.length[last] + 1, 0), last
        while p >= 0 and not self.target(p, w):
            self.lead(p, w, cur)
            p = self.link[p]
        if p >= 0:
            q = self.target(p, w)
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self.split(p, w, q)
        return cur


def _resolve(parent: np.ndarray) -> np.ndarray:
    """The last of the chain of parents of each state; one that is its own parent ends a chain."""
    while True:
        further = parent[parent]
        if np.array_equal(further, parent):
            return parent.astype(np.int32)
        parent = further


def _shards(items: DataFrame, id_col: str, text_col: str, window: int, max_words: int) -> tuple[int, Iterator[ItemAutomaton]]:
    """How many automata of about max_words words each (an item is in one of them), and these one by one."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    shards = max(1, -(-total // max_words))

    def build() -> Iterator[ItemAutomaton]:
        for k in range(shards):
            part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k) if shards > 1 else rows
            yield ItemAutomaton(sorted((r.id or "", words_of(r.text.encode())) for r in part.toLocalIterator()), window)

    return shards, build()


def _scanner(shared: Broadcast, kind: pa.DataType):
    def scan(texts: pa.Array) -> pa.Array:
        found = (shared.value.scan(t) for t in texts.to_pylist())
        return pa.array([{"n_words": n, "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(names)} for n, spans, names in found], kind)

    return scan


def _found(rows: DataFrame, items: DataFrame, item_id: str, item_text: str, window: int, max_words: int) -> DataFrame:
    """rows (with _text) with _hits: struct of n_words, spans and items, without _text. Where the items
    take several automata, rows are written once with a number; each automaton reads the texts and
    writes numbers and hits, so that a task holds one automaton and no text is written twice or moved."""
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])
    sql = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"
    n, automata = _shards(items, item_id, item_text, window, max_words)
    context = rows.sparkSession.sparkContext

    def hits(automaton: ItemAutomaton) -> tuple[Broadcast, F.Column]:
        shared = context.broadcast(automaton)
        return shared, F.arrow_udf(_scanner(shared, kind), sql)(F.col("_text").cast("binary")).alias("_hits")

    others = [c for c in rows.columns if c != "_text"]
    if n == 1:
        return rows.select(*others, hits(next(automata))[1])
    numbered = stage(rows.withColumn("_number", F.monotonically_increasing_id()), "numbered")
    parts = []
    for automaton in automata:
        shared, column = hits(automaton)
        parts.append(stage(numbered.select("_number", column), "hits"))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy("_number").agg(
        F.struct(F.max("_hits.n_words").alias("n_words"), _united(F.flatten(F.collect_list("_hits.spans"))).alias("spans"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hits.items")))).alias("items")).alias("_hits"))
    return numbered.select("_number", *others).join(every.hint("merge"), "_number").drop("_number")


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", window: int = 13, max_words: int = 1_000_000) -> DataFrame:
    """id, n_words, spans (array of [first word, end word) that lie in occurrences of item windows),
    items (sorted ids of the items that occur), one row for each row of docs.

    Each document streams through the automaton; where its longest match reaches `window` words
    (or a whole shorter item) the matched words are hit. The automaton is broadcast; its size is
    bounded by max_words, and a larger benchmark is handled in several such passes whose hits are
    united. Null or empty texts have no words and no hits; null or empty items match nothing; items
    with equal text are all reported. Ids may repeat or be null: rows stay rows. Other columns are
    ignored. Nothing is shuffled but, with several passes, row numbers and hits.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return _found(slim, items, item_id, item_text, window, max_words).select(F.col("_id").alias(id_col), "_hits.*")


def _united(spans: str) -> F.Column:
    """Overlapping or touching spans become one."""
    return F.aggregate(
        F.array_sort(spans), F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["b"] >= s["a"]),
                              F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                                       F.array(F.struct(F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["a"].alias("a"),
                                                        F.greatest(F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["b"], s["b"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(s))))


def _n_hit(spans: F.Column) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))


def judge(found: DataFrame, id_col: str = "doc_id", num: int = 20) -> DataFrame:
    """The digest of `find_contamination`: contaminated where at least 1/num of the words are hit."""
    return (found.withColumn("n_hit", _n_hit(F.col("spans")))
            .select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (num * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")))


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = 13, num: int = 20,
                        max_words: int = 1_000_000) -> DataFrame:
    """docs without the documents of which 1/num or more is test items; columns as in docs, whatever
    their names. Works on each row by itself, so repeated and null ids are no matter; documents
    without words and an empty table stay as they are. With items for several automata, rows meet
    their hits by number in a shuffle."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    with_hits = _found(rows.select("row", F.col("row")[text_col].alias("_text")), items, "item_id", "text", window, max_words)
    n_hit = _n_hit(F.col("_hits.spans"))
    return with_hits.filter(~((n_hit > 0) & (num * n_hit >= F.col("_hits.n_words")))).select("row.*")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the hit words, for callers that remove spans instead of documents."""
    data = text.encode()
    folded, ends, at = data.translate(FOLD), [], 0
    for w in folded.split():
        a = folded.index(w, at)
        at = a + len(w)
        ends.append((a, at))
    out, last = [], 0
    for a, b in spans:
        out.append(data[last:ends[a][0]])
        last = ends[b - 1][1]
    return b"".join([*out, data[last:]]).decode()
