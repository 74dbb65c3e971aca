"""Near duplicates: an exact Jaccard join of word shingles by token-combination prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, free_shuffles, keep_keyed, keyed, runs_for, stage
from .hashing import MIX, mix, span_hashes

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
WHITE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
SEEN_BITS = 27  # 16 MB of bitmap
SLOTS = 1 << 27  # 16 MB of bitmap at most


# Shingles.


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts in a row, and where each text's begin.
    Words lie between ASCII white space, A-Z lowered; fewer than `width` words are one shingle."""
    data = LOWER[np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]), np.uint8)]
    ends_of = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    white = WHITE[data]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]])[: len(white)])
    ends = np.flatnonzero(white & np.concatenate([[False], ~white[:-1]])[: len(white)])
    words = span_hashes(data, starts, ends)
    owner = np.searchsorted(ends_of, starts, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    short = (n_words[owner] < width) if len(owner) else np.zeros(0, bool)
    parts, of = [], []
    if len(words) >= width:
        h = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            h = mix(h + words[k: len(words) - width + 1 + k])
        whole = owner[: len(h)] == owner[width - 1:]
        parts.append(h[whole])
        of.append(owner[: len(h)][whole])
    if short.any():  # the few words of a short text in order
        at = np.flatnonzero(short)
        h = np.zeros(len(texts), np.uint64)
        place = at - np.searchsorted(owner, owner[at])
        for k in range(width - 1):
            now = at[place == k]
            h[owner[now]] = mix(h[owner[now]] + words[now])
        few = np.unique(owner[at])
        parts.append(mix(h[few] + n_words[few].astype(np.uint64) * MIX))
        of.append(few)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h, o = np.concatenate(parts), np.concatenate(of)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    h, o = h[first], o[first]
    return h, np.searchsorted(o, np.arange(len(texts) + 1))


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches (_text, _width and others) of about `most` bytes with their sets."""
    for batch in batches:
        if batch.num_rows:
            width = int(batch.column("_width")[0].as_py())
            ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("_text")), 0).to_numpy().astype(np.int64) + 1)
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(most, ends[-1] + most, most)) + 1, 0))
            for start, end in zip(cuts[:-1].tolist(), np.minimum(cuts[1:], batch.num_rows).tolist(), strict=True):
                if end > start:
                    part = batch.slice(start, end - start)
                    h, at = shingle_sets(part.column("_text").to_pylist(), width)
                    yield part, h, at


def entity_of(h: np.ndarray, at: np.ndarray, seed: int = 11) -> np.ndarray:
    """A 64-bit name of each set: documents with equal sets are one entity. Another seed gives an
    unrelated name."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h * MIX + np.uint64(seed)), dtype=np.uint64)])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * MIX).view(np.int64)


# Token counts over all documents, by ranges of tokens.


def token_bits(total: int) -> tuple[int, int]:
    """Of so many tokens: the bits of the range, so that a range has half a million tokens or so, and how
    many bits after it tell tokens apart. One in 128 is then taken for another one, which changes
    its class (in all sets alike) and no result; more bits would only be more bytes to shuffle."""
    range_bits = min(22, max(10, total.bit_length() - 19))
    return range_bits, min(32, max(24, total.bit_length() + 7 - range_bits))


def _emit_tokens(range_bits: int, low_bits: int):
    return lambda batches: _tokens_by_range((h for _, h, _ in _pieces(batches)), range_bits, low_bits)


def _tokens_by_range(hashes: Iterator[np.ndarray], range_bits: int, low_bits: int) -> Iterator[pa.RecordBatch]:
    """The low_bits after the range of each token, sorted, and of repeated ones the place and how many
    more there are, in pieces by range: a token of every document has one entry in a piece."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(held) >> np.uint64(64 - low_bits - range_bits), return_counts=True)
        cut = np.searchsorted(h >> np.uint64(low_bits), np.arange((1 << range_bits) + 1))
        low = (h & np.uint64((1 << low_bits) - 1)).astype(np.uint32)
        used = np.flatnonzero(np.diff(cut))
        # Byte planes of the differences: the upper ones are mostly zeros and compress.
        blobs, more = [], []
        for r in used:
            blobs.append(np.diff(low[cut[r]: cut[r + 1]], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes())
            again = np.flatnonzero(n[cut[r]: cut[r + 1]] > 1)
            more.append(np.stack([again, n[cut[r]: cut[r + 1]][again] - 1]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary()), pa.array(more, pa.binary())], names=["range", "tokens", "more"])

    for h in hashes:
        held.append(h)
        size += len(h)
        if size >= 1_000_000:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def limits_from(least: int) -> list[int]:
    """Numbers of documents from `least` on, by steps of a quarter, to more than any corpus has tokens."""
    out = [least]
    while out[-1] < 1 << 44:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


COUNTED = "range int, bits binary, often binary, docs binary, above array<long>"


def _count_range(group: pa.Table, least: int, range_bits: int, low_bits: int) -> pa.Table:
    """Of a range: which hash slots tokens of two or more documents fall in (a bitmap), the tokens
    (range and low_bits more) of more than `least` documents with their numbers of documents, and how
    many tokens are in more documents than each of the limits."""
    r = group["range"][0].as_py()
    low, count = [], []
    for blob, more in zip(group["tokens"].to_pylist(), group["more"].to_pylist(), strict=True):
        low.append(np.cumsum(np.frombuffer(blob, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32))
        at, n = np.frombuffer(more, np.int32).reshape(2, -1)
        count.append(np.ones(len(low[-1]), np.int64))
        count[-1][at] += n
    low, count = np.concatenate(low), np.concatenate(count)
    order = np.argsort(low, kind="stable")
    low, count = low[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    n, kinds = np.add.reduceat(count, first), low[first]
    bits = np.zeros(1 << (SEEN_BITS - range_bits), np.uint8)
    bits[kinds[n > 1] >> np.uint32(low_bits - (SEEN_BITS - range_bits))] = 1
    often = (np.uint64(r) << np.uint64(low_bits)) | kinds[n > least].astype(np.uint64)
    docs = n[n > least]
    above = len(docs) - np.searchsorted(np.sort(docs), limits_from(least), side="right")
    return pa.table({"range": pa.array([r], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "often": pa.array([often.tobytes()], pa.binary()),
                     "docs": pa.array([docs.tobytes()], pa.binary()), "above": pa.array([above.tolist()], pa.list_(pa.int64()))})


def _emit_often(least: int):
    """range, bits and the tokens of more than `least` documents of counted ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            often = [np.frombuffer(t, np.uint64)[np.frombuffer(n, np.int64) > least].tobytes() for t, n in zip(batch.column("often").to_pylist(), batch.column("docs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("range"), batch.column("bits"), pa.array(often, pa.binary())], names=["range", "bits", "often"])

    return run


@dataclass
class TokenClasses:
    """seen: bitmap of hash slots with tokens of two or more documents, of 2 ** SEEN_BITS bits.
    often: sorted tokens (their first `bits` bits) of more than `least` documents, at
    most 2 ** 22 of them."""

    seen: np.ndarray
    often: np.ndarray
    bits: int
    least: int

    def frequent(self, h: np.ndarray) -> np.ndarray:
        t = h >> np.uint64(64 - self.bits)
        at = np.searchsorted(self.often, t)
        at[at == len(self.often)] = 0
        return self.often[at] == t if len(self.often) else np.zeros(len(h), bool)

    def shared(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - SEEN_BITS)).astype(np.int64)
        return (self.seen[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0


def count_tokens(slim: DataFrame, total_tokens: int, least: int, most: int = 1 << 22) -> TokenClasses:
    """Document counts of all tokens by their first bits, in ranges that grow in number with the corpus.
    Tokens of more than `least` documents are frequent; where that are more than `most`, the limit is
    the first one above which there are no more. It is told from the counts, not from the size of the
    corpus: single tokens below it are indexed, and their buckets must stay small. The driver
    gets at most 16 MB of bitmap and 32 MB of tokens, whatever the corpus."""
    range_bits, low_bits = token_bits(total_tokens)
    counted = slim.mapInArrow(_emit_tokens(range_bits, low_bits), "range int, tokens binary, more binary").groupBy("range")
    counted = stage(counted.applyInArrow(lambda t: _count_range(t, least, range_bits, low_bits), COUNTED), "tokens")
    above = dict(counted.select(F.posexplode("above").alias("k", "n")).groupBy("k").agg(F.sum("n")).collect())
    least = next(limit for k, limit in enumerate(limits_from(least)) if above.get(k, 0) <= most)
    seen, often = _collected(counted.mapInArrow(_emit_often(least), "range int, bits binary, often binary"), range_bits)
    return TokenClasses(seen, often, range_bits + low_bits, least)


def _collected(counted: DataFrame, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap of all ranges, and their tokens in order."""
    size = 1 << (SEEN_BITS - range_bits - 3)
    seen = np.zeros(1 << (SEEN_BITS - 3), np.uint8)
    often = []
    for row in counted.collect():
        seen[row["range"] * size: (row["range"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
        often.append(np.frombuffer(row["often"], np.uint64))
    return seen, np.sort(np.concatenate([*often, np.zeros(0, np.uint64)]))


# Signatures.


def groups_for(n: int, k: int = 2) -> int:
    """Hash groups of frequent tokens for combinations of k out of sets of n tokens: a power of two,
    about n / (k + 2) to half of that. At least half of the tokens are then units (see below)."""
    return 1 if n < 8 else 1 << (max(1, n // (k + 2)).bit_length() - 1)


def combinations_of(t: np.ndarray, g: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-combination of tokens inside a group; t in a fixed order, g the group of each."""
    order = np.argsort(g, kind="stable")
    t, g = t[order], g[order]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(g)))
    out = [np.zeros(0, np.uint64)]
    for m in np.unique(sizes[sizes >= k]).tolist():
        pick = np.array(list(combinations(range(m), k)))
        rows = t[starts[sizes == m][:, None] + np.arange(m)]
        h = np.full((len(rows), len(pick)), np.uint64(k))
        for j in range(k):
            h = mix(h * MIX + rows[:, pick[:, j]])
        out.append(h.ravel())
    return np.concatenate(out)


def deep_signatures(often: np.ndarray, n: int, need: int, num: int, k: int) -> list[np.ndarray]:
    """The k-combinations of the prefix of `often` (in the common order) that holds `need` units.

    Tokens are dealt into hash groups. Of m tokens of a group in the prefix, at most m - k + 1 can
    be missing before no combination is left, so each token after the first k - 1 of its group is
    one unit. The larger of two partners sets the number of groups, so a set prepares for its own
    size and for all larger ones that it may meet.
    """
    out = []
    for groups in sorted({groups_for(m, k) for m in range(n, n * 100 // num + 1, max(1, n // 8))} | {groups_for(n * 100 // num, k)}):
        g = (often >> np.uint64(20)) % np.uint64(groups)
        order = np.argsort(g, kind="stable")
        gs = g[order]
        first = np.concatenate([[True], gs[1:] != gs[:-1]]) if len(gs) else np.zeros(0, bool)
        place = np.arange(len(gs)) - np.maximum.accumulate(np.where(first, np.arange(len(gs)), 0)) if len(gs) else np.zeros(0, np.int64)
        unit = np.empty(len(often), np.int64)
        unit[order] = place >= k - 1
        size = int(np.searchsorted(np.cumsum(unit), need)) + 1
        out.append(mix(combinations_of(often[:size], g[:size], k) + np.uint64(groups)))
    return out


def signatures(h: np.ndarray, classes: TokenClasses, num: int, frequent: np.ndarray | None = None) -> tuple[list[np.ndarray], bool]:
    """Signatures of one set; and whether all of them are single tokens.

    Tokens are ordered by class (rare, frequent), then hash. A partner may lack at most
    d = n - ceil(num n / 100) of the tokens. Rare tokens are single signatures, one unit each;
    frequent ones are indexed as pairs inside a hash group. The prefix grows to d + 1 units; then
    a partner shares a signature.
    """
    n = len(h)
    need = n - -(-num * n // 100) + 1
    if frequent is None:
        frequent = classes.frequent(h)
    rare = h[~frequent][:need]
    out = [rare[classes.shared(rare)]]
    if len(rare) == need:
        return out, True
    return out + deep_signatures(h[frequent], n, need - len(rare), num, 2), False


def _emit_signatures(shared: Broadcast, num: int):
    """A row for each document (sig is null) and, once for each set of a piece, its signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for batch, h, at in _pieces(batches):
            ents, sizes = entity_of(h, at), np.diff(at)
            checks = entity_of(h, at, 13)
            frequent = classes.frequent(h)
            seen: set[int] = set()
            sigs, owner, single = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.ones(len(sizes), bool)
            for k, (e, n) in enumerate(zip(ents.tolist(), sizes.tolist(), strict=True)):
                if e in seen or 100 * n < num * (n + 1):  # too small to be like another set
                    continue
                seen.add(e)
                found, single[k] = signatures(h[at[k]: at[k + 1]], classes, num, frequent[at[k]: at[k + 1]])
                sigs += found
                owner += [np.full(len(x), k) for x in found]
            o, n_rows = np.concatenate(owner), batch.num_rows
            every = np.concatenate([np.arange(n_rows), o])
            none = lambda name, kind: pa.concat_arrays([batch.column(name) if name else pa.array(checks), pa.nulls(len(o), kind)])  # noqa: E731, B023
            sig = pa.concat_arrays([pa.nulls(n_rows, pa.int64()), pa.array(np.concatenate(sigs).view(np.int64))])
            yield pa.RecordBatch.from_arrays([none("_id", batch.schema.field("_id").type), none("_slot", pa.int32()), none("", pa.int64()), sig, pa.array(ents[every]), pa.array(sizes[every].astype(np.int32)),
                                              pa.array(single[every])], names=["_id", "_slot", "check", "sig", "ent", "n", "single"])

    return run


def size_classes(n: int, most: int) -> list[int]:
    """Upper bounds, by steps of a quarter, of the classes that sizes from n to most are in."""
    out, bound = [], 4
    while not out or out[-1] < most:
        if bound >= n:
            out.append(bound)
        bound = max(bound + 1, bound * 5 // 4)
    return out


def group_signatures(h: np.ndarray, bound: int, num: int) -> tuple[np.ndarray, int]:
    """A hash of all tokens of each hash group, and how many of them a set has to index.

    Links of sets of up to `bound` tokens differ in at most d tokens, so of 2 (d + 1) groups at least
    d + 2 hold the same tokens in both. If all sets order their groups alike, those in which both
    are the same cannot all lie behind the first d + 1 of either: these meet."""
    d = 2 * bound * (100 - num) // (100 + num)
    groups = 2 * (d + 1)
    sums = np.zeros(groups, np.uint64)
    np.add.at(sums, ((h >> np.uint64(20)) % np.uint64(groups)).astype(np.int64), mix(h * MIX + np.uint64(bound)))
    return mix(sums + np.arange(1, groups + 1, dtype=np.uint64) * MIX + np.uint64(bound)), d + 1


def _deep_of(batches: Iterator[pa.RecordBatch], num: int) -> Iterator[tuple[np.ndarray, int, int, int, int]]:
    """Group signatures, ent, n, bound and need of whole sets (ent, tokens), for their own size and for all
    larger ones that they may meet."""
    for batch in batches:
        for e, blob in zip(batch.column("ent").to_pylist(), batch.column("tokens"), strict=True):
            h = np.frombuffer(blob.as_buffer(), np.uint64)
            for bound in size_classes(len(h), len(h) * 100 // num):
                sigs, need = group_signatures(h, bound, num)
                yield sigs, e, len(h), bound, need


def _emit_deep(num: int, shared: Broadcast, most: int = 200_000):
    """sig, ent, n, single, bound, need: the group signatures that a set may have to index. The rarest
    come first, so those that no other set has take their places at once and are not written;
    a set of which they take all places cannot have a link and has no rows."""
    def rows(held: list[tuple]) -> pa.RecordBatch:
        sigs, of = np.concatenate([x[0] for x in held]), np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
        ent, n, bound, need = (np.array([x[k] for x in held])[of] for k in range(1, 5))
        return pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(ent), pa.array(n.astype(np.int32)), pa.array(np.zeros(len(of), bool)), pa.array(bound.astype(np.int32)), pa.array(need.astype(np.int32))],
                                          names=["sig", "ent", "n", "single", "bound", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, held, count = shared.value, [], 0
        for sigs, e, n, bound, need in _deep_of(batches, num):
            met = sigs[classes.shared(sigs)]
            need -= len(sigs) - len(met)
            if need > 0 and len(met):
                held.append((met, e, n, bound, need))
                count += len(met)
            if count >= most:
                yield rows(held)
                held, count = [], 0
        if held:
            yield rows(held)

    return run


def _deep_signatures(sets: DataFrame, num: int) -> DataFrame:
    """The group signatures of sets (staged) that more than one of them has. They are counted like tokens,
    a few bytes each, so that only these are rows; about as many as there are tokens."""
    total = (sets.agg(F.sum(F.length("tokens"))).first()[0] or 0) // 8
    range_bits, low_bits = token_bits(total)
    by_range = sets.mapInArrow(lambda batches: _tokens_by_range((x[0] for x in _deep_of(batches, num)), range_bits, low_bits), "range int, tokens binary, more binary")
    counted = by_range.groupBy("range").applyInArrow(lambda t: _count_range(t, 1 << 44, range_bits, low_bits), COUNTED)
    seen, often = _collected(counted.select("range", "bits", "often"), range_bits)
    shared = sets.sparkSession.sparkContext.broadcast(TokenClasses(seen, often, range_bits + low_bits, 0))
    return stage(sets.mapInArrow(_emit_deep(num, shared), "sig long, ent long, n int, single boolean, bound int, need int"), "signatures")


def _rarest(deep: DataFrame) -> DataFrame:
    """Of each set the group signatures that it has to index, the rarest ones: what many share, such
    as a passage, comes last. A signature of many rows meets its count by salted keys."""
    counts = deep.groupBy("sig").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("ent", "bound").orderBy("c", "sig")
    rare = attach(deep, counts, ["sig"], F.xxhash64("ent"), runs_for(deep.count())).withColumn("place", F.row_number().over(w))
    return stage(rare.filter("place <= need and c > 1").select("sig", "ent", "n", "single"), "rarest")


def slots_for(n: int) -> int:
    """Slots of a bitmap of n keys, a power of two: 128 or more a key, so that a key that is not among
    them finds its slot taken once in 128 times at most; up to SLOTS."""
    return min(SLOTS, max(1 << 20, 1 << (128 * n).bit_length()))


def bitmap_of(keys: DataFrame, key: str, n: int) -> np.ndarray:
    """A bitmap with the slots of the n keys (longs); the driver sees nothing else of them."""
    slots = slots_for(n)
    one = keys.select((F.col(key).bitwiseAND(F.lit(slots - 1)) + 1).alias("slot"))
    maps = one.groupBy(F.expr("bitmap_bucket_number(slot)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect()
    out = np.zeros(slots >> 3, np.uint8)
    for part, bits in maps:  # parts count from 1
        out[(part - 1) * len(bits): part * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.astype(np.int64) & (8 * len(bitmap) - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _emit_asked(shared: Broadcast):
    """Rows whose ent has a slot of the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(shared.value, batch.column("ent").to_numpy())))

    return run


def _emit_sets(shared: Broadcast):
    """Sets of the documents whose slot is wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            few = batch.filter(pa.array(in_bitmap(wanted, batch.column("_slot").to_numpy())))
            if few.num_rows:
                for _, h, at in _pieces(iter([few])):
                    each = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(entity_of(h, at)), pa.array(each, pa.binary())], names=["ent", "tokens"])

    return run


# Verification.


def is_link(a: np.ndarray, b: np.ndarray, num: int) -> bool:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= num * (len(a) + len(b) - both)


def _verify(num: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [is_link(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _verify_block(num: int):
    """Links among the pairs (a, b) of a block, with the sets (ent, tokens) of its entities."""
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        of = dict(zip(sets["ent"].to_pylist(), (np.frombuffer(x.as_buffer(), np.uint64) for chunk in sets["tokens"].chunks for x in chunk), strict=True))
        linked = [is_link(of[a], of[b], num) for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)]
        return pairs.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def common_tokens(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, often: int = 32, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right]. Tokens of more than `often` sets go
    as matrix products, a `width` of them at a time; the others by the pairs of sets that hold them."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right)), np.float32)
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    dense = np.cumsum(df > often) - 1
    use = df[token] > often
    col, row = dense[token[use]], owner[use]
    for start in range(0, int((df > often).sum()), width):
        now = (col >= start) & (col < start + width)
        x = np.zeros((len(sets), width), np.float32)
        x[row[now], col[now] - start] = 1
        out += x[left] @ x[right].T
    use = (df[token] > 1) & (df[token] <= often)
    order = np.argsort(token[use], kind="stable")
    t, o = token[use][order], owner[use][order]
    own = at_left >= 0
    for step in range(1, often):
        same = t[step:] == t[:-step] if step < len(t) else np.zeros(0, bool)
        if not same.any():
            break
        a, b = o[:-step][same], o[step:][same]
        for x, y in ((a, b), (b, a)):
            ok = own[x] & (at_right[y] >= 0)
            np.add.at(out, (at_left[x[ok]], at_right[y[ok]]), 1)
    itself = np.flatnonzero(own & (at_right >= 0))
    out[at_left[itself], at_right[itself]] = sizes[itself]
    return out


def _tile(num: int):
    """Of a tile of a family: links that join the components which links of the tile can join, at
    most twice as many as it has members. Every pair of different components is tested."""
    def run(group: pa.Table) -> pa.Table:
        ent, comp, side = (group[c].to_numpy() for c in ("ent", "comp", "side"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in group["tokens"].chunks for x in chunk]
        n = np.fromiter(map(len, sets), np.float32, len(sets))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        both = common_tokens(sets, left, right)
        linked = (100 * both >= num * (n[left][:, None] + n[right][None] - both) - 1e-3) & (comp[left][:, None] != comp[right][None])
        x, y = np.nonzero(linked)
        x, y = left[x], right[y]
        few = joining(comp[x], comp[y])
        a, b = ent[x[few]], ent[y[few]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def joining(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of edges x - y that join all nodes which all edges join: in each round every component
    takes one edge that leaves it, so that their number halves at least."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = ends[: len(x)], ends[len(x):]
    root, out, left = np.arange(len(nodes)), [np.zeros(0, np.int64)], np.arange(len(x))
    while len(left):
        a, b = root[x[left]], root[y[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        _, first = np.unique(np.concatenate([a, b]), return_index=True)
        pick = np.unique(first % max(1, len(left)))
        out.append(left[pick])
        while True:  # the smaller root of each edge, until nothing changes
            p, q = root[a[pick]], root[b[pick]]
            if (p == q).all():
                break
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            root = root[root]
            while (root != root[root]).any():
                root = root[root]
    return np.concatenate(out)


# Links and components.


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node, comp (its smallest reachable node) of links a < b, for nodes with links but the smallest
    ones. Alternating large-star and small-star steps: larger neighbours of a node, then smaller ones
    are hung on its smallest neighbour, until all are stars. That neighbour is a partial aggregate,
    and only nodes where something changes are told; the edges of a hub never meet in one task."""
    edges = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    edges = stage(edges.distinct(), "edges")
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        between = both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"), F.max("v").alias("top")).filter("m < v and top > v").select("v", "m")
        large, moved = _told(edges, between, "v")
        if moved:
            large = stage(large.select("u", F.coalesce("m", "v").alias("v")), "edges")
        several = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")).filter("m < top").select("u", "m")
        small, hung = _told(large, several, "u")
        if not hung and not moved:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).distinct()
        stays = F.col("m").isNull() | (F.col("v") == F.col("m"))
        edges = stage(small.select(F.when(stays, F.col("u")).otherwise(F.col("v")).alias("u"), F.coalesce("m", "v").alias("v")), "edges") if hung else large
    raise RuntimeError(f"components have not settled in {most} rounds")


def _told(edges: DataFrame, facts: DataFrame, key: str, most: int = 1_000_000) -> tuple[DataFrame, bool]:
    """edges with m of facts (null if there is none), and whether there are any facts. So many (16 MB)
    are broadcast; more meet the edges by salted keys."""
    facts = stage(facts, "facts")
    n = facts.count()
    if not n:
        return edges, False
    if n <= most:
        return edges.join(F.broadcast(facts), key, "left"), True
    return attach(edges, facts, [key], F.xxhash64(*[c for c in edges.columns if c != key]), runs_for(edges.count())), True


def _fetch_sets(slim: DataFrame, entities: DataFrame, ents: DataFrame) -> DataFrame:
    """ent, tokens of the entities asked for. Texts are read again, but only documents whose slot
    holds a wanted one are made into sets; nothing but those sets is shuffled. Slots grow in number
    with what is asked for, so that few other documents are made into sets and shuffled."""
    one = stage(entities.join(ents.hint("merge"), "ent", "left_semi").select(F.col("slot").cast("long").alias("slot")), "slots")
    wanted = slim.sparkSession.sparkContext.broadcast(bitmap_of(one, "slot", one.count()))
    sets = slim.mapInArrow(_emit_sets(wanted), "ent long, tokens binary")
    return stage(sets.join(ents.hint("merge"), "ent", "left_semi").dropDuplicates(["ent"]), "sets")


def _sets_of(sets: DataFrame, ents: DataFrame) -> DataFrame:
    """The sets of a staged table of entities. A bitmap of these goes to the sets first: others are not
    shuffled but for one in 128."""
    asked = sets.sparkSession.sparkContext.broadcast(bitmap_of(ents, "ent", ents.count()))
    return stage(sets.mapInArrow(_emit_asked(asked), "ent long, tokens binary").join(ents.hint("merge"), "ent", "left_semi"), "sets")


def _linked(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """The pairs that are links. AQE splits the pairs of a leader that has many; its set is one row."""
    x = sets.select(F.col("ent").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("ent").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").mapInArrow(_verify(num), "a long, b long")


def _blocks(pairs: DataFrame, sets: DataFrame, tiles: int) -> tuple[DataFrame, DataFrame]:
    """a, b, t1, t2 of pairs, and u1, u2, ent, tokens of the sets that each block (t1, t2) of them needs.
    Entities are dealt to tiles by their hash: a set is in `tiles` blocks at most, in however many pairs."""
    tile = lambda c: F.pmod(F.col(c), F.lit(tiles)).cast("int")
    placed = pairs.select("a", "b", F.least(tile("a"), tile("b")).alias("t1"), F.greatest(tile("a"), tile("b")).alias("t2"))
    needed = placed.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.explode(F.array("a", "b")).alias("ent")).distinct()
    return placed, needed.join(sets.hint("merge"), "ent")


def _linked_in_blocks(pairs: DataFrame, sets: DataFrame, num: int, most: int = 1 << 16, most_tokens: int = 1 << 21) -> DataFrame:
    """The pairs (staged) that are links, where an entity has many pairs. Its set does not go with each
    of them but once to each block of about `most` pairs and twice most_tokens tokens at most. Of fewer
    pairs there are more blocks, of 4,096 pairs or so, up to 16 tiles."""
    n, tokens = pairs.count(), (sets.agg(F.sum(F.length("tokens"))).first()[0] or 0) // 8
    tiles = max(1, min(16, math.ceil((2 * n / 4096) ** 0.5)), math.ceil((2 * n / most) ** 0.5), -(-tokens // most_tokens))
    parts = min(4096, tiles * tiles)
    placed, held = _blocks(pairs, sets, tiles)
    grouped = placed.repartition(parts, "t1", "t2").groupBy("t1", "t2").cogroup(held.repartition(parts, "u1", "u2").groupBy("u1", "u2"))
    return grouped.applyInArrow(_verify_block(num), "a long, b long")


def _buckets(rows: DataFrame, hot_rows: int) -> DataFrame:
    """sig, ent, n, single, m (entities of the signature), lead (the smallest), for m > 1, staged.

    Entities of a signature meet by a window. A signature of many rows does not: those that a
    thirty-second of the entities shows to have more than about `hot_rows` are counted by partial
    aggregates, and members meet only the count and the lead. They are at most 2 ** 20, a table of
    8 MB; which way a signature takes changes no result."""
    spark = rows.sparkSession
    seen = rows.filter("pmod(ent, 32) = 5").groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") * 32 > hot_rows)
    hot = stage(seen.orderBy(F.desc("c"), "sig").limit(1 << 20).select("sig"), "hot")
    some = not hot.isEmpty()
    cold = rows.join(F.broadcast(hot), "sig", "left_anti") if some else rows
    once = cold.repartition("sig").dropDuplicates(["sig", "ent"])
    found = once.selectExpr("*", "count(1) over (partition by sig) as m", "min(ent) over (partition by sig) as lead").filter("m > 1")
    if some:
        own = stage(rows.join(F.broadcast(hot), "sig", "left_semi").groupBy("sig", "ent").agg(F.first("n").alias("n"), F.first("single").alias("single")), "hot-members")
        facts = stage(own.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min("ent").alias("lead")), "hot-facts")  # a row for each of at most 2 ** 20
        found = found.unionByName(own.join(F.broadcast(facts), "sig").filter("m > 1").select(*found.columns))
    return stage(found, "buckets")


def _met(small: DataFrame, num: int) -> DataFrame:
    """Pairs a < b of small buckets that may be links by their sizes and by what they share."""
    right = small.select("sig", F.col("ent").alias("b"), F.col("n").alias("nb"), F.col("single").alias("sb"))
    near = (F.col("ent") < F.col("b")) & (100 * F.least("n", "nb") >= num * F.greatest("n", "nb"))
    met = (small.join(right.hint("merge"), "sig").filter(near).groupBy(F.col("ent").alias("a"), "b")
           .agg(F.count(F.lit(1)).alias("s"), F.first("n").alias("na"), F.first("nb").alias("nb"), F.first(F.col("single") & F.col("sb")).alias("single")))
    # Tokens of the shorter prefix in common, and all that lies behind it, must reach the overlap.
    needed = F.ceil(num * (F.col("na") + F.col("nb")) / F.lit(100 + num)) - F.ceil(num * F.greatest("na", "nb") / F.lit(100)) + 1
    return met.filter(~F.col("single") | (F.col("s") >= needed)).select("a", "b")


def _stars(large: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's leader."""
    return large.filter("ent != lead").select(F.col("lead").alias("a"), F.col("ent").alias("b")).distinct()


def _unresolved(large: DataFrame, comps: DataFrame) -> DataFrame:
    """Buckets that hold more than one component."""
    own = large.join(comps.hint("merge"), F.col("ent") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "ent"))
    ends = own.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("sig")
    return large.join(stage(ends, "open").hint("merge"), "sig", "left_semi")


ROUNDS = 8  # of tile pairs at a time


def _family_tiles(stars: DataFrame, sizes: DataFrame, comps: DataFrame, most_tokens: int = 1 << 21, most: int = 2048) -> DataFrame:
    """Families are the entities that the largest buckets connect. ent, fam, own (tile), ta, tb of the
    members of each family that has several components: members of the largest component are dealt into
    `ta` tiles with negative numbers, the others into `tb`. A tile has a sixth of a family, 128 to `most`
    members and about most_tokens tokens at most."""
    family = components(stars)
    members = family.select(F.col("node").alias("ent"), F.col("comp").alias("fam")).unionByName(family.select(F.col("comp").alias("ent"), F.col("comp").alias("fam")).distinct())
    own = stage(members.join(sizes.hint("merge"), "ent").join(comps.hint("merge"), F.col("ent") == F.col("node"), "left").select("ent", "fam", "n", F.coalesce("comp", "ent").alias("comp")), "members")
    each = own.groupBy("fam", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    facts = each.groupBy("fam").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("all"), F.max("n").alias("long"), F.max(F.struct("c", "comp")).alias("main"))
    tile = F.least(F.greatest(F.col("all") / 6, F.least(F.lit(128), F.lit(most))), F.lit(most), F.greatest(F.lit(most_tokens) / F.col("long"), F.lit(16)))
    facts = facts.filter("kinds > 1").select("fam", F.col("main.comp").alias("main"), F.ceil(F.col("main.c") / tile).cast("int").alias("ta"), F.ceil((F.col("all") - F.col("main.c")) / tile).cast("int").alias("tb"))
    # The facts are one row of a staged table, so that AQE can split a family's members.
    placed = own.join(stage(facts, "families").hint("merge"), "fam").withColumn("inner", F.col("comp") == F.col("main"))
    tile_of = F.pmod(F.xxhash64("ent"), F.when(F.col("inner"), F.col("ta")).otherwise(F.col("tb"))).cast("int")
    return placed.select("ent", "fam", F.when(F.col("inner"), -1 - tile_of).otherwise(tile_of).alias("own"), "ta", "tb")


def _tile_pairs(placed: DataFrame, first: int, last: int) -> DataFrame:
    """fam, ent, t1, t2, side of the pairs of tiles of the rounds first to last - 1. In round r tile t of the
    others meets tile t + r (modulo tb), and tile m of the largest component, whose members do not meet
    each other, meets tile m + r. So each pair of tiles meets in one round, and a round has at most
    two rows of each member for the one and as many as both sides have members for the other."""
    rounds = placed.withColumn("r", F.explode(F.sequence(F.lit(first), F.lit(last - 1)))).filter("r < tb")
    pair = lambda a, b: f"struct(least({a}, {b}) as t1, greatest({a}, {b}) as t2, if({a} = {b}, -1, if({a} < {b}, 0, 1)) as side)"
    after, before = "pmod(own + r, tb)", "pmod(own - r, tb)"
    among = f"case when 2 * r > tb then array() when r = 0 or 2 * r = tb then array({pair('own', after)}) else array({pair('own', after)}, {pair('own', before)}) end"
    main = f"if({before} < ta, transform(sequence({before}, ta - 1, tb), m -> struct(-1 - m as t1, own as t2, 1 as side)), array())"
    met = F.expr(f"if(own < 0, array(struct(own as t1, pmod(r - 1 - own, tb) as t2, 0 as side)), concat({among}, {main}))")
    return rounds.select("fam", "ent", F.explode(met).alias("p")).select("fam", "ent", "p.t1", "p.t2", "p.side")


def _tiled_links(placed: DataFrame, sets: DataFrame, comps: DataFrame, num: int) -> Iterator[DataFrame]:
    """Links of families, some rounds of tile pairs at a time: what is staged at once is a fixed multiple of the
    members. The caller sends the components that the links make; families of one component drop out."""
    longest = placed.agg(F.max("tb")).first()[0] or 0
    for first in range(0, longest, ROUNDS):
        own = placed.filter(F.col("tb") > first).join(comps.hint("merge"), F.col("ent") == F.col("node"), "left").select(*placed.columns, F.coalesce("comp", "ent").alias("comp"))
        own = stage(own, "members")
        open_ = own.groupBy("fam").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("fam")
        tiles = _tile_pairs(own.join(stage(open_, "families").hint("merge"), "fam", "left_semi"), first, first + ROUNDS)
        tiles = stage(tiles.join(own.select("ent", "comp").hint("merge"), "ent"), "tiles")
        found = tiles.join(sets.hint("merge"), "ent").groupBy("fam", "t1", "t2").applyInArrow(_tile(num), "a long, b long")
        comps = yield stage(found, "links")


def find_links(slim: DataFrame, num: int, least: int, bucket: int = 64, hot_rows: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities (ent, low, slot, n), described (_id, ent, n, by document) and comps (node, comp) of entities.

    All links whose signatures meet in buckets of up to `bucket` entities are verified; that limit
    does not depend on the corpus. In larger buckets each entity is compared with the bucket's leader.
    Where that leaves several components, the entities are indexed again, by combinations of all
    tokens of a hash group, the rarest first: documents that only share a passage then part, and
    links meet in the smaller buckets. What is in larger ones still are families of much the same text:
    again members are compared with leaders, and what is in different components after that by
    tiles, in which all sets are compared and as many links returned as join components. So
    components are exact, and no step makes all pairs of a group. Comparisons inside a family are
    quadratic in its unlinked members; rows of any one step are not, because tiles meet in rounds.
    """
    total = int(slim.agg(F.sum(F.length("_text"))).first()[0] or 0) // 6
    classes = count_tokens(slim, total, least)
    free_shuffles(slim.sparkSession)
    shared = slim.sparkSession.sparkContext.broadcast(classes)
    kind = dict(slim.dtypes)["_id"]
    emitted = stage(slim.mapInArrow(_emit_signatures(shared, num), f"_id {kind}, _slot int, check long, sig long, ent long, n int, single boolean"), "signatures")
    shared.unpersist()
    described = emitted.filter("sig is null").select("_id", "_slot", "n", "ent", "check")
    entities = stage(described.groupBy("ent").agg(F.min("_id").alias("low"), F.min("_slot").alias("slot"), F.first("n").alias("n"), F.min("check").alias("c1"), F.max("check").alias("c2")), "entities")
    if not entities.filter("c1 != c2").isEmpty():
        raise RuntimeError("two sets of shingles have one name of 64 bits: use another width")

    buckets = _buckets(emitted.filter("sig is not null").select("sig", "ent", "n", "single"), hot_rows)
    large = buckets.filter(F.col("m") > bucket)
    pairs = stage(_met(buckets.filter(F.col("m") <= bucket), num).unionByName(_stars(large)).distinct(), "pairs")
    free_shuffles(slim.sparkSession)
    ents = pairs.select(F.col("a").alias("ent")).unionByName(pairs.select(F.col("b").alias("ent"))).distinct()
    sets = _fetch_sets(slim, entities, ents)
    free_shuffles(slim.sparkSession)
    links = stage(_linked(pairs, sets, num), "links")
    comps = components(links)
    free_shuffles(slim.sparkSession)

    crowd = stage(_unresolved(large, comps).select("ent").distinct(), "crowd")
    if crowd.isEmpty():
        return entities, described, comps
    sets = _sets_of(sets, crowd)  # all that is compared from here on is in the crowd
    buckets = _buckets(_rarest(_deep_signatures(sets, num)), hot_rows // 100)  # few rows, and families among them
    large = buckets.filter(F.col("m") > bucket)
    more = _met(buckets.filter(F.col("m") <= bucket), num).unionByName(_stars(large)).distinct().join(pairs.hint("merge"), ["a", "b"], "left_anti")
    links = links.unionByName(stage(_linked_in_blocks(stage(more, "pairs"), sets, num), "links"))
    comps = components(links)
    free_shuffles(slim.sparkSession)

    stars = stage(_stars(_unresolved(large, comps)), "stars")
    if stars.isEmpty():
        return entities, described, comps
    placed = stage(_family_tiles(stars, entities.select("ent", "n"), comps), "placed")
    found = _tiled_links(placed, sets, comps, num)
    more = next(found, None)
    while more is not None:
        links = links.unionByName(more)
        comps = components(links)
        try:
            more = found.send(comps)
        except StopIteration:
            more = None
    return entities, described, comps


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, least: int = 32, bucket: int = 64, hot_rows: int = 100_000) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links, its own included), one row
    for each row of docs. Two documents link when num / 100 of the union of their shingle sets is
    common (num >= 60). The join is exact up to collisions of 64-bit hashes of single shingles;
    sets are named by 64 bits, and a second hash proves that no two sets share a name.

    Texts are whole; documents with equal sets are one entity, however many. Null and empty texts
    have no shingles and their own id. Null ids never name a component that has another id;
    repeated ids are linked by their texts only. Other columns are ignored; an empty table gives
    an empty result. Texts are read three times and never shuffled; token counts go by hash range,
    frequent tokens and bitmaps that are broadcast have fixed size bounds.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), F.pmod(F.xxhash64(id_col), F.lit(SLOTS)).cast("int").alias("_slot"), F.lit(width).alias("_width"))
    entities, described, comps = find_links(slim, num, least, bucket, hot_rows)
    named = entities.filter("n > 0").join(comps.hint("merge"), entities["ent"] == comps["node"], "left").select("ent", "low", F.coalesce("comp", "ent").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    found = named.join(lowest.hint("merge"), "comp").select("ent", "component_id")
    out = attach(described, found, ["ent"], F.xxhash64("_id"), runs_for(described.count()))
    return out.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80) -> DataFrame:
    """docs with one document of each component, that of the smallest id; columns as in docs, whatever
    their names.

    A document is an id and a text: unlike texts under a repeated or null id are apart, each in the
    component of its text, and of rows that repeat both one stays. A null id loses to any other.
    Documents without words stay. An empty table gives an empty one."""
    rows = keyed(docs, id_col, text_col)
    key = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    found = jaccard_components(rows.select(key.alias("key"), "text"), "key", "text", width, num)
    kept = found.filter(F.col("key") == F.col("component_id")).select("key.k1", "key.k2").distinct()
    return keep_keyed(rows, kept)
