"""Licences in texts, by a positional index of their rare words.

Each template (a phrase or a notice) has an index entry for each of its words: where in the template it
stands. What a word is worth is its inverse document frequency over the scanned corpus. A template found
to a share of `limit` of its worth must agree in one of its dearest words whose worth together is more
than the rest, so only the places of those words are looked up in a file; each place and posting gives
a relative position, at which the template's other words are then compared and its key phrases verified.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 4 << 20  # bytes of a text that are split into words at a time


@dataclass(frozen=True)
class Template:
    """label; words of the text; phrases that must stand in it word by word. An exact template must agree in
    all words; others in most of their worth, a word or two of difference in place allowed."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    exact: bool = False


#: Phrases whose every place counts.
BASE = (
    Template("gpl", "gnu general public license", exact=True),
    Template("apache", "apache license", exact=True),
    Template("cc-by", "cc by", exact=True),
    Template("mit", "mit license", exact=True),
)

#: Public licence notices, with what must not be missing from them.
NOTICES = (
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    Template("apache-2.0", "licensed under the apache license version 2.0", ("apache license", "version 2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms",)),
    Template("cc-by-4.0", "licensed under cc by 4.0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by-nc 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by-sa 4.0", ("cc by sa 4 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
             ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
)

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII; A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def codes_of(text: str, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a text, -1 for words that no template has."""
    data, parts, at = text.encode("utf-8", "surrogatepass").translate(_TABLE), [], 0
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        parts.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


class LicenseIndex:
    """Templates, the worth of their words, and for the words that are looked up where they stand."""

    def __init__(self, templates: tuple[Template, ...], vocabulary: dict[bytes, int], worth: np.ndarray, limit: float, slack: int) -> None:
        self.templates, self.vocabulary, self.limit, self.slack = templates, vocabulary, limit, slack
        self.codes = [np.array([vocabulary[w] for w in words_of(t.text)], np.int32) for t in templates]
        self.phrases = [[np.array([vocabulary[w] for w in words_of(p)], np.int32) for p in t.phrases] for t in templates]
        self.worth = [worth[c] for c in self.codes]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            spare, found = self.worth[k].sum() * (0.0 if t.exact else 1 - limit), 0.0
            for q in sorted(range(len(self.codes[k])), key=lambda q: (-self.worth[k][q], q)):
                self.postings.setdefault(int(self.codes[k][q]), []).append((k, q))
                found += self.worth[k][q]
                if found > spare + 1e-9:
                    break
        self.rare = np.zeros(len(vocabulary) + 1, bool)  # the last is for -1
        self.rare[list(self.postings)] = True

    def _shifted(self, codes: np.ndarray, at: int, k: int) -> float:
        """The share of the template's worth whose words stand within `slack` of their place from `at` on."""
        t, s = self.codes[k], self.slack
        window = np.full(len(t) + 2 * s, -2, np.int32)
        low, high = max(0, at - s), min(len(codes), at + len(t) + s)
        window[low - at + s:high - at + s] = codes[low:high]
        there = (np.lib.stride_tricks.sliding_window_view(window, 2 * s + 1) == t[:, None]).any(axis=1)
        return float(self.worth[k][there].sum() / self.worth[k].sum())

    def find(self, codes: np.ndarray) -> list[tuple[int, int, float]]:
        """(start, template, share) of the places where a template is found, in order. Of tolerant templates
        the best of overlapping places is told, the first of equals."""
        seen: set[tuple[int, int]] = set()
        for p in np.flatnonzero(self.rare[codes]).tolist():
            seen.update((k, p - q) for k, q in self.postings[int(codes[p])])
        found: list[tuple[int, int, float]] = []
        loose: dict[int, list[tuple[int, float]]] = {}
        for k, at in sorted(seen):
            t = self.codes[k]
            if self.templates[k].exact:
                if 0 <= at <= len(codes) - len(t) and np.array_equal(codes[at:at + len(t)], t):
                    found.append((at, k, 1.0))
                continue
            share = self._shifted(codes, at, k)
            if share >= self.limit:
                window = codes[max(0, at - self.slack):at + len(t) + self.slack]
                if all(_holds(window, phrase) for phrase in self.phrases[k]):
                    loose.setdefault(k, []).append((max(0, at), share))
        for k, places in loose.items():
            end = -1
            for at, share in sorted(places, key=lambda x: (x[0], -x[1])):
                if at < end:
                    if share > found[-1][2]:
                        found[-1] = (at, k, share)
                        end = at + len(self.codes[k])
                else:
                    found.append((at, k, share))
                    end = at + len(self.codes[k])
        return sorted(found)


def _holds(codes: np.ndarray, phrase: np.ndarray) -> bool:
    return len(codes) >= len(phrase) and bool((np.lib.stride_tricks.sliding_window_view(codes, len(phrase)) == phrase).all(axis=1).any())


def fit_index(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = BASE + NOTICES, limit: float = 0.8, slack: int = 2) -> LicenseIndex:
    """The index of templates, with document frequencies of their words from all whole texts. The driver gets
    one number for each word of the templates."""
    vocabulary: dict[bytes, int] = {}
    for t in templates:
        for text in (t.text, *t.phrases):
            for w in words_of(text):
                vocabulary.setdefault(w, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen[-1] += 1
                seen.update(c for c in np.unique(codes_of(text or "", vocabulary)).tolist() if c >= 0)
        yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.int32()), "n": pa.array(seen.values(), pa.int64())})

    counts = {r.word: r.n for r in docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    worth = np.array([1 + log((counts.get(-1, 0) + 1) / (counts.get(c, 0) + 1)) for c in range(len(vocabulary))])
    return LicenseIndex(templates, vocabulary, worth, limit, slack)


PLACES = "array<struct<label: string, start: long, n_words: long, share: double, exact: boolean>>"


def scan_licenses(docs: DataFrame, index: LicenseIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, places (label, start in words, n_words, share, exact) for each row of docs, from the whole
    text. Null and empty texts have no words and no places; null and repeated ids are ordinary rows; other
    columns are not looked at; an empty table gives an empty result. Places of exact templates are all told,
    overlapping ones too; tolerant templates are found where `limit` of their worth stands."""
    index = index or fit_index(docs, text_col)
    told = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = told.value
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64()), ("exact", pa.bool_())]))
        for b in batches:
            counts, places = [], []
            for text in b.column(1).to_pylist():
                codes = codes_of(text or "", x.vocabulary)
                counts.append(len(codes))
                places.append([{"label": x.templates[k].label, "start": at, "n_words": len(x.codes[k]), "share": share, "exact": x.templates[k].exact} for at, k, share in x.find(codes)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(places, kind)], names=[b.schema.names[0], "n_words", "places"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, places {PLACES}").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and labels: base ones from exact places, and those of all places; score is the best share."""
    base = F.filter("places", lambda p: p["exact"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    return found.select(F.col(f"`{id_col}`"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))
