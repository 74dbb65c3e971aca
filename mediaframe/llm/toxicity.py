"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .decontaminate import words_of
from .quality import sample_labelled

#: Fixed lexicon of insults; each word is a voter.
INSULTS = """bastard brainless clown coward creep cretin crybaby degenerate despicable disgusting dumb filth fool freak
    garbage idiot imbecile jerk liar loser lowlife maggot moron pathetic parasite pig rat scum shameless sicko slob
    stupid trash twit ugly useless vermin vile weirdo worthless""".split()
#: Fixed patterns over the raw text; each is a voter.
PATTERNS = {
    "you are": re.compile(r"\byou(?:'re| are)? (?:an? |such an? |all )?(?:" + "|".join(INSULTS) + r")s?\b", re.IGNORECASE),
    "masked": re.compile(r"\b(?:st[*u]p[*i]d|[i1]d[i1]0t|m[0o]r[0o]n|l[0o]s[3e]r|tr[@4]sh|sc[*v]m)\b", re.IGNORECASE),
    "get out": re.compile(r"\b(?:shut up|go away|get lost|drop dead|nobody likes you|hate you)\b", re.IGNORECASE),
}
STEM = 7  # bytes of a word that a stem voter looks at


def mined(words: list[set[bytes]], labels: np.ndarray, least: int = 2, most: int = 1500) -> list[bytes]:
    """Words whose share of labelled-toxic texts is beyond what chance makes of so many words
    (binomial large deviation against the log of their number), the most telling first."""
    pos, every = Counter(), Counter()
    for w, y in zip(words, labels, strict=True):
        every.update(w)
        if y:
            pos.update(w)
    kinds = sum(n >= least for n in every.values())
    if not kinds or not 0 < labels.mean() < 1:
        return []
    base = float(labels.mean())
    found = {}
    for w, c in pos.items():
        n, share = every[w], c / every[w]
        if n >= least and share > base:
            away = n * (share * np.log(share / base) + ((1 - share) * np.log((1 - share) / (1 - base)) if share < 1 else 0))
            if away > np.log(kinds) + 1 and share > 0.6:
                found[w] = away
    return sorted(found, key=lambda w: (-found[w], w))[:most]


def votes(texts: list[str], words: list[set[bytes]], lexicon: list[bytes], stems: list[bytes]) -> np.ndarray:
    """texts x voters: 1 toxic, 0 abstains. The last voter votes -1, clean, where no other votes."""
    out = np.zeros((len(texts), len(lexicon) + len(stems) + len(PATTERNS) + 1), np.int8)
    at, stem_at = {w: k for k, w in enumerate(lexicon)}, {s: len(lexicon) + k for k, s in enumerate(stems)}
    for i, (t, w) in enumerate(zip(texts, words, strict=True)):
        hit = [at[x] for x in w if x in at] + [stem_at[x[:STEM]] for x in w if x[:STEM] in stem_at]
        hit += [len(lexicon) + len(stems) + k for k, p in enumerate(PATTERNS.values()) if p.search(t)]
        out[i, hit] = 1
        out[i, -1] = 0 if hit else -1
    return out


@dataclass
class LabelModel:
    """P(vote | class) for each voter, the strength of each voter after its correlations with
    others are discounted, and the share of toxic texts."""

    prior: float
    p_toxic: np.ndarray
    p_clean: np.ndarray
    strength: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """A voter that abstains says nothing."""
        z = np.log(self.prior / (1 - self.prior)) + (v != 0) @ (self.strength * np.log(self.p_toxic / self.p_clean))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(v: np.ndarray, prior: float, rounds: int = 12) -> LabelModel:
    """Expectation maximisation without labels. Correlations: within the classes as they are
    estimated, voters that fire together more than independent ones would share their evidence."""
    fired = (v != 0).astype(float)
    p = np.where((v == 1).sum(1) > 0, 0.9, 0.02)
    model = None
    for _ in range(rounds):
        n1, n0 = p.sum(), (1 - p).sum()
        a = (p @ fired + 0.02) / (n1 + 1)
        b = ((1 - p) @ fired + 0.02) / (n0 + 1)
        a[-1], b[-1] = min(a[-1], 0.1), max(b[-1], 0.5)
        a, b = np.clip(a, 1e-5, 1 - 1e-5), np.clip(b, 1e-5, 1 - 1e-5)
        centred = fired - np.where(p[:, None] > 0.5, a, b)
        sd = np.sqrt((centred**2).mean(0) + 1e-9)
        corr = (centred.T @ centred) / len(v) / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        strength = 1 / np.sqrt(1 + np.maximum(corr - 0.1, 0).sum(1))
        model = LabelModel(float(np.clip(prior, 0.005, 0.5)), a, b, strength)
        p = model.posterior(v)
    return model


@dataclass
class ToxicityModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    patterns: list[float] = field(default_factory=lambda: [0.0] * len(PATTERNS))
    bias: float = -3.0

    def logit(self, text: str | None) -> float:
        if not text:
            return self.bias
        found = self.weights.keys() & set(words_of(text.encode("utf-8", "replace")))
        z = self.bias + sum(self.weights[w] for w in found)
        return z + sum(w for w, p in zip(self.patterns, PATTERNS.values(), strict=True) if w and p.search(text))

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.logit(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], labels: np.ndarray, epochs: int = 30, rate: float = 0.5, decay: float = 1e-5, seed: int = 5) -> ToxicityModel:
    words = [set(words_of(t.encode("utf-8", "replace"))) for t in texts]
    found = mined(words, labels)
    lexicon = list(dict.fromkeys([*found, *(w.encode() for w in INSULTS)]))
    stems = Counter(w[:STEM] for w in found if len(w) > STEM)
    used = Counter(s for w in words for s in {x[:STEM] for x in w if len(x) > STEM})
    hit = Counter(s for w, y in zip(words, labels, strict=True) if y for s in {x[:STEM] for x in w if len(x) > STEM})
    stems = [s for s, n in sorted(stems.items()) if n >= 3 and hit[s] > 0.9 * used[s]]
    v = votes(texts, words, lexicon, stems)
    truth = labels.mean() if len(labels) else 0.1
    posterior = fit_label_model(v, float(truth)).posterior(v)
    # A linear classifier of the same words and patterns on the posterior labels.
    feats = [[k for k in np.flatnonzero(row[: len(lexicon)] == 1)] + [len(lexicon) + k for k in np.flatnonzero(row[len(lexicon) + len(stems): -1] == 1)] for row in v]
    w, b = np.zeros(len(lexicon) + len(PATTERNS)), -2.0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(feats)):
            f = feats[i]
            g = 1 / (1 + np.exp(-np.clip(w[f].sum() + b, -30, 30))) - posterior[i]
            w[f] -= lr * (g + decay * w[f])
            b -= 0.05 * lr * g
    # An insult or pattern that the sample lacks counts as much as the median of the insults it has.
    seen = (v[:, : len(lexicon)] != 0).any(0)
    strong = w[: len(lexicon)][seen & (w[: len(lexicon)] > 0)]
    usual = 0.8 * float(np.median(strong)) if len(strong) else 4.0
    weights = {x: float(w[k]) if seen[k] else usual for k, x in enumerate(lexicon)}
    matched = (v[:, len(lexicon) + len(stems): -1] != 0).any(0)
    return ToxicityModel(weights, [float(x) if m else usual for x, m in zip(w[len(lexicon):], matched, strict=True)], float(b))


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fits on at most `most` labelled rows of docs. Without any, the fixed lexicon and patterns decide."""
    sample = sample_labelled(docs, labels, "toxic", most, id_col, text_col)
    if not len(sample):
        return ToxicityModel({w.encode(): 4.5 for w in INSULTS}, [4.5] * len(PATTERNS))
    return train(sample.text.tolist(), sample.label.to_numpy())
