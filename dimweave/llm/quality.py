"""Quality by pairwise ranking: a Bradley-Terry model on features of form, thresholded at a score quantile.

``train`` takes every pair of labelled training rows as a preference (a document labelled good is preferred to
one labelled bad) and fits document scores, linear in the features, by the logistic loss on feature
differences. The pairs are never made: Newton's method needs their sums alone, and these follow from how many
rows of each class, with which features, score about how much. The texts stay where they lie: they become features
before the labels are joined to them, and a pass over the labelled rows' features
adds them up on a grid of scores ``STEP`` apart (a row counts with both neighbouring grid points, so a pair's chance
is off by less than 0.001). The threshold is the quantile of the scores of all training rows at the share of
bad labels, found by counting. ``score`` maps a raw score r to
sigmoid(r - threshold + logit(CUT)), so a document is kept from ``CUT`` on.

Features are counts of the whole text: letters' case, digits, spaces, punctuation, other signs,
repeated words, word pairs and lines, entropy, lengths. Label, language, source and key are none.

Edge cases: a NULL text scores as an empty one. Very long texts are read whole. Without labels, or with one class only, every score is
``CUT`` (nothing is known against a document). Repeated rows are scored one by one. An empty table
gives an empty result. ``score`` returns the ``keep`` columns and ``score, predicted``; an input column
of one of these names is left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from dimweave.llm.common import saved
from dimweave.llm.labelled import label_shares, training_features
from dimweave.llm.scoring import keep_texts, score_texts

CUT = 0.7
STEP = 0.25
GRID = np.arange(-32, 32 + STEP, STEP)
CELLS = 4096
ROUNDS = 20
_PLAIN = frozenset(".,;:'\"-?()")


def features(text: str) -> list[float]:
    words, chars = text.split(), Counter(text)
    n, length = max(1, len(words)), max(1, len(text))
    upper = digits = spaces = marks = other = 0
    for sign, k in chars.items():
        if sign.isalpha():
            upper += k * sign.isupper()
        elif sign.isdigit():
            digits += k
        elif sign.isspace():
            spaces += k
        elif sign in _PLAIN:
            marks += k
        else:
            other += k
    counts = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x]
    entropy = -sum(k / n * math.log(k / n) for k in counts.values()) / math.log(n + 1)
    ends = sum(not w[-1].isalnum() for w in words)
    return [
        upper / length, digits / length, spaces / length, marks / length, other / length, other / n,
        repeats / n, 1 - pairs / max(1, len(words) - 1), max(counts.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)), entropy, ends / n, math.log1p(len(words)),
        length / n, len(counts) / n, len(lines) / n, chars["!"] / n, chars["|"] / n,
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return _curves((rows - self.mean) / self.scale) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        margin = self.raw(rows) - self.threshold + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _curves(z: np.ndarray) -> np.ndarray:
    """Each standardised feature as a line, a fold, a square and a root, so extremes on both sides can count."""
    z = np.clip(z, -8, 8)
    return np.hstack([z, np.abs(z), z * z / 4, np.sqrt(np.abs(z)) * np.sign(z)])


# What a pass takes from a block of rows (their classes and features): numbers to add up, and numbers whose least counts.
Part = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Passes = Callable[[Part], tuple[np.ndarray, np.ndarray]]


def _moments(passes: Passes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many rows the classes 0 and 1 have, and the features' mean and deviation."""

    def sums(good: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[(good == 0).sum(), (good == 1).sum()], rows.sum(axis=0)]), np.zeros(0)

    total = passes(sums)[0]
    if not len(total):
        return np.zeros(2), total, total
    mean = total[2:] / total[:2].sum()
    squares = passes(lambda good, rows: (((rows - mean) ** 2).sum(axis=0), np.zeros(0)))[0]
    return total[:2], mean, np.sqrt(squares / total[:2].sum()) + 1e-9


def _weights(passes: Passes, counts: np.ndarray, curves: Callable[[np.ndarray], np.ndarray], width: int, penalty: float) -> np.ndarray:
    """Bradley-Terry weights over all pairs of a good and a bad row, by Newton's method with halved steps where the loss grows."""
    n = len(GRID)

    def on_grid(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (np.clip(scores, GRID[0], GRID[-1]) - GRID[0]) / STEP
        low = np.minimum(at.astype("i8"), n - 2)
        return low, at - low

    def gathered(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each class and grid point: its share of the class's rows, and their features added up."""

        def part(good: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = curves(rows)
            low, upper = on_grid(z @ w)
            out = np.zeros((2 * n, 1 + width))
            for point, weight in ((low, 1 - upper), (low + 1, upper)):
                np.add.at(out, good * n + point, np.hstack([weight[:, None], z * weight[:, None]]))
            return out.ravel(), np.zeros(0)

        out = passes(part)[0].reshape(2, n, 1 + width) / counts[:, None, None]
        return out[:, :, 0], out[:, :, 1:]

    apart = GRID[None, :] - GRID[:, None]  # bad score less good score: good, bad
    wrong = 1 / (1 + np.exp(-np.clip(apart, -30, 30)))
    w, held, best = np.zeros(width), np.zeros(width), np.inf
    for _ in range(ROUNDS):
        (bad, good), (bad_z, good_z) = gathered(w)
        loss = good @ np.logaddexp(0, apart) @ bad + penalty * (w @ w) / 2
        if loss > best:
            w = (w + held) / 2
            continue
        held, best = w, loss
        gradient = (good @ wrong) @ bad_z - (wrong @ bad) @ good_z + penalty * w
        if np.abs(gradient).max() < 1e-6:
            break
        bend = wrong * (1 - wrong)
        own = np.stack([good @ bend, bend @ bad])  # of a bad row and of a good row, by its score

        def part(good: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = curves(rows)
            low, upper = on_grid(z @ w)
            weight = ((1 - upper) * own[good, low] + upper * own[good, low + 1]) / counts[good]
            return ((z * weight[:, None]).T @ z).ravel(), np.zeros(0)

        across = good_z.T @ bend @ bad_z
        curvature = passes(part)[0].reshape(width, width) - across - across.T + penalty * np.eye(width)
        # what the grid rounds off could make a direction without any slope bend downwards
        values, vectors = np.linalg.eigh((curvature + curvature.T) / 2)
        w = w - vectors @ ((vectors.T @ gradient) / np.maximum(values, penalty))
    return held


def _quantile(passes: Passes, counts: np.ndarray, raw: Callable[[np.ndarray], np.ndarray], bad_share: float) -> float:
    """Midway between the least score up to which the rows weigh ``bad_share``, each class its share, and the next score."""
    each = np.array([bad_share, 1 - bad_share]) / counts
    low, high = -np.inf, np.inf
    edges = None
    while True:

        def part(good: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            scores = raw(rows)
            inside = scores[(scores > low) & (scores <= high)]
            above = scores[scores > high]
            cells = np.zeros((2, CELLS + 2))
            if edges is not None:
                np.add.at(cells, (good, np.searchsorted(edges, scores, "left")), 1)
            return cells.ravel(), np.array([inside.min(initial=np.inf), -inside.max(initial=-np.inf), above.min(initial=np.inf)])

        cells, (least, most, after) = passes(part)
        most = -most
        if edges is not None:
            reached = np.cumsum(each @ cells.reshape(2, CELLS + 2)) >= bad_share * (1 - 1e-9)
            at = min(int(np.argmax(reached)), CELLS)
            at_low, at_high = (edges[at - 1] if at else low), edges[at]
            if (at_low, at_high) == (low, high):
                least = most  # no number lies between
            low, high, edges = at_low, at_high, None
            continue
        if least >= most or np.nextafter(least, np.inf) >= most:
            return float((most + after) / 2 if np.isfinite(after) else most)
        edges = np.linspace(least, most, CELLS + 1)


def _fit(passes: Passes, bad_share: float, penalty: float) -> QualityModel | None:
    counts, mean, scale = _moments(passes)
    if not counts.all():
        return None
    middle = passes(lambda good, rows: (_curves((rows - mean) / scale).sum(axis=0), np.zeros(0)))[0] / counts.sum()
    w = _weights(passes, counts, lambda rows: _curves((rows - mean) / scale) - middle, len(middle), penalty)
    model = QualityModel(mean, scale, w, 0.0)
    return QualityModel(mean, scale, w, _quantile(passes, counts, model.raw, bad_share))


def fit_pairs(rows: np.ndarray, good: np.ndarray, bad_share: float, penalty: float = 1e-3) -> QualityModel | None:
    """The model of rows in memory: Bradley-Terry weights on all pairs of a good and a bad row, and the quantile threshold."""
    return _fit(lambda part: part(good, rows), bad_share, penalty)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text_col: str = "text", penalty: float = 1e-3) -> QualityModel | None:
    """The model of all labelled training rows, or None when a class has none. A task's sums over its rows alone reach the driver."""
    shares = label_shares(labels, label, key)
    rows = saved(training_features(docs, labels, label, features, key, text_col), "quality-features")

    def passes(part: Part) -> tuple[np.ndarray, np.ndarray]:
        def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = least = None
            for batch in batches:
                if len(batch):
                    own, low = part(batch["label"].to_numpy(), np.stack(batch["x"].to_list()))
                    sums, least = (own, low) if sums is None else (sums + own, np.minimum(least, low))
            if sums is not None:
                yield pd.DataFrame({"sums": [sums.astype("f8").tobytes()], "least": [least.astype("f8").tobytes()]})

        found = rows.mapInPandas(gather, "sums binary, least binary").collect()
        if not found:
            return np.zeros(0), np.zeros(0)
        sums, least = (np.stack([np.frombuffer(r[c], dtype="f8") for r in found]) for c in ("sums", "least"))
        return sums.sum(axis=0), least.min(axis=0)

    return _fit(passes, shares.get(0, 0) / max(1, sum(shares.values())), penalty)


def _scorer(model: QualityModel | None):
    def make():
        def of(texts: list[str]) -> np.ndarray:
            if model is None or not texts:
                return np.full(len(texts), CUT)
            return model.scores(np.array([features(t) for t in texts]))

        return of

    return make


def score(docs: DataFrame, model: QualityModel | None, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    return score_texts(docs, _scorer(model), CUT, keep, text_col)


def keep_good(docs: DataFrame, model: QualityModel | None, text_col: str = "text") -> DataFrame:
    """The documents predicted good, with the columns of ``docs``."""
    return keep_texts(docs, _scorer(model), lambda scores: scores >= CUT, text_col)
