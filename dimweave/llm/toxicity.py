"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

1. A lexicon is induced from a bounded sample of labelled training rows: words and word beginnings of
   three to eight letters whose documents are labelled toxic far more often than the others; of those,
   the ones that cover the toxic texts at the least cost are chosen greedily, on equal evidence the
   longest. A beginning stands for words not seen, so several telling words must share it, and more
   of them a short one.
2. Voters look at a document: one for each kind of entry (word or beginning) and grade of its log odds,
   patterns (two and three words with entries, entries dense in the text, exclamation, capitals) and
   one that votes against when no entry is there. A voter votes 1, 0 or abstains.
3. A generative model of a hidden class estimates what each voter votes under either class
   (expectation maximisation on the counts of vote patterns; the labels give the first guess only).
   Voters that agree
   beyond what the class explains are correlated: the model estimates that from the votes' covariance
   within the classes and lets such voters share one weight.
4. A logistic regression on the entries found, the voters' patterns and their number is trained on the
   posteriors. It gives the score; ``CUT`` and more is toxic.

Edge cases: a NULL text scores as an empty one. Very long texts are read whole. Without labels, with one class only or without a
lexicon entry, every score is the share of toxic labels, kept below ``CUT``. Repeated rows are scored
one by one. An empty table gives an empty result. ``score`` returns the ``keep`` columns and
``score, predicted``; an input column of one of these names is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimweave.llm.common import saved
from dimweave.llm.labelled import PER_CLASS, label_shares, training_texts
from dimweave.llm.scoring import keep_texts, score_texts

CUT = 0.3
ENTRIES = 512
LEAST_DOCS = 5
LEAST_GAIN = 2
FALSE_COST = 2
LEAST_RATIO = 8.0
BEGINNINGS = (3, 4, 5, 6, 7, 8)
# So many telling words share a beginning at least; one of at most SHORT letters is common in other words too.
LEAST_WORDS, SHORT, LEAST_WORDS_SHORT = 2, 4, 8
GRADES = (5.0,)
# Capitals vote from this share of a text's letters on, if it has so many letters.
CAPITALS, LEAST_LETTERS = 0.4, 20
ABSTAIN = -1
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def entries_of(words: set[str]) -> set[str]:
    """The words, and their beginnings marked by a closing hyphen."""
    return words.union(*({w[:k] + "-" for w in words if len(w) >= k} for k in BEGINNINGS))


def shouted(text: str) -> bool:
    """The text has letters enough, and many of all its letters are capitals."""
    capitals = sum(map(str.isupper, text))
    if capitals < CAPITALS * LEAST_LETTERS:
        return False
    letters = sum(map(str.isalpha, text))
    return letters >= LEAST_LETTERS and capitals >= CAPITALS * letters


def entry_order(lexicon: dict[str, float]) -> list[str]:
    """Strong entries first; of equal ones the longest, and a word before a beginning as long."""
    return sorted(lexicon, key=lambda e: (-lexicon[e], -len(e.rstrip("-")), e.endswith("-"), e))


def induce_lexicon(sample: DataFrame, entries: int = ENTRIES) -> dict[str, float]:
    """Entry: log odds, of at most ``entries`` entries; ``sample`` has text and label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = (Counter(), Counter())
            for text, label in zip(batch["text"], batch["label"]):
                held[label].update(entries_of(words_of(text)))
            both = list(held[0] | held[1])
            yield pd.DataFrame({"entry": both, "pos": [held[1][e] for e in both], "neg": [held[0][e] for e in both]})

    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    summed = sample.mapInPandas(count, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (pos + 1) / ((F.col("neg") + 0.5) / (neg + 1)))
    telling = saved(summed.where("pos >= 2").withColumn("odds", odds).where(F.col("odds") >= float(np.log(LEAST_RATIO))), "toxicity-entries")
    beginning = F.col("entry").endswith("-")
    starts = F.transform(F.lit(list(BEGINNINGS)), lambda k: F.when(F.length("entry") >= k, F.concat(F.substring("entry", F.lit(1), k), F.lit("-"))))
    shared = telling.where(~beginning).select(F.explode(starts).alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("words"))
    needed = F.when(F.length("entry") - 1 <= SHORT, LEAST_WORDS_SHORT).otherwise(LEAST_WORDS)
    best = telling.where(F.col("pos") >= LEAST_DOCS).join(shared, "entry", "left").where(~beginning | (F.col("words") >= needed))
    # strong and frequent first: the log odds times the documents they tell apart
    chosen = best.orderBy(F.desc(F.col("odds") * (F.col("pos") - F.col("neg"))), F.desc(F.length("entry")), "entry").limit(entries)
    return {r["entry"]: r["odds"] for r in chosen.select("entry", "odds").collect()}


def choose_entries(order: list[str], has: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[str]:
    """The entries that cover the toxic texts, greedily: ``has[i, e]`` says text i has entry ``order[e]``.

    A toxic text counts half as much with each entry that covers it, so a word that only copies of one
    text share gains little once better entries cover them; another text costs ``FALSE_COST``. Equal
    gains are decided by ``order``. Of entries that begin alike, the first chosen stays alone.
    """
    toxic = label == 1
    value = np.where(toxic, weight, -FALSE_COST * weight) / weight[toxic].mean()
    chosen: list[str] = []
    free = np.ones(len(order), dtype=bool)
    while free.any():
        gain = np.where(free, value @ has, -np.inf)
        best = int((gain >= gain.max() - 1e-9).argmax())  # sums of equal evidence may differ by rounding
        if gain[best] < LEAST_GAIN:
            break
        chosen.append(order[best])
        value = np.where(has[:, best] & toxic, value / 2, value)
        stem = order[best].rstrip("-")
        free &= np.array([not (e.startswith(stem) or stem.startswith(e.rstrip("-"))) for e in order])
    return chosen


class Voters:
    """Votes and classifier features of a text, for a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.order = entry_order(lexicon)
        self.place = {e: i for i, e in enumerate(self.order)}
        # a voter for each kind of entry (word or beginning) and grade of log odds
        self.kind = {e: 2 * sum(lexicon[e] >= g for g in GRADES) + e.endswith("-") for e in self.order}
        self.heads = {e.rstrip("-")[:3] for e in self.order}
        self.lexical = 2 * (len(GRADES) + 1)
        self.count = self.lexical + 6

    def look(self, text: str) -> tuple[list[int], list[int], int]:
        """(places of the entries found, votes, number of words with an entry)."""
        words, place = words_of(text), self.place
        found, whole = set(), 0
        for w in words:
            if w[:3] not in self.heads:
                continue
            hits = [e for e in (w, *(w[:k] + "-" for k in BEGINNINGS if k <= len(w))) if e in place]
            whole += bool(hits)
            found.update(hits)
        votes = [ABSTAIN] * self.count
        for e in found:
            votes[self.kind[e]] = 1
        patterns = (
            1 if whole >= 2 else ABSTAIN,
            1 if whole >= 3 else ABSTAIN,
            1 if whole >= 0.02 * max(1, len(words)) and whole else ABSTAIN,
            1 if text.count("!") >= 0.02 * max(1, len(text)) and text else ABSTAIN,
            1 if shouted(text) else ABSTAIN,
            ABSTAIN if found else 0,
        )
        votes[self.lexical:] = patterns
        return sorted(place[e] for e in found), votes, whole

    def matrix(self, looked: list[tuple[list[int], list[int], int]]) -> np.ndarray:
        """Classifier features: entries found, votes cast for, and how many entries and words with one (logarithms)."""
        out = np.zeros((len(looked), len(self.order) + self.count + 2))
        for row, (found, votes, whole) in zip(out, looked):
            row[found] = 1
            row[len(self.order):-2] = [v == 1 for v in votes]
            row[-2:] = np.log1p(len(found)), np.log1p(whole)
        return out


@dataclass(frozen=True)
class LabelModel:
    """``table[j, y, v]``: probability that voter j votes v (0, 1, abstain) under class y; ``share``: weight of each voter."""

    prior: float
    table: np.ndarray
    share: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.table)
        codes = np.where(votes == ABSTAIN, 2, votes)
        each = np.stack([logs[j, :, codes[:, j]] for j in range(codes.shape[1])], axis=1)  # rows, voters, classes
        total = (each * self.share[None, :, None]).sum(axis=1) + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -30, 30)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, positive: np.ndarray, prior: float, rounds: int = 40) -> LabelModel:
    """Fit on distinct vote patterns and how often each occurs; the classes are named by the first guess,
    the share of ``positive`` labels in a pattern, shrunk to the prior."""
    voters = patterns.shape[1]
    codes = np.where(patterns == ABSTAIN, 2, patterns)
    onehot = np.stack([codes == v for v in range(3)], axis=2).astype(float)
    post = (positive + prior) / (counts + 1)
    share = np.ones(voters)
    for phase in range(2):
        for _ in range(rounds):
            weights = np.stack([counts * (1 - post), counts * post])
            table = np.einsum("yp,pjv->jyv", weights, onehot) + 0.5
            table /= table.sum(axis=2, keepdims=True)
            model = LabelModel(prior, table, share)
            post = model.posterior(patterns)
        if phase == 0:
            # correlation of the votes for, within the classes; voters bound to each other share their weight
            cast = onehot[:, :, 1]
            covariance = np.zeros((voters, voters))
            for w in (counts * (1 - post), counts * post):
                total = max(w.sum(), 1e-9)
                centred = cast - (w @ cast) / total
                covariance += (centred * w[:, None]).T @ centred
            deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
            correlation = np.abs(covariance / np.outer(deviation, deviation))
            np.fill_diagonal(correlation, 0)
            share = 1 / (1 + (correlation ** 2).sum(axis=1))
    return model


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression on soft labels, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + ridge * w
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        w -= np.linalg.solve(curvature, gradient)
    return w


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    weights: np.ndarray
    label_model: LabelModel | None
    prior: float


def _looked(sample: DataFrame, lexicon: dict[str, float], prior: float) -> tuple[pd.DataFrame, np.ndarray]:
    """label, found, votes and whole of the sample's texts, and weights that give the classes their shares."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters = Voters(lexicon)
        for batch in batches:
            looked = [voters.look(t) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "found": [f for f, _, _ in looked], "votes": [v for _, v, _ in looked], "whole": [w for _, _, w in looked]})

    rows = sample.mapInPandas(look, "label int, found array<int>, votes array<int>, whole int").toPandas()
    share = rows["label"].map(rows["label"].value_counts(normalize=True)).to_numpy()
    return rows, np.where(rows["label"] == 1, prior, 1 - prior) / share


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> ToxicityModel:
    """At most ``per_class`` rows a class reach the driver, as places of lexicon entries and votes."""
    shares = label_shares(labels, label, key)
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    sample = saved(training_texts(docs, labels, label, key, text_col, per_class).dropDuplicates(["text"]), "toxicity-sample")
    lexicon = induce_lexicon(sample) if 0 < prior < 1 else {}
    rows, weight = _looked(sample, lexicon, prior) if lexicon else (None, None)
    if lexicon:
        order, has = Voters(lexicon).order, np.zeros((len(rows), len(lexicon)), dtype=bool)
        for row, found in zip(has, rows["found"]):
            row[list(found)] = True
        lexicon = {e: lexicon[e] for e in choose_entries(order, has, rows["label"].to_numpy(), weight)}
    if not lexicon:
        return ToxicityModel({}, np.zeros(0), None, prior)
    voters = Voters(lexicon)
    rows, weight = _looked(sample, lexicon, prior)
    votes = np.array([list(v) for v in rows["votes"]])
    patterns, inverse = np.unique(votes, axis=0, return_inverse=True)
    counts = np.bincount(inverse.reshape(-1), weights=weight)
    positive = np.bincount(inverse.reshape(-1), weights=weight * (rows["label"] == 1))
    label_model = fit_label_model(patterns, counts, positive, prior)
    x = voters.matrix(list(zip(rows["found"], rows["votes"], rows["whole"])))
    return ToxicityModel(lexicon, fit_logistic(x, label_model.posterior(votes), weight), label_model, prior)


def _scorer(model: ToxicityModel):
    lexicon, weights, prior = model.lexicon, model.weights, model.prior

    def make():
        voters = Voters(lexicon)

        def of(texts: list[str]) -> np.ndarray:
            if not lexicon or not texts:
                return np.full(len(texts), min(prior, 0.99 * CUT))
            scores = []
            for i in range(0, len(texts), 512):
                margin = voters.matrix([voters.look(t) for t in texts[i:i + 512]]) @ weights[:-1] + weights[-1]
                scores.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            return np.concatenate(scores)

        return of

    return make


def score(docs: DataFrame, model: ToxicityModel, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    return score_texts(docs, _scorer(model), CUT, keep, text_col)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents not predicted toxic, with the columns of ``docs``."""
    return keep_texts(docs, _scorer(model), lambda scores: scores < CUT, text_col)
