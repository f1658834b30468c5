"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents are counted into cells of source, language and topic (tokens: words of the whole text). A
cell's sampling probability starts at ``fraction`` and is raked: for one dimension after the other it
is multiplied by the target tokens of the cell's value over what the value now has, and kept at 1 at
most, until all three marginals fit within ``tolerance``, nothing moves any more (the marginals do not
fit together with probabilities up to 1), or ``rounds`` are over. The raked weight of a cell is its tokens times its
probability. A document is selected when a hash of its key, read as a number from 0 to 1, is below its
cell's probability, so a run repeats. ``marginals`` tells for every value the tokens it has, its goal
and what the fit reaches.

Targets are shares per dimension; values without a given share divide what is left by their own share
to the power ``temper`` (below 1 it lifts small sources). No value can have more than its own tokens: a
share above that is cut to them, and what it cannot take goes to the values without a given share, in the same proportions, so a
dimension's goals always add up to ``fraction`` of all tokens where its open values have them.

All of it is DataFrame work: cells are aggregated map-side, so a source with a third of all rows sends
one row a task; the cell table joins back by key, and Spark broadcasts it only below its byte bound.

Edge cases: NULL source, language or topic is a value of its own. NULL and empty texts have no tokens
and keep the probability of their cell (``fraction`` where the whole cell has none); very long ones are
counted whole. Repeated rows with one key share their fate. An empty table gives an empty result. ``mix`` names its columns itself;
``keep`` columns of the same name are left out. ``sample`` returns the columns of its input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimweave.llm.common import column_name, saved, text_of

OUTPUT = ("source", "lang", "topic", "n_tokens", "weight", "probability", "selected")
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
ROUNDS = 25
TOLERANCE = 1e-6


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A form of writing as the topic: table, slogan, note (under 60 words), essay (from 600 words) or article."""
    chars = F.length(text)

    def share(sign: str) -> Column:
        return (chars - F.length(F.replace(text, F.lit(sign), F.lit("")))) / chars

    return (
        F.when(tokens == 0, "note").when(share("|") >= 0.01, "table").when(share("!") >= 0.01, "slogan")
        .when(tokens < 60, "note").when(tokens >= 600, "essay").otherwise("article")
    )


def _targets(cells: DataFrame, dimension: str, total: float, given: Mapping[str, float], temper: float) -> DataFrame:
    """``dimension, has, goal``: the tokens each value has, and is to have of ``total``; a goal is never above ``has``."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("has"))
    share = F.lit(None).cast("double")
    for value, part in given.items():
        share = F.when(F.col(dimension) == value, F.lit(float(part))).otherwise(share)
    sums = saved(sums.select(dimension, "has", F.when(share.isNotNull(), F.least(share * total, F.col("has"))).alias("given"), F.pow("has", F.lit(temper)).alias("lifted")), f"targets-{dimension}")
    taken = sums.agg(F.coalesce(F.sum("given"), F.lit(0.0))).first()[0]
    rate, full = 0.0, -1
    while True:  # each pass fills more values up to what they have, and shares the rest among the others
        reached = F.col("given").isNull() & (F.col("lifted") * rate >= F.col("has")) & F.lit(full >= 0)
        open_ = F.col("given").isNull() & ~reached
        n, used, lifted = sums.agg(F.count_if(reached), F.coalesce(F.sum(F.when(reached, F.col("has"))), F.lit(0.0)), F.coalesce(F.sum(F.when(open_, F.col("lifted"))), F.lit(0.0))).first()
        if n == full or not lifted:
            break
        rate, full = max(0.0, total - taken - used) / lifted, n
    return sums.select(dimension, "has", F.coalesce("given", F.least("has", F.col("lifted") * rate)).alias("goal"))


def _goals(cells: DataFrame, fraction: float, targets: Mapping[str, Mapping[str, float]] | None, temper: float) -> tuple[float, dict[str, DataFrame]]:
    total = float((cells.agg(F.sum("tokens")).first()[0] or 0) * fraction)
    return total, {d: _targets(cells, d, total, (targets or {}).get(d, {}), temper) for d in DIMENSIONS}


def fit(cells: DataFrame, fraction: float, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = 0.7, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (the three dimensions, tokens) with the raked ``probability`` and the goals of its three values."""
    total, goals = _goals(cells, fraction, targets, temper)
    fitted = cells.withColumn("probability", F.lit(float(fraction)))
    for dimension in DIMENSIONS:
        fitted = fitted.join(goals[dimension].select(dimension, F.col("goal").alias(f"goal_{dimension}")), dimension)
    fitted = saved(fitted, "fit")
    for _ in range(rounds if total else 0):
        now_fits = fitted.withColumn("old", F.col("probability"))
        for dimension in DIMENSIONS:
            now = now_fits.groupBy(dimension).agg(F.sum(F.col("tokens") * F.col("probability")).alias("now"))
            goal = F.col(f"goal_{dimension}")
            factor = F.when(F.col("now") > 0, goal / F.col("now")).otherwise(F.lit(1.0))
            now_fits = now_fits.join(now, dimension).withColumns({
                "probability": F.least(F.lit(1.0), F.col("probability") * factor), f"off_{dimension}": F.abs(F.col("now") - goal) / total,
            }).drop("now")
        now_fits = saved(now_fits, "fit")
        # how far the marginals were off when their turn came, and how far the probabilities moved
        off, moved = now_fits.agg(F.max(F.greatest(*(f"off_{d}" for d in DIMENSIONS))), F.max(F.abs(F.col("probability") - F.col("old")))).first()
        fitted = now_fits.drop("old", *(f"off_{d}" for d in DIMENSIONS))
        if off < tolerance or moved < tolerance:
            break
    return fitted.select(*DIMENSIONS, "tokens", "probability", *(f"goal_{d}" for d in DIMENSIONS))


def marginals(fitted: DataFrame) -> DataFrame:
    """``dimension, value, has, goal, reached`` of every value of the three dimensions, from the result of ``fit``."""
    out = None
    for d in DIMENSIONS:
        reached = F.sum(F.col("tokens") * F.col("probability")).alias("reached")
        one = fitted.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("has"), F.max(f"goal_{d}").alias("goal"), reached)
        one = one.select(F.lit(d).alias("dimension"), "value", "has", "goal", "reached")
        out = one if out is None else out.unionByName(one)
    return out


def count_cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``source, lang, topic, tokens``: the words of all texts of a cell."""
    text = text_of(text_col)
    counted = docs.select(*(F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) for d in ("source", "lang")), word_count(text).alias("tokens"), text.alias("text"))
    counted = counted.withColumn("topic", topic_of(F.col("text"), F.col("tokens")))
    return counted.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))


def _mixed(docs: DataFrame, fraction: float, targets, temper: float, key: str, seed: int, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the output columns under names none of its own has, and those names."""
    names = {c: column_name(docs, f"mix_{c}") for c in OUTPUT}
    fitted = fit(saved(count_cells(docs, text_col), "cells"), fraction, targets, temper)
    text = text_of(text_col)
    dims = {d: F.coalesce(F.col(d).cast("string"), F.lit(NONE)) for d in ("source", "lang")}
    counted = docs.withColumns({names["n_tokens"]: word_count(text), **{names[d]: c for d, c in dims.items()}})
    counted = counted.withColumn(names["topic"], topic_of(text, F.col(names["n_tokens"])))
    cells = fitted.select(*(F.col(d).alias(names[d]) for d in DIMENSIONS), F.col("probability").alias(names["probability"]))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    joined = counted.join(cells, [names[d] for d in DIMENSIONS])
    return joined.withColumns({
        names["weight"]: F.col(names["n_tokens"]) * F.col(names["probability"]),
        names["selected"]: drawn < F.col(names["probability"]),
    }), names


def mix(docs: DataFrame, fraction: float, keep: Sequence[str] = ("doc_id",), targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = 0.7, key: str = "doc_id", seed: int = 7, text_col: str = "text") -> DataFrame:
    """``keep`` columns, source, lang, topic, n_tokens, weight (raked tokens), probability and selected of every document."""
    keep = [c for c in keep if c not in OUTPUT]
    narrow = docs.select(*dict.fromkeys([*keep, key, "source", "lang", text_col]))
    mixed, names = _mixed(narrow, fraction, targets, temper, key, seed, text_col)
    return mixed.select(*keep, *(F.col(names[c]).alias(c) for c in OUTPUT))


def sample(docs: DataFrame, fraction: float, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = 0.7, key: str = "doc_id", seed: int = 7, text_col: str = "text") -> DataFrame:
    """The selected documents, with the columns of ``docs``."""
    mixed, names = _mixed(docs, fraction, targets, temper, key, seed, text_col)
    return mixed.where(F.col(names["selected"])).select(*docs.columns)
