"""Attribute texts that are not what their role reads them as, found before a strict cast fails on them.

A cast that fails in the middle of a job names one text, and may end several stages at once with errors of
different kinds. Here the texts are counted per role while the attribute values are written anyway (an
``Observation``: no extra job), or reported as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dimweave.config import MAX_DATE, DimensionConfig
from dimweave.functions.dates import date_or_null
from dimweave.functions.text import int_or_null, substr
from dimweave.operators.eav import id_filter


class BadAttributeValues(ValueError):
    """Texts that their role cannot read: ``found`` is a list of (role, attribute ids, values, a demand that has one)."""

    def __init__(self, found: list[tuple]):
        self.found = found
        told = "; ".join(f"{role} (attribute {', '.join(map(str, ids))}): {n} values, one of demand {demand}" for role, ids, n, demand in found)
        super().__init__(f"attribute texts that cannot be read: {told}")


def unreadable(cfg: DimensionConfig) -> dict[str, Column]:
    """For each role with a type, whether a row of attribute values (id_dado, nm_valor) holds a text it cannot read."""
    text, out = F.col("nm_valor"), {}
    for role, attr in cfg.attributes.items():
        if role == "nup":
            read = int_or_null(substr(text, 14, 4))  # the year of the process number
        elif attr.cast == "int":
            read = int_or_null(text)
        elif attr.cast == "date" or attr.pick == MAX_DATE:
            read = date_or_null(text, cfg.date_formats)
        else:
            continue
        out[role] = id_filter(attr.ids) & text.isNotNull() & read.isNull()
    return out


def bad_values(values: DataFrame, cfg: DimensionConfig) -> DataFrame:
    """role, id_dado, nm_valor, demands, first_demand: the unreadable texts among attribute values (id_demanda, id_dado, nm_valor)."""
    roles = F.array_compact(F.array(*[F.when(bad, F.lit(role)) for role, bad in unreadable(cfg).items()]))
    rows = values.select("id_demanda", "id_dado", "nm_valor", F.explode(roles).alias("role"))
    folded = rows.groupBy("role", "id_dado", "nm_valor").agg(F.countDistinct("id_demanda").alias("demands"), F.min("id_demanda").alias("first_demand"))
    return folded.select("role", "id_dado", "nm_valor", "demands", "first_demand")


def observed(values: DataFrame, cfg: DimensionConfig) -> tuple[DataFrame, Observation]:
    """``values`` that count their unreadable texts while another job reads them."""
    seen = Observation("unreadable attribute texts")
    counts = []
    for role, bad in unreadable(cfg).items():
        counts += [F.count_if(bad).alias(f"n_{role}"), F.min(F.when(bad, F.col("id_demanda"))).alias(f"demand_{role}")]
    return values.observe(seen, *counts), seen


def raise_if_bad(seen: Observation, cfg: DimensionConfig) -> None:
    """Raise ``BadAttributeValues`` when the observed job met unreadable texts."""
    counts = seen.get
    found = [(role, cfg.attributes[role].ids, counts[f"n_{role}"], counts[f"demand_{role}"]) for role in unreadable(cfg) if counts[f"n_{role}"]]
    if found:
        raise BadAttributeValues(found)
