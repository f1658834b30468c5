"""Fan-out of multi-valued attributes: the product of a demand's value lists, laid out as an index range.

The dimension has one row per combination of a demand's multi-valued attribute values. Joining the values
one role at a time shuffles a growing table once per role. Instead, each demand gets one row that holds
a list of distinct values per role, and the combinations are numbered in mixed radix: combination ``i``
takes from each role the value at ``i div stride % length``. The range of numbers is cut into stretches of
``rows_per_task``, the stretches are dealt to tasks, and each task decodes its own.

A list must fit in memory, and one demand may hold most values of a role. So a role with more than
``block`` values in a demand is cut into blocks by the values' hash. The demand then has a cell for each
combination of blocks, numbered in mixed radix too, and a value goes to all cells of its block: every
combination of values lies in exactly one cell, and a cell's lists hold about ``block`` values.

Shuffles: the values once to meet the cuts (Spark may split a hot demand there, or broadcast the cuts) and
once by (demand, cell) into the lists; above the lists only the deal of the stretches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 8192

_CUT = "struct<role:int,blocks:bigint,stride:bigint>"


def value_column(role: int) -> str:
    return f"v{role}"


def member_rows(df: DataFrame, role: int) -> DataFrame:
    """``df`` (id_demanda and value columns) as members of the product: id_demanda, role, v<role>."""
    columns = [c for c in df.columns if c != "id_demanda"]
    value = F.struct(*columns) if columns else F.struct(F.lit(True).alias("kept"))
    return df.select("id_demanda", F.lit(role).alias("role"), value.alias(value_column(role)))


def hot_cuts(counts: DataFrame, block: int) -> DataFrame:
    """Demands with a role above ``block`` values (id_demanda, role, n): id_demanda, cells, cuts (role, blocks, stride)."""
    hot = counts.where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)))
    listed = hot.groupBy("id_demanda").agg(F.sort_array(F.collect_list(F.struct("role", "blocks"))).alias("hot"))  # one entry a role

    def lay(state: Column, one: Column) -> Column:
        cut = F.struct(one["role"].alias("role"), one["blocks"].alias("blocks"), state["stride"].alias("stride"))
        return F.struct((state["stride"] * one["blocks"]).alias("stride"), F.array_append(state["cuts"], cut).alias("cuts"))

    start = F.struct(F.lit(1).cast("bigint").alias("stride"), F.array().cast(f"array<{_CUT}>").alias("cuts"))
    laid = listed.select("id_demanda", F.aggregate("hot", start, lay).alias("s"))
    return laid.select("id_demanda", F.col("s.stride").alias("cells"), F.col("s.cuts").alias("cuts"))


def _cut_of(role: Column, field: str) -> Column:
    """The role's number of blocks, or their stride, in the demand's ``cuts`` (1 where the role is not cut)."""
    own = F.filter("cuts", lambda c: c["role"] == role)
    return F.coalesce(F.try_element_at(own, F.lit(1))[field], F.lit(1).cast("bigint"))


def _to_cells(members: DataFrame, cuts: DataFrame, values: Sequence[str], everywhere: Column) -> DataFrame:
    """Each member once in every cell of its block (where ``everywhere``: in every cell of its demand)."""
    out = members.join(cuts, "id_demanda", "left")
    out = out.withColumns({
        "cells": F.coalesce("cells", F.lit(1).cast("bigint")),
        "blocks": F.when(everywhere, F.lit(1).cast("bigint")).otherwise(_cut_of(F.col("role"), "blocks")),
        "stride": F.when(everywhere, F.lit(1).cast("bigint")).otherwise(_cut_of(F.col("role"), "stride")),
    })
    # the other digits of a cell's number: below the stride of the member's role, and above its blocks
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("cells div blocks") - 1)).alias("other")
    out = out.select("*", F.pmod(F.xxhash64(*values), F.col("blocks")).alias("own"), other)
    cell = F.expr("(other div stride) * stride * blocks + own * stride + other % stride")
    return out.select(*members.columns, "cuts", cell.alias("cell"))


def product(
    members: DataFrame,
    schemas: Sequence[Sequence[str]],
    rows_per_task: int,
    optional: Iterable[int] = (),
    fill: tuple[int, Callable[[Column], Column]] | None = None,
    partitions: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Every combination of one member of each role per demand: id_demanda, the roles' columns, cell, place.

    ``members`` has id_demanda, role (0 and up) and a struct column ``v<role>`` per role, NULL but for the
    row's own role; repeated members count once. ``schemas`` are the names of each role's columns. A
    demand without a member of a role has no rows, or NULLs if the role is ``optional``. Role 0 is never cut
    into blocks: it holds a demand's few plain rows.

    ``fill`` = (role, value): a role of one column whose NULLs read as ``value`` of a row of role 0, which
    must be the same for all of a demand's rows there. The demand has that value once, even if it has it
    as a member too.
    """
    partitions = partitions or int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [value_column(i) for i in range(len(schemas))]
    none = F.lit(0).cast("bigint")
    counts = members.where("role > 0").groupBy("id_demanda", "role").agg(F.count(F.lit(1)).alias("n"))
    filled = F.lit(False)
    if fill:
        (name,) = schemas[fill[0]]
        filled = (F.col("role") == fill[0]) & F.col(values[fill[0]])[name].isNull()
    placed = _to_cells(members, hot_cuts(counts, block), values, filled)
    lists = [F.collect_set(v).alias(v) for v in values]
    # dealt by cell explicitly: a grouping on top of the join's partitions would keep all cells of a demand in one task
    held = placed.repartition(partitions, "id_demanda", "cell").groupBy("id_demanda", "cell").agg(*lists, F.first("cuts").alias("cuts"))

    held = held.where(F.size(values[0]) > 0)
    for i in sorted(set(optional)):
        kind = members.schema[values[i]].dataType
        missing = F.array(F.struct(*[F.lit(None).cast(kind[c].dataType).alias(c) for c in schemas[i]]))
        lacking = (F.size(values[i]) == 0) & (_cut_of(F.lit(i), "blocks") == 1)  # a block may be empty by chance
        held = held.withColumn(values[i], F.when(lacking, missing).otherwise(F.col(values[i])))
    if fill:
        held = _filled(held, schemas, *fill)
    for v in values:
        held = held.where(F.size(v) > 0)

    strides, rows = [], F.lit(1).cast("bigint")
    for v in values:
        strides.append(rows)
        rows = rows * F.size(v)
    held = held.withColumns({f"s{i}": s for i, s in enumerate(strides)} | {"total": rows}).drop("cuts")
    held = held.withColumn("stretch", F.explode(F.sequence(none, F.expr(f"(total - 1) div {rows_per_task}"))))
    dealt = held.repartition(partitions, "id_demanda", "cell", "stretch")
    ends = F.least(F.col("total"), (F.col("stretch") + 1) * rows_per_task) - 1
    dealt = dealt.withColumn("place", F.explode(F.sequence(F.col("stretch") * rows_per_task, ends)))
    picked = [F.expr(f"element_at({v}, cast(place div s{i} % size({v}) + 1 as int))").alias(v) for i, v in enumerate(values)]
    out = dealt.select("id_demanda", *picked, "cell", "place")
    columns = [F.col(f"{v}.{c}").alias(c) for v, names in zip(values, schemas) for c in names]
    return out.select("id_demanda", *columns, "cell", "place")


def _filled(held: DataFrame, schemas: Sequence[Sequence[str]], role: int, value: Callable[[Column], Column]) -> DataFrame:
    """NULLs of the role's list read as the fill value, in one block of the role only: where it would be a member."""
    v, (name,) = value_column(role), schemas[role]
    kinds = [held.schema[value_column(i)].dataType.elementType for i in range(len(schemas))]
    fill = value(F.element_at(value_column(0), 1)).cast(kinds[role][name].dataType)
    own = F.struct(fill.alias(name))
    hashed = F.xxhash64(*[own if i == role else F.lit(None).cast(kind) for i, kind in enumerate(kinds)])
    held = held.withColumns({"fill_blocks": _cut_of(F.lit(role), "blocks"), "fill_stride": _cut_of(F.lit(role), "stride")})
    home = F.when(fill.isNull(), F.lit(0).cast("bigint")).otherwise(F.pmod(hashed, F.col("fill_blocks")))
    here = F.expr("cell div fill_stride % fill_blocks") == home
    full = F.array_distinct(F.transform(v, lambda x: F.when(x[name].isNull(), own).otherwise(x)))
    rest = F.filter(v, lambda x: x[name].isNotNull())
    return held.withColumn(v, F.when(here, full).otherwise(rest)).drop("fill_blocks", "fill_stride")


def fan_out(
    df: DataFrame,
    roles: Sequence[tuple[str, DataFrame]],
    rows_per_task: int,
    optional: Iterable[str] = (),
    partitions: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``df`` (rows of demands) joined with every role's values; the columns ``cell`` and ``place`` stay.

    ``roles`` are (name, frame of id_demanda and value columns). Repeated rows of ``df`` or of a role count
    once. A demand without a value of a role named in ``optional`` has NULLs there.
    """
    frames = [df, *(vals for _, vals in roles)]
    members = member_rows(df, 0)
    for i, frame in enumerate(frames[1:], start=1):
        members = members.unionByName(member_rows(frame, i), allowMissingColumns=True)
    schemas = [[c for c in f.columns if c != "id_demanda"] for f in frames]
    may_lack = [i for i, (name, _) in enumerate(roles, start=1) if name in set(optional)]
    return product(members, schemas, rows_per_task, may_lack, partitions=partitions, block=block)
