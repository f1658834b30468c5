"""Operators: latest/max-date picks, current stage, existence flag, gated chain."""

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from dimweave.operators import (
    current_stage,
    eav_rows,
    existence_flag,
    gated_left_chain,
    latest_values,
    pick_latest,
    pick_max_date,
    scalar_picks,
    spine,
    stage_log,
    top1_per_key,
)
from dimweave.config import LATEST, MAX_DATE, Attribute, SOURCE_STAGE_RULES, STAGE_DEFAULT
from dimweave.sources.tables import from_rows

T0 = dt.datetime(2024, 1, 1)


def _tables(spark, dado, valor, demanda=None):
    demanda = demanda or [(d, 1, T0, "u", 1) for d in sorted({r[0] for r in dado})]
    return from_rows(spark, {"demanda": demanda, "demanda_dado": dado, "dado_valor": valor})


def test_latest_null_time_wins_then_newest_then_value_id(spark):
    dado = [
        (1, 1, T0), (1, 2, None), (1, 3, T0 + dt.timedelta(days=1)),  # NULL time wins
        (2, 4, T0), (2, 5, T0 + dt.timedelta(days=2)),  # newest time wins
        (3, 6, T0), (3, 7, T0),  # tie: newest value id wins
    ]
    valor = [(i, 9, f"v{i}") for i in range(1, 8)]
    t = _tables(spark, dado, valor)
    got = {r[0]: r[1] for r in pick_latest(eav_rows(t, [9]), "x").collect()}
    assert got == {1: "v2", 2: "v5", 3: "v7"}
    # the single-pass pick agrees
    sp = scalar_picks(latest_values(eav_rows(t, [9])), {"x": Attribute((9,), LATEST)})
    assert {r[0]: r[1] for r in sp.collect()} == got


def test_latest_keeps_null_value(spark):
    t = _tables(spark, [(1, 1, T0), (1, 2, T0 + dt.timedelta(days=1))], [(1, 9, "old"), (2, 9, None)])
    assert pick_latest(eav_rows(t, [9]), "x").collect()[0][1] is None


def test_latest_independent_of_partitioning(spark):
    dado = [(d, d * 100 + k, None if k % 4 == 0 else T0 + dt.timedelta(hours=k % 3)) for d in range(20) for k in range(9)]
    valor = [(r[1], 9, f"v{r[1]}") for r in dado]
    t = _tables(spark, dado, valor)
    base = sorted(pick_latest(eav_rows(t, [9]), "x").collect())
    for n in (1, 3, 7):
        t2 = from_rows(spark, {"demanda": [(d, 1, T0, "u", 1) for d in range(20)], "demanda_dado": dado, "dado_valor": valor})
        shuffled = t2.__class__(
            demanda=t2.demanda,
            demanda_dado=t2.demanda_dado.repartition(n),
            dado_valor=t2.dado_valor.repartition(n),
            demanda_etapa=t2.demanda_etapa,
            elemento_pn=t2.elemento_pn,
            status_demanda=t2.status_demanda,
        )
        assert sorted(pick_latest(eav_rows(shuffled, [9]), "x").collect()) == base


def test_max_date_null_first_and_ties(spark):
    dado = [(1, 1, T0), (1, 2, T0), (1, 3, T0), (2, 4, T0), (2, 5, T0)]
    valor = [(1, 9, "2024-06-03"), (2, 9, "2024-06-03"), (3, 9, "2024-05-01"), (4, 9, None), (5, 9, "2024-07-01")]
    t = _tables(spark, dado, valor)
    got = Counter(tuple(r) for r in pick_max_date(eav_rows(t, [9]), "d").collect())
    assert got == Counter({(1, dt.date(2024, 6, 3)): 2, (2, None): 1})
    sp = scalar_picks(latest_values(eav_rows(t, [9])), {"d": Attribute((9,), MAX_DATE)})
    assert sorted(tuple(r) for r in sp.collect()) == [(1, dt.date(2024, 6, 3)), (2, None)]


def test_version_spine_filters_attribute_rows(spark):
    demanda = [(1, 1, T0, "u", 1), (2, 2, T0, "u", 1)]
    t = _tables(spark, [(1, 1, T0), (2, 2, T0)], [(1, 9, "a"), (2, 9, "b")], demanda)
    assert [r[0] for r in eav_rows(t, [9], spine(t, 1)).collect()] == [1]


def test_current_stage_rank_after_version_filter(spark, fixture_tables):
    cur = current_stage(stage_log(fixture_tables, 8747), SOURCE_STAGE_RULES, STAGE_DEFAULT, dt.datetime(2025, 1, 1))
    got = {r["id_demanda"]: (r["id_demanda_etapa"], r["etapa"]) for r in cur.collect()}
    assert got[14] == (15, "Etapa 05")  # stage 16 belongs to another version
    assert 12 not in got  # only a foreign-version stage
    assert got[15] == (19, "Etapa 01")  # matches two patterns, the first wins
    assert got[1] == (2, "Demanda Finalizada")


def test_existence_flag_is_distinct(spark, fixture_tables):
    flags = existence_flag(fixture_tables, 106298, 106308, "flag", 8747)
    assert sorted(tuple(r) for r in flags.collect()) == [(1, "flag"), (15, "flag")]


def test_gated_chain_drops_ungated(spark, fixture_tables):
    t = fixture_tables
    rows = lambda ids: eav_rows(t, ids, spine(t, 8747))
    mun, uf, aero = pick_latest(rows([4270]), "m"), pick_latest(rows([4269]), "u"), pick_latest(rows([124]), "a")
    got = {r[0]: (r[1], r[2], r[3]) for r in gated_left_chain(mun, uf, aero).collect()}
    assert got == {1: (" Confins ", "MG", "SBCF"), 7: (None, "MG", None)}  # demand 6 has no municipality


def test_top1_ties(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 3), (2, 1)], "k int, v int")
    assert top1_per_key(df, "k", [F.col("v").desc()], ties=True).count() == 3
    assert top1_per_key(df, "k", [F.col("v").desc()]).count() == 2


def _brute_latest(rows):
    """Newest row per demand by (time is NULL, time, value id), in plain Python."""
    best = {}
    for d, vid, t, v in rows:
        k = (t is None, t or dt.datetime.min, vid)
        if d not in best or k > best[d][0]:
            best[d] = (k, v)
    return {d: v for d, (k, v) in best.items()}


def _brute_max_date(rows):
    out = {}
    for d, vid, t, v in rows:
        day = None if v is None else dt.date.fromisoformat(v)
        k = (day is None, day or dt.date.min)
        if d not in out or k > out[d][0]:
            out[d] = (k, day)
    return {d: day for d, (k, day) in out.items()}


def test_single_pass_picks_match_brute_force(spark):
    import random

    rng = random.Random(17)
    rows = []
    for vid in range(1, 2001):
        d = rng.randrange(1, 60)
        t = None if rng.random() < 0.15 else T0 + dt.timedelta(hours=rng.randrange(0, 30))
        v = None if rng.random() < 0.1 else (dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(0, 90))).isoformat()
        rows.append((d, vid, t, v))
    t = _tables(spark, [(d, vid, ts) for d, vid, ts, _ in rows], [(vid, 9, v) for _, vid, _, v in rows])
    attrs = {"x": Attribute((9,), LATEST), "m": Attribute((9,), MAX_DATE)}
    got = {r["id_demanda"]: (r["x"], r["m"]) for r in scalar_picks(latest_values(eav_rows(t, [9])), attrs).collect()}
    latest, greatest = _brute_latest(rows), _brute_max_date(rows)
    assert got == {d: (latest[d], greatest[d]) for d in latest}


def test_null_rows_make_a_left_join_inner(spark):
    from dimweave.operators import with_null_rows

    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id_demanda long, x string")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (3, None), (9, "z")], "id_demanda long, v string")
    full = with_null_rows(right, left.join(right, "id_demanda", "left_anti"))
    inner = left.join(full, "id_demanda")
    assert sorted(map(str, inner.collect())) == sorted(map(str, left.join(right, "id_demanda", "left").collect()))
