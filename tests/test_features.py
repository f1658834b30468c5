"""Incremental state, bucketed layout, JDBC slices, ordered files, office refresh, reports of unreadable texts."""

import datetime as dt
import glob
import os
import random
import uuid
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dimweave import DimensionConfig, demand_dimension
from dimweave.config import MAX_DATE
from dimweave.functions.dates import business_days, count_up_to
from dimweave.operators.eav import eav_rows, spine
from dimweave.operators.incremental import merge_latest, read_state, update_state, write_state
from dimweave.operators.pivot import latest_values
from dimweave.plans import BadAttributeValues, bad_values, write_attributes
from dimweave.sources import load_bucketed, read_in_order, refresh_office, save_bucketed, write_ordered, write_parquet
from dimweave.sources.jdbc import job_conditions, quantile_query, slice_predicates, sql_literal
from dimweave.sources.schemas import TABLES
from dimweave.sources.tables import from_rows
from tests.fixture import fixture_rows
from tests.random_eav import RANDOM_CONFIG, random_rows


def _bag(df):
    return Counter(tuple(r) for r in df.collect())


# --- incremental state -------------------------------------------------------------------------


def _all_rows(spark, seed):
    t = from_rows(spark, random_rows(seed, n_demands=12))
    rows = eav_rows(t, range(1, 16), spine(t, 1)).collect()
    return rows, eav_rows(t, [1]).schema


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_states_equal_the_fold_of_all_rows(spark, seed):
    rows, schema = _all_rows(spark, seed)
    draw = random.Random(seed)
    parts = [[] for _ in range(4)]
    for r in rows:
        parts[draw.randrange(4)].append(r)
    parts[0] += parts[1][:5]  # a repeated delivery changes nothing
    states = [latest_values(spark.createDataFrame(p, schema)) for p in parts]
    want = _bag(latest_values(spark.createDataFrame(rows, schema)))
    assert _bag(merge_latest(*states)) == want
    assert _bag(merge_latest(merge_latest(states[3], states[1]), merge_latest(states[2], states[0]))) == want
    assert _bag(merge_latest(states[0], states[0].limit(0))) == _bag(states[0])


def test_an_update_rewrites_only_the_attributes_with_new_rows(spark, tmp_path):
    rows, schema = _all_rows(spark, 3)
    old, new = [r for r in rows if r["id_dado_valor"] % 4], [r for r in rows if not r["id_dado_valor"] % 4 and r["id_dado"] in (2, 14)]
    path = str(tmp_path / "state")
    write_state(latest_values(spark.createDataFrame(old, schema)), path)
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{path}/id_dado=*/*.parquet")}
    before = files()
    fresh = latest_values(spark.createDataFrame(new, schema))
    assert update_state(path, fresh) == [2, 14]
    after = files()
    kept = {f for f in before if "id_dado=2/" not in f and "id_dado=14/" not in f}
    assert kept and all(after[f] == before[f] for f in kept)
    assert not any(f in after for f in before if f not in kept)
    want = _bag(latest_values(spark.createDataFrame(old + new, schema)))
    assert _bag(read_state(spark, path, fresh)) == want
    assert update_state(path, fresh) == [2, 14] and _bag(read_state(spark, path, fresh)) == want  # once more: the same
    assert update_state(path, fresh.limit(0)) == [] and files().keys() and _bag(read_state(spark, path, fresh)) == want


# --- bucketed layout ---------------------------------------------------------------------------


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    t = from_rows(spark, random_rows(4, n_demands=30))
    name = f"buckets_{uuid.uuid4().hex}"
    save_bucketed(t, name, 4, str(tmp_path / "db"))
    loaded = load_bucketed(spark, name)
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        rows = eav_rows(loaded, [2, 14])
        assert _bag(rows) == _bag(eav_rows(t, [2, 14]))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        scan = [ln for ln in plan.splitlines() if "FileScan" in ln and "nm_valor" in ln][0]
        assert "PartitionFilters: [" in scan and "id_dado" in scan.split("PartitionFilters: [")[1]
        of_version = eav_rows(loaded, [2, 14], spine(loaded, 1))
        assert _bag(of_version) == _bag(eav_rows(t, [2, 14], spine(t, 1)))
        below = of_version._jdf.queryExecution().executedPlan().toString().split("id_dado_valor#")
        assert "hashpartitioning(id_dado_valor" not in "id_dado_valor#".join(below)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert _bag(demand_dimension(loaded, RANDOM_CONFIG)) == _bag(demand_dimension(t, RANDOM_CONFIG))
    spark.sql(f"DROP DATABASE {name} CASCADE")


# --- JDBC slices -------------------------------------------------------------------------------


@pytest.mark.parametrize("cuts", [[], [5], [1, 1, 1], [None, 3, 10, 10, 77], [0, 25, 50, 75, 101], ["a", "l'x", "z"]])
@pytest.mark.parametrize("condition", ["", "k % 2 = 0 OR k IS NULL"])
def test_slices_are_disjoint_and_cover_all_rows(cuts, condition):
    import duckdb

    con = duckdb.connect()
    if cuts and isinstance(cuts[0], str):
        con.execute("CREATE TABLE t AS SELECT chr(CAST(97 + i % 26 AS INTEGER)) AS k FROM range(60) r(i) UNION ALL SELECT NULL UNION ALL SELECT 'l''x'")
        condition = condition and "k > 'c' OR k IS NULL"
    else:
        con.execute("CREATE TABLE t AS SELECT i AS k FROM range(-3, 100) r(i) UNION ALL SELECT 7 UNION ALL SELECT NULL UNION ALL SELECT NULL")
    parts = slice_predicates("k", cuts, condition)
    rows = con.execute("SELECT rowid, k FROM t" + (f" WHERE {condition}" if condition else "")).fetchall()
    got = [r for p in parts for r in con.execute(f"SELECT rowid, k FROM t WHERE {p}").fetchall()]
    assert Counter(got) == Counter(rows)
    assert len(parts) == max(1, len({c for c in cuts if c is not None}))


def test_cuts_of_a_skewed_key_give_even_slices():
    import duckdb

    con = duckdb.connect()
    # a third of all rows under one key, the others in two far ranges
    con.execute("CREATE TABLE t AS SELECT 500 AS k FROM range(1000) UNION ALL SELECT i FROM range(1000) r(i) UNION ALL SELECT 10000000 + 3 * i FROM range(1000) r(i)")
    cuts = [r[0] for r in con.execute(quantile_query("t", "k", 12)).fetchall()]
    sizes = [con.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in slice_predicates("k", cuts)]
    assert sum(sizes) == 3000 and sorted(sizes)[-2] <= 500 and max(sizes) <= 1500  # equal keys cannot be split
    none = con.execute(quantile_query("t", "k", 4, "k < 0")).fetchall()
    assert none == [] and slice_predicates("k", none) == ["1 = 1"]


def test_only_rows_of_the_job_are_asked_for(spark):
    rows = random_rows(6, n_demands=25)
    t = from_rows(spark, rows)
    for name in TABLES:
        getattr(t, name).createOrReplaceTempView(f"jdbc_{name}")
    conditions = job_conditions(RANDOM_CONFIG, prefix="jdbc_")
    assert set(conditions) == {"demanda", "demanda_dado", "dado_valor", "demanda_etapa"}
    from dataclasses import replace

    sliced = {}
    for name, key in (("demanda", "id_demanda"), ("demanda_dado", "id_demanda"), ("dado_valor", "id_dado_valor"), ("demanda_etapa", "id_demanda")):
        parts = [spark.sql(f"SELECT * FROM jdbc_{name} WHERE {p}") for p in slice_predicates(key, [3, 9, 14], conditions[name])]
        sliced[name] = parts[0].union(parts[1]).union(parts[2])
        assert sliced[name].count() <= getattr(t, name).count()
    assert sliced["demanda"].count() == sum(r[1] == 1 for r in rows["demanda"])
    reduced = replace(t, **sliced)
    assert _bag(demand_dimension(reduced, RANDOM_CONFIG)) == _bag(demand_dimension(t, RANDOM_CONFIG))
    assert "id_dado IN" in job_conditions(RANDOM_CONFIG, id_dado_on_bridge=True)["demanda_dado"]
    assert set(job_conditions(RANDOM_CONFIG.with_(version=None))) == {"dado_valor"}
    assert sql_literal("o'x") == "'o''x'" and sql_literal(-3) == "-3"
    with pytest.raises(TypeError):
        sql_literal(1.5)


def test_the_jdbc_loader_passes_slices_to_spark(monkeypatch):
    from types import SimpleNamespace

    from dimweave.sources import jdbc

    asked = []

    class Reader:
        def option(self, *_):
            return self

        def jdbc(self, url, table, predicates=None, properties=None):
            asked.append((table, predicates))
            return SimpleNamespace(collect=lambda: [(1,), (40,), (70,)])

    monkeypatch.setattr(jdbc, "DemandTables", lambda **frames: frames)
    frames = jdbc.load_jdbc(SimpleNamespace(read=Reader()), "jdbc:x", {}, RANDOM_CONFIG, slices=3, schema="w", cuts={"demanda": [5, 6]})
    assert set(frames) == set(TABLES)
    plain = {table: p for table, p in asked if not table.startswith("(")}
    assert plain["w.elemento_pn"] is None and plain["w.status_demanda"] is None
    assert len(plain["w.demanda"]) == 2 and len(plain["w.dado_valor"]) == 3
    assert all("id_versao_processo = 1" in p for p in plain["w.demanda_etapa"])
    queries = [table for table, _ in asked if table.startswith("(")]
    assert len(queries) == 3 and all("ntile(3)" in q for q in queries)


# --- sinks -------------------------------------------------------------------------------------


def test_files_read_by_name_give_the_report_order(spark, tmp_path):
    draw = random.Random(2)
    rows = [(draw.choice([None, *range(40)]), draw.choice("xyz"), i) for i in range(900)]
    df = spark.createDataFrame(rows, "`Nº Demanda` long, b string, n long").repartition(7)
    path = str(tmp_path / "ordered")
    write_ordered(df, path, ["Nº Demanda", "b"], files=5, rows_per_file=60)
    import pyarrow.parquet as pq

    files = sorted(glob.glob(f"{path}/*.parquet"))
    assert len(files) >= 15
    read = [r for f in files for r in pq.read_table(f).to_pylist()]
    keys = [(-1 if r["Nº Demanda"] is None else r["Nº Demanda"], r["b"]) for r in read]
    assert keys == sorted(keys) and sorted(r["n"] for r in read) == list(range(900))
    again = read_in_order(spark, path).orderBy("file_name", "file_row").collect()
    assert [r["n"] for r in again] == [r["n"] for r in read]


def test_one_office_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "report")
    report = spark.createDataFrame([(1, "BHZ", "a"), (2, "SAO", "b"), (3, "SAO", "c"), (4, "N.D.", "d"), (5, "R/J", "e")], "id long, NURAC string, x string")
    write_parquet(report, path, partition_by="NURAC")
    files = lambda office: {f: os.path.getmtime(f) for f in glob.glob(f"{path}/NURAC={office}/*.parquet")}
    before = files("SAO") | files("N.D.")
    refresh_office(report.where("id = 1").withColumn("x", F.lit("new")), path, "BHZ")
    assert files("SAO") | files("N.D.") == before and len(before) >= 2
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("id", "NURAC", "x").collect())
    assert read() == [(1, "BHZ", "new"), (2, "SAO", "b"), (3, "SAO", "c"), (4, "N.D.", "d"), (5, "R/J", "e")]
    with pytest.raises(Exception, match="another office"):
        refresh_office(report, path, "SAO")
    assert len(read()) == 5
    refresh_office(report.limit(0), path, "SAO")
    refresh_office(report.limit(0), path, "R/J")
    assert [r[0] for r in read()] == [1, 4]
    refresh_office(report.where("id < 4 and id > 1"), path, "SAO")
    assert [r[0] for r in read()] == [1, 2, 3, 4]


# --- unreadable texts --------------------------------------------------------------------------


@pytest.mark.parametrize("attr,role,text", [(4604, "ini_prev", "31/12/2024"), (4694, "ano_prev", "20x1"), (4654, "data_exec", "amanhã"), (35, "nup", "00065.000001/20x4-11")])
def test_unreadable_texts_raise_one_error_that_names_them(spark, attr, role, text):
    rows = fixture_rows()
    for demand, vid in ((2, 900), (1, 901), (1, 902)):
        rows["dado_valor"].append((vid, attr, text + (" " if vid == 902 else "")))
        rows["demanda_dado"].append((demand, vid, dt.datetime(2024, 1, 1)))
    t = from_rows(spark, rows)
    cfg = DimensionConfig(as_of=dt.datetime(2025, 1, 1), office=None)
    with pytest.raises(BadAttributeValues, match=role) as raised:
        write_attributes(t, cfg)
    assert raised.value.found == [(role, cfg.attributes[role].ids, 3, 1)]
    listed = bad_values(eav_rows(t, [attr], spine(t, cfg.version)), cfg).collect()
    assert sorted(tuple(r) for r in listed) == sorted([(role, attr, text, 2, 1), (role, attr, text + " ", 1, 1)])
    # the same text under an attribute without a type is fine
    fine = {4623 if a.ids == (attr,) else a.ids[0] for a in cfg.attributes.values() if not a.cast and a.pick != MAX_DATE}
    assert attr not in fine or role == "nup"


def test_readable_values_are_written(spark):
    t = from_rows(spark, fixture_rows())
    cfg = DimensionConfig(as_of=dt.datetime(2025, 1, 1))
    with write_attributes(t, cfg) as values:
        assert bad_values(values, cfg).collect() == []
        assert demand_dimension(t, cfg, values=values).count() == 13


# --- holidays ----------------------------------------------------------------------------------


def test_many_holidays_against_a_count(spark):
    draw = random.Random(9)
    days = [dt.date(1990, 1, 1) + dt.timedelta(days=i) for i in range(14_000)]
    holidays = draw.sample(days, 5000)
    spans = [(draw.choice(days), draw.choice(days)) for _ in range(60)] + [(days[0], days[-1]), (days[5], days[5]), (None, days[1]), (days[1], None), (dt.date(1950, 1, 1), dt.date(1989, 12, 31))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i long, a date, b date")
    off = set(holidays)
    for i, a, b, n in df.select("i", "a", "b", business_days("a", "b", holidays)).collect():
        if a is None or b is None:
            assert n is None
            continue
        want = sum(1 for k in range((b - a).days + 1) if (a + dt.timedelta(days=k)).weekday() < 5 and a + dt.timedelta(days=k) not in off)
        assert n == want, (a, b)


@settings(max_examples=15, deadline=None)
@given(st.sets(st.dates(dt.date(2020, 1, 1), dt.date(2020, 3, 1)), min_size=1, max_size=20))
def test_count_up_to_any_list(spark, days):
    ordered = sorted(days)
    at = [dt.date(2019, 12, 31) + dt.timedelta(days=i) for i in range(0, 64, 3)]
    df = spark.createDataFrame([(d,) for d in at], "d date")
    got = [r[0] for r in df.select(count_up_to(F.col("d"), ordered)).collect()]
    assert got == [sum(x <= d for x in ordered) for d in at]
