"""The dimension plans: equivalence on random data, properties, error behaviour, plan shape."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from dimweave import DimensionConfig, demand_dimension
from dimweave.config import ALL, MAX_DATE, Attribute
from dimweave.plans.dimension import attribute_values, write_attributes
from dimweave.sources.tables import from_rows, load_parquet
from tests.fixture import fixture_rows
from tests.random_eav import RANDOM_CONFIG, random_rows

AS_OF = dt.datetime(2025, 1, 1)


def _bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plans_agree_on_random_eav(spark, seed):
    t = from_rows(spark, random_rows(seed))
    a = demand_dimension(t, RANDOM_CONFIG, plan="per_attribute", sort=False)
    b = demand_dimension(t, RANDOM_CONFIG, plan="single_pass", sort=False)
    ra, rb = _bag(a), _bag(b)
    assert ra == rb
    assert sum(ra.values()) > 0


def test_plans_agree_with_a_hot_demand(spark):
    # demand 1 holds about a third of all attribute rows
    rows = random_rows(5, n_demands=60, hot_rows=600)
    assert sum(1 for r in rows["demanda_dado"] if r[0] == 1) * 3 >= len(rows["demanda_dado"])
    rows["demanda"][0] = (1, 1) + rows["demanda"][0][2:]  # keep it in the version
    rows["demanda_etapa"].append((10_000, 1, "ana", 101, None, None, None, None))
    t = from_rows(spark, rows)
    cfg = RANDOM_CONFIG.with_(office=None)
    a = _bag(demand_dimension(t, cfg, plan="per_attribute", sort=False))
    b = _bag(demand_dimension(t, cfg, plan="single_pass", sort=False))
    assert a == b
    assert sum(n for r, n in b.items() if r[0] == 1) > 100
    # the same with the hot demand's fan-out split over many cells
    split = demand_dimension(t, cfg.with_(fanout_rows_per_task=10), sort=False)
    assert _bag(split) == a


def test_hot_demand_without_a_role(spark):
    # demand 1 is above the split in rows and in values; it lacks an optional role, demand 2 a required one
    rows = random_rows(5, n_demands=6, hot_rows=300)
    rows["demanda"][:2] = [(d, 1) + rows["demanda"][d - 1][2:] for d in (1, 2)]
    rows["demanda_etapa"] += [(10_000 + d, d, "ana", 101, None, None, None, None) for d in (1, 2)]
    owned = {v[0] for v in rows["dado_valor"] if v[1] == 11}  # linha_pta
    rows["demanda_dado"] = [r for r in rows["demanda_dado"] if not (r[0] == 1 and r[1] in owned)]
    required = {v[0] for v in rows["dado_valor"] if v[1] == 2}  # cliente
    rows["demanda_dado"] = [r for r in rows["demanda_dado"] if not (r[0] == 2 and r[1] in required)]
    t = from_rows(spark, rows)
    cfg = RANDOM_CONFIG.with_(office=None)
    want = _bag(demand_dimension(t, cfg, plan="per_attribute", sort=False))
    hot = [r for r in want if r[0] == 1]
    assert len(hot) > 100 and {r[7] for r in hot} == {None} and not any(r[0] == 2 for r in want)
    for rows_per_task, block in ((10, 8192), (7, 2), (10**6, 1)):
        split = demand_dimension(t, cfg.with_(fanout_rows_per_task=rows_per_task, fanout_block=block), sort=False)
        assert _bag(split) == want


def _brute_product(base, a, b, c):
    """All combinations of a demand's distinct values; b and c are optional, and a missing b reads as the row's year."""
    out = set()
    for d, name, year in base:
        lists = [{r[1:] for r in rows if r[0] == d} for rows in (a, b, c)]
        years = {year if x[0] is None else x[0] for x in lists[1] or {(None,)}}
        out |= {(d, name, year, *x, y, *z) for x in lists[0] for y in years for z in lists[2] or {(None,)}}
    return out


@pytest.mark.parametrize("rows_per_task,block", [(10**6, 8192), (3, 8192), (3, 2), (1, 1), (5, 4)])
def test_product_matches_brute_force(spark, rows_per_task, block):
    import random

    from dimweave.operators.fanout import member_rows, product

    draw = random.Random(1)
    base = [(d, f"n{d}", d % 3 if d % 4 else None) for d in range(1, 30)] + [(1, "extra", 1), (3, "n3", 0)]
    a = [(1, f"a{i}", i) for i in range(40)] + [(d, f"a{draw.randrange(4)}", None) for d in range(2, 30) if d % 5 for _ in range(3)]
    b = [(1, draw.choice([0, 1, 2, None])) for _ in range(25)] + [(d, draw.choice([0, 1, 2, None])) for d in range(2, 30) if d % 3 for _ in range(2)]
    c = [(d, f"c{i}") for d in (1, 3, 7, 99) for i in range(11)]
    frames = [
        spark.createDataFrame(base, "id_demanda long, n string, y int"), spark.createDataFrame(a, "id_demanda long, a string, k int"),
        spark.createDataFrame(b, "id_demanda long, b int"), spark.createDataFrame(c, "id_demanda long, c string"),
    ]
    members = member_rows(frames[0], 0)
    for i, f in enumerate(frames[1:], start=1):
        members = members.unionByName(member_rows(f, i), allowMissingColumns=True)
    out = product(members, [["n", "y"], ["a", "k"], ["b"], ["c"]], rows_per_task, [2, 3], (2, lambda r: r["y"]), block=block)
    assert out.columns == ["id_demanda", "n", "y", "a", "k", "b", "c", "cell", "place"]
    got = Counter(tuple(r)[:-2] for r in out.collect())
    assert set(got) == _brute_product(base, a, b, c) and max(got.values()) == 1


def test_hot_cuts_number_the_cells(spark):
    from dimweave.operators.fanout import hot_cuts

    counts = spark.createDataFrame([(1, 1, 40), (1, 2, 5), (1, 3, 9), (2, 1, 8)], "id_demanda long, role int, n long")
    (row,) = hot_cuts(counts, block=8).collect()
    assert (row["id_demanda"], row["cells"]) == (1, 10)
    assert [tuple(c) for c in row["cuts"]] == [(1, 5, 1), (3, 2, 5)]


def test_no_stretch_exceeds_its_rows(spark):
    from pyspark.sql import functions as F

    from dimweave.operators.fanout import fan_out

    # six roles of 12 values: 2,985,984 rows
    roles = [(r, spark.createDataFrame([(1, f"{r}{i}") for i in range(12)], f"id_demanda long, {r} string")) for r in "abcdef"]
    out = fan_out(spark.createDataFrame([(1,)], "id_demanda long"), roles, 2000)
    sizes = [r["count"] for r in out.groupBy("cell", F.floor(F.col("place") / 2000)).count().collect()]
    assert sum(sizes) == 12**6 and max(sizes) == 2000
    assert out.select("id_demanda", *"abcdef").distinct().count() == 12**6


def test_the_lists_take_one_exchange_more(spark):
    t = from_rows(spark, random_rows(3))
    with write_attributes(t, RANDOM_CONFIG) as values:
        plan = _executed(demand_dimension(t, RANDOM_CONFIG, sort=False, values=values))
    above, lists, _ = plan.partition("collect_set(v0")
    assert lists and above.count("Exchange") <= 2 and "REPARTITION_BY_NUM" in above
    assert "SortMergeJoin" not in above and "BroadcastHashJoin" not in above


@pytest.mark.parametrize("office", [None, "BHZ"])
def test_plans_agree_without_office_filter(spark, office):
    t = from_rows(spark, random_rows(7))
    cfg = RANDOM_CONFIG.with_(office=office)
    assert _bag(demand_dimension(t, cfg, plan="per_attribute", sort=False)) == _bag(
        demand_dimension(t, cfg, plan="single_pass", sort=False)
    )


def test_dimension_properties(spark):
    t = from_rows(spark, random_rows(11))
    out = demand_dimension(t, RANDOM_CONFIG).collect()
    assert len(out) == len(set(tuple(r) for r in out))  # distinct rows
    labels = {lbl for _, lbl in RANDOM_CONFIG.stage_rules} | {RANDOM_CONFIG.stage_default}
    assert {r["Etapa"] for r in out} <= labels
    assert {r["NURAC"] for r in out} == {"BHZ"}
    ids = [r["Nº Demanda"] for r in out]
    assert ids == sorted(ids)


def _with_value(rows, demand, vid, attr, text):
    rows = {k: list(v) for k, v in rows.items()}
    rows["dado_valor"].append((vid, attr, text))
    rows["demanda_dado"].append((demand, vid, dt.datetime(2024, 1, 1)))
    return rows


@pytest.mark.parametrize("plan", ["single_pass", "per_attribute"])
@pytest.mark.parametrize("attr,text", [(4604, "31/12/2024"), (4694, "20x1"), (4654, "amanhã")])
def test_bad_text_under_its_attribute_raises(spark, plan, attr, text):
    t = from_rows(spark, _with_value(fixture_rows(), 1, 900, attr, text))
    with pytest.raises(PySparkException):
        demand_dimension(t, DimensionConfig(as_of=AS_OF), plan=plan).collect()


@pytest.mark.parametrize("plan", ["single_pass", "per_attribute"])
def test_bad_date_of_another_version_is_never_read(spark, plan):
    # demand 9 belongs to another process version: its attribute rows are never parsed
    t = from_rows(spark, _with_value(fixture_rows(), 9, 900, 4604, "31/12/2024"))
    out = demand_dimension(t, DimensionConfig(as_of=AS_OF), plan=plan).collect()
    assert len(out) == 13


def test_same_text_under_another_attribute_does_not_raise(spark):
    # a text that is no date under an attribute that is not read as a date: no error in the single pass
    rows = _with_value(fixture_rows(), 1, 900, 4623, "31/12/2024")
    t = from_rows(spark, rows)
    out = demand_dimension(t, DimensionConfig(as_of=AS_OF), plan="single_pass").collect()
    assert "31/12/2024" in {r["Linha PTA (SPO)"] for r in out}


def test_registry_is_configurable(spark, fixture_tables):
    # reading term_prev as a multi-valued date instead of the greatest one still runs
    attrs = dict(DimensionConfig().attributes)
    attrs["term_prev"] = Attribute((4647,), MAX_DATE)
    attrs["linha_pta"] = Attribute((4623, 4594), ALL)
    out = demand_dimension(fixture_tables, DimensionConfig(as_of=AS_OF, attributes=attrs)).collect()
    assert {"Rampa", "PTA-7"} <= {r["Linha PTA (SPO)"] for r in out}


def _parquet_tables(spark, tmp_path):
    t = from_rows(spark, fixture_rows())
    for name in ("demanda", "demanda_dado", "dado_valor", "demanda_etapa", "elemento_pn", "status_demanda"):
        getattr(t, name).write.parquet(str(tmp_path / name))
    return load_parquet(spark, str(tmp_path))


def _executed(df):
    """The final adaptive plan (the text also lists the initial plan, which is cut off)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


VALUE_SCAN = "ReadSchema: struct<id_dado_valor:bigint,nm_valor:string,id_dado:int>"
BRIDGE_SCAN = "ReadSchema: struct<id_demanda:bigint,id_dado_valor:bigint,dt_cadastro:timestamp_ntz>"


def _scans(plan, schema):
    return [ln for ln in plan.splitlines() if "FileScan parquet" in ln and schema in ln]


def test_single_pass_reads_the_attribute_tables_once(spark, tmp_path):
    t = _parquet_tables(spark, tmp_path)
    cfg = DimensionConfig(as_of=AS_OF)
    written = _executed(attribute_values(t, cfg.with_(office=None)))  # the plan that write_attributes runs
    assert len(_scans(written, VALUE_SCAN)) == 1 and len(_scans(written, BRIDGE_SCAN)) == 1, written
    assert "PushedFilters: [In(id_dado" in _scans(written, VALUE_SCAN)[0]
    # with an office one more read finds its demands: of the office attribute alone
    office, all_ids = sorted(_scans(_executed(attribute_values(t, cfg)), VALUE_SCAN), key=lambda ln: "In(id_dado" in ln)
    assert "EqualTo(id_dado,3780)" in office and "In(id_dado" in all_ids
    with write_attributes(t, cfg) as values:
        plan = _executed(demand_dimension(t, cfg, values=values))
    assert not _scans(plan, VALUE_SCAN) and not _scans(plan, BRIDGE_SCAN), plan


def test_no_shuffle_carries_the_whole_report(spark, tmp_path):
    t = _parquet_tables(spark, tmp_path)
    plan = _executed(demand_dimension(t, DimensionConfig(as_of=AS_OF)))
    keys = [ln.split("partitioning(")[1].split("), ")[0].count("#") for ln in plan.splitlines() if "Exchange" in ln and "partitioning(" in ln]
    # no distinct over the report's columns: the widest key is (demand, cell, stretch) or the sort's
    assert keys and max(keys) <= 4
    assert any("rangepartitioning(id_demanda" in ln and "cell" in ln for ln in plan.splitlines())


def _shuffled_rows(df, column):
    """Rows each exchange of the final plan wrote, with its plan text, for exchanges whose rows have ``column``."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if name == "Exchange":
            output = [a.name() for a in _seq(node.output())]
            if column in output:
                found.append((node.metrics().apply("shuffleRecordsWritten").value(), output))
        todo.extend(_seq(node.children()))
    return found


def _seq(scala):
    return [scala.apply(i) for i in range(scala.size())]


def test_rows_of_other_offices_reach_no_shuffle(spark, tmp_path):
    # 40 demands of the version, the last of them alone in its office, and every third moved away from it
    rows = random_rows(8, n_demands=40)
    rows["demanda"] = [(d[0], 1) + d[2:] for d in rows["demanda"]]
    offices = {v[0] for v in rows["dado_valor"] if v[1] == 4}
    rows["demanda_dado"] = [r for r in rows["demanda_dado"] if r[1] not in offices]
    early, late = dt.datetime(2023, 1, 1), dt.datetime(2024, 6, 1)
    for d in range(1, 41):
        rows["dado_valor"] += [(9000 + d, 4, "REC" if d == 40 else "SAO"), (9500 + d, 4, "REC" if d % 3 == 0 else "SAO")]
        rows["demanda_dado"] += [(d, 9000 + d, late), (d, 9500 + d, early)]
        rows["demanda_etapa"].append((10_000 + d, d, "ana", 101, None, None, None, None))
    for attr in (1, 2, 3):
        rows["dado_valor"].append((9900 + attr, attr, "00040.000001/2024-11"))
        rows["demanda_dado"].append((40, 9900 + attr, late))
    t = from_rows(spark, rows)
    for name in ("demanda", "demanda_dado", "dado_valor", "demanda_etapa", "elemento_pn", "status_demanda"):
        getattr(t, name).write.parquet(str(tmp_path / name))
    t = load_parquet(spark, str(tmp_path))
    cfg = RANDOM_CONFIG.with_(office="REC")
    own = sum(r[0] == 40 for r in rows["demanda_dado"])
    written = _shuffled_rows(attribute_values(t, cfg), "newest")
    assert written and max(n for n, _ in written) <= own
    everything = write_attributes(t, cfg.with_(office=None))
    out = demand_dimension(t, cfg, values=everything.df, sort=False)
    assert {r[0] for r in out.collect()} == {40}  # the moved ones are not back
    for column in ("v1", "etapa", "nm_elemento_pn", "purpose"):
        sizes = _shuffled_rows(out, column)
        assert all(n <= own for n, _ in sizes), (column, sizes)
    assert _shuffled_rows(out, "v1")
    everything.remove()
    want = demand_dimension(t, cfg, plan="per_attribute", sort=False)
    assert _bag(out.sparkSession.createDataFrame(want.collect(), want.schema)) == _bag(demand_dimension(t, cfg, sort=False))


def test_the_stage_log_is_read_once(spark, tmp_path):
    t = _parquet_tables(spark, tmp_path)
    cfg = DimensionConfig(as_of=AS_OF)
    with write_attributes(t, cfg) as values:
        plan = _executed(demand_dimension(t, cfg, values=values))
    log = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "nm_login_executor" in ln.split("ReadSchema")[1]]
    assert len(log) == 1 and "WindowGroupLimit" in plan, plan


def test_stages_and_flag_keep_ties(spark):
    from dimweave.operators.stages import stages_and_flag

    rows = fixture_rows()
    log = [(7, 1, "ana", 10, 11, None, None, None), (9, 1, "bia", 10, None, None, None, None), (9, 1, None, 12, None, None, None, None),
           (9, 1, None, 12, None, None, None, None), (None, 2, "eva", 12, None, None, None, None), (8, 2, "leo", 10, 99, None, None, None), (5, 3, "x", 20, 11, None, None, None)]
    rows["demanda_etapa"] = log
    rows["elemento_pn"] = [(10, "Conferir cadastro", 1), (11, "Fim", 2), (12, None, 1), (20, "Conferir cadastro", 2)]
    out = stages_and_flag(from_rows(spark, rows), 1, (("%conferir%", "E1"),), "other", 10, 11, "flagged")
    got = Counter(tuple(r) for r in out.collect())
    # demand 1: three rows tie for stage 9, two of them alike; demand 2: a NULL id is newest; demand 3: another version
    assert got == Counter({(1, "bia", "E1", "flagged"): 1, (1, None, "other", "flagged"): 1, (2, "eva", "other", None): 1})


def test_building_a_dimension_runs_no_job(spark):
    t = from_rows(spark, random_rows(3))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    try:
        for plan in ("single_pass", "per_attribute"):
            demand_dimension(t, RANDOM_CONFIG, plan=plan)
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_written_attributes_give_the_same_rows_and_are_removed(spark):
    import os

    t = from_rows(spark, random_rows(4))
    plain = _bag(demand_dimension(t, RANDOM_CONFIG))
    stored = write_attributes(t, RANDOM_CONFIG)
    assert _bag(demand_dimension(t, RANDOM_CONFIG, values=stored.df)) == plain
    path = stored.path.removeprefix("file:")
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) <= 2 * len(os.listdir(path))  # a file or two per attribute, not one per task
    stored.remove()
    assert not os.path.exists(path)


def test_a_cluster_session_without_checkpoint_folder_raises():
    from types import SimpleNamespace

    from dimweave.session import checkpoint_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master=master)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_dir(SimpleNamespace(sparkContext=context))


def test_per_attribute_plan_uses_window_group_limit(spark, tmp_path):
    t = _parquet_tables(spark, tmp_path)
    plan = _executed(demand_dimension(t, DimensionConfig(as_of=AS_OF), plan="per_attribute"))
    assert "WindowGroupLimit" in plan
    assert len(_scans(plan, VALUE_SCAN)) > 1  # one lookup per attribute


def test_status_and_elements_are_broadcast(spark, tmp_path):
    t = _parquet_tables(spark, tmp_path)
    plan = _executed(demand_dimension(t, DimensionConfig(as_of=AS_OF)))
    assert "BroadcastHashJoin" in plan


def test_config_rejects_wrong_pick_for_a_role():
    attrs = dict(DimensionConfig().attributes)
    attrs["cliente"] = Attribute((4599,), "latest", required=True)
    with pytest.raises(ValueError, match="cliente"):
        DimensionConfig(attributes=attrs)
    with pytest.raises(ValueError, match="pick"):
        Attribute((1,), "first")


SETTINGS = [(c, b) for c in ("true", "false") for b in ("10m", "-1")]


@pytest.mark.parametrize("coalesce,broadcast", SETTINGS)
def test_salting_spreads_a_hot_demand_over_partitions(spark, coalesce, broadcast):
    from pyspark.sql import functions as F

    from dimweave.operators.fanout import fan_out as fan_out_roles

    # demand 1: 40 x 30 x 20 = 24,000 output rows; demands 2..50: one row each
    roles = {"a": 40, "b": 30, "c": 20}
    mv = spark.createDataFrame(
        [(1, r, f"{r}{i}") for r, n in roles.items() for i in range(n)]
        + [(d, r, "x") for d in range(2, 51) for r in roles],
        "id_demanda long, role string, nm_valor string",
    )
    narrow = spark.createDataFrame([(d,) for d in range(1, 51)], "id_demanda long")

    def fan_out(rows_per_task):
        frames = [(r, mv.where(F.col("role") == r).select("id_demanda", F.col("nm_valor").alias(r))) for r in roles]
        df = fan_out_roles(narrow, frames, rows_per_task)
        return df.where("id_demanda = 1").groupBy(F.spark_partition_id().alias("p")).count()

    changed = {"spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.autoBroadcastJoinThreshold": broadcast}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        unsalted = [r["count"] for r in fan_out(10**9).collect()]
        salted = [r["count"] for r in fan_out(1000).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert unsalted == [24000]  # the whole product in one partition
    assert sum(salted) == 24000 and len(salted) >= 6  # spread over the shuffle partitions
    assert max(salted) < 24000 / 2
