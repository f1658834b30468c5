"""Column helpers: business days against brute force, month names, labels, strict casts."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dimweave.config import MONTH_NAMES_PT, SOURCE_STAGE_RULES, STAGE_DEFAULT
from dimweave.functions import (
    business_days,
    close_interval,
    executor_label,
    first_match_label,
    month_name,
    place_label,
    strict_date,
    strict_int,
    substr,
)


def brute_business_days(start, end, holidays=()):
    if start is None or end is None:
        return None
    if end < start:
        return 0
    hol = set(holidays)
    n, d = 0, start
    while d <= end:
        if d.weekday() < 5 and d not in hol:
            n += 1
        d += dt.timedelta(days=1)
    return n


HOLIDAYS = (dt.date(2024, 1, 1), dt.date(2024, 12, 25), dt.date(2024, 6, 8), dt.date(2025, 5, 1))


@settings(max_examples=1, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.dates(dt.date(2023, 6, 1), dt.date(2025, 6, 1))),
            st.one_of(st.none(), st.dates(dt.date(2023, 6, 1), dt.date(2025, 6, 1))),
        ),
        min_size=300,
        max_size=300,
    )
)
def test_business_days_matches_brute_force(spark, pairs):
    # one Spark job checks 300 random intervals (with NULL ends and reversed intervals)
    pairs = pairs + [(dt.date(2024, 1, 1), dt.date(2024, 1, 1)), (dt.date(2024, 1, 6), dt.date(2024, 1, 7))]
    df = spark.createDataFrame(pairs, "s date, e date")
    got = df.select("s", "e", business_days("s", "e", HOLIDAYS).alias("n")).collect()
    for r in got:
        assert r["n"] == brute_business_days(r["s"], r["e"], HOLIDAYS), (r["s"], r["e"], r["n"])


def test_business_days_known_values(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 3, 4), dt.date(2024, 3, 8)), (dt.date(2024, 3, 2), dt.date(2024, 3, 3)),
         (dt.date(2024, 3, 1), dt.date(2024, 3, 11)), (dt.date(2024, 3, 8), dt.date(2024, 3, 4))],
        "s date, e date",
    )
    assert [r[0] for r in df.select(business_days("s", "e")).collect()] == [5, 0, 7, 0]


def test_month_name_null_and_values(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 4),), (None,), (dt.date(2024, 12, 1),)], "d date")
    assert [r[0] for r in df.select(month_name("d", MONTH_NAMES_PT)).collect()] == ["Março", None, "Dezembro"]


def test_first_match_label_order_and_default(spark):
    names = ["Conferir cadastro e executar atividade", "Emitir a O.S.", "Emitir Relatório Síntese", None, "Fim",
             "ENTRADA DO PROCESSO SEI"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(first_match_label("n", SOURCE_STAGE_RULES, STAGE_DEFAULT)).collect()]
    # the first matching pattern wins; the loose 'emitir%o%s' also takes a report name
    assert got == ["Etapa 01", "Etapa 05", "Etapa 05", STAGE_DEFAULT, STAGE_DEFAULT, "Etapa 00"]


def test_place_label(spark):
    rows = [(" Confins ", "MG"), (None, "MG"), ("Confins", None), (None, None)]
    df = spark.createDataFrame(rows, "m string, u string")
    assert [r[0] for r in df.select(place_label("m", "u")).collect()] == ["Confins, MG", "MG", None, None]


def test_executor_label_keeps_null(spark):
    rows = [("", "Concluída"), ("", "Em andamento"), (None, "Concluída"), ("ana", "Concluída")]
    df = spark.createDataFrame(rows, "l string, s string")
    got = [r[0] for r in df.select(executor_label("l", "s", "Concluída", "Fin", "Sem")).collect()]
    assert got == ["Fin", "Sem", None, "ana"]


def test_substr_short_text(spark):
    df = spark.createDataFrame([("SPO/GTREG",), ("AB",), (None,)], "v string")
    got = df.select(substr("v", 5, 7).alias("a"), substr("v", 1, 3).alias("b")).collect()
    assert [tuple(r) for r in got] == [("GTREG", "SPO"), ("", "AB"), (None, None)]


def test_strict_int_accepts_and_rejects(spark):
    ok = spark.createDataFrame([(" 2021 ",), ("7",), (None,)], "v string")
    assert [r[0] for r in ok.select(strict_int("v")).collect()] == [2021, 7, None]
    for bad in ("20x1", ""):
        df = spark.createDataFrame([(bad,)], "v string")
        with pytest.raises(PySparkException):
            df.select(strict_int("v")).collect()


def test_strict_date_rejects_other_format(spark):
    ok = spark.createDataFrame([("2024-03-04",)], "v string")
    assert ok.select(strict_date("v")).first()[0] == dt.date(2024, 3, 4)
    bad = spark.createDataFrame([("31/12/2024",)], "v string")
    with pytest.raises(PySparkException):
        bad.select(strict_date("v")).collect()


def test_strict_date_reads_what_the_postgresql_cast_reads(spark):
    texts = ["2024-01-05 10:00:00", "2024-1-5", " 2024-01-05 ", "2024-01-05T10:00", "2024-01-05"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert {r[0] for r in df.select(strict_date("v")).collect()} == {dt.date(2024, 1, 5)}
    br = spark.createDataFrame([(" 05/01/2024",), ("2024-01-05",), ("05.01.2024",)], "v string")
    assert {r[0] for r in br.select(strict_date("v", ("dd/MM/yyyy", "dd.MM.yyyy"))).collect()} == {dt.date(2024, 1, 5)}
    for bad in ("2024", "2024-01", "2024-13-05", "amanhã", ""):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "v string").select(strict_date("v")).collect()


def test_strict_casts_raise_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = spark.createDataFrame([("x",)], "v string")
        with pytest.raises(PySparkException):
            df.select(strict_int("v")).collect()
        with pytest.raises(PySparkException):
            df.select(strict_date("v")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_close_interval_fixed_and_now(spark):
    as_of = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(None,), (dt.datetime(2024, 2, 1, 8),)], "e timestamp_ntz")
    got = [r[0] for r in df.select(close_interval("e", as_of)).collect()]
    assert got == [as_of, dt.datetime(2024, 2, 1, 8)]
    live = df.select(close_interval("e").alias("x"))
    assert live.schema["x"].dataType.simpleString() == "timestamp_ntz"
    assert live.where(F.col("x").isNull()).count() == 0


def test_cluster_conf_sizes_partitions():
    from dimweave.session import cluster_conf

    conf = cluster_conf(100 << 40, cores=8000)  # 100 TiB on 8000 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert cluster_conf(1 << 30, cores=64)["spark.sql.shuffle.partitions"] == str(3 * 64)
    assert conf["spark.sql.adaptive.enabled"] == "true"
