"""The demand dimension on the hand-made fixture equals the expected 13 rows (FIXTURES.md §2)."""

import datetime as dt
from collections import Counter

import pytest

from dimweave import DimensionConfig, demand_dimension
from dimweave.plans import REPORT_COLUMNS
from tests.fixture import expected_rows

AS_OF = dt.datetime(2025, 1, 1)


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("plan", ["single_pass", "per_attribute"])
def test_golden_dimension(spark, fixture_tables, plan):
    header, expected = expected_rows()
    assert tuple(header) == REPORT_COLUMNS
    out = demand_dimension(fixture_tables, DimensionConfig(as_of=AS_OF), plan=plan)
    assert tuple(out.columns) == REPORT_COLUMNS
    got = _rows(out)
    assert got == Counter(expected), (sorted(got - Counter(expected)), sorted(Counter(expected) - got))


def test_sorted_by_demand(spark, fixture_tables):
    ids = [r[0] for r in demand_dimension(fixture_tables, DimensionConfig(as_of=AS_OF)).collect()]
    assert ids == sorted(ids)


def test_office_filter_off_keeps_demands_without_office(spark, fixture_tables):
    out = demand_dimension(fixture_tables, DimensionConfig(as_of=AS_OF, office=None), sort=False)
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r["Nº Demanda"], set()).add(r["NURAC"])
    # demand 13 has no office: 'N.D.'; demand 3 moved to SAO and is back once the filter is off
    assert by_id[13] == {"N.D."}
    assert by_id[3] == {"SAO"}
    assert 9 not in by_id and 10 not in by_id and 11 not in by_id and 12 not in by_id
