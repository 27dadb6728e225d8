"""Every registered query against its SQL twin, and the driver's contract."""

import __spark_entry__ as driver
import pytest
from support import SMALL, plan_of

from workload import all_queries, all_sql
from workload.compare import connect, difference


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, name):
    df = all_queries()[name](spark, SMALL)
    assert difference(df, con, all_sql()[name]) is None
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    # What cat5 asks for is stored before its result is planned.
    assert ("InPandas" in plan) == (name == "cat1_user_classifier")


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(all_sql()) == set(all_queries()) <= set(driver.queries())
    df = driver.entry(spark)
    assert df.count() > 0 and "quadrant" in df.columns


def test_filters_and_columns_reach_the_scan(spark, capsys):
    all_queries()["top1_by_reactions"](spark, SMALL).explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "EqualTo(o_orderstatus,O)" in pushed and "GreaterThanOrEqual(o_orderdate" in pushed
    read = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "o_totalprice" in read and "o_custkey" not in read


def test_whole_texts_are_not_read_for_ranking(spark, capsys):
    """The wide column is read once, for the winners' join, not for the ranking."""
    all_queries()["set1_duplicate_texts"](spark, SMALL).explain("formatted")
    plan = capsys.readouterr().out
    assert sum("text" in line for line in plan.splitlines() if line.startswith("ReadSchema")) == 1
