"""Every query of the catalogue against its oracle on the smallest tables."""

import pytest

from tests.compare import connect, same
from ventura.plans import catalogue

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    same(QUERIES[name](spark, DIR), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    QUERIES[name](spark, DIR).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_buckets_partition_the_firms(spark):
    from ventura.plans.model import Tables

    total = Tables(spark, DIR).companies.count()
    assert sum(r["n"] for r in QUERIES["K01_share_by_bucket"](spark, DIR).collect()) == total


def test_whole_forms_take_every_firm(spark):
    from ventura.plans.model import Tables

    d = "/root/testdata/sf0.01"
    t = Tables(spark, d)
    assert QUERIES["A08_ordered_list"](spark, d).count() == t.deals.select("company_id").distinct().count()
    assert QUERIES["J12_entity_match"](spark, d).filter("match_id % 2 = 1").count() > 0


def test_reference_limits(spark):
    from ventura.plans.model import Tables

    d = "/root/testdata/sf0.01"
    assert QUERIES["D01_newest_firms"](spark, d).count() == Tables(spark, d).companies.count() > 500
    assert "LIMIT 5000" in ORACLES["D20_hidden_search"]
