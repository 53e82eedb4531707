"""Every registered query equals its SQL on the smallest tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from civiltext.plans import planted

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(queries()))
def test_query_equals_sql(spark, con, key):
    ok, message = compare(spark, con, key, queries()[key], oracle_sql().get(key), SF)
    assert ok, message


def test_entry_and_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    df = entry(spark)
    assert df.columns == ["msg_id", "confidence", "is_bullying", "severity", "n_detections"]
    assert df.limit(1).count() == 1


def test_merge_returns_every_term(spark):
    merged = queries()["lexicon_merge"](spark, SF)
    assert merged.columns == ["term", "kind", "lang", "severity", "origin"]
    mined = planted.mined_with_levels(spark, SF).select("term", "kind", "lang")
    assert mined.join(merged, ["term", "kind", "lang"], "left_anti").isEmpty()
