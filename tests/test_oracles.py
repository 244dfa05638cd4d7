"""Every query of the engine's own operators against its SQL, over the smallest tables."""

import oracle
import pytest

from siftstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    assert oracle.of_spark(registry.QUERIES[name](spark, SF)) == oracle.of_sql(registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["item_id", "rank", "doc_id", "score"]
