"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import pytest

from tallyspark import plans
from tests.compare import oracle, same
from tests.conftest import SF

#: Rows that the smallest tables don't have.
MAY_BE_EMPTY = {"l2_entity_page", "j18_merge_conflicts"}


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, name):
    found = plans.queries()[name](spark, SF).toPandas()
    if name in plans.oracles():
        same(found, oracle(SF, plans.oracles()[name]))
    else:
        assert len(found) or name in MAY_BE_EMPTY


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
