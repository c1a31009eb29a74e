"""Every registered query of the layer analysis against its SQL on the smallest tables."""

import pytest

from tests.compare import duck_rows, spark_rows
from tests.conftest import DATA
from lamella.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        assert spark_rows(df) == duck_rows(duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
