"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from tessera.plans import hybrid

from .compare import differences, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(hybrid.queries()))
def test_query(spark, name):
    got = hybrid.queries()[name](spark, SF).toPandas()
    sql = hybrid.oracle_sql().get(name)
    if sql:
        assert (d := differences(got, sql_rows(SF, sql))) is None, d
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
