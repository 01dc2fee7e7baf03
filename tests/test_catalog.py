"""Every registered record query against its SQL."""

import pytest
from oracle import same

from recordsieve import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name], sf_dir)


def test_pushed_down(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = catalog.QUERIES["typed_and"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(l_returnflag,R)" in plan and "GreaterThanOrEqual(l_quantity,25.0)" in plan and "StringStartsWith(l_linestatus,O)" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]
    assert "Exchange" not in plan and "Python" not in plan
