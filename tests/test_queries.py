"""Every registered query of the reference's operators against its SQL, over whole tables."""

import pytest
from sql_compare import assert_same, connect

from loomspan.queries import QUERIES, SQL

ROWS_ONLY = sorted(set(QUERIES) - set(SQL))


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, con, name):
    assert_same(QUERIES[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["task_id", "crossfile_context"]
    assert found.count() > 0


def test_losses_of_a_zero(spark, tmp_path):
    """The logarithm of 0 is minus infinity in the SQL and makes the mean so; null counts 0."""
    spark.sql("SELECT * FROM VALUES (1D), (0D), (2.5D), (CAST(NULL AS DOUBLE)) t(value)").coalesce(1).toPandas().to_parquet(tmp_path / "events.parquet")
    assert assert_same(QUERIES["losses"](spark, str(tmp_path)), connect(str(tmp_path)), SQL["losses"]) == 1
