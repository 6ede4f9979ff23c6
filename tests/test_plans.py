"""Each registered query against its SQL, at the smallest size."""

import pytest
from pyspark.sql import functions as F

from tests.compare import SMALL, assert_same
from tidewell import plans
from tidewell.plans.tables import rounded


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(plans.QUERIES[name](spark, SMALL), plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_has_rows(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0


def test_days_of_five_digit_years(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("event_id", F.col("event_id") + 2_932_000)
    events.write.parquet(str(tmp_path / "events.parquet"))
    sql = plans.ORACLES["date_functions"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    days = {len(r["day"]) for r in plans.QUERIES["date_functions"](spark, str(tmp_path)).collect()}
    assert days == {10, 11}  # some before the year 10000, some after
    assert_same(plans.QUERIES["date_functions"](spark, str(tmp_path)), sql)
    assert_same(rounded(spark.sql("SELECT make_date(12345, 6, 7) AS d")), "SELECT '12345-06-07' AS d")
