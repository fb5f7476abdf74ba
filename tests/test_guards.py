"""Checks that run inside the plan of the operator they guard."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohorts, lifecycle
from tidemark.operators import timewin as tw
from tidemark.sources import tables as src

DAY = datetime(2024, 1, 5)


def test_a_prospect_with_two_customer_records_raises(spark):
    prospects = spark.createDataFrame([(1, DAY, "a"), (2, DAY, "b")], "prospect_id int, created_at timestamp_ntz, acquisition_channel string")
    make = lambda rows: spark.createDataFrame(rows, "prospect_id int, customer_id int, customer_since timestamp_ntz")
    good = lifecycle.people_frame(prospects, make([(1, 7, DAY), (None, 8, DAY), (None, 9, DAY)]))
    assert sorted((r.prospect_id, r.customer_id) for r in good.collect()) == [(1, 7), (2, None)]
    with pytest.raises(Exception, match="2 for prospect_id 1"):
        lifecycle.people_frame(prospects, make([(1, 7, DAY), (1, 8, DAY)])).collect()


def test_the_check_adds_no_shuffle_to_the_join(spark):
    """Both sides are partitioned by the key once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = spark.range(50).select(F.col("id").alias("prospect_id"), F.lit(DAY).alias("created_at"), F.lit("a").alias("acquisition_channel"))
        c = spark.range(50).select(F.col("id").alias("prospect_id"), F.col("id").alias("customer_id"), F.lit(DAY).alias("customer_since"))
        plan = lifecycle.people_frame(p, c)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_order_before_its_cohort_raises(spark):
    customers = spark.createDataFrame([(1, datetime(2024, 2, 3))], "customer_id int, customer_since timestamp_ntz")
    orders = lambda m: spark.createDataFrame([(1, datetime(2024, m, 20), 5.0)], "customer_id int, order_ts timestamp_ntz, net_amount double")
    fine = cohorts.cohort_retention(customers, orders(3), "2024-01-01", "2024-05-01").where("buyers = 1").collect()
    assert [r.months_since_acquisition for r in fine] == [1]
    with pytest.raises(Exception, match="before the cohort month of customer 1"):
        cohorts.cohort_retention(customers, orders(1), "2024-01-01", "2024-05-01").collect()


def test_saved_depths_are_met_within_a_tolerance(spark):
    curve = spark.createDataFrame([(0.1 + 0.2, "x"), (0.3, "y"), (0.5, "z")], "depth double, who string")
    assert sorted(r.who for r in tw.nearest_rows(curve, "depth", 0.31).collect()) == ["x", "y"]


def test_tables_are_read_by_declared_name(spark, tmp_path):
    from tidemark.schema import TABLES
    spec = TABLES["experiment_assignments"]
    spark.createDataFrame([("e", "p", "control", DAY)], spec.struct()).write.parquet(f"{tmp_path}/experiment_assignments.parquet")
    assert src.load_tables(spark, str(tmp_path), ["experiment_assignments"])["experiment_assignments"].count() == 1
    with pytest.raises(KeyError, match="unknown"):
        src.load_tables(spark, str(tmp_path), ["orders", "unknown"])


def test_assumptions_are_named_and_in_range():
    from tidemark.operators import targeting as tg
    assert tg.assume(tg.RETENTION, save_rate=0.2)["incentive_cost"] == tg.RETENTION["incentive_cost"]
    for bad in ({"save_rate": 1.2}, {"contact_cost": -1.0}, {"unknown": 0.5}):
        with pytest.raises(ValueError, match="out of range"):
            tg.assume(tg.RETENTION, **bad)
    assert tg._perk_and_contact(tg.assume(tg.GROWTH, perk_cost=20.0)) == 10.0
