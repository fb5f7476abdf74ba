"""Rules with a tolerance at just the tolerance."""

from datetime import datetime

from tidemark.operators import quality

DAY = datetime(2024, 1, 5)


def test_a_discount_off_by_just_the_tolerance_is_allowed(spark):
    """0.01 an item and 0.011 are 0.021 and 0.041; as doubles the first sum is smaller."""
    campaigns = spark.createDataFrame([(1, 0.0, "nurture", DAY, DAY)],
                                      "campaign_id long, discount_pct double, objective string, start_date timestamp_ntz, end_date timestamp_ntz")
    orders = spark.createDataFrame(
        [(1, DAY, 0.21, 0.21 * 0.1, 1), (1, DAY, 0.41, 0.41 * 0.1, 3), (1, DAY, 0.22, 0.22 * 0.1, 1), (1, DAY, 0.21, 0.0, 1)],
        "campaign_id long, order_ts timestamp_ntz, gross_amount double, discount_amount double, item_count long")
    got = {r.rule: r.violations for r in quality.discounts(orders, campaigns).collect()}
    assert got["discount differs from campaign"] == 1


def test_sums_of_lines_off_by_just_the_tolerance_are_allowed(spark):
    orders = spark.createDataFrame([(1, 10.0, 0.11, 9.89, 1)], "order_id long, gross_amount double, discount_amount double, net_amount double, item_count long")
    lines = spark.createDataFrame([(1, 1, 9.89, 0.0, 9.89)], "order_id long, quantity long, unit_price double, discount_amount double, net_amount double")
    got = {r.rule: r.violations for r in quality.order_arithmetic(orders, lines).collect()}
    assert got["discount != sum of lines"] == 0
