"""The integrity audit finds what is wrong, and walks the panel twice only."""

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import cohorts, leads, lifecycle, segments
from tidemark.plans import q_lifecycle as plans
from tidemark.sources import adapters as ad

SF = "/root/testdata/sf0.001"


def audit(spark, change):
    t, args = ad.ledger(spark, SF), (plans.AS_OF, plans.FIRST, plans.LAST, plans.RULES)
    p = change(lifecycle.build_panel(t["prospects"], t["customers"], t["orders"], plans.FIRST, plans.LAST, plans.RULES))
    table = cohorts.cohort_retention(t["customers"], t["orders"], "1995-01-01", plans.END)
    prof = segments.customer_profile(t, plans.AS_OF, plans.RULES)
    return lifecycle.integrity_audit(t["prospects"], t["customers"], t["orders"], p, table, cohorts.pooled_retention(table, 12), prof, *args)


def test_broken_panels_are_reported(spark):
    month = F.col("period") == F.lit(date(2000, 3, 1))
    who = F.col("prospect_id") == 7
    same = {r.check_name: r.violations for r in audit(spark, lambda p: p).collect()}
    assert len(same) == 10 and set(same.values()) == {0}
    lost = {r.check_name: r.violations for r in audit(spark, lambda p: p.where(~(month & who))).collect()}
    assert lost["every_created_person_is_present"] == 1
    bad = F.when(month & who, "gone").otherwise(F.col("state"))
    odd = {r.check_name: r.violations for r in audit(spark, lambda p: p.withColumn("state", bad)).collect()}
    assert odd["every_person_has_one_valid_state_once_created"] == 1
    probe = F.when((F.col("period") == F.lit(date(2001, 6, 1))) & who, "loyal").otherwise(F.col("state"))
    late = {r.check_name: r.violations for r in audit(spark, lambda p: p.withColumn("state", probe)).collect()}
    assert late["states_unchanged_when_later_orders_removed"] == late["segment_profile_uses_panel_states"] == 2


def test_the_panel_is_walked_twice(spark):
    walks = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(s):
        walks.add(1)
        return s

    report = audit(spark, lambda p: p.withColumn("state", seen.asNondeterministic()("state")))
    report.collect()
    rows = lifecycle.build_panel(*[ad.ledger(spark, SF)[n] for n in ("prospects", "customers", "orders")], plans.FIRST, plans.LAST,
                                 plans.RULES).count()
    assert walks.value <= 2 * rows


def test_a_difference_counts_copies_on_both_sides(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "z")], "k int, v string")
    assert leads.frame_difference(a, b).first()[0] == 3
    assert leads.frame_difference(a.limit(0), b.limit(0)).first()[0] == 0
