"""Two-arm experiment: hash assignment, unit table, audits and inference from arm sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import (
    Z95,
    days_between,
    flag,
    plus_days,
    ratio,
    true_or_false,
    ts,
)
from tidemark.functions.lineage import cut
from tidemark.functions.numeric import p_chi2, p_normal, p_student, q_normal, q_student
from tidemark.operators.ranking import by_score, running_extreme, running_totals, score_bounds
from tidemark.operators.replicates import smallest_sums, split_sums

# The analysis plan.
ALPHA, MIN_EFFECT, REVENUE_DAYS, MIN_UNITS = 0.05, 0.02, 90, 30
COVARIATES = ("device_type", "acquisition_channel", "region", "age_band", "income_band",
              "email_opt_in", "lead_type")
NUMERIC_COVARIATES = ("prior_sessions", "days_since_lead")
SUBGROUPS = ("device_type", "acquisition_channel", "lead_type")


def bucket(experiment_id: Column, unit: Column) -> Column:
    """Stable position of a unit in [0, 1): first 32 bits of the SHA-256 of ``experiment:unit``."""
    head = F.substring(F.sha2(F.concat_ws(":", experiment_id, unit.cast("string")), 256), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(4294967296.0)


def variant(experiment_id: Column, unit: Column, share: Column) -> Column:
    return F.when(bucket(experiment_id, unit) < share, "treatment").otherwise("control")


def registry(experiments: DataFrame, experiment_id: str) -> DataFrame:
    """The experiment's row with an exclusive end and its length."""
    end = plus_days("end_date", 1)
    return experiments.where(F.col("experiment_id") == experiment_id).withColumn(
        "window_end", end).withColumn("duration_days", F.datediff(end, "start_date"))


def eligible_population(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """First pre-conversion session of every prospect inside ``[start, end)``."""
    s = sessions.where(F.col("customer_id").isNull() & (F.col("session_start") >= ts(start))
                       & (F.col("session_start") < ts(end)))
    return s.groupBy("prospect_id").agg(F.min("session_start").alias("first_eligible_session"))


def build_units(t: Mapping[str, DataFrame], experiment_id: str, window_end: str,
                revenue_days: int = REVENUE_DAYS) -> DataFrame:
    """One row per assigned prospect: arm, covariates before and outcomes after assignment."""
    from tidemark.operators.funnel import session_depth
    from tidemark.schema import STAGES
    a = t["experiment_assignments"].where(F.col("experiment_id") == experiment_id).select(
        "prospect_id", "variant", "assigned_at")
    end = ts(window_end)
    people = t["prospects"].drop("campaign_id")
    since = t["customers"].select("prospect_id", "customer_id", "customer_since")
    units = a.join(people, "prospect_id", "left").join(since, "prospect_id", "left")

    s = t["sessions"].select("session_id", "prospect_id", F.col("customer_id").alias("_linked"),
                             "session_start").join(
        a.select("prospect_id", "assigned_at"), "prospect_id")
    s = s.join(session_depth(t["funnel_events"]).select("session_id", "depth"), "session_id",
               "left")
    before = F.col("session_start") < F.col("assigned_at")
    after = F.col("_linked").isNull() & ~before & (F.col("session_start") < end)
    per = s.groupBy("prospect_id").agg(
        F.count_if(before).alias("prior_sessions"),
        F.max(F.when(after, F.coalesce("depth", F.lit(0)))).alias("_deepest"))

    o = t["orders"].select("customer_id", "order_id", "order_ts", "net_amount", "item_count")
    o = o.join(units.select("customer_id", "assigned_at").where("customer_id is not null"),
               "customer_id")
    in_window = (F.col("order_ts") >= F.col("assigned_at")) & (
        F.col("order_ts") < plus_days("assigned_at", revenue_days))
    money = o.groupBy("customer_id").agg(
        F.min_by(F.struct("net_amount", "item_count"), F.struct("order_ts", "order_id"))
        .alias("_first"),
        F.sum(F.when(in_window, F.col("net_amount"))).alias("_revenue"))
    units = units.join(per, "prospect_id", "left").join(money, "customer_id", "left")
    converted = true_or_false((F.col("customer_since") >= F.col("assigned_at"))
                              & (F.col("customer_since") < end))
    deepest = F.coalesce("_deepest", F.lit(0))
    units = (units.withColumn("prior_sessions", F.coalesce("prior_sessions", F.lit(0)))
             .withColumn("converted", converted))
    return units.select(
        "prospect_id", "variant", "assigned_at", "created_at", "acquisition_channel", "region",
        "age_band", "income_band", "device_type", "email_opt_in", "customer_id", "customer_since",
        (F.col("variant") == "treatment").alias("treated"), "prior_sessions",
        F.when(F.col("prior_sessions") == 0, "new lead").otherwise("returning lead")
        .alias("lead_type"), days_between("created_at", "assigned_at").alias("days_since_lead"),
        "converted",
        F.when(F.col("converted"), F.col("_first.net_amount")).alias("first_order_value"),
        F.when(F.col("converted"), F.col("_first.item_count").cast("double"))
        .alias("first_order_items"),
        F.when(F.col("converted"), F.col("_first.net_amount")).otherwise(0.0)
        .alias("first_order_revenue"),
        F.coalesce("_revenue", F.lit(0.0)).alias(f"revenue_{revenue_days}d"),
        *[(deepest >= k).alias(f"reached_{s}") for k, s in enumerate(STAGES, 1) if k > 1])


def assignment_audit(units: DataFrame, sessions: DataFrame, experiment_id: str, start: str,
                     window_end: str, share: float) -> DataFrame:
    """Violations per design check plus arm counts for the sample-ratio test."""
    want = variant(F.lit(experiment_id), F.col("prospect_id"), F.lit(share))
    eligible = eligible_population(sessions, start, window_end)
    j = units.join(eligible, "prospect_id", "full_outer")
    n = F.col("variant").isNotNull()
    one = j.agg(
        F.count_if(n & (F.col("variant") != want)).alias("variant_differs_from_hash"),
        (F.count("variant") - F.countDistinct(F.when(n, F.col("prospect_id"))))
        .alias("assigned_twice"),
        F.count_if((F.col("assigned_at") < ts(start)) | (F.col("assigned_at") >= ts(window_end)))
        .alias("assigned_outside_window"),
        F.count_if(F.col("customer_since") < F.col("assigned_at")).alias("assigned_after_order"),
        F.count_if(~F.col("first_eligible_session").eqNullSafe(F.col("assigned_at")))
        .alias("not_assigned_at_first_exposure"),
        F.count_if(F.col("variant") == "control").alias("control_units"),
        F.count_if(F.col("variant") == "treatment").alias("treatment_units"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check_name"),
                                                  F.col(c).alias("rows")) for c in one.columns])))


# ------------------------------------------------------------------ arm sums to estimates
def arm_sums(df: DataFrame, metrics: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, metric) rows with per-arm count, sum and variance; null outcomes are dropped."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("y"))
                      for m, c in metrics.items()])
    long = df.select(*keys, "treated", F.inline(pairs)).where("y is not null")
    t = F.col("treated")
    agg = []
    for arm, cond in (("c", ~t), ("t", t)):
        y = F.when(cond, F.col("y"))
        agg += [F.count(y).alias(f"n_{arm}"), F.sum(y).alias(f"x_{arm}"),
                F.avg(y).alias(f"m_{arm}"), F.var_samp(y).alias(f"v_{arm}")]
    return long.groupBy(*keys, "metric").agg(*agg)


def two_proportions(sums: DataFrame, z: float = Z95) -> DataFrame:
    """Difference of proportions with unpooled SE, interval, z scores and the risk-ratio CI."""
    keys = [c for c in sums.columns if c not in
            {f"{p}_{a}" for p in "nxmv" for a in "ct"}]
    pc, pt = F.col("m_c"), F.col("m_t")
    nc, nt, xc, xt = (F.col(c) for c in ("n_c", "n_t", "x_c", "x_t"))
    diff = pt - pc
    se = F.sqrt(pc * (1 - pc) / nc + pt * (1 - pt) / nt)
    pooled = (xc + xt) / (nc + nt)
    se_pooled = F.sqrt(pooled * (1 - pooled) * (1 / nc + 1 / nt))
    log_rr = F.log(pt / pc)
    se_log = F.sqrt((1 - pt) / xt + (1 - pc) / xc)
    both = (xc > 0) & (xt > 0)
    return sums.select(
        *keys, nc.alias("n_control"), nt.alias("n_treatment"), pc.alias("control"),
        pt.alias("treatment"), diff.alias("diff"), se.alias("se"),
        (diff - z * se).alias("ci_low"), (diff + z * se).alias("ci_high"),
        ratio(diff, se).alias("z"), ratio(diff, se_pooled).alias("z_pooled"),
        F.when(both, F.expm1(log_rr)).alias("relative"),
        F.when(both, F.expm1(log_rr - z * se_log)).alias("relative_ci_low"),
        F.when(both, F.expm1(log_rr + z * se_log)).alias("relative_ci_high"))


def with_p_normal(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", p_normal("z")).withColumn("p_value_pooled",
                                                              p_normal("z_pooled"))


def welch(sums: DataFrame) -> DataFrame:
    """Welch difference of means: SE, degrees of freedom, t statistic, log-ratio SE."""
    keys = [c for c in sums.columns if c not in
            {f"{p}_{a}" for p in "nxmv" for a in "ct"}]
    mc, mt, nc, nt = (F.col(c) for c in ("m_c", "m_t", "n_c", "n_t"))
    vc, vt = F.col("v_c") / nc, F.col("v_t") / nt
    se = F.sqrt(vc + vt)
    df = (vc + vt) * (vc + vt) / (vc * vc / (nc - 1) + vt * vt / (nt - 1))
    diff = mt - mc
    positive = (mc > 0) & (mt > 0)
    return sums.select(*keys, nc.alias("n_control"), nt.alias("n_treatment"), mc.alias("control"),
                       mt.alias("treatment"), diff.alias("diff"), se.alias("se"), df.alias("df"),
                       ratio(diff, se).alias("t"),
                       F.when(positive, F.log(mt / mc)).alias("log_ratio"),
                       F.when(positive, F.sqrt(vt / (mt * mt) + vc / (mc * mc)))
                       .alias("se_log_ratio"))


def with_p_student(df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    crit = q_student(F.lit(1 - alpha / 2), F.col("df"))
    d = df.withColumn("_q", crit).withColumn("p_value", p_student("t", "df"))
    return (d.withColumn("ci_low", F.col("diff") - F.col("_q") * F.col("se"))
            .withColumn("ci_high", F.col("diff") + F.col("_q") * F.col("se"))
            .withColumn("relative", F.expm1("log_ratio"))
            .withColumn("relative_ci_low", F.expm1(F.col("log_ratio")
                                                   - F.col("_q") * F.col("se_log_ratio")))
            .withColumn("relative_ci_high", F.expm1(F.col("log_ratio")
                                                    + F.col("_q") * F.col("se_log_ratio")))
            .drop("_q"))


def guardrail_status(low: Column, high: Column, margin: float) -> Column:
    return F.when(low >= -margin, "pass").when(high < -margin, "fail").otherwise("inconclusive")


def practical_significance(diff: Column, low: Column, high: Column, mei: float = MIN_EFFECT
                           ) -> Column:
    return (F.when(low >= mei, "ci_above_mei").when(high < mei, "ci_below_mei")
            .when(diff >= mei, "estimate_above_mei").otherwise("estimate_below_mei"))


def decision(diff: Column, low: Column, high: Column, guardrails_pass: Column,
             mei: float = MIN_EFFECT) -> Column:
    """Ship rule: significance is read off the interval of the same standard error."""
    significant = (low > 0) | (high < 0)
    return (F.when(~significant, "hold_no_evidence").when(diff < 0, "reject_harm")
            .when(~guardrails_pass, "hold_guardrail").when(low >= mei, "ship")
            .otherwise("ship_and_monitor"))


def _adjusted(df: DataFrame, p: str, name: str, family: Sequence[str], worth: Column, descending: bool) -> DataFrame:
    """The rows with an adjusted p-value.

    ``worth`` gives the value of a distinct p from its totals in ascending order (see ``running_totals``): equal
    p-values share the best of their ranks, so a distinct p is one row. The largest so far (from above: the least)
    is taken inside buckets of p and carried over them, so no window holds a whole family. Missing p-values rank first.
    """
    rows = cut(df)  # an average made twice may differ in its last bit, and the result is joined by p
    key = F.coalesce(F.col(p).cast("double"), F.lit(float("-inf")))
    keyed = rows.select(*family, key.alias("_p"))
    bounds = score_bounds(keyed.where(F.col("_p") > float("-inf")), "_p")
    totals = running_totals(by_score(keyed, "_p", {}, family), [], family, descending=False, bounds=bounds)
    each = totals.select(*family, "score", F.when(F.col("score") > float("-inf"), worth).alias("_w"))
    far = running_extreme(each, "_w", F.min if descending else F.max, family, "score", descending, bounds)
    adjusted = far.select(*[F.col(c).alias(f"_k_{c}") for c in family], F.col("score").alias("_p"), F.col("_w").alias("_a"))
    same = key == F.col("_p")
    for c in family:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(adjusted, same).select(*rows.columns, F.least(F.lit(1.0), F.col("_a")).alias(name))


def holm(df: DataFrame, p: str, name: str = "p_holm", family: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values over a family of any size."""
    return _adjusted(df, p, name, family, (F.col("total_n") - F.col("before_n")) * F.col("score"), False)


def benjamini_hochberg(df: DataFrame, p: str, name: str = "q_bh", family: Sequence[str] = ()
                       ) -> DataFrame:
    """Step-up false discovery rates over a family of any size."""
    return _adjusted(df, p, name, family, F.col("score") * F.col("total_n") / F.col("upto_n"), True)


def cochran_q(effects: DataFrame, by: str) -> DataFrame:
    """Heterogeneity of subgroup effects per dimension."""
    w = 1 / (F.col("se") * F.col("se"))
    s = effects.where("se > 0").groupBy(by).agg(
        F.count(F.lit(1)).alias("levels"), F.sum(w).alias("_w"),
        F.sum(w * F.col("diff")).alias("_wd"), F.sum(w * F.col("diff") * F.col("diff"))
        .alias("_wdd"))
    pooled = F.col("_wd") / F.col("_w")
    return s.where("levels > 1").select(
        by, "levels", (F.col("_wdd") - F.col("_wd") * pooled).alias("q"),
        (F.col("levels") - 1).alias("df"), pooled.alias("pooled_effect"))


def with_p_chi2(df: DataFrame, stat: str = "q") -> DataFrame:
    return df.withColumn("p_value", p_chi2(F.col(stat), F.col("df").cast("double")))


def sample_ratio(units: DataFrame, share: float) -> DataFrame:
    """Chi-square of the observed arm sizes against the designed split."""
    c = units.agg(F.count_if(~F.col("treated")).alias("control"),
                  F.count_if(F.col("treated")).alias("treatment"))
    n = F.col("control") + F.col("treatment")
    ec, et = n * (1 - share), n * share
    chi2 = ((F.col("control") - ec) * (F.col("control") - ec) / ec
            + (F.col("treatment") - et) * (F.col("treatment") - et) / et)
    return c.select("control", "treatment", chi2.alias("chi2"),
                    (F.col("treatment") / n).alias("treatment_share"))


def covariate_balance(units: DataFrame) -> DataFrame:
    """Arm means and standardised mean difference of every covariate level and number."""
    levels = F.array(*[F.concat_ws("=", F.lit(c), F.col(c).cast("string")) for c in COVARIATES])
    counts = units.select("treated", F.explode(levels).alias("covariate")).groupBy(
        "covariate").agg(F.count_if(~F.col("treated")).alias("x_c"),
                         F.count_if(F.col("treated")).alias("x_t"))
    arms = units.agg(F.count_if(~F.col("treated")).alias("n_c"),
                     F.count_if(F.col("treated")).alias("n_t")).withColumn("_j", F.lit(1))
    mc, mt = F.col("x_c") / F.col("n_c"), F.col("x_t") / F.col("n_t")
    vc = mc * (1 - mc) * F.col("n_c") / (F.col("n_c") - 1)
    vt = mt * (1 - mt) * F.col("n_t") / (F.col("n_t") - 1)
    cats = counts.withColumn("_j", F.lit(1)).join(F.broadcast(arms), "_j").select(
        "covariate", mc.alias("m_c"), mt.alias("m_t"), vc.alias("v_c"), vt.alias("v_t"))
    nums = arm_sums(units, {c: F.col(c) for c in NUMERIC_COVARIATES}).select(
        F.col("metric").alias("covariate"), "m_c", "m_t", "v_c", "v_t")
    sd = F.sqrt((F.col("v_c") + F.col("v_t")) / 2)
    return cats.unionByName(nums).select(
        "covariate", F.col("m_c").alias("control_mean"), F.col("m_t").alias("treatment_mean"),
        ratio(F.col("m_t") - F.col("m_c"), sd).alias("smd"))


def subgroup_effects(units: DataFrame, metric: str, dimensions: Sequence[str] = SUBGROUPS,
                     min_units: int = MIN_UNITS) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level"))
                      for d in dimensions])
    long = units.select("treated", F.col(metric), F.inline(pairs))
    sums = arm_sums(long, {metric: F.col(metric)}, ["dimension", "level"])
    return two_proportions(sums.where((F.col("n_c") >= min_units) & (F.col("n_t") >= min_units)))


def adjusted_subgroups(units: DataFrame, metric: str, alpha: float = ALPHA,
                       min_units: int = MIN_UNITS) -> DataFrame:
    """Subgroup effects with p-values adjusted over the family and Bonferroni-width intervals."""
    t = with_p_normal(subgroup_effects(units, metric, min_units=min_units))
    t = benjamini_hochberg(holm(t, "p_value"), "p_value")
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))  # one row per subgroup
    t = t.withColumn("_z", q_normal(1 - alpha / m / 2))
    return (t.withColumn("significant_raw", F.col("p_value") < alpha)
            .withColumn("significant_holm", F.col("p_holm") < alpha)
            .withColumn("ci_bonferroni_low", F.col("diff") - F.col("_z") * F.col("se"))
            .withColumn("ci_bonferroni_high", F.col("diff") + F.col("_z") * F.col("se"))
            .drop("_z"))


def cumulative_effects(units: DataFrame, cuts: Sequence[str]) -> DataFrame:
    """The primary estimate as seen at each weekly look."""
    looks = F.array(*[F.struct(F.lit(i).alias("week"), ts(c).alias("cut"))
                      for i, c in enumerate(cuts, 1)])
    seen = units.select("treated", "assigned_at", "customer_since", "converted",
                        F.inline(looks)).where("assigned_at < cut")
    y = true_or_false((F.col("customer_since") < F.col("cut")) & F.col("converted"))
    return two_proportions(arm_sums(seen.withColumn("y_seen", y), {"converted": F.col("y_seen")},
                                    ["week", "cut"]))


def arm_funnel(units: DataFrame) -> DataFrame:
    """Stage reach by arm, plus the conditional last step."""
    from tidemark.schema import STAGES
    metrics = {s: F.col(f"reached_{s}") for s in STAGES[1:]}
    metrics["purchase | checkout_start"] = F.when(F.col("reached_checkout_start"),
                                                  F.col("reached_purchase"))
    return two_proportions(arm_sums(units, metrics))


def unit_summary(units: DataFrame, columns: Sequence[str]) -> DataFrame:
    return units.groupBy("variant").agg(F.count(F.lit(1)).alias("units"), *[
        F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns])


def planning(sessions: DataFrame, customers: DataFrame, pre_start: str, start: str) -> DataFrame:
    """Eligible volume and baseline conversion in the equally long window before launch."""
    pre = eligible_population(sessions, pre_start, start).join(
        customers.select("prospect_id", "customer_since"), "prospect_id", "left")
    return pre.agg(F.count(F.lit(1)).alias("expected_eligible_prospects"),
                   F.avg(flag(F.col("customer_since") < ts(start))).alias("baseline_conversion"))


def business_translation(results: DataFrame, units: int | Column, duration_days: int
                         ) -> DataFrame:
    """Effects per 1,000 eligible prospects and per year of eligible traffic."""
    annual = (F.lit(units) if isinstance(units, int) else units) * 365 / duration_days
    return results.select(
        "metric", annual.alias("annual_eligible_prospects"),
        *[(F.col(c) * 1000).alias(f"{c}_per_1000") for c in ("diff", "ci_low", "ci_high")],
        *[(F.col(c) * annual).alias(f"{c}_per_year") for c in ("diff", "ci_low", "ci_high")])


# ------------------------------------------------------------------ resampling checks
def permutation_test(units: DataFrame, outcome: str, replicates: int, seed: int = 0
                     ) -> DataFrame:
    """Randomisation p-value with arm sizes fixed: each replicate treats the units with the
    smallest hashes (``replicates.smallest_sums``)."""
    y = F.when(F.col(outcome).isNotNull(), F.col(outcome).cast("double"))
    t = F.col("treated")
    base = units.agg(F.count(y).alias("n"), F.count(F.when(t, y)).alias("n_t"), F.sum(y).alias("total"),
                     F.sum(F.when(t, y)).alias("s_t")).first()
    n, n_t, total = base["n"], base["n_t"], base["total"]
    schema = "replicates long, p_value double"
    if not 0 < n_t < n:
        return units.sparkSession.createDataFrame([(replicates, None)], schema)

    def distance(treated_sum):
        return abs(treated_sum / n_t - (total - treated_sum) / (n - n_t))

    sums = smallest_sums(units, "prospect_id", outcome, replicates, n_t, seed)
    extreme = int((distance(sums) >= distance(base["s_t"]) - 1e-12).sum())
    return units.sparkSession.createDataFrame(
        [(replicates, (extreme + 1) / (replicates + 1))], schema)


def aa_check(units: DataFrame, outcome: str, replicates: int, share: float = 0.5,
             alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """How often re-randomised arms with no effect would be called different."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    n, total, count, hits = split_sums(units, "prospect_id", outcome, replicates, share, seed)
    arms = units.sparkSession.createDataFrame(
        [(k, float(n - c), float(total - s), float(c), float(s)) for k, (c, s) in enumerate(zip(count, hits))],
        "replicate int, n_c double, x_c double, n_t double, x_t double")  # a row per replicate
    est = two_proportions(arms.withColumn("m_c", ratio(F.col("x_c"), F.col("n_c"), None)).withColumn(
        "m_t", ratio(F.col("x_t"), F.col("n_t"), None)), z)
    reject = F.abs("z") > z
    rate = F.avg(flag(reject))
    half = Z95 * F.sqrt(rate * (1 - rate) / F.count(F.lit(1)))
    return est.agg(F.count(F.lit(1)).alias("simulations"), rate.alias("false_positive_rate"),
                   (rate - half).alias("rate_ci_low"), (rate + half).alias("rate_ci_high"),
                   F.avg(flag((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)))
                   .alias("ci_coverage_of_zero"))


# What is known of a unit before its assignment.
COVARIATES = ("device_type", "acquisition_channel", "region", "age_band", "income_band",
              "email_opt_in", "lead_type")
NUMERIC_COVARIATES = ("prior_sessions", "days_since_lead")


def covariate_columns(units: DataFrame, categorical: Sequence[str] = COVARIATES,
                      numeric: Sequence[str] = NUMERIC_COVARIATES) -> dict[str, Column]:
    """Indicators of every level but the first of each category, and logs of the numbers.

    Levels are read from the units in one pass; a category has few of them by definition.
    """
    found = units.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c)
                        for c in categorical]).first()
    out = {f"{c}_{i}": (F.col(c).cast("string") == level).cast("double")
           for c in categorical for i, level in enumerate(found[c] or []) if i}
    return out | {c: F.log1p(F.col(c).cast("double")) for c in numeric}


def regression_adjusted(units: DataFrame, outcome: str, covariates: Mapping[str, Column]
                        ) -> DataFrame:
    """Lin adjustment: treatment, centred covariates and interactions, HC2 standard error.

    Two distributed passes over Arrow batches sum the k x k cross products; only those k x k
    matrices ever leave the executors.
    """
    import numpy as np
    import pandas as pd
    names = list(covariates)
    means = units.agg(*[F.avg(c.cast("double")).alias(n) for n, c in covariates.items()]).first()
    data = units.select(F.col(outcome).cast("double").alias("y"),
                        F.col("treated").cast("double").alias("z"),
                        *[(c.cast("double") - F.lit(float(means[n]))).alias(n)
                          for n, c in covariates.items()])
    k = 2 + 2 * len(names)

    def design(pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[names].to_numpy(float)
        z = pdf["z"].to_numpy(float)
        return np.column_stack([np.ones(len(pdf)), z, x, x * z[:, None]])

    def gram(batches):
        g = np.zeros((k, k + 1))
        for pdf in batches:
            d = design(pdf)
            g[:, :k] += d.T @ d
            g[:, k] += d.T @ pdf["y"].to_numpy(float)
        yield pd.DataFrame({"i": np.arange(g.size), "v": g.ravel()})

    def total(fn, width):
        rows = data.mapInPandas(fn, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        out = np.zeros(k * width)
        for r in rows.collect():  # k x width cells
            out[r["i"]] = r["v"]
        return out.reshape(k, width)

    g = total(gram, k + 1)
    inverse = np.linalg.pinv(g[:, :k])
    beta = inverse @ g[:, k]

    def meat(batches):
        m = np.zeros((k, k))
        for pdf in batches:
            d = design(pdf)
            resid = pdf["y"].to_numpy(float) - d @ beta
            lever = np.einsum("ij,jk,ik->i", d, inverse, d)
            m += (d * (resid ** 2 / np.clip(1 - lever, 1e-12, None))[:, None]).T @ d
        yield pd.DataFrame({"i": np.arange(m.size), "v": m.ravel()})

    cov = inverse @ total(meat, k) @ inverse
    est, se = float(beta[1]), float(np.sqrt(cov[1, 1]))
    return units.sparkSession.createDataFrame(
        [(outcome, est, se, est - Z95 * se, est + Z95 * se, est / se if se > 0 else 0.0,
          len(names))],
        "metric string, diff double, se double, ci_low double, ci_high double, z double, "
        "n_covariates int")
