"""One scoring section end to end: dataset, candidates, champion, refit, holdout evaluation.

A section names its candidates and the metric that picks among them on the validation runs: average
precision for leads, log loss for churn, RMSE for value. Learned candidates are fitted to the fit runs and again to all
training runs; boosted trees grow both fits in shared rounds.

`stored` keeps a finished run in the shared folder under the identity of the files it was made from (path, size and
time of change) and of the section itself, so two queries of one section pay once and rewritten inputs are never
answered with old results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.cols import ts
from tidemark.functions.lineage import cut
from tidemark.operators import boosting, churn, leads, metrics, models, value
from tidemark.operators.timewin import SplitPlan
from tidemark.session import ensure_checkpoint_dir

Rule = Callable[[DataFrame, DataFrame, str], DataFrame]
REPLICATES = 200
BOOSTED = "gradient_boosting"


@dataclass(frozen=True)
class Section:
    name: str
    entity: str
    label: str
    numeric: Sequence[str]
    categorical: Sequence[str]
    build: Callable[[Mapping[str, DataFrame], SplitPlan], DataFrame]
    rules: Mapping[str, Rule]
    boosting: boosting.Boosting
    metric: str
    largest: bool
    logistic: bool = True                 # whether a logistic regression is a candidate
    unscaled: Sequence[str] = ()          # rules whose score is an order, not a probability

    @property
    def is_value(self) -> bool:
        return self.boosting.loss == "poisson"

    @property
    def models(self) -> list[str]:
        return [*self.rules, *(["logistic_regression"] if self.logistic else []), BOOSTED]


def _rate_rule(key, label: str) -> Rule:
    """Smoothed training rate (or mean) of the row's level; key(train) gives the level."""
    def rule(train: DataFrame, rows: DataFrame, name: str) -> DataFrame:
        k = key(train)
        return models.apply_rates(rows, models.smoothed_rates(train, k, label), k, name)
    return rule


def _column_rule(score) -> Rule:
    return lambda train, rows, name: rows.withColumn(name, score())


def _churn_cell(_):
    return models.rfm_cell(F.col("days_since_last_order"), F.col("orders_total"))


def _value_cell(train: DataFrame):
    return models.rfm_cell(F.col("days_since_last_order"), F.col("orders_total"), models.VALUE_RECENCY,
                           F.col("avg_order_value"), models.money_terciles(train, "avg_order_value"))


LEADS = Section(
    "leads", "prospect_id", "converted", leads.NUMERIC, leads.CATEGORICAL,
    lambda t, plan: leads.build_dataset(t, plan.runs, plan.horizon_days),
    {"channel_rate": _rate_rule(lambda _: F.col("acquisition_channel"), "converted"),
     "recent_activity": _column_rule(lambda: models.recent_activity_score(F.col("days_since_last_session")))},
    boosting.Boosting("log", trees=250, min_leaf=80), "average_precision", True, unscaled=("recent_activity",))

CHURN = Section(
    "churn", "customer_id", "churned", churn.NUMERIC, churn.CATEGORICAL,
    lambda t, plan: churn.build_dataset(t, plan.runs, plan.horizon_days),
    {"recency_rule": _column_rule(lambda: models.recency_score(F.col("days_since_last_order"))),
     "rfm_cell_rate": _rate_rule(_churn_cell, "churned")},
    boosting.Boosting("log", trees=250, min_leaf=80), "log_loss", False, unscaled=("recency_rule",))

VALUE = Section(
    "value", "customer_id", "future_revenue", value.FEATURES, value.CATEGORICAL,
    lambda t, plan: value.build_dataset(t, plan.runs, plan.horizon_days),
    {"run_rate": _column_rule(lambda: F.col("revenue_180d").cast("double")),
     "rfm_cell_mean": _rate_rule(_value_cell, "future_revenue"),
     "bgnbd_gamma_gamma": _column_rule(lambda: F.coalesce("clv_expected_revenue", F.lit(0.0)))},
    boosting.Boosting("poisson", trees=300, min_leaf=60), "rmse", False, logistic=False)


@dataclass
class SectionRun:
    data: DataFrame
    validation: DataFrame      # metrics per candidate on the validation runs
    champion: str
    holdout: DataFrame         # rows with every candidate's score
    comparison: DataFrame
    intervals: DataFrame       # percentile intervals per candidate and per difference


def split(data: DataFrame, runs: Sequence[str]) -> DataFrame:
    return data.where(F.col("run_cutoff").isin([ts(r) for r in runs]))


def fit_logistic(section: Section, train: DataFrame):
    return models.logistic_pipeline(section.numeric, section.categorical, section.label, train.count()).fit(train)


def with_scores(section: Section, train: DataFrame, rows: DataFrame, boosted: boosting.BoostedModel) -> DataFrame:
    """Every candidate's score on ``rows``; rates and models come from ``train`` only."""
    out = rows
    for name, rule in section.rules.items():
        out = rule(train, out, name)
    if section.logistic:
        out = models.probability(fit_logistic(section, train), out, "logistic_regression")
    return boosted.score(out, BOOSTED)


def evaluate(section: Section, scored: DataFrame) -> DataFrame:
    """The metrics of every candidate on scored rows."""
    names = {n: n for n in section.models}
    if section.is_value:
        return metrics.regression_metrics(scored, names, section.label).join(
            metrics.normalized_gini(scored, names, section.label).drop("gini"), "model")
    sure = {n: n for n in names if n not in section.unscaled}
    return metrics.discrimination(scored, names, section.label).join(
        metrics.probability_metrics(scored, sure, section.label).select(
            "model", "brier", "log_loss", "mean_predicted"), "model", "left")


def resampled(section: Section, scored: DataFrame, best: str, replicates: int) -> DataFrame:
    names = {n: n for n in section.models}
    run = metrics.value_bootstrap if section.is_value else metrics.cluster_bootstrap
    references = section.models if section.is_value else [r for r in section.rules if r != best]
    return run(scored, names, section.label, section.entity, replicates, 7, references)


def run(section: Section, tables: Mapping[str, DataFrame], plan: SplitPlan, trees: int | None = None,
        replicates: int = REPLICATES) -> SectionRun:
    """Choose on the validation runs among candidates fitted before them, refit on both, score the holdout once."""
    cfg = section.boosting if trees is None else replace(section.boosting, trees=trees)
    data = cut(section.build(tables, plan))
    fit, train = split(data, plan.fit), split(data, plan.train)
    early = F.col("run_cutoff").isin([ts(r) for r in plan.fit])
    first, final = boosting.fit_boosted(train, section.numeric, section.categorical, section.label, cfg, [early, F.lit(True)])
    validation = cut(evaluate(section, cut(with_scores(section, fit, split(data, plan.validation), first))))
    best = models.champion(validation.where(F.col(section.metric).isNotNull()), section.metric, section.largest).first()["champion"]
    holdout = cut(with_scores(section, train, split(data, plan.holdout), final))
    intervals = cut(resampled(section, holdout, best, replicates))
    tested = evaluate(section, holdout)
    kept = [c for c in tested.columns if c != "model"]
    shown = ("rmse", "mae", "bias", "normalized_gini") if section.is_value else ("roc_auc", "average_precision")
    ends = [c for c in intervals.columns if c not in ("model", "replicates")]
    comparison = tested.select("model", *[F.col(c).alias(f"holdout_{c}") for c in kept]).join(
        validation.select("model", *[F.col(c).alias(f"validation_{c}") for c in shown]), "model").join(
        intervals.select("model", *[F.col(c).alias(f"holdout_{c}") for c in ends]), "model").withColumn(
        "role", F.when(F.col("model").isin(*section.rules), "baseline").otherwise("learned")).withColumn(
        "champion", F.col("model") == best)
    return SectionRun(data, validation, best, holdout, cut(comparison), intervals)


# ------------------------------------------------------------------ finished runs
def files_identity(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of path, size and time of change of every file under the paths."""
    meta = [F.col(f"_metadata.{c}").cast("string").alias(c) for c in ("file_path", "file_size", "file_modification_time")]
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(p).select(*meta).distinct() for p in paths])
    one = rows.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws("|", *rows.columns)))), 256).alias("h"))
    return one.first()["h"]  # a line per file


PARTS = ("data", "validation", "holdout", "comparison", "intervals")


def stored(spark: SparkSession, section: Section, tables: Mapping[str, DataFrame], plan: SplitPlan, inputs: Sequence[str],
           **settings) -> SectionRun:
    """The finished run of these input files, made and kept if there is none yet."""
    made_of = [section.name, files_identity(spark, inputs), repr(plan), repr(section.boosting), list(section.numeric), settings]
    key = hashlib.sha256(json.dumps(made_of, default=str).encode()).hexdigest()[:24]
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/section-{section.name}-{key}"
    try:
        best = spark.read.schema("champion string").json(f"{folder}/whole").first()
    except AnalysisException:
        best = None
    if best is None:
        made = run(section, tables, plan, **settings)
        for part in PARTS:
            getattr(made, part).write.mode("overwrite").parquet(f"{folder}/{part}")
        # Written last: a folder without it is not whole and is made again.
        spark.createDataFrame([(made.champion,)], "champion string").coalesce(1).write.mode("overwrite").json(f"{folder}/whole")
        best = [made.champion]
    read = {part: spark.read.parquet(f"{folder}/{part}") for part in PARTS}
    return SectionRun(champion=best[0], **read)
