"""Rule baselines, Spark ML models, champion selection and explanations."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import edges_at_or_below, edges_below
from tidemark.operators.metrics import discrimination, probability_metrics

PRIOR = 20.0
# Interior edges of the RFM cells.
CHURN_RECENCY, VALUE_RECENCY, FREQUENCY = (30, 60, 90, 120), (30, 90, 180, 365), (1, 3, 7)


# ------------------------------------------------------------------ rule baselines
def smoothed_rates(train: DataFrame, key: str | Column, target: str, prior: float = PRIOR
                   ) -> DataFrame:
    """(level, rate) shrunk towards the global mean, with the global mean alongside."""
    k = F.col(key) if isinstance(key, str) else key
    t = train.groupBy(k.alias("level")).agg(F.sum(F.col(target).cast("double")).alias("s"),
                                            F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # one row per level
    g = F.sum("s").over(whole) / F.sum("n").over(whole)
    return t.select("level", ((F.col("s") + prior * g) / (F.col("n") + prior)).alias("rate"),
                    g.alias("global_rate"))


def apply_rates(df: DataFrame, rates: DataFrame, key: str | Column, name: str) -> DataFrame:
    """Score rows by level; unseen levels get the global rate."""
    k = F.col(key) if isinstance(key, str) else key
    fallback = rates.agg(F.max("global_rate").alias("_g")).withColumn("_j", F.lit(1))
    out = df.withColumn("level", k).join(rates.select("level", "rate"), "level", "left")
    out = out.withColumn("_j", F.lit(1)).join(F.broadcast(fallback), "_j")
    return out.withColumn(name, F.coalesce("rate", "_g")).drop("level", "rate", "_g", "_j")


def recent_activity_score(days: Column) -> Column:
    return 1.0 / (1.0 + days)


def recency_score(days: Column) -> Column:
    return days / (1.0 + days)


def rfm_cell(recency: Column, frequency: Column, recency_edges=CHURN_RECENCY,
             money: Column | None = None, money_edges: Sequence[float] = ()) -> Column:
    """Cell label; recency (and money) bands are left-closed, frequency bands right-closed."""
    parts = [F.lit("R"), edges_at_or_below(recency, recency_edges).cast("string"), F.lit("F"),
             edges_below(frequency, FREQUENCY).cast("string")]
    if money is not None:
        parts += [F.lit("M"), edges_at_or_below(money, money_edges).cast("string")]
    return F.concat(*parts)


def money_terciles(train: DataFrame, col: str) -> list[float]:
    """Interpolated terciles from exact running counts (two numbers)."""
    from tidemark.operators.monitoring import by_value, exact_quantiles
    q = exact_quantiles(by_value(train, [col]), steps=3).where("j in (1, 2)").orderBy("j")
    return [r["value"] for r in q.collect()]


# ------------------------------------------------------------------ learned models
def _encoded(categorical: Sequence[str]) -> list:
    """One-hot stages in which an unseen level is all zeros."""
    idx = [f"_{c}_i" for c in categorical]
    hot = [f"_{c}_h" for c in categorical]
    return [StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=True)]


def logistic_pipeline(numeric: Sequence[str], categorical: Sequence[str], label: str, rows: int,
                      c: float = 0.5) -> Pipeline:
    """log1p + standardised numbers, one-hot levels, L2 with strength 1 / (C n).

    A missing number (such as the category count of a customer whose orders have no lines) counts as zero.
    """
    logs = ", ".join(f"coalesce(nanvl(log1p({n}), 0D), 0D) AS _{n}_l" for n in numeric)
    stages = [SQLTransformer(statement=f"SELECT *, {logs} FROM __THIS__"),
              VectorAssembler(inputCols=[f"_{n}_l" for n in numeric], outputCol="_num",
                              handleInvalid="keep"),
              StandardScaler(inputCol="_num", outputCol="_std", withMean=True),
              *_encoded(categorical),
              VectorAssembler(inputCols=["_std", *[f"_{x}_h" for x in categorical]],
                              outputCol="_x"),
              LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / (c * rows),
                                 elasticNetParam=0.0, standardization=False, maxIter=200)]
    return Pipeline(stages=stages)


def poisson_regressor(numeric: Sequence[str], categorical: Sequence[str], label: str) -> Pipeline:
    """Poisson mean model on log-scaled inputs."""
    logs = ", ".join(f"log1p(greatest({n}, 0)) AS _{n}_l" for n in numeric)
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {logs} FROM __THIS__"), *_encoded(categorical),
        VectorAssembler(inputCols=[*[f"_{n}_l" for n in numeric],
                                   *[f"_{x}_h" for x in categorical]], outputCol="_x",
                        handleInvalid="keep"),
        GeneralizedLinearRegression(featuresCol="_x", labelCol=label, family="poisson",
                                    link="log", regParam=1e-3, maxIter=25)])


def probability(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    keep = df.columns
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*keep, name)


def prediction(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    keep = df.columns
    return model.transform(df).withColumn(name, F.greatest(F.col("prediction"), F.lit(0.0))
                                          ).select(*keep, name)


# ------------------------------------------------------------------ selection and comparison
def champion(scores: DataFrame, metric: str, largest: bool) -> DataFrame:
    """Best model by a validation metric (name order breaks a tie)."""
    key = F.struct(F.col(metric) if largest else -F.col(metric), F.col("model"))
    return scores.agg(F.max_by("model", key).alias("champion"),
                      (F.max(metric) if largest else F.min(metric)).alias(metric))


def comparison_table(df: DataFrame, scores: Mapping[str, str], label: str,
                     probabilistic: Sequence[str], references: Sequence[str], best: str
                     ) -> DataFrame:
    """Metrics per model with role, champion flag and AUC deltas against the references."""
    m = discrimination(df, scores, label).drop("rows", "positives")
    p = probability_metrics(df, {k: v for k, v in scores.items() if k in probabilistic},
                            label).select("model", "brier", "log_loss", "mean_predicted")
    t = m.join(p, "model", "left").withColumn(
        "role", F.when(F.col("model").isin(*references), "baseline").otherwise("learned"))
    t = t.withColumn("champion", F.col("model") == best)
    whole = Window.partitionBy(F.lit(0))  # one row per model
    for r in references:
        ref = F.max(F.when(F.col("model") == r, F.col("roc_auc"))).over(whole)
        t = t.withColumn(f"auc_minus_{r}", F.col("roc_auc") - ref)
    return t


def calibration_slope(df: DataFrame, score: str, label: str) -> float:
    """Slope of an unpenalised logistic recalibration on logit(p)."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(score)))
    d = df.select(F.col(label).cast("double").alias("y"), F.log(p / (1 - p)).alias("z"))
    x = VectorAssembler(inputCols=["z"], outputCol="x").transform(d)
    fit = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.0, maxIter=100).fit(x)
    return float(fit.coefficients[0])


# ------------------------------------------------------------------ explanations
def term_names(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str]
               ) -> list[tuple[str, str]]:
    """(term, feature) of every model input, in vector order."""
    indexer = next(s for s in model.stages if hasattr(s, "labelsArray"))
    out = [(n, n) for n in numeric]
    for c, labels in zip(categorical, indexer.labelsArray):
        out += [(f"{c}={v}", c) for v in labels]
    return out


def logistic_coefficients(model: PipelineModel, numeric: Sequence[str],
                          categorical: Sequence[str], df: DataFrame) -> DataFrame:
    """Coefficients with one-hot terms centred within their feature, and odds ratios."""
    spark = df.sparkSession
    coef = [float(v) for v in model.stages[-1].coefficients]
    rows = [(t, f, c) for (t, f), c in zip(term_names(model, numeric, categorical), coef)]
    t = spark.createDataFrame(rows, "term string, feature string, raw double")
    mean = F.avg("raw").over(Window.partitionBy("feature"))
    value = F.when(F.col("feature").isin(*categorical), F.col("raw") - mean).otherwise(
        F.col("raw"))
    return t.select("term", "feature", value.alias("coefficient"), F.exp(value)
                    .alias("odds_ratio"))


def linear_contributions(model: PipelineModel, df: DataFrame, background: DataFrame,
                         numeric: Sequence[str], categorical: Sequence[str], entity: str
                         ) -> DataFrame:
    """(entity, feature, contribution): coefficient x (input - background mean), one-hots summed.

    For a linear model with independent inputs these are the exact Shapley values.
    """
    terms = term_names(model, numeric, categorical)
    coef = [float(v) for v in model.stages[-1].coefficients]
    prep = PipelineModel(model.stages[:-1])
    bg = prep.transform(background).select(vector_to_array("_x").alias("v"))
    means = bg.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(len(terms))]).first()
    x = prep.transform(df).select(entity, *[F.col(f).alias(f"raw_{f}") for f in numeric],
                                  vector_to_array("_x").alias("v"))
    by_feature: dict[str, list[int]] = {}
    for i, (_, f) in enumerate(terms):
        by_feature.setdefault(f, []).append(i)
    parts = [F.struct(F.lit(f).alias("feature"), (F.col(f"raw_{f}").cast("double") if f in numeric
                                                  else F.lit(None).cast("double")).alias("raw"),
                      reduce(lambda a, b: a + b, [F.lit(coef[i]) * (
                          F.col("v")[i] - F.lit(float(means[f"m{i}"]))) for i in idx])
                      .alias("contribution")) for f, idx in by_feature.items()]
    return x.select(entity, F.inline(F.array(*parts)))


def contribution_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature and its direction."""
    t = contributions.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs_contribution"),
        F.corr("raw", "contribution").alias("_c"), F.count("raw").alias("_n"))
    sign = (F.when(F.col("_n") == 0, "categorical").when(F.col("_c") > 0, "higher -> more likely")
            .when(F.col("_c") < 0, "higher -> less likely").otherwise("no effect"))
    return t.select("feature", "mean_abs_contribution", sign.alias("direction"))


def reason_codes(contributions: DataFrame, entity: str, top: int = 3, runs: Sequence[str] = ()
                 ) -> DataFrame:
    """The largest positive contributions of every row, joined by ``; ``.

    With several runs in the frame their columns belong to the key, or rows of one entity would
    merge across runs.
    """
    pos = F.filter(F.collect_list(F.struct((-F.col("contribution")).alias("c"), "feature")),
                   lambda s: s["c"] < 0)
    codes = F.transform(F.slice(F.sort_array(pos), 1, top), lambda s: s["feature"])
    return contributions.groupBy(*runs, entity).agg(F.concat_ws("; ", codes).alias("drivers"))


def permutation_importance(model: PipelineModel, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                           label: str, entity: str, repeats: int = 5, seed: int = 7) -> DataFrame:
    """AUC drop of a linear model when one feature is shuffled, for every feature and repeat.

    A shuffle is a bijection of rows: two hash orders of the same rows are matched rank by rank,
    with ranks built per hash bucket so that no task sorts everything. Replacing a feature by its donor's changes
    the margin by the difference of their contributions, so a matched row carries one number per feature and is
    neither copied nor scored again. A task packs the margins by (repeat, feature, bucket) before they are moved.
    """
    from tidemark.functions.lineage import cut
    from tidemark.operators.ranking import row_ranks
    terms = term_names(model, numeric, categorical)
    coef = [float(v) for v in model.stages[-1].coefficients]
    features = list(dict.fromkeys(f for _, f in terms))
    x = PipelineModel(model.stages[:-1]).transform(df).select(entity, F.col(label).cast("double").alias("_y"), vector_to_array("_x").alias("v"))
    parts = [reduce(lambda a, b: a + b, [F.lit(c) * F.col("v")[i] for i, (c, (_, g)) in enumerate(zip(coef, terms)) if g == f])
             for f in features]
    base = cut(x.select(entity, "_y", F.array(*parts).alias("_c")))
    home = cut(row_ranks(base.withColumn("_h", hash01(F.col(entity), seed)), "_h", entity, [], "_r").select("_r", "_y", "_c"))
    bounds = _margin_bounds(base, home.count())
    packed = base.select("_y", "_c", F.lit(None).cast("array<double>").alias("_d")).mapInArrow(_packer(-1, len(features), bounds), PACKED)
    for b in range(repeats):
        donor = row_ranks(base.select(entity, "_c", hash01(F.col(entity), seed + 1 + b).alias("_h")), "_h", entity, [], "_r").select(
            "_r", F.col("_c").alias("_d"))
        one = home.join(donor, "_r").select("_y", "_c", "_d")
        packed = packed.unionByName(one.mapInArrow(_packer(b, len(features), bounds), PACKED))
    pieces = packed.groupBy("repeat", "feature", "bucket").applyInPandas(_piece, "repeat int, feature int, bucket int, pos double, neg double, area double")
    earlier = Window.partitionBy("repeat", "feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # A pair of a row of each kind counts in the bucket of both, or else by the kinds of lower buckets.
    won = F.col("area") + F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))
    auc = pieces.withColumn("won", won).groupBy("repeat", "feature").agg(
        (F.sum("won") / F.when(F.sum("pos") * F.sum("neg") > 0, F.sum("pos") * F.sum("neg"))).alias("auc"))
    auc = cut(auc)  # a row per feature and repeat
    whole = auc.where("repeat < 0").select(F.lit(1).alias("_j"), F.col("auc").alias("_base"))
    drop = F.col("_base") - F.col("auc")
    names = F.array(*[F.lit(f) for f in features])
    return auc.where("repeat >= 0").withColumn("_j", F.lit(1)).join(F.broadcast(whole), "_j").groupBy(
        F.element_at(names, F.col("feature") + 1).alias("feature")).agg(
        F.avg(drop).alias("auc_drop"), F.stddev_pop(drop).alias("auc_drop_std"))


PACKED = "repeat int, feature int, bucket int, rows binary"
#: Rows of a bucket of margins (about), and digits after which equal inputs differ by rounding only.
BUCKET_ROWS, DIGITS = 200_000, 10


def _margin_bounds(base: DataFrame, rows: int) -> np.ndarray:
    """Bounds that cut the margins into buckets; they balance the work and do not change a result."""
    buckets = -(-rows // BUCKET_ROWS)
    if buckets < 2:
        return np.zeros(0)
    margin = F.aggregate("_c", F.lit(0.0), lambda a, v: a + v)
    return np.unique(base.select(margin.alias("m")).approxQuantile("m", [i / buckets for i in range(1, buckets)], 0.25 / buckets))


def _packer(repeat: int, width: int, bounds: np.ndarray):
    """Margins and labels of a task's rows, packed by feature and bucket; without donors the one margin of every row (feature 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            c, d, y = (np.concatenate(v) for v in zip(*held))
            margin, parts = c.sum(axis=1), {}
            for f in range(1 if repeat < 0 else width):
                m = np.round(margin if repeat < 0 else margin - c[:, f] + d[:, f], DIGITS) + 0.0
                at = np.searchsorted(bounds, m, "right")
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], np.arange(len(bounds) + 2))
                for k in np.unique(at).tolist():
                    mine = order[ends[k]:ends[k + 1]]
                    parts[f, k] = m[mine].astype("<f8").tobytes() + (y[mine] > 0).astype(np.uint8).tobytes()
            f, k = zip(*parts)
            return pa.RecordBatch.from_arrays([pa.array([repeat] * len(f), pa.int32()), pa.array(f, pa.int32()), pa.array(k, pa.int32()),
                                               pa.array(list(parts.values()), pa.binary())], ["repeat", "feature", "bucket", "rows"])
        for batch in batches:
            if batch.num_rows:
                c = batch["_c"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                d = c if repeat < 0 else batch["_d"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                held.append((c, d, batch["_y"].to_numpy(zero_copy_only=False)))
                size += batch.num_rows
            if size >= BUCKET_ROWS:
                yield out()
                held, size = [], 0
        if held:
            yield out()
    return run


def _piece(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of each kind in a bucket, and the pairs inside it that are in order (a tie is half a pair)."""
    n = [len(r) // 9 for r in frame["rows"]]
    margin = np.concatenate([np.frombuffer(r, "<f8", k) for r, k in zip(frame["rows"], n)])
    y = np.concatenate([np.frombuffer(r, np.uint8, k, 8 * k) for r, k in zip(frame["rows"], n)]) > 0
    low = np.sort(margin[~y])
    own = margin[y]
    area = (np.searchsorted(low, own, "left").sum() + np.searchsorted(low, own, "right").sum()) / 2
    return pd.DataFrame([(*key, float(len(own)), float(len(low)), float(area))], columns=["repeat", "feature", "bucket", "pos", "neg", "area"])


def hash01(c: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
