"""Batch scores build the features once, and learn from the rows that the model's own dataset holds."""

from pyspark.sql import functions as F

from tidemark.operators import churn
from tidemark.plans import q_models as q
from tidemark.sources import adapters as ad

SF = "/root/testdata/sf0.001"


def test_features_are_built_once_and_training_rows_are_the_same(spark, monkeypatch):
    built, learned = [], []
    real, fit = churn.build_features, q.sr.fit_logistic
    monkeypatch.setattr(churn, "build_features", lambda *a, **k: built.append(1) or real(*a, **k))
    monkeypatch.setattr(q.sr, "fit_logistic", lambda s, train: learned.append(train) or fit(s, train))
    scores, _ = q.batch(spark, SF)
    assert built == [1]
    assert {str(r[0])[:10] for r in scores.select("run_cutoff").distinct().collect()} <= set(q.BATCH_RUNS)
    keys = [*churn.KEYS, "churned", *churn.CATEGORICAL, *churn.NUMERIC]
    kinds = dict(learned[0].dtypes)
    tidy = lambda d: d.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in keys])
    want = tidy(churn.build_dataset(ad.ledger(spark, SF), q.PLAN.train, 90))
    assert tidy(learned[0]).exceptAll(want).count() == 0 and learned[0].count() == want.count()
