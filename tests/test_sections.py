"""Section runs: selection, refit, holdout and the store of finished runs."""

import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.plans import q_models as q
from tidemark.plans import section_run as sr
from tidemark.sources import adapters as ad

SF = "/root/testdata/sf0.001"
CASES = {"leads": (sr.LEADS, q.LEAD_PLAN, ad.journey), "churn": (sr.CHURN, q.PLAN, ad.ledger),
         "value": (sr.VALUE, q.VALUE_PLAN, ad.ledger)}


@pytest.mark.parametrize("name", CASES)
def test_a_section_from_tables_to_comparison(spark, name):
    spec, plan, tables = CASES[name]
    small = sr.replace(spec, boosting=sr.replace(spec.boosting, min_leaf=10))
    run = sr.run(small, tables(spark, SF.replace("0.001", "0.01") if name == "leads" else SF), plan, trees=3, replicates=15)
    rows = {r.model: r for r in run.validation.collect()}
    assert set(rows) == set(spec.models)
    scored = {m: r[spec.metric] for m, r in rows.items() if r[spec.metric] is not None}
    pick = max if spec.largest else min
    assert scored[run.champion] == pick(scored.values())
    if spec.unscaled:
        assert all(rows[m]["log_loss"] is None for m in spec.unscaled)
    assert {str(r[0])[:10] for r in run.holdout.select("run_cutoff").distinct().collect()} <= set(plan.holdout)
    table = run.comparison.collect()
    assert {r.model for r in table} == set(spec.models) and sum(r.champion for r in table) == 1
    assert {r.role for r in table if r.model in spec.rules} == {"baseline"}
    first = "rmse" if spec.is_value else "roc_auc"
    for r in table:
        point, low, high = r[f"holdout_{first}"], r[f"holdout_{first}_low"], r[f"holdout_{first}_high"]
        assert low <= high and low - 0.2 * abs(low) <= point <= high + 0.2 * abs(high)
    names = {r.model for r in run.intervals.collect()} - set(spec.models)
    assert f"{run.champion} minus {next(r for r in spec.rules if r != run.champion)}" in names


def test_finished_runs_are_kept_under_their_inputs(spark, tmp_path, monkeypatch):
    for t in q.LEDGER_INPUTS:
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    paths = [f"{tmp_path}/{t}.parquet" for t in q.LEDGER_INPUTS]
    small = sr.replace(sr.CHURN, boosting=sr.replace(sr.CHURN.boosting, min_leaf=10))
    made = []
    real = sr.run
    monkeypatch.setattr(sr, "run", lambda *a, **k: made.append(1) or real(*a, **k))

    def ask(**settings):
        return sr.stored(spark, small, ad.ledger(spark, str(tmp_path)), q.PLAN, paths, **{"trees": 2, "replicates": 5, **settings})
    first, again = ask(), ask()
    assert made == [1] and first.champion == again.champion
    assert first.comparison.exceptAll(again.comparison).count() == 0
    ask(trees=1)
    assert made == [1, 1]  # other settings are another run
    orders = spark.read.parquet(paths[1]).where(F.col("o_orderkey") % 3 > 0).cache()
    orders.count()
    shutil.rmtree(tmp_path / "orders.parquet") if (tmp_path / "orders.parquet").is_dir() else (tmp_path / "orders.parquet").unlink()
    orders.coalesce(1).write.parquet(paths[1])
    spark.catalog.clearCache()
    changed = ask()
    assert made == [1, 1, 1] and changed.data.count() < first.data.count()
