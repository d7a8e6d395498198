"""Attributions from packed columns against the row-wise operators, and their plan."""

import pytest
from pyspark.sql import functions as F

from featstab.operators import attribution, membership, preprocess, splits
from featstab.plans.study import FOLD, N_SPLITS, Study
from featstab.sources import tables


@pytest.fixture(scope="module")
def study(spark, sf):
    values = tables.cohort(spark, sf).where("p < 20").withColumn("x", F.round("x", 2))  # many ties
    return Study(values, n_repeats=3)


def near(a, b):
    keys = [*FOLD, "gene"]
    both = a.join(b, keys, "full_outer").collect()
    value = [c for c in a.columns if c not in keys]
    assert both and all(abs(r[c] - r[f"{c}_b"]) < 1e-11 for r in both for c in value)
    return len(both)


def test_equal_to_rows(study):
    moves = splits.permutations(splits.training(study.labels.select("sample_id"), study.folds, N_SPLITS), 4, 1)
    got = membership.fold_attributions(study.values, study.folds, study.state, moves).cache()
    rename = lambda d: d.select(*FOLD, "gene", *[F.col(c).alias(f"{c}_b") for c in d.columns if c not in (*FOLD, "gene")])
    n = near(got.select(*FOLD, "gene", "auc"), rename(attribution.class_auc(study.train_z)))
    assert n == study.state.count()
    shap = attribution.shown(got, F.col("shap"), F.col("shap_signed"))
    near(shap, rename(attribution.linear_shap(study.train_z, study.weights)))
    near(attribution.permutation_importance(got), rename(attribution.linear_permutation(study.train_z, study.weights, moves)))


def test_rankings_are_the_same_where_samples_are_too_many(study, monkeypatch):
    whole = sorted(map(tuple, study.rankings.select("pipeline", *FOLD, "gene", "rank").collect()))
    monkeypatch.setattr(membership, "MOST_BYTES", 0)
    other = Study(study.values, n_repeats=3)
    assert sorted(map(tuple, other.rankings.select("pipeline", *FOLD, "gene", "rank").collect())) == whole


def test_no_value_is_copied(study):
    plan = membership.columns(study.values, study.state)._jdf.queryExecution().toString()
    assert "explode" not in plan.split("posexplode")[-1] and "train_fold" not in plan


def test_missing_classes_and_samples(spark, study):
    one = study.folds.where("y = 1")
    state = study.state.limit(3)
    values = study.values.join(one.select("sample_id").distinct(), "sample_id", "left_semi")
    rows = membership.fold_attributions(values, one, state).collect()
    assert len(rows) == 3 and all(r["auc"] is None and r["raw"] is None and r["shap"] is not None for r in rows)
    with pytest.raises(Exception, match="lacks samples"):
        membership.fold_attributions(values.where("sample_id > 5"), one, state).collect()
    assert membership.fold_attributions(study.values, study.folds, study.state.where("false")).collect() == []


def test_permutations_drawn_in_the_task_are_those_of_the_table(study):
    moves = splits.permutations(splits.training(study.labels.select("sample_id"), study.folds, N_SPLITS), 3, 7)
    shown = lambda d: sorted((r["repeat"], r["fold"], r["gene"], round(r["raw"], 12)) for r in d.collect())
    assert shown(membership.fold_attributions(study.values, study.folds, study.state, moves)) == shown(membership.fold_attributions(study.values, study.folds, study.state, draws=(3, 7)))


def test_folds_do_not_go_to_every_task(study):
    """What grows with the samples is joined by sorted samples, however small it is taken for."""
    rows = [splits.testing(study.values, study.folds), splits.training(study.values, study.folds, N_SPLITS), preprocess.fold_probes(study.values, study.folds, study.floor, N_SPLITS)]
    for plan in (d._jdf.queryExecution().toString().split("Physical Plan")[1] for d in rows):
        assert not [line for line in plan.splitlines() if "Broadcast" in line and "Join" in line and "sample_id" in line] and "SortMergeJoin [sample_id" in plan
