"""Registered fits run every fold of every repeat with whole ensembles, whose trees are grown level by level."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from featstab.functions import solvers
from featstab.plans import catalogue, study


def test_fits_take_every_repeat(spark, sf, monkeypatch):
    z = spark.range(study.N_REPEATS).select(F.col("id").cast("int").alias("repeat"), F.lit(0).alias("fold"), F.lit(1).cast("long").alias("sample_id"), F.lit(1).alias("y"), F.lit("G1").alias("gene"), F.lit(0.5).alias("z"))
    monkeypatch.setattr(catalogue, "the_study", lambda spark, sf: SimpleNamespace(train_z=z, test_z=z))
    assert catalogue.packed_folds.__wrapped__(spark, sf).select("repeat").distinct().count() == study.N_REPEATS
    asked = []
    monkeypatch.setattr(catalogue, "packed_folds", lambda spark, sf: None)
    monkeypatch.setattr(catalogue.models, "fit_folds", lambda rows, configs, n_perm: asked.append((configs, n_perm)))
    catalogue.fits.__wrapped__(spark, sf)
    configs = {c["id"]: c for c in asked[0][0]}
    assert [catalogue.models.resolved(configs[m]["model"], **configs[m].get("parameters", {}))["n_trees"] for m in ("rf", "xgb")] == [500, 300] and asked[0][1] == study.N_PERM


def gini(one, zero):
    return (one * one + zero * zero) / (one + zero)


@pytest.mark.parametrize("digits", [1, 9])
def test_trees_split_where_the_gain_is_largest(digits):
    rng = np.random.default_rng(5)
    y = (rng.random(70) < 0.7).astype(int)
    z = np.round(rng.normal(size=(70, 3)) + y[:, None], digits)  # width is one feature; with few digits there are ties
    x = z.astype(np.float32)
    for number, tree in enumerate(solvers.forest(z, y, 4, 9)):
        count = np.bincount(np.random.default_rng([9, number]).integers(0, 70, 70), minlength=70)
        weight = count * np.where(y == 1, 70 / (2 * count[y == 1].sum()), 70 / (2 * count[y == 0].sum()))
        todo = [(0, np.flatnonzero(count))]
        while todo:
            node, rows = todo.pop()
            one, zero = (weight[rows][y[rows] == c].sum() for c in (1, 0))
            assert tree.cover[node] == pytest.approx(one + zero) and tree.value[node] == pytest.approx(one / (one + zero))
            gains = {}
            for f in range(3):
                for low in np.unique(x[rows, f])[:-1]:
                    left = rows[x[rows, f] <= low]
                    a, b = (weight[left][y[left] == c].sum() for c in (1, 0))
                    gains.setdefault(f, []).append(gini(a, b) + gini(one - a, zero - b) - gini(one, zero))
            f = tree.feature[node]
            if f < 0:
                assert min(one, zero) == 0 or max((max(g) for g in gains.values()), default=0) <= 1e-9
                continue
            go = x[rows, f] <= tree.threshold[node]
            a, b = (weight[rows[go]][y[rows[go]] == c].sum() for c in (1, 0))
            assert gini(a, b) + gini(one - a, zero - b) - gini(one, zero) == pytest.approx(max(gains[f]), abs=1e-9)
            todo += [(tree.left[node], rows[go]), (tree.right[node], rows[~go])]


def test_a_tree_does_not_depend_on_its_company(monkeypatch):
    rng = np.random.default_rng(2)
    y = (rng.random(50) < 0.5).astype(int)
    z = rng.normal(size=(50, 5)) + y[:, None]
    whole = solvers.forest(z, y, 7, 3)
    monkeypatch.setattr(solvers, "GROWN", 120)
    for a, b in zip(whole, solvers.forest(z, y, 7, 3), strict=True):
        assert a == b
    assert all(t.feature == [-1] and t.value == [1.0] for t in solvers.forest(z, np.ones(50, dtype=int), 2, 3))
