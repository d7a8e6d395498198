"""The frozen regression's metrics come with bootstrap intervals and the numbers of units."""

import numpy as np

from featstab.plans import catalogue


def test_transfer_has_intervals(spark, sf, monkeypatch):
    def cohort(first, even):
        rng = np.random.default_rng(first)
        return spark.createDataFrame([(first + i, g, i % 3 % 2, float(rng.normal() + (i % 3 % 2) * s)) for i in range(60) for g, s in (("G1", 1.0), ("G2", -0.5), ("G3", 0.0))], "sample_id long, gene string, y int, x double")

    monkeypatch.setattr(catalogue, "disc", lambda spark, sf: cohort(0, True))
    monkeypatch.setattr(catalogue, "ext", lambda spark, sf: cohort(100, False))
    monkeypatch.setattr(catalogue, "frozen", lambda spark, sf: spark.createDataFrame([("G1", True), ("G2", True), ("G3", False)], "gene string, in_S_top25 boolean"))
    r = catalogue.QUERIES["frozen_lr_transfer"](spark, sf).first().asDict()
    for name in ("roc_auc", "ap_normal", "balanced_accuracy"):
        assert r[f"{name}_lo"] < r[f"{name}_hi"] and r[f"{name}_lo"] <= r[name] <= r[f"{name}_hi"]
    assert (r["n"], r["n_normal"]) == (60, 40)
