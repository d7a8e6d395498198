"""Resamples as a byte a sample: no row a draw or a sample is kept, shuffled or sorted, and results are those of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featstab.functions import resampled
from featstab.operators import metrics, splits


@pytest.fixture(scope="module")
def labels(spark):
    return spark.range(0, 180, 3).select(F.col("id").alias("sample_id"), (F.col("id") % 5 > 0).cast("int").alias("y"))


def test_packed_draws_are_the_weights(spark, labels):
    draws = splits.Draws(labels, 7, 5)
    ids = {c: sorted(r["sample_id"] for r in labels.collect() if r["y"] == c) for c in (0, 1)}
    want = {(r["b"], r["sample_id"]): r["w"] for r in splits.bootstrap_weights(labels, 7, 5).collect()}
    rows = draws.packed().collect()
    assert len(rows) == 14
    got = {(r["b"], i): int(w) for r in rows for i, w in zip(ids[r["y"]], np.frombuffer(r["counts"], np.uint8), strict=True) if w}
    assert got == want and all(len(r["counts"]) == r["n"] for r in rows)
    plan = draws.packed()._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert "HashAggregate(keys=[b#" not in plan and plan.count("Exchange hashpartitioning(b#") == 1
    assert np.frombuffer(splits.counted(np.array([3, 256])), np.int32).tolist() == [3, 256]


def test_bootstrap_by_rows_and_by_bytes(spark, labels, monkeypatch):
    monkeypatch.setattr(metrics, "CHUNK", 3)
    rng = np.random.default_rng(1)
    ids = [(r["sample_id"], r["y"]) for r in labels.orderBy("sample_id").collect()]
    table = [(g, i, y, float(np.round(rng.random() + y * 0.3, 1)), int(rng.integers(0, 2))) for g in ("a", "b") for i, y in ids if g == "a" or i % 2]  # b lacks samples
    rows = spark.createDataFrame(table, "g string, sample_id long, y int, score double, pred int")
    weights = splits.bootstrap_weights(labels, 7, 5).localCheckpoint()
    shown = lambda d: sorted((r["g"], r["b"], round(r["roc_auc"], 12), round(r["ap_normal"], 12), round(r["balanced_accuracy"], 12)) for r in d.collect())
    got = shown(metrics.bootstrap(rows, splits.Draws(labels, 7, 5), ["g"]))
    assert got == shown(metrics.bootstrap(rows, weights, ["g"])) and len(got) == 14
    w = {(r["b"], r["sample_id"]): r["w"] for r in weights.collect()}
    for g, b, auc, ap, accuracy in got:
        own = [t for t in table if t[0] == g]
        y, score, pred = (np.array([t[k] for t in own]) for k in (2, 3, 4))
        m = np.array([[w.get((b, t[1]), 0) for t in own]], dtype=float)
        assert auc == pytest.approx(resampled.auc(score, y, m)[0]) and ap == pytest.approx(resampled.average_precision(score, y, m, 0)[0]) and accuracy == pytest.approx(resampled.balanced_accuracy(pred, y, m)[0])
    assert metrics.bootstrap(rows.where("false"), splits.Draws(labels, 7, 5), ["g"]).collect() == []
