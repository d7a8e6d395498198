"""Resamples at scale: draws stay where they are made, and prepared groups give what sorting in every resample does."""

import numpy as np
from pyspark.sql import functions as F

from featstab.functions import resampled
from featstab.operators import replication, splits


def test_prepared_groups_equal_the_sorted_way():
    rng = np.random.default_rng(3)
    for n0, n1 in ((5, 9), (0, 4), (4, 0), (1, 30)):
        y = rng.permutation([0] * n0 + [1] * n1)
        score, pred = np.round(rng.random(n0 + n1), 1), rng.integers(0, 2, n0 + n1)
        m = rng.integers(0, 4, (20, n0 + n1)).astype(float)
        got = resampled.Prepared(score, y, pred).statistics(m, ["roc_auc", "ap_normal", "balanced_accuracy"])
        for name, want in (("roc_auc", resampled.auc(score, y, m)), ("ap_normal", resampled.average_precision(score, y, m, 0)), ("balanced_accuracy", resampled.balanced_accuracy(pred, y, m))):
            assert np.allclose(got[name], want, equal_nan=True, atol=1e-14, rtol=0)


def test_draws_are_counted_where_they_are_made(spark):
    labels = spark.range(60).select(F.col("id").alias("sample_id"), (F.col("id") % 3 > 0).cast("int").alias("y"))
    w = splits.bootstrap_weights(labels, 6, 1)
    assert [r["n"] for r in w.groupBy("b").agg(F.sum("w").alias("n")).collect()] == [60] * 6
    plan = w._jdf.queryExecution().toString().split("Physical Plan")[1]
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(b#" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]
    rows = labels.select("sample_id", "y", F.lit("G1").alias("gene"), F.col("sample_id").cast("double").alias("x"))
    assert "explode" not in replication.weighted_auc(rows, w)._jdf.queryExecution().toString()
