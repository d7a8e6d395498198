"""Steps whose tasks held a whole cohort: their parts give what the whole did."""

import numpy as np
from pyspark.sql import functions as F

from featstab.operators import cohort, replication
from featstab.sources import tables


def test_correlations_by_chunks_of_samples(spark, sf):
    values = tables.cohort(spark, sf).where("p < 9").withColumn("x", F.when(F.col("p") == 4, 0.3).otherwise(F.col("x")))
    wide = values.toPandas().pivot(index="p", columns="sample_id", values="x").to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.corrcoef(wide)
    want = {p: max((r[p, q] for q in range(p + 1, 9) if p != 4 and q != 4), default=None) for p in range(9)}
    for block, chunk in ((4, 30), (512, 7), (512, 8192)):
        got = {row["p"]: row["max_r"] for row in replication.largest_correlations(values, block, chunk).collect()}
        assert got.keys() == want.keys() and all((want[p] is None and got[p] is None) or abs(got[p] - want[p]) < 1e-12 for p in want)


def test_random_control_has_no_task_per_class(spark, sf):
    got = cohort.subset(tables.titles(spark, sf), "random_control", "95-03")
    assert got.count() and "row_number" not in got._jdf.queryExecution().toString()
