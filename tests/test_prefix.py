"""Positions and running values against a loop over sorted rows."""

import random

import pytest
from pyspark.sql import functions as F

from featstab.functions.prefix import running


def brute(rows, grouped):
    """(group, key, value) sorted; position, running sum and minimum of each."""
    out, state = [], {}
    for g, k, v in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0) if grouped else (), r[1])):
        n, total, least = state.get(g if grouped else 0, (0, None, None))
        n += 1
        if v is not None:
            total, least = (total or 0) + v, v if least is None else min(least, v)
        state[g if grouped else 0] = (n, total, least)
        out.append((g, k, v, n, total, least))
    return sorted(out, key=lambda r: r[1])


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_running_equals_loop(spark, grouped, partitions):
    draw = random.Random(partitions)
    # one group holds half of the rows, so it spreads over several partitions; one group is null
    rows = [(draw.choice([1, 1, 1, 2, 3, None, 4]), k, draw.choice([None, draw.randrange(-9, 9)])) for k in draw.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "g int, k long, v long").repartition(4)
    got = running(df, [F.col("k")], by=("g",) if grouped else (), partitions=partitions, total=("sum", "v"), least=("min", "v"))
    assert got.columns == ["g", "k", "v", "position", "total", "least"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == brute(rows, grouped)


def test_empty_ties_and_clashing_names(spark):
    none = spark.createDataFrame([], "k long, v long")
    assert running(none, [F.col("k")], total=("sum", "v")).collect() == []
    same = spark.createDataFrame([(1, 2, 0)] * 5, "k long, v long, position long")
    got = running(same, [F.col("k").desc()], total=("sum", "v"), partitions=3).orderBy("position").collect()
    assert [(r["position"], r["total"]) for r in got] == [(i, 2 * i) for i in range(1, 6)]
    only = running(same, [F.col("k")], position=None, largest=("max", "v"))
    assert only.columns == ["k", "v", "position", "largest"]


def test_no_window_over_one_partition(spark):
    got = running(spark.range(1000).withColumn("v", F.col("id") % 7), [F.col("id").desc()], total=("sum", "v"))
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
