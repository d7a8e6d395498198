"""Permutation tables are many times as large as Spark's estimate of them: no side of their join goes through the driver."""

from pyspark.sql import functions as F

from featstab.operators import splits


def test_permutations_are_joined_by_sorted_rows(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("sample_id")).write.parquet(str(tmp_path / "samples"))  # a file's size is what Spark's estimate starts from
    rows = spark.read.parquet(str(tmp_path / "samples")).withColumn("repeat", F.lit(0)).withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1))))
    got = splits.permutations(rows, 3, 42)
    drawn = got.collect()
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().toString() and "SortMergeJoin" in got._jdf.queryExecution().toString()
    for fold in (0, 1):
        for r in range(3):
            own = [x for x in drawn if x["fold"] == fold and x["r"] == r]
            assert sorted(x["sample_id"] for x in own) == sorted(x["from_id"] for x in own) == list(range(40))
