"""First look at a cohort before it is studied: scale, floor, copies, nearest samples and labels of the given tables.

    python -m jobs.cohort_recon --config jobs/cohort_recon.json [--output PATH ...]

Reads the vectors of ``tables`` as the matrix of a cohort, and its labelled documents as sample metadata, and writes one table,
partitioned by section: ``matrix`` (scale and floor of all values), ``classes`` (samples of each class), ``labels`` (metadata fields that
disagree with the tissue), ``samples`` (each sample's largest correlation with another) and ``copies`` (samples with equal values, and
texts that several documents share). A rerun replaces the partitions of the sections with the same rows; no other file is touched.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featstab.functions.scalars import rounded
from featstab.operators import cohort, recon
from featstab.sources import tables

log = logging.getLogger(__name__)
SCHEMA = "item string, measure string, value double, section string"


@dataclass(frozen=True)
class Config:
    """``tables``: folder of the input tables; ``output``: folder of the result; ``below_percent``: values under a hundredth of it are counted as low."""

    tables: str
    output: str
    below_percent: int = 5


def sections(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """item, measure, value of each section."""
    values = tables.cohort(spark, config.tables).select("sample_id", "probe_id", "y", "x")
    whole = lambda d: d.select(F.lit("all").alias("item"), "measure", "value")
    metadata = tables.descriptions(spark, config.tables)
    docs = tables.load(spark, config.tables, "documents").groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    shared = docs.where("n > 1").agg(F.count(F.lit(1)).cast("double").alias("shared_texts"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("documents_sharing"), F.coalesce(F.max("n"), F.lit(0)).cast("double").alias("most_documents"))
    equal = recon.copies(values, 4).agg(F.countDistinct("digest").cast("double").alias("shared_columns"), F.count(F.lit(1)).cast("double").alias("samples_sharing"))
    counted = lambda d, item, measure: d.groupBy(item.alias("item")).agg(F.count(F.lit(1)).cast("double").alias("value")).select("item", F.lit(measure).alias("measure"), "value")
    return {
        "matrix": whole(recon.scale(values, config.below_percent / 100).unionByName(recon.floor_profile(values))),
        "classes": counted(tables.samples(values), F.col("y").cast("string"), "samples"),
        "labels": counted(cohort.label_violations(metadata), F.col("field"), "disagreements"),
        "samples": recon.nearest_samples(values).select(F.col("sample_id").cast("string").alias("item"), F.lit("largest_correlation").alias("measure"), F.col("r").alias("value")),
        "copies": whole(shared.unpivot([], shared.columns, "measure", "value").unionByName(equal.unpivot([], equal.columns, "measure", "value"))),
    }


def read(spark: SparkSession, config: Config) -> DataFrame:
    """The output as it stands."""
    return spark.read.schema(SCHEMA).parquet(config.output)


def run(spark: SparkSession, config: Config) -> DataFrame:
    """Write every section. Returns the output, read back."""
    log.info("read the tables of %s", config.tables)
    for name, rows in sections(spark, config).items():
        shown = rounded(rows, 9).withColumn("section", F.lit(name))
        shown.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section").parquet(config.output)
    out = read(spark, config)
    for r in out.groupBy("section").count().orderBy("section").collect():
        log.info("wrote %d rows of section %s to %s", r["count"], r["section"], config.output)
    return out


if __name__ == "__main__":
    from jobs.common import main

    main(Config, run)
