"""Incremental intake of text samples: new document files become samples, and the class effects of their features are kept up to date.

    python -m jobs.document_intake --config jobs/document_intake.json [--documents PATH ...]

A file stream takes the files of ``documents`` that it has not taken before (its checkpoint knows which), a bounded number a step, and
ends when there are no more. Each step measures its documents (features of the text, digest, cohort) and adds those with new ids to
``samples``, partitioned by step. Then the effects of all samples with a label (``labels`` is read whole, so labels may come later than
their documents) are written to ``output``, partitioned by cohort: one row per cohort and feature.

Texts are read once, when they are new; later runs read the few columns of ``samples``. A step that was stopped is taken again with the
same files and replaces its own partition, so a run that is repeated, or goes on after a failure, gives the same result. Of documents
with the same id the first step's counts, and within a step the one with the smallest digest; a null id can't be labelled and is left
out, with a line in the log. Rows without a source are of cohort ``(none)``. An empty table gives an empty output.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featstab.functions.scalars import rounded
from featstab.operators import intake

log = logging.getLogger(__name__)
SAMPLES = "doc_id long, digest string, source string, " + ", ".join(f"{f} long" for f in intake.FEATURES) + ", batch long"
EFFECTS = "feature string, n1 long, n0 long, mean1 double, mean0 double, t double, g double, auc double, direction long, n_cohorts long, n_agree long, source string"


@dataclass(frozen=True)
class Config:
    """Paths of the input tables, of the samples, of the stream's checkpoint and of the output; ``files_a_step``: most files in a step."""

    documents: str
    labels: str
    samples: str
    checkpoint: str
    output: str
    files_a_step: int = 1000


def samples_of(documents: DataFrame) -> DataFrame:
    """doc_id, digest, source, features: a row per id."""
    t = F.coalesce(F.col("text"), F.lit(""))
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("(none)"))
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(t.cast("binary")).alias("digest"), source.alias("source"), *[c.alias(f) for f, c in intake.measured().items()])
    each = rows.groupBy("doc_id").agg(F.min(F.struct("digest", "source", *intake.FEATURES)).alias("_one"))
    return each.select("doc_id", "_one.*")


def effects_of(samples: DataFrame, labels: DataFrame) -> DataFrame:
    return rounded(intake.effects(samples, intake.agreed_labels(labels)), 9)


def read(spark: SparkSession, config: Config) -> DataFrame:
    """The output as it stands."""
    return spark.read.schema(EFFECTS).parquet(config.output)


def run(spark: SparkSession, config: Config) -> DataFrame:
    """Take new documents, then write the effects of all samples. Returns the output, read back."""
    spark.createDataFrame([], SAMPLES).write.mode("ignore").partitionBy("batch").parquet(config.samples)
    stored = lambda: spark.read.schema(SAMPLES).parquet(config.samples)

    def take(batch: DataFrame, number: int) -> None:
        before = stored().where(F.col("batch") < number).select("doc_id")
        new = samples_of(batch).join(before, "doc_id", "left_anti").withColumn("batch", F.lit(number).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(config.samples)

    schema = spark.read.parquet(config.documents).select("doc_id", "text", "source").schema
    path = config.documents.rstrip("/")
    path = path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"  # as a pattern of its own, which may be one file as well as a folder of files
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_a_step).parquet(path)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", config.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    steps = [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]
    log.info("read %d new documents of %s in %d steps", sum(n for _, n in steps), config.documents, len(steps))
    for r in stored().groupBy("batch").agg(F.count(F.lit(1)).alias("n")).where(F.col("batch").isin([b for b, _ in steps])).orderBy("batch").collect() if steps else []:
        log.info("wrote %d samples of step %d to %s", r["n"], r["batch"], config.samples)
    found = effects_of(stored(), spark.read.parquet(config.labels))
    found.write.mode("overwrite").partitionBy("source").parquet(config.output)
    out = read(spark, config)
    log.info("wrote %d effects to %s", out.count(), config.output)
    return out


if __name__ == "__main__":
    from jobs.common import main

    main(Config, run)
