"""Adapters from the driver's tables to cohorts: tall (sample, probe, value) facts with labels and a probe-to-gene map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLOOR = -0.15
N_GENES = 24
N_SIGNAL, SIGNAL = 6, 0.15
FIRST_RARE, RARE = 56, -0.45


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, p, probe_id, gene, y, x: vectors as samples, label 0 as the minority class, with planted signal and rare probes."""
    y = F.when(F.col("label") == 0, 0).otherwise(1)
    tall = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), y.alias("y"), F.posexplode("embedding").alias("p", "v"))
    sign = F.when(F.col("p") % 2 == 0, F.lit(SIGNAL)).otherwise(F.lit(-SIGNAL))
    shift = F.when(F.col("p") < N_SIGNAL, sign * F.col("y")).when(F.col("p") >= FIRST_RARE, F.lit(RARE)).otherwise(F.lit(0.0))
    return tall.select("sample_id", F.col("p").cast("long").alias("p"), F.concat(F.lit("P"), F.lpad(F.col("p").cast("string"), 2, "0"), F.lit("_at")).alias("probe_id"), F.concat(F.lit("G"), (F.col("p") % N_GENES).cast("string")).alias("gene"), "y", F.greatest(F.col("v").cast("double") + shift, F.lit(FLOOR)).alias("x"))


def samples(values: DataFrame) -> DataFrame:
    """sample_id, y of a tall cohort."""
    return values.select("sample_id", "y").distinct()


def probe_map(values: DataFrame) -> DataFrame:
    return values.select("probe_id", "gene").distinct()


def discovery_half(values: DataFrame) -> DataFrame:
    """Samples with an even id."""
    return values.where(F.col("sample_id") % 2 == 0)


def external_arrays(values: DataFrame) -> DataFrame:
    """Samples with an odd id on another scale, as arrays with a title and a group; pairs of one class share a tumour."""
    group = F.when(F.col("y") == 0, "Healthy").when(F.col("sample_id") % 3 == 0, "TNBC").when(F.col("sample_id") % 3 == 1, "Her2").otherwise("Luminal A")
    number = F.floor(F.col("sample_id") / 4)
    title = F.concat(F.lit("TUM"), number.cast("string"), F.when(F.col("sample_id") % 4 == 1, "_repA").otherwise("_repB"))
    group = F.when(F.col("y") == 0, "Healthy").when(number % 3 == 0, "TNBC").when(number % 3 == 1, "Her2").otherwise("Luminal A")
    kept = values.where(F.col("sample_id") % 2 == 1)
    return kept.select("sample_id", "probe_id", "gene", F.when(F.col("sample_id") % 97 == 5, "CellLine").otherwise(group).alias("sample_group"), title.alias("title"), (2 * F.col("x") + 5).alias("x"))


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a platform annotation with control probes, unmapped and ambiguous symbols."""
    key = F.col("p_partkey")
    symbol = F.when(key % 11 == 0, "---").when(key % 13 == 0, "").when(key % 7 == 0, F.concat(F.lit("G"), key % 24, F.lit("///G"), key % 5)).otherwise(F.concat(F.lit(" G"), key % 500, F.lit(" ")))
    ident = F.when(key % 50 == 0, F.concat(F.lit("AFFX-"), key)).otherwise(F.concat(key, F.lit("_at")))
    return load(spark, sf_dir, "part").select(ident.alias("probe_id"), symbol.alias("symbol"), (key % 500).cast("string").alias("entrez"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples with a dated title; every tenth has no date."""
    d = F.col("o_orderdate")
    dated = F.concat_ws("_", F.concat(F.lit("Breast cancer, T"), F.col("o_orderkey")), F.date_format(d, "dd"), F.date_format(d, "MM"), F.date_format(d, "yy"))
    y = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), y.alias("y"), F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("Breast cancer, T"), F.col("o_orderkey"))).otherwise(dated).alias("title"))


def vector_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, y, title of the vectors: two thirds of them were processed in December 2004."""
    number = F.col("vec_id")
    month = F.when(number % 3 == 0, F.lit("11")).otherwise(F.lit("12"))
    return load(spark, sf_dir, "embeddings").select(number.alias("sample_id"), F.when(F.col("label") == 0, 0).otherwise(1).alias("y"), F.concat(F.lit("Breast cancer, T"), number, F.lit("_03_"), month, F.lit("_04")).alias("title"))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as sample metadata; some fields disagree with the tissue, some tissues are unknown."""
    docs = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id")
    tissue = F.when(F.col("doc_id") % 41 == 0, "unknown").when(F.col("quality") == 1, " Breast Cancer").otherwise("normal breast")
    source = F.when((F.col("quality") == 1) != (F.col("doc_id") % 17 == 0), "tumour: cancer").otherwise("healthy")
    title = F.when(F.col("quality") == 1, "Breast cancer, T").otherwise("Normal, N")
    about = F.when((F.col("quality") == 1) != (F.col("doc_id") % 23 == 0), "Invasive CANCER").otherwise("control")
    return docs.select(F.col("doc_id").alias("sample_id"), tissue.alias("tissue"), source.alias("source_name"), title.alias("title"), about.alias("description"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene sets: a term per brand and per type, members by part key."""
    part = load(spark, sf_dir, "part")
    gene = F.concat(F.lit("G"), F.col("p_partkey") % 500)
    return part.select(F.col("p_brand").alias("term"), gene.alias("gene")).union(part.select("p_type", gene)).distinct()
