"""Small text sources: the feature universe, gene-set libraries, stored result tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .geo import lines


def feature_universe(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header, all text: empty cells stay empty, nothing is quoted."""
    return spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False).na.fill("")


def gmt_library(spark: SparkSession, path: str) -> DataFrame:
    """term, gene of a GMT file: a term, its description and its genes per line; repeated genes count once."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) > 2).select(parts[0].alias("term"), F.explode(F.slice(parts, 3, F.size(parts))).alias("gene"))
    return rows.select("term", F.trim("gene").alias("gene")).where("gene <> ''").distinct()


def cached_library(spark: SparkSession, path: str) -> DataFrame:
    """term, gene of a library stored as JSON: {"terms": {term: [genes]}}. Nothing is fetched."""
    terms = json.loads("".join(lines(path)))["terms"]
    rows = spark.createDataFrame([(t, g) for t, g in terms.items()], "term string, genes array<string>")
    return rows.select("term", F.explode("genes").alias("gene")).distinct()


def result_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stored table: Parquet folders and CSV files, gzipped or not; a CSV file's types come from ``schema``."""
    if ".csv" in path:
        return spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.parquet(path)
