"""Cohort rules: labels, usable probes, the feature universe, subsets, exclusions, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running
from ..functions.scalars import keyed

#: Tissues and their labels.
TISSUES = {"breast cancer": 1, "normal breast": 0}


class LabelError(ValueError):
    """Labels cannot be told reliably."""


def _tissue() -> Column:
    return F.lower(F.trim("tissue"))


def derive_labels(samples: DataFrame) -> DataFrame:
    """sample_id, y of every sample whose tissue is known."""
    y = F.lit(None).cast("int")
    for name, label in TISSUES.items():
        y = F.when(_tissue() == name, label).otherwise(y)
    return samples.select("sample_id", y.alias("y")).where("y is not null")


def label_violations(samples: DataFrame) -> DataFrame:
    """sample_id, field of every disagreement with the tissue, and of unknown tissues: must be empty, labels are never guessed."""
    cancer = _tissue() == "breast cancer"
    checks = {
        "source_name": F.lower("source_name").contains("cancer"), "title": F.lower("title").startswith("breast cancer"), "description": F.lower("description").contains("cancer"),
    }
    known = F.coalesce(_tissue().isin(*TISSUES), F.lit(False))
    found = [F.when(~known, F.lit("tissue")), *(F.when(known & (F.coalesce(flag, F.lit(False)) != cancer), F.lit(name)) for name, flag in checks.items())]
    return samples.select("sample_id", F.explode(F.array_compact(F.array(*found))).alias("field"))


def checked_labels(samples: DataFrame) -> DataFrame:
    """derive_labels() behind the check."""
    bad = [(r["sample_id"], r["field"]) for r in label_violations(samples).limit(4).collect()]
    if bad:
        raise LabelError(f"fields disagree or tissue is unknown, e.g. {bad}")
    return derive_labels(samples)


def usable_probes(annotation: DataFrame) -> DataFrame:
    """Probes of one gene: no control, no missing and no ambiguous symbol."""
    symbol = F.trim("symbol")
    return annotation.where(~symbol.isin("", "---") & ~symbol.contains("///") & ~F.col("probe_id").startswith("AFFX")).select("probe_id", symbol.alias("gene"), "entrez")


def feature_universe(usable: DataFrame, *cohorts: DataFrame) -> DataFrame:
    """Usable probes that every cohort has, by probe id."""
    for probes in cohorts:
        usable = usable.join(probes.select("probe_id").distinct(), "probe_id", "left_semi")
    return usable.orderBy("probe_id")


def missing_probes(universe: DataFrame, values: DataFrame) -> DataFrame:
    """Probes of the universe that a cohort lacks: must be empty."""
    return universe.join(values.select("probe_id").distinct(), "probe_id", "left_anti").select("probe_id")


def processing_month(title: str = "title") -> Column:
    """yy-mm of titles that end in _day_month_year; null without a date."""
    day = r"_(\d{1,2})_(\d{1,2})_(\d{2})$"
    part = lambda i: F.regexp_extract(title, day, i)
    return F.when(part(0) != "", F.concat(part(3), F.lit("-"), F.lpad(part(2), 2, "0")))


def subset(samples: DataFrame, kind: str, month: str, seed: int = 42) -> DataFrame:
    """``full``, the ``month``'s samples, or as many random ones of each class as the month has."""
    dated = samples.withColumn("month", processing_month())
    if kind == "full":
        return dated
    if kind == "month":
        return dated.where(F.col("month") == month)
    if kind != "random_control":
        raise ValueError(kind)
    n = dated.where(F.col("month") == month).groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    drawn = running(dated.withColumn("_key", keyed(seed, F.col("sample_id"))), [F.col("_key"), F.col("sample_id")], ("y",), position="_i")
    return drawn.join(F.broadcast(n), "y").where("_i <= _n").select(*dated.columns)  # n: a row a class


def without_genes(values: DataFrame, genes: Sequence[str]) -> DataFrame:
    return values.where(~F.col("gene").isin(*genes))


def first_entrez(usable: DataFrame) -> DataFrame:
    """gene, entrez: of the first probe by id."""
    return usable.groupBy("gene").agg(F.min_by("entrez", "probe_id").alias("entrez"))


def profile(values: DataFrame, floor: float) -> DataFrame:
    """Per probe: scale and values on the floor."""
    return values.groupBy("probe_id", "gene").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.count_if(F.col("x") <= floor + 1e-9).alias("n_floor"))


def annotation_profile(usable: DataFrame) -> DataFrame:
    """n_probes, n_genes, n_entrez, genes with two and five probes or more, genes with several entrez ids."""
    genes = usable.groupBy("gene").agg(F.count(F.lit(1)).alias("p"), F.countDistinct("entrez").alias("e"))
    return usable.agg(F.count(F.lit(1)).alias("n_probes"), F.countDistinct("gene").alias("n_genes"), F.countDistinct("entrez").alias("n_entrez")).join(
        F.broadcast(genes.agg(F.count_if(F.col("p") >= 2).alias("genes_ge2"), F.count_if(F.col("p") >= 5).alias("genes_ge5"), F.count_if(F.col("e") > 1).alias("genes_multi_entrez")))
    )


def duplicate_columns(values: DataFrame) -> DataFrame:
    """Probes whose values are equal in every sample, by a hash of the values in sample order: first, n."""
    packed = values.groupBy("probe_id").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("sample_id", "x")))).alias("h"))
    return packed.groupBy("h").agg(F.min("probe_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first", "n")
