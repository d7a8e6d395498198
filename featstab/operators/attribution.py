"""Attributions and rankings: Welch t, linear coefficients, linear Shapley values, exact permutation, ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import average_rank

FOLD = ("repeat", "fold")
#: Fixed value: what a separated pair of constant classes counts as.
SEPARATED = 1e9
#: Permutation losses under this count as none.
NOISE = 1e-12


def ranked(rows: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    """Adds rank: largest importance first, ties by gene. A null or non-finite importance fails the job that meets it."""
    i = F.col("importance")
    bad = i.isNull() | F.isnan(i) | (F.abs(i) == float("inf"))
    told = F.raise_error(F.concat_ws(" ", F.lit("importance is missing or not finite:"), F.col("gene"))).cast("double")
    return rows.withColumn("importance", F.when(bad, told).otherwise(i)).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("importance"), "gene")))


def positive_top(rows: DataFrame, k: int) -> DataFrame:
    """Ranks up to ``k`` with a positive importance: sets may be smaller than k."""
    return rows.where((F.col("rank") <= k) & (F.col("importance") > 0))


def welch_t(mean1: str = "mean1", mean0: str = "mean0", var1: str = "var1", var0: str = "var0", n1: str = "n1", n0: str = "n0") -> Column:
    """Welch's t from class moments; null unless both classes have two samples. Without variance: 0, or +-SEPARATED by sign."""
    difference = F.col(mean1) - F.col(mean0)
    error = F.sqrt(F.col(var1) / F.col(n1) + F.col(var0) / F.col(n0))
    return F.when((F.col(n1) < 2) | (F.col(n0) < 2), None).when(error > 0, difference / F.when(error > 0, error)).when(difference == 0, F.lit(0.0)).otherwise(F.signum(difference) * SEPARATED)


def shown(rows: DataFrame, importance: Column, signed: Column, by: tuple[str, ...] = FOLD) -> DataFrame:
    """by, gene, importance, signed, to twelve decimals."""
    return rows.select(*by, "gene", F.round(importance, 12).alias("importance"), F.round(signed, 12).alias("signed"))


def ttest(state: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    t = welch_t()
    return shown(state, F.abs(t), t, by)


def mean_difference(state: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    """by, gene, w: the class means' difference in units of the scale; a closed-form linear model."""
    return state.select(*by, "gene", ((F.col("mean1") - F.col("mean0")) / F.col("scale")).alias("w"))


def coefficients(weights: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    return shown(weights, F.abs("w"), F.col("w"), by)


def linear_shap(z: DataFrame, weights: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    """Mean absolute and mean of w (z - mean z) over the training rows."""
    centre = z.groupBy(*by, "gene").agg(F.avg("z").alias("c"))
    phi = F.col("w") * (F.col("z") - F.col("c"))
    rows = z.join(centre, [*by, "gene"]).join(weights, [*by, "gene"]).groupBy(*by, "gene").agg(F.avg(F.abs(phi)).alias("i"), F.avg(phi).alias("s"))
    return shown(rows, F.col("i"), F.col("s"), by)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def balanced_brier(p: Column, y: Column) -> Column:
    """Aggregate: the mean of the classes' mean squared errors."""
    return (F.avg(F.when(y == 1, (1 - p) * (1 - p))) + F.avg(F.when(y == 0, p * p))) / 2


def margins(z: DataFrame, weights: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    """by, sample_id, y, f: linear scores."""
    return z.join(weights, [*by, "gene"]).groupBy(*by, "sample_id", "y").agg(F.round(F.sum(F.col("w") * F.col("z")), 9).alias("f"))


def linear_permutation(z: DataFrame, weights: DataFrame, moves: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    """Rise of the balanced Brier loss when a gene is permuted: the score moves by (z of the other sample - z) w, so no model is run.

    A task holds one fold's matrix and its permutations."""

    def run(rows: pa.Table, drawn: pa.Table) -> pa.Table:
        data, moved = rows.to_pandas().sort_values(["gene", "sample_id"]), drawn.to_pandas().sort_values(["r", "sample_id"])
        out = []
        if len(data) and len(moved):
            genes, samples = data["gene"].drop_duplicates().to_numpy(), np.sort(data["sample_id"].unique())
            x = data["z"].to_numpy().reshape(len(genes), len(samples))
            w = data["w"].to_numpy()[:: len(samples)]
            y = data["y"].to_numpy()[: len(samples)]
            source = np.searchsorted(samples, moved["from_id"].to_numpy()).reshape(-1, len(samples))
            f = np.round(w @ x, 9)
            loss = lambda s: (((1 / (1 + np.exp(-s))) - y)[..., y == 1] ** 2).mean(-1) / 2 + ((1 / (1 + np.exp(-s)))[..., y == 0] ** 2).mean(-1) / 2
            start = loss(f)
            raw = np.array([loss(f + (x[g][source] - x[g]) * w[g]).mean() - start for g in range(len(genes))])
            keys = [pa.array(data[c].to_numpy()[: len(genes)], rows.schema.field(c).type) for c in by]
            out = [*keys, pa.array(genes, pa.string()), pa.array(raw, pa.float64())]
        fields = [*(rows.schema.field(c) for c in by), pa.field("gene", pa.string()), pa.field("raw", pa.float64())]
        return pa.Table.from_arrays(out or [pa.array([], f.type) for f in fields], schema=pa.schema(fields))

    kinds = {f.name: f.dataType.simpleString() for f in z.schema}
    rows = z.join(weights, [*by, "gene"]).select(*by, "gene", "sample_id", "y", "z", "w")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", gene string, raw double"
    own = moves.select(*(F.col(c).alias(c) for c in (*by, "r", "sample_id", "from_id")))  # columns of its own, as both sides come from the folds
    raw = rows.groupBy(*by).cogroup(own.groupBy(*by)).applyInArrow(run, schema)
    return permutation_importance(raw, by)


def permutation_importance(raw: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    """From the rise of the loss: what is under NOISE counts as none; ``signed`` keeps it."""
    return shown(raw, F.when(F.col("raw") > NOISE, F.col("raw")).otherwise(F.lit(0.0)), F.col("raw"), by)


def class_auc(rows: DataFrame, value: str = "x", by: tuple[str, ...] = (*FOLD, "gene")) -> DataFrame:
    """by, auc: P(value of class 1 > value of class 0) + half of ties, from average ranks; null without both classes."""
    r = rows.select(*by, "y", average_rank(value, by).alias("_r"))
    n1, n0 = F.sum(F.when(F.col("y") == 1, 1.0).otherwise(0.0)), F.sum(F.when(F.col("y") == 0, 1.0).otherwise(0.0))
    sums = r.groupBy(*by).agg(F.sum(F.when(F.col("y") == 1, F.col("_r"))).alias("_s"), n1.alias("_n1"), n0.alias("_n0"))
    return sums.select(*by, F.when((F.col("_n1") > 0) & (F.col("_n0") > 0), (F.col("_s") - F.col("_n1") * (F.col("_n1") + 1) / 2) / (F.col("_n1") * F.col("_n0"))).alias("auc"))


def auc_importance(auc: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    return shown(auc, F.abs(F.col("auc") - 0.5), F.col("auc") - 0.5, by)
