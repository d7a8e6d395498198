"""Repeated stratified folds, training rows, label permutations and permutation tables, all from keyed orders."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running
from ..functions.scalars import keyed, keyed_int


def stratified_folds(labels: DataFrame, n_splits: int = 5, n_repeats: int = 2, seed: int = 42) -> DataFrame:
    """repeat, fold, sample_id, y: the test fold of each sample in each repeat, classes spread evenly."""
    rows = labels.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    order = Window.partitionBy("repeat", "y").orderBy(keyed(F.lit(seed) + F.col("repeat"), F.col("sample_id")), "sample_id")
    return rows.select("repeat", ((F.row_number().over(order) - 1) % n_splits).alias("fold"), "sample_id", "y")


def too_small_classes(labels: DataFrame, n_splits: int) -> DataFrame:
    """Classes with fewer samples than folds, and labels that aren't 0 or 1: rows here are errors."""
    return labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") < n_splits) | ~F.col("y").isin(0, 1))


def by_sample(folds: DataFrame, *columns: str) -> DataFrame:
    """sample_id, _folds: the ``columns`` of a sample's rows as one array, to be joined by sorted samples. Folds grow with the samples, so
    they never go whole to the driver or to every task, and the join makes no copies."""
    return folds.groupBy("sample_id").agg(F.collect_list(F.struct(*columns)).alias("_folds")).hint("merge")


def training(values: DataFrame, folds: DataFrame, n_splits: int) -> DataFrame:
    """Every value with each fold that it trains: an equi-join on the sample and an explode, no inequality join."""
    others = F.filter(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda f: f != F.col("fold"))
    placed = values.join(by_sample(folds, "repeat", "fold"), "sample_id").select(*values.columns, F.inline("_folds"))
    return placed.withColumn("fold", F.explode(others))


def testing(values: DataFrame, folds: DataFrame) -> DataFrame:
    return values.join(by_sample(folds, "repeat", "fold"), "sample_id").select(*values.columns, F.inline("_folds"))


def overlap(folds: DataFrame, n_splits: int) -> DataFrame:
    """Samples that both train and test a fold: must be empty."""
    train = training(folds.select("sample_id").distinct(), folds, n_splits).select("repeat", "fold", "sample_id")
    return train.intersect(folds.select("repeat", "fold", "sample_id"))


def permuted_labels(labels: DataFrame, seed: int, replicate: int) -> DataFrame:
    """Labels dealt anew: the label of rank n in one keyed order goes to the sample of rank n by id."""
    by_id = running(labels.select("sample_id"), [F.col("sample_id")], position="n")
    drawn = labels.select("y", "sample_id", keyed(seed, 777, replicate, F.col("sample_id")).alias("_key"))
    dealt = running(drawn, [F.col("_key"), F.col("sample_id")], position="n").select("y", "n")
    return by_id.join(dealt, "n").select("sample_id", "y")


def null_folds(labels: DataFrame, n_splits: int, replicates: int, seed: int = 42) -> DataFrame:
    """repeat, fold, sample_id, y of the permutation null: each replicate, under ``repeat``, has labels and folds of its own.

    Replicate b has permuted_labels(labels, seed, b) and the folds that stratified_folds() draws for the seed moved by 100000 (1 + b)."""
    rows = labels.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    of = lambda *order: F.row_number().over(Window.partitionBy("repeat").orderBy(*order))
    placed = rows.select("repeat", "sample_id", of("sample_id").alias("n"))
    dealt = rows.select("repeat", "y", of(keyed(seed, 777, F.col("repeat"), F.col("sample_id")), "sample_id").alias("n"))
    rows = placed.join(dealt, ["repeat", "n"])
    order = Window.partitionBy("repeat", "y").orderBy(keyed(F.lit(seed) + 100_000 * (1 + F.col("repeat")), F.col("sample_id")), "sample_id")
    return rows.select("repeat", ((F.row_number().over(order) - 1) % n_splits).alias("fold"), "sample_id", "y")


def permutations(rows: DataFrame, n: int, seed: int, by: tuple[str, ...] = ("repeat", "fold")) -> DataFrame:
    """by, r, sample_id, from_id: ``n`` permutations of the samples of each group, the same for all genes.

    Spark's estimate of a table's size does not see what explode makes of it, so the join is asked to be by sorted rows."""
    rows = rows.select(*by, "sample_id").distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = rows.withColumn("i", F.row_number().over(Window.partitionBy(*by, "r").orderBy("sample_id")))
    key = keyed(seed, *(F.col(c) for c in by), F.col("r"), F.col("sample_id"))
    moved = rows.select(*by, "r", F.col("sample_id").alias("from_id"), F.row_number().over(Window.partitionBy(*by, "r").orderBy(key, "sample_id")).alias("i"))
    return placed.join(moved.hint("merge"), [*by, "r", "i"]).drop("i")


def placed(labels: DataFrame) -> DataFrame:
    """sample_id, y, i: the place of each sample in its class, by id, from 0."""
    return labels.select("sample_id", "y", (F.row_number().over(Window.partitionBy("y").orderBy("sample_id")) - 1).cast("long").alias("i"))


def _drawn(labels: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """b, y, n, i: places that the resamples draw. They are made in the task that has the resample's number, a class after the other."""
    n = labels.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    parts = min(n_boot, int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))) or 1
    each = n.select("y", "n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")).repartition(parts, "b")
    draws = each.select("y", "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("draw"))
    return draws.select("b", "y", "n", (keyed_int(seed, F.col("b"), F.col("y"), F.col("draw")) % F.col("n")).alias("i"))


def bootstrap_weights(labels: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """b, sample_id, w: how often each sample is drawn, with replacement, within its class; 0 rows are left out.

    A resample's draws are made and counted in the task that has its number, so draws are never shuffled; samples by their places in
    their class go to every task."""
    drawn = _drawn(labels, n_boot, seed)
    return drawn.groupBy("b", "y", "i").agg(F.count(F.lit(1)).alias("w")).join(F.broadcast(placed(labels)), ["y", "i"]).select("b", "sample_id", "w")


@dataclass(frozen=True)
class Draws:
    """The resamples that bootstrap_weights() has as rows, for those who need them by place in the class."""

    labels: DataFrame
    n_boot: int
    seed: int

    def packed(self) -> DataFrame:
        """b, y, n, counts: how often a resample draws each sample of a class, a byte a sample in the order of placed(), or four where a byte
        is too small. Draws are counted as they come, so that a task holds one class of one resample."""

        def row(key: tuple[int, int, int], parts: list[np.ndarray]) -> pa.RecordBatch:
            counts = counted(np.bincount(np.concatenate(parts), minlength=key[2]))
            return pa.RecordBatch.from_pydict({"b": pa.array([key[0]], pa.int64()), "y": pa.array([key[1]], pa.int32()), "n": pa.array([key[2]], pa.int64()), "counts": pa.array([counts], pa.binary())})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, parts = None, []
            for batch in batches:
                b, y, n, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "y", "n", "i"))
                ends = [*(np.flatnonzero((b[1:] != b[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(b)] if len(b) else []
                for start, end in zip([0, *ends], ends):  # noqa: B905  # one start more
                    own = (int(b[start]), int(y[start]), int(n[start]))
                    if own != key and parts:
                        yield row(key, parts)
                        parts = []
                    key = own
                    parts.append(i[start:end])
            if parts:
                yield row(key, parts)

        drawn = _drawn(self.labels, self.n_boot, self.seed).select(F.col("b").cast("long").alias("b"), F.col("y").cast("int").alias("y"), F.col("n").cast("long").alias("n"), "i")
        return drawn.mapInArrow(run, "b long, y int, n long, counts binary")


def counted(counts: np.ndarray) -> bytes:
    """Counts as bytes, one each if they fit, else four."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int32).tobytes()
