"""Classification metrics, weighted for bootstrap resamples. Everything is an ordered running sum over distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import resampled
from ..functions.kept import kept
from ..functions.prefix import running
from ..functions.resampled import nullable
from . import splits


def _curve(rows: DataFrame, by: Sequence[str], score: Column, positive: Column, weight: Column) -> DataFrame:
    """by, s, p, n: weights of positives and negatives at each distinct score."""
    return rows.groupBy(*by, score.alias("s")).agg(F.sum(F.when(positive, weight).otherwise(0)).cast("double").alias("p"), F.sum(F.when(positive, 0).otherwise(weight)).cast("double").alias("n"))


def roc_auc(rows: DataFrame, by: Sequence[str], name: str = "roc_auc", weight: Column | None = None, spread: bool = False) -> DataFrame:
    """Weighted probability that a positive outranks a negative, ties half; null without both classes.

    A group's distinct scores are summed up in one task, or with ``spread``, for groups of any size, over all tasks (functions.prefix)."""
    curve = _curve(rows, by, F.col("score"), F.col("y") == 1, F.lit(1) if weight is None else weight)
    if spread:
        curve = running(curve, [F.col("s")], tuple(by), None, through=("sum", "n")).withColumn("below", F.col("through") - F.col("n"))
    else:
        below = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        curve = curve.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0.0)))
    sums = curve.groupBy(*by).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("_concordant"), F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    return sums.select(*by, F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), F.col("_concordant") / (F.col("all_p") * F.col("all_n"))).alias(name))


def average_precision(rows: DataFrame, by: Sequence[str], name: str, positive: int = 1, weight: Column | None = None, spread: bool = False) -> DataFrame:
    """Sum over falling distinct scores of recall gained times precision. For class 0 the score is 1 - score. ``spread`` as for roc_auc()."""
    score = F.col("score") if positive == 1 else 1 - F.col("score")
    curve = _curve(rows, by, score, F.col("y") == positive, F.lit(1) if weight is None else weight)
    if spread:
        every = curve.groupBy(*by).agg(F.sum("p").alias("all_p"))  # a row a group
        curve = running(curve, [F.desc("s")], tuple(by), None, tp=("sum", "p"), fp=("sum", "n")).join(every, list(by))
    else:
        down = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
        curve = curve.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down)).withColumn("all_p", F.sum("p").over(Window.partitionBy(*by)))
    all_ = F.col("tp") + F.col("fp")
    gained = F.when((F.col("all_p") > 0) & (all_ > 0), F.col("p") / F.when(F.col("all_p") > 0, F.col("all_p")) * F.col("tp") / F.when(all_ > 0, all_))
    return curve.groupBy(*by).agg(F.sum(gained).alias(name))


def confusion(rows: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """by, tn, fp, fn, tp over the classes 0 and 1, whether they occur or not."""
    w = F.lit(1) if weight is None else weight
    cell = lambda y, p: F.sum(F.when((F.col("y") == y) & (F.col("pred") == p), w).otherwise(0))
    return rows.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b))


def classification(rows: DataFrame, by: Sequence[str], spread: bool = False) -> DataFrame:
    """All metrics of (y, score, pred) per group; undefined ones are null, F1 is 0 where nothing is right. ``spread``: groups may have any size."""
    c = confusion(rows, by)
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    sens, spec = _share(tp, tp + fn), _share(tn, tn + fp)
    f1 = lambda t, a, b: F.coalesce(_share(2 * t, 2 * t + a + b), F.lit(0.0))
    c = c.select(*by, "tn", "fp", "fn", "tp", sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced_accuracy"), f1(tp, fp, fn).alias("f1_cancer"), f1(tn, fn, fp).alias("f1_normal"))
    for part in (roc_auc(rows, by, spread=spread), average_precision(rows, by, "ap_cancer", spread=spread), average_precision(rows, by, "ap_normal", 0, spread=spread)):
        c = c.join(part, list(by))
    return c


def predicted_once(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Samples that a group predicts more than once: must be empty."""
    return rows.groupBy(*by, "sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: Resamples that a task gets; multiplicities that it looks at together.
CHUNK, BLOCK = 64, 1 << 20
STATISTICS = ("roc_auc", "ap_normal", "balanced_accuracy")


def packed_weights(weights: DataFrame, places: DataFrame) -> DataFrame:
    """Draws.packed() of weights (b, sample_id, w) of any kind, by the places (sample_id, y, i) of those samples that have one."""
    n = places.groupBy("y").agg(F.count(F.lit(1)).alias("n"))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        total = rows.column("n")[0].as_py()
        counts = np.zeros(total, dtype=np.int64)
        np.add.at(counts, rows.column("i").to_numpy(), rows.column("w").to_numpy())
        return pa.table({"b": pa.array([key[0].as_py()], pa.int64()), "y": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([total], pa.int64()), "counts": pa.array([splits.counted(counts)], pa.binary())})

    drawn = weights.join(places.hint("merge"), "sample_id").join(F.broadcast(n), "y")  # a row a class
    shown = drawn.select(F.col("b").cast("long").alias("b"), F.col("y").cast("int").alias("y"), F.col("n").cast("long").alias("n"), F.col("i").cast("long").alias("i"), F.col("w").cast("long").alias("w"))
    return shown.groupBy("b", "y").applyInArrow(pack, "b long, y int, n long, counts binary")


def bootstrap(rows: DataFrame, weights: DataFrame | splits.Draws, by: Sequence[str], names: Sequence[str] = STATISTICS) -> DataFrame:
    """by, b, ``names`` (of roc_auc, ap_normal, balanced_accuracy) of every resample, by multiplicities.

    A class of a resample is packed into one row, a byte a sample, and so is a group's predictions, and they meet CHUNK resamples at a time. A
    task holds these and the groups' packed predictions, and prepares one group after the other, so its memory grows with the
    samples of the cohort and not with the resamples. Undefined values are null; an empty table gives an empty result."""
    kinds, names, by = dict(rows.dtypes), list(names), list(by)
    of = lambda table, c, i: table.column(c)[i].values.to_numpy(zero_copy_only=False)

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("c", "ascending"), ("i", "ascending")])
        keys = {n: pa.array([k.as_py()], group.schema.field(n).type) for n, k in zip(by, key, strict=True)}
        return pa.table(keys | {c: pa.ListArray.from_arrays([0, len(group)], group.column(c).combine_chunks()) for c in ("c", "i", "y", "score", "pred")})

    def run(drawn: pa.Table, predicted: pa.Table) -> pa.Table:
        if not drawn.num_rows or not predicted.num_rows:
            return empty
        numbers, out = np.unique(drawn.column("b").to_numpy()), []
        counts = {}
        for b, c, n, data in zip(drawn.column("b").to_pylist(), drawn.column("y").to_pylist(), drawn.column("n").to_pylist(), drawn.column("counts"), strict=True):
            data = data.as_buffer()
            counts[b, c] = np.frombuffer(data, np.uint8 if data.size == n else np.int32)
        for at in range(predicted.num_rows):
            c, i = of(predicted, "c", at), of(predicted, "i", at)
            group = resampled.Prepared(*(of(predicted, name, at) for name in ("score", "y", "pred")))
            own = [(k, slice(*np.searchsorted(c, [k, k + 1]))) for k in np.unique(c).tolist()]  # classes in rising order
            many = max(1, BLOCK // max(1, len(i)))
            for start in range(0, len(numbers), many):
                some = numbers[start : start + many]
                m = np.zeros((len(some), len(i)))
                for row, b in zip(m, some.tolist(), strict=True):
                    for k, part in own:
                        if (b, k) in counts:
                            row[part] = counts[b, k].take(i[part])
                found = group.statistics(m, names)
                keys = [pa.repeat(predicted.column(n)[at], len(some)) for n in by]
                out.append(pa.Table.from_arrays([*keys, pa.array(some, pa.int64()), *(nullable(found[n]) for n in names)], schema=empty.schema))
        return pa.concat_tables(out)

    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    empty = pa.schema([*((n, types[kinds[n]]) for n in by), ("b", pa.int64()), *((v, pa.float64()) for v in names)]).empty_table()
    shown = ", ".join(f"`{n}` {kinds[n]}" for n in by)
    if isinstance(weights, splits.Draws):
        places, packed = splits.placed(weights.labels), weights.packed()
    else:
        places = splits.placed(rows.groupBy("sample_id").agg(F.min("y").alias("y")))
        packed = packed_weights(weights, places)
    drawn = kept(packed).withColumn("chunk", F.floor(F.col("b") / CHUNK))
    chunks = drawn.select(F.col("chunk").alias("part")).distinct()  # a row per CHUNK resamples
    places = places.select("sample_id", F.col("y").cast("tinyint").alias("c"), F.col("i").cast("int").alias("i")).hint("merge")  # what has no place is never drawn
    plain = rows.join(places, "sample_id").select(*by, "c", "i", F.col("y").cast("tinyint").alias("y"), F.col("score").cast("double").alias("score"), F.col("pred").cast("tinyint").alias("pred"))
    each = kept(plain.groupBy(*by).applyInArrow(pack, f"{shown}, c array<tinyint>, i array<int>, y array<tinyint>, score array<double>, pred array<tinyint>")).join(F.broadcast(chunks))
    return drawn.groupBy("chunk").cogroup(each.groupBy("part")).applyInArrow(run, f"{shown}, b bigint, " + ", ".join(f"{n} double" for n in names))


def percentile_interval(rows: DataFrame, by: Sequence[str], values: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """``<value>_lo``, ``<value>_hi``: exact percentiles of the finite values."""
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(F.col(v)) < float("inf")), F.col(v))
    shown = [F.percentile(finite(v), F.lit(q)).alias(f"{v}_{n}") for v in values for n, q in (("lo", alpha / 2), ("hi", 1 - alpha / 2))]
    return rows.groupBy(*by).agg(*shown)
