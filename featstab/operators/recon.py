"""A first look at a cohort's matrix: scale with exact quantiles, floor, copies, and the samples that correlate most.

Values are tall rows (sample_id, probe_id, x). Nothing here gathers a matrix: quantiles come from running counts of values, samples are
compared block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kept import kept
from ..functions.prefix import running

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def exact_quantiles(rows: DataFrame, column: str, shares: tuple[float, ...] = QUANTILES) -> DataFrame:
    """share, value: linear interpolation between the ordered values, exact at any size; null for a table without values.

    Equal values are counted before they are ordered; a value covers a range of positions, found by a running count. Nulls and NaN
    don't count."""
    counted = rows.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    through = running(counted, [F.col("x")], position=None, through=("sum", "n"))
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    wanted = [(q, int(q * (n - 1)) if n else 0, q * (n - 1) - int(q * (n - 1)) if n else 0.0) for q in shares]
    found = through.select("x", (F.col("through") - F.col("n")).alias("first"), "through")
    hits = [F.when((F.col("first") <= at) & (at < F.col("through")), F.col("x")) for _, low, _ in wanted for at in (low, low + 1)]
    values = found.agg(*[F.max(h).alias(f"v{i}") for i, h in enumerate(hits)])
    each = [F.struct(F.lit(q).alias("share"), (F.col(f"v{2 * i}") + F.lit(part) * (F.coalesce(F.col(f"v{2 * i + 1}"), F.col(f"v{2 * i}")) - F.col(f"v{2 * i}"))).alias("value")) for i, (q, _, part) in enumerate(wanted)]
    return values.select(F.inline(F.array(*each)))


def scale(values: DataFrame, below: float) -> DataFrame:
    """measure, value: counts, least, largest, mean, shares of values at the least and under ``below``, negative and missing values, the
    range of the samples' medians, and the exact quantiles of all values. Undefined measures of an empty matrix are null."""
    x = F.when(~F.isnan("x"), F.col("x"))
    rows = values.withColumn("x", x)
    count = lambda c: F.count_if(c).cast("double")
    low = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("x is not null")
    n = F.sum("n")
    cells = low.agg(F.min("x").alias("least"), F.max("x").alias("largest"), (F.sum(F.col("x") * F.col("n")) / n).alias("mean"), (F.min_by("n", "x") / n).alias("share_at_least"), (F.sum(F.when(F.col("x") < below, F.col("n")).otherwise(0)) / n).alias("share_below"), F.sum(F.when(F.col("x") < 0, F.col("n")).otherwise(0)).cast("double").alias("n_negative"))
    sizes = rows.agg(F.countDistinct("sample_id").cast("double").alias("n_samples"), F.countDistinct("probe_id").cast("double").alias("n_probes"), count(F.lit(True)).alias("n_cells"), count(F.col("x").isNull()).alias("n_missing"))
    medians = rows.groupBy("sample_id").agg(F.median("x").alias("m")).agg(F.min("m").alias("least_sample_median"), F.max("m").alias("largest_sample_median"))
    melted = [d.unpivot([], d.columns, "measure", "value") for d in (sizes, cells, medians)]
    quantiles = exact_quantiles(rows, "x").select(F.concat(F.lit("quantile_"), F.lpad(F.round(F.col("share") * 100).cast("int").cast("string"), 2, "0")).alias("measure"), "value")
    return melted[0].unionByName(melted[1]).unionByName(melted[2]).unionByName(quantiles)


def floor_profile(values: DataFrame) -> DataFrame:
    """measure, value: probes that lie on the matrix's least value in all, 90 % and half of the samples, and probes without variance."""
    least = values.agg(F.min("x")).first()[0]
    on = (F.col("x") == F.lit(least)) if least is not None else F.lit(False)
    share = F.count_if(on) / F.count("x")
    probes = values.where("x is not null").groupBy("probe_id").agg(share.alias("s"), (F.min("x") == F.max("x")).alias("same"))
    count = lambda c: F.count_if(c).cast("double")
    found = probes.agg(count(F.col("s") == 1).alias("floor_all"), count(F.col("s") >= 0.9).alias("floor_90"), count(F.col("s") >= 0.5).alias("floor_50"), count(F.col("same")).alias("zero_variance"))
    return found.unpivot([], found.columns, "measure", "value")


def copies(values: DataFrame, digits: int | None = None) -> DataFrame:
    """digest, sample_id, n of samples that have the same values for the same probes as another; rounded to ``digits`` if given."""
    x = F.round("x", digits) + F.lit(0.0) if digits is not None else F.col("x") + F.lit(0.0)
    one = values.groupBy("sample_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("probe_id", x.alias("x")))), lambda c: F.concat_ws("=", c["probe_id"], c["x"].cast("string"))), ",").cast("binary"), 256).alias("digest"))
    many = one.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return one.join(many, "digest").select("digest", "sample_id", "n")


#: Blocks of samples that nearest_samples() makes, if they have LEAST samples then; tasks that a block's products are dealt to; rows of a tile.
BLOCKS, LEAST, SHARES, TILE = 24, 256, 4, 1024


def best_of_pair(x: np.ndarray, y: np.ndarray, same: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(own rows, nearest row of the other, r) of the rows of ``x`` and, unless both are the ``same``, of ``y``; ties to the first row. Rows
    with NaN have none and are nobody's nearest. Products are made and looked at in tiles."""
    least = -np.inf
    best = [(np.full(len(m), least), np.zeros(len(m), dtype=np.int64)) for m in (x, y)]
    void = [np.isnan(m[:, :1]).any(1) for m in (x, y)]
    for i in range(0, len(x), TILE):
        for j in range(0, len(y), TILE):
            tile = np.round(x[i : i + TILE] @ y[j : j + TILE].T, 12)
            tile[void[0][i : i + TILE]] = least
            tile[:, void[1][j : j + TILE]] = least
            if same and i == j:
                np.fill_diagonal(tile, least)
            for (r, at), axis, own, other in ((best[0], 1, i, j), (best[1], 0, j, i))[: 1 if same else 2]:
                k = tile.argmax(axis)
                most = np.take_along_axis(tile, np.expand_dims(k, axis), axis).ravel()
                part = slice(own, own + len(most))
                better = most > r[part]
                r[part][better], at[part][better] = most[better], k[better] + other
    return [(np.flatnonzero(~np.isinf(r)), at[~np.isinf(r)], r[~np.isinf(r)]) for r, at in best[: 1 if same else 2]]


def nearest_samples(values: DataFrame, samples: int = 16384, probes: int = 256) -> DataFrame:
    """sample_id, nearest, r: the other sample with the largest Pearson correlation, ties to the smaller id; samples without variance or
    without another have null.

    Values are standardised by sample. A block holds at most ``samples`` samples and ``samples`` times ``probes`` values, whatever the number of
    probes. Two blocks meet in one task, which returns only each sample's best of them: products are neither stored nor shuffled. A block is
    copied for each later one, so that what is shuffled is the values times half the number of blocks.
    Every sample must have every probe once: another count of cells fails the job, as a part of a matrix would pass for a whole one."""
    w = Window.partitionBy("sample_id")
    numbers = running(values.select("sample_id").distinct(), [F.col("sample_id")], position="number")
    n_samples, n_probes, cells = values.agg(F.countDistinct("sample_id"), F.countDistinct("probe_id"), F.count("x")).first()
    if cells != n_samples * n_probes or cells != values.count():
        raise ValueError(f"{cells} values are not {n_probes} probes of each of {n_samples} samples")
    size = max(1, min(samples, samples * probes // max(n_probes, 1), max(LEAST, -(-n_samples // BLOCKS))))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(w))
    centred = values.select("sample_id", "probe_id", (F.col("x") - F.avg("x").over(w)).alias("c"))
    z = centred.select("sample_id", "probe_id", F.when(norm > 1e-12, F.col("c") / F.when(norm > 1e-12, norm)).alias("z"))
    cells = F.sort_array(F.collect_list(F.struct("probe_id", F.coalesce("z", F.lit(float("nan"))).alias("z"))))
    rows = z.groupBy("sample_id").agg(cells.alias("cells")).join(numbers.hint("merge"), "sample_id")
    dealt = rows.select(F.floor((F.col("number") - 1) / size).alias("a"), ((F.col("number") - 1) % size).cast("int").alias("i"), F.col("cells.z").alias("z"))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        z = rows.sort_by("i").column("z").combine_chunks().flatten()
        return pa.table({"a": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(rows)], pa.int32()), "z": pa.array([z.to_numpy().tobytes()], pa.binary())})

    def best(key: tuple, pair: pa.Table) -> pa.Table:
        a, b = key[0].as_py(), key[1].as_py()
        x, y = (np.frombuffer(pair.column(c)[0].as_buffer()).reshape(pair.column(n)[0].as_py(), -1) for c, n in (("z", "n"), ("z2", "m")))
        out = [(own * size + at + 1, other * size + near + 1, r) for (own, other), (at, near, r) in zip(((a, b), (b, a)), best_of_pair(x, y, a == b), strict=False)]
        number, near, r = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"number": pa.array(number, pa.int64()), "near": pa.array(near, pa.int64()), "r": pa.array(r, pa.float64())})

    blocks = kept(dealt.groupBy("a").applyInArrow(pack, "a long, n int, z binary"))
    last = (max(n_samples, 1) - 1) // size
    left = blocks.select("a", "n", "z", F.explode(F.sequence(F.col("a"), F.lit(last).cast("long"))).alias("b"), F.pmod("a", F.lit(SHARES)).cast("int").alias("share"))
    right = blocks.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("z").alias("z2"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    pairs = left.join(right.hint("merge"), ["b", "share"])
    found = pairs.groupBy("a", "b", "share").applyInArrow(best, "number long, near long, r double").groupBy("number").agg(F.max(F.struct("r", (-F.col("near")).alias("near"))).alias("best"))  # a pair a group
    ids = numbers.select(F.col("number").alias("near"), F.col("sample_id").alias("nearest"))
    return numbers.join(found.select("number", (-F.col("best.near")).alias("near"), "best.r"), "number", "left").join(ids, "near", "left").select("sample_id", "nearest", "r")
