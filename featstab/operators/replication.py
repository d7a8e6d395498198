"""Scale-free replication in a second cohort: effects, rank association, signatures, composition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kept import kept
from ..functions.scalars import average_rank, percent_rank, scaled_rank
from . import metrics, splits
from .attribution import class_auc

#: Groups that count as tumours, and as their controls.
TUMOURS, HEALTHY = ("TNBC", "Her2", "Luminal A", "Luminal B"), "Healthy"


def unit_errors(arrays: DataFrame) -> DataFrame:
    """Tumour arrays without a tumour number in the title: must be empty."""
    return arrays.where(F.col("sample_group").isin(*TUMOURS) & (F.regexp_extract("title", r"TUM\d+", 0) == "")).select("sample_id").distinct()


def units(arrays: DataFrame, variant: str = "mean") -> DataFrame:
    """unit_id, subtype, y, probe_id, gene, n_arrays, x: arrays of one tumour averaged; ``repA`` leaves out second arrays; others than
    tumours and healthy samples go."""
    if variant not in ("mean", "repA"):
        raise ValueError(variant)
    tumour = F.col("sample_group").isin(*TUMOURS)
    rows = arrays.where(tumour | (F.col("sample_group") == HEALTHY))
    if variant == "repA":
        rows = rows.where(~F.col("title").rlike("_repB$"))
    rows = rows.withColumn("unit_id", F.when(tumour, F.regexp_extract("title", r"TUM\d+", 0)).otherwise(F.col("sample_id").cast("string")))
    return rows.groupBy("unit_id", "probe_id", "gene").agg(F.min("sample_group").alias("subtype"), F.max(tumour.cast("int")).alias("y"), F.countDistinct("sample_id").alias("n_arrays"), F.avg("x").alias("x"))


def hedges_g(rows: DataFrame, by: Sequence[str] = ("gene",)) -> DataFrame:
    """by, g: standardised mean difference of the classes with the small-sample factor; 0 without variance."""
    one, zero = F.when(F.col("y") == 1, F.col("x")), F.when(F.col("y") == 0, F.col("x"))
    m = rows.groupBy(*by).agg(F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(zero).alias("v0"), F.count(one).alias("n1"), F.count(zero).alias("n0"))
    n = F.col("n1") + F.col("n0")
    sp = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (n - 2))
    return m.select(*by, (F.when(sp > 0, (F.col("m1") - F.col("m0")) / F.when(sp > 0, sp)).otherwise(F.lit(0.0)) * (1 - F.lit(3.0) / (4 * n - 9))).alias("g"))


def within_cohort_z(rows: DataFrame) -> DataFrame:
    """Adds z by gene, with the cohort's own mean and deviation, without labels."""
    w = Window.partitionBy("gene")
    sd = F.stddev_pop("x").over(w)
    return rows.withColumn("z", (F.col("x") - F.avg("x").over(w)) / F.when(sd > 0, sd).otherwise(F.lit(1.0)))


def effects(rows: DataFrame) -> DataFrame:
    """gene, probe_id, e, g, direction: AUC - 0.5 and Hedges' g of every gene of a collapsed cohort."""
    auc = class_auc(rows, "x", ("gene",))
    probes = rows.groupBy("gene").agg(F.min("probe_id").alias("probe_id"))
    e = F.round(F.col("auc") - 0.5, 9)
    return auc.join(hedges_g(rows), "gene").join(probes, "gene").select("gene", "probe_id", e.alias("e"), "g", F.signum(e).cast("double").alias("direction"))


def spearman(rows: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """by, rho, n: correlation of average ranks; null without variance."""
    r = rows.select(*by, average_rank(a, by).alias("_a"), average_rank(b, by).alias("_b"))
    return r.groupBy(*by).agg(correlation("_a", "_b").alias("rho"), F.count(F.lit(1)).alias("n"))


def correlation(a: str, b: str) -> Column:
    """Aggregate: Pearson's r, null without variance."""
    va, vb = F.var_pop(a), F.var_pop(b)
    ok = (va > 0) & (vb > 0)
    return F.when(ok, F.covar_pop(a, b) / F.sqrt(F.when(ok, va * vb)))


def largest_correlations(values: DataFrame, block: int = 512, chunk: int = 8192) -> DataFrame:
    """p, max_r: the largest Pearson correlation of each numbered feature with a later one; null without variance or a later feature.

    Standardised values are packed into blocks of ``block`` features and about ``chunk`` samples; a task multiplies two blocks of the
    same samples, and the products of a pair of feature blocks are added up, so pairs are never rows and a task's memory grows neither with
    the samples nor with the features. Every feature must have every sample."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        data = rows.to_pandas().pivot(index="p", columns="sample_id", values="x").sort_index(axis=0).sort_index(axis=1)
        return pa.table({"b": pa.array([key[0].as_py()], pa.int64()), "s": pa.array([key[1].as_py()], pa.int64()), "ids": pa.array([data.index.to_numpy(dtype=np.int64).tobytes()], pa.binary()), "x": pa.array([data.to_numpy(dtype=float).tobytes()], pa.binary())})

    def multiply(batches):
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("b", "c", "ids", "x", "ids2", "x2")), strict=True):
                left, right, own_ids, own, other_ids, other = (c.as_py() for c in row)
                r = np.frombuffer(own).reshape(len(own_ids) // 8, -1) @ np.frombuffer(other).reshape(len(other_ids) // 8, -1).T
                yield pa.RecordBatch.from_pydict({"b": pa.array([left], pa.int64()), "c": pa.array([right], pa.int64()), "ids": pa.array([own_ids], pa.binary()), "ids2": pa.array([other_ids], pa.binary()), "r": pa.array([r.tobytes()], pa.binary())})

    def largest(rows: pa.Table) -> pa.Table:
        p, q = (np.frombuffer(rows.column(c)[0].as_py(), np.int64) for c in ("ids", "ids2"))
        if any(len(set(rows.column(c).to_pylist())) > 1 for c in ("ids", "ids2")):
            raise ValueError("a feature lacks samples")
        r = np.zeros((len(p), len(q)))
        for part in rows.column("r"):
            r += np.frombuffer(part.as_buffer()).reshape(r.shape)
        r = np.where((p[:, None] < q[None, :]) & ~np.isnan(r), r, -np.inf).max(1)
        return pa.table({"p": p, "r": pa.array(r, pa.float64(), mask=np.isinf(r))})

    moments = values.groupBy("p").agg(F.avg("x").alias("_m"), F.when(F.min("x") < F.max("x"), F.sqrt(F.var_pop("x") * F.count("x"))).alias("_size"))  # a row a feature
    n, samples = values.agg(F.max(F.floor(F.col("p") / block)), F.count_distinct("sample_id")).first()
    deal = F.pmod(F.xxhash64("sample_id"), F.lit(max(1, -(-samples // chunk))))
    scaled = values.join(F.broadcast(moments), "p").select("sample_id", F.col("p").cast("long").alias("p"), ((F.col("x") - F.col("_m")) / F.col("_size")).alias("x"), F.floor(F.col("p") / block).alias("b"), deal.alias("s"))
    blocks = kept(scaled.groupBy("b", "s").applyInArrow(pack, "b bigint, s bigint, ids binary, x binary"))
    left = blocks.withColumn("c", F.explode(F.sequence(F.col("b"), F.lit(n).cast("long"))))  # with itself and each later block
    right = blocks.select(F.col("b").alias("c"), "s", F.col("ids").alias("ids2"), F.col("x").alias("x2"))
    products = left.join(right.hint("merge"), ["c", "s"]).select("b", "c", "ids", "x", "ids2", "x2").mapInArrow(multiply, "b bigint, c bigint, ids binary, ids2 binary, r binary")
    return products.groupBy("b", "c").applyInArrow(largest, "p bigint, r double").groupBy("p").agg(F.max("r").alias("max_r"))


def c1_c2(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """From (s, e_disc, auc_ext): Spearman of stability s with the aligned effect r, the same where s > 0 (over three genes), the
    coefficients of rank(r) on rank(s) and rank(|e|) in closed form, and the partial correlation."""
    rows = rows.withColumn("_r", F.round(F.signum("e_disc") * (F.col("auc_ext") - 0.5), 9)).withColumn("_e", F.abs("e_disc"))
    ranks = rows.select(*by, "s", scaled_rank("s", by).alias("rank_s"), scaled_rank("_r", by).alias("rank_r"), scaled_rank("_e", by).alias("rank_e"))
    m = ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_genes"), F.count_if(F.col("s") > 0).alias("n_selected"), F.var_pop("rank_s").alias("ss"), F.var_pop("rank_e").alias("aa"), F.covar_pop("rank_s", "rank_e").alias("sa"), F.covar_pop("rank_s", "rank_r").alias("sr"), F.covar_pop("rank_e", "rank_r").alias("ar"),
        correlation("rank_s", "rank_r").alias("c1"), correlation("rank_s", "rank_e").alias("rsa"), correlation("rank_e", "rank_r").alias("rra"),
    )
    det = F.col("ss") * F.col("aa") - F.col("sa") * F.col("sa")
    fit = lambda x: F.when(det > 1e-12, x / F.when(det > 1e-12, det))
    left = (1 - F.col("rsa") * F.col("rsa")) * (1 - F.col("rra") * F.col("rra"))
    partial = F.when(left > 1e-12, (F.col("c1") - F.col("rsa") * F.col("rra")) / F.sqrt(F.when(left > 1e-12, left)))
    pos = spearman(rows.where("s > 0"), "s", "_r", by).where("n > 3").select(*by, F.col("rho").alias("c1_selected"))
    shown = m.select(*by, "n_genes", "n_selected", "c1", fit(F.col("sr") * F.col("aa") - F.col("ar") * F.col("sa")).alias("c2_stability"), fit(F.col("ar") * F.col("ss") - F.col("sr") * F.col("sa")).alias("c2_effect"), partial.alias("c2_partial"))
    return shown.join(pos, list(by), "left") if by else shown.join(pos, F.lit(True), "left")  # one row each


def weighted_auc(rows: DataFrame, weights: DataFrame | splits.Draws) -> DataFrame:
    """b, gene, auc: class AUC of every gene in every resample, from multiplicities; null without both classes."""
    scored = rows.select("gene", "sample_id", "y", F.col("x").alias("score"), F.lit(0).alias("pred"))
    return metrics.bootstrap(scored, weights, ["gene"], ["roc_auc"]).select("b", "gene", F.col("roc_auc").alias("auc")).where("auc is not null")


def direction(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, n, n_consistent, fraction of (e_disc, e_ext) with equal signs."""
    agree = F.count_if(F.signum("e_disc") == F.signum("e_ext"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), agree.alias("n_consistent"), (agree / F.count(F.lit(1))).alias("fraction"))


def binomial_interval(agree: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact (Clopper-Pearson) interval of a proportion, by bisection on the binomial tails."""
    import math

    def tail(p: float, first: int, last: int) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(first, last + 1)]
        return math.fsum(map(math.exp, logs))

    def root(rises) -> float:
        low, high = 0.0, 1.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if rises(mid) else (low, mid)
        return (low + high) / 2

    half = (1 - level) / 2
    low = 0.0 if agree == 0 else root(lambda p: tail(p, agree, n) < half)
    high = 1.0 if agree == n else root(lambda p: tail(p, 0, agree) > half)
    return low, high


def exact_interval(rows: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds fraction_lo and fraction_hi to rows with n and n_consistent: the exact interval of the fraction; null without genes."""

    def run(batches):
        for batch in batches:
            ends = [binomial_interval(a, n, level) if n else (None, None) for a, n in zip(batch.column("n_consistent").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield batch.append_column("fraction_lo", pa.array([e[0] for e in ends], pa.float64())).append_column("fraction_hi", pa.array([e[1] for e in ends], pa.float64()))

    shown = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{shown}, fraction_lo double, fraction_hi double")


def signature(z: DataFrame, genes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, sample_id, y, score: mean z of the genes with positive e_disc minus that of the negative ones; an empty side is 0."""
    rows = z.join(genes.select(*by, "gene", "e_disc"), "gene")
    up, down = F.avg(F.when(F.col("e_disc") > 0, F.col("z"))), F.avg(F.when(F.col("e_disc") < 0, F.col("z")))
    return rows.groupBy(*by, "sample_id", "y").agg(F.round(F.coalesce(up, F.lit(0.0)) - F.coalesce(down, F.lit(0.0)), 9).alias("score"))


def panel_score(z: DataFrame, panel: Sequence[str]) -> DataFrame:
    """sample_id, y, panel: mean z of the panel's genes that are there; none at all fails the job."""
    there = F.col("gene").isin(*panel)
    rows = z.groupBy("sample_id", "y").agg(F.count_if(there).alias("_n"), F.round(F.avg(F.when(there, F.col("z"))), 9).alias("panel"))
    none = F.raise_error(F.lit("no gene of the panel is in the cohort")).cast("double")
    return rows.select("sample_id", "y", F.when(F.col("_n") == 0, none).otherwise(F.col("panel")).alias("panel"))


def residual_scores(rows: DataFrame, score: str, covariate: str) -> DataFrame:
    """sample_id, y, score: what a linear fit on the covariate leaves."""
    fit = rows.agg(F.regr_slope(score, covariate).alias("_b"), F.regr_intercept(score, covariate).alias("_a"))
    return rows.join(F.broadcast(fit)).select("sample_id", "y", F.round(F.col(score) - F.col("_a") - F.col("_b") * F.col(covariate), 9).alias("score"))  # fit: one row


def panel_membership(lists: DataFrame, s: DataFrame, panel: DataFrame) -> DataFrame:
    """gene, panel, in_universe, s, percentile and a flag per list for every panel gene; null where the universe hasn't it."""
    ranks = s.select("gene", "s", percent_rank("s").alias("percentile"))
    flags = lists.groupBy("gene").pivot("list", ["S_cons", "S_top25", "S_top50"]).agg(F.count(F.lit(1)))
    rows = panel.join(ranks, "gene", "left").join(flags, "gene", "left")
    return rows.select("gene", "panel", F.col("s").isNotNull().alias("in_universe"), "s", "percentile", *((F.coalesce(F.col(x), F.lit(0)) > 0).alias(f"in_{x}") for x in ("S_cons", "S_top25", "S_top50")))
