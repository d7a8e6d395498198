"""Consensus over pipelines: selection frequencies, frozen lists, the frozen gene table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running


def frequencies(rankings: DataFrame, k: int) -> DataFrame:
    """pipeline, gene, freq: the share of all folds in which a pipeline's top-k holds the gene."""
    folds = rankings.select("repeat", "fold").distinct().agg(F.count(F.lit(1)).alias("_n"))
    top = rankings.where((F.col("rank") <= k) & (F.col("importance") > 0))
    return top.groupBy("pipeline", "gene").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(folds)).select("pipeline", "gene", (F.col("c") / F.col("_n")).alias("freq"))  # folds: one row


def gene_table(rankings: DataFrame, pipelines: DataFrame, k: int) -> DataFrame:
    """A row per gene that any pipeline selects, of whatever role; frequencies count primary pipelines, 0 where never selected."""
    primary = pipelines.where("role = 'primary'")
    n = primary.agg(F.count(F.lit(1)).alias("_p"))
    freq = frequencies(rankings, k).join(pipelines.select("pipeline", "model", "explainer", "role"), "pipeline")
    is_primary = F.col("role") == "primary"
    half = is_primary & (F.col("freq") >= 0.5)
    counts = freq.groupBy("gene").agg(
        F.coalesce(F.sum(F.when(is_primary, F.col("freq"))), F.lit(0.0)).alias("_total"), F.count_if(half).alias("n_pipelines_ge50"), F.countDistinct(F.when(half, F.col("model"))).alias("n_models_ge50"),
        F.countDistinct(F.when(half, F.col("explainer"))).alias("n_explainers_ge50"), F.coalesce(F.max(F.when(F.col("pipeline") == "ttest|ttest", F.col("freq"))), F.lit(0.0)).alias("ttest_frequency"),
    )
    top = rankings.where((F.col("rank") <= k) & (F.col("importance") > 0)).join(pipelines.select("pipeline", "role"), "pipeline")
    rank = F.when(is_primary, F.col("rank"))
    signs = F.when(F.col("explainer").isin("coef", "shap", "ttest"), (F.col("signed") > 0).cast("double"))
    ranks = top.groupBy("gene").agg(F.median(rank).alias("median_rank"), F.min(rank).alias("best_rank"), F.avg(rank).alias("mean_rank"), F.avg(signs).alias("frac_signed_positive"))
    rows = counts.join(F.broadcast(n)).join(ranks, "gene", "left")  # n: one row
    rows = rows.withColumn("mean_selection_frequency", F.col("_total") / F.col("_p")).withColumn("consensus", F.col("n_pipelines_ge50") >= F.ceil(F.col("_p") / 2))
    order = [F.round("mean_selection_frequency", 9).desc(), F.round("mean_rank", 9).asc_nulls_last(), F.col("gene")]
    return running(rows.drop("_total", "_p"), order)


def frozen_lists(rankings: DataFrame, pipelines: DataFrame, small: int = 25, large: int = 50) -> DataFrame:
    """list, position, gene: the consensus genes, and the heads of the tables at two sizes."""
    a, b = gene_table(rankings, pipelines, small), gene_table(rankings, pipelines, large)
    name = lambda rows, n: rows.select(F.lit(n).alias("list"), "position", "gene")
    return name(a.where("consensus"), "S_cons").union(name(a.where(F.col("position") <= small), f"S_top{small}")).union(name(b.where(F.col("position") <= large), f"S_top{large}"))


def universe_frequency(table: DataFrame, universe: DataFrame) -> DataFrame:
    """gene, s of every gene of the universe: 0 where never selected."""
    return universe.select("gene").distinct().join(table.select("gene", "mean_selection_frequency"), "gene", "left").select("gene", F.round(F.coalesce("mean_selection_frequency", F.lit(0.0)), 9).alias("s"))


def frozen_table(effects: DataFrame, table: DataFrame, lists: DataFrame, universe: DataFrame) -> DataFrame:
    """Discovery effects of every gene with its consensus columns and a flag for each list."""
    flags = lists.groupBy("gene").pivot("list", ["S_cons", "S_top25", "S_top50"]).agg(F.count(F.lit(1)))
    rows = effects.join(universe_frequency(table, universe), "gene", "left").join(table.select("gene", "mean_selection_frequency", "n_pipelines_ge50", "mean_rank", "consensus"), "gene", "left").join(flags, "gene", "left")
    return rows.select(*effects.columns, F.coalesce("s", F.lit(0.0)).alias("s"), "n_pipelines_ge50", "mean_rank", "consensus", *((F.coalesce(F.col(x), F.lit(0)) > 0).alias(f"in_{x}") for x in ("S_cons", "S_top25", "S_top50")))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """gene, freq_a, freq_b of two runs: full outer, 0 where a run hasn't the gene."""
    x, y = a.select("gene", F.round("mean_selection_frequency", 9).alias("freq_a")), b.select("gene", F.round("mean_selection_frequency", 9).alias("freq_b"))
    return x.join(y, "gene", "full_outer").na.fill(0.0)
