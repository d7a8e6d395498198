"""Over-representation of gene sets: hypergeometric tail, Haldane odds ratio, Benjamini-Hochberg."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running


def benjamini_hochberg(rows: DataFrame, p: str = "p_value", name: str = "adj_p") -> DataFrame:
    """Adds the adjusted p-value: the running minimum of p n / i from the largest p down, at most 1.

    Places and minima are made partition by partition (functions.prefix), so there may be any number of terms."""
    placed = running(rows, [F.col(p), F.col("term")], position="_i")
    n = placed.agg(F.max("_i")).first()[0]
    least = running(placed.withColumn("_q", F.col(p) * F.lit(n) / F.col("_i")), [F.desc("_i")], position=None, _least=("min", "_q"))
    return least.withColumn(name, F.least(F.lit(1.0), F.col("_least"))).drop("_q", "_i", "_least")


def _log_choose(table: Column, n: Column, k: Column) -> Column:
    at = lambda x: F.element_at(table, x.cast("int") + 1)
    return at(n) - at(k) - at(n - k)


def enrich(foreground: DataFrame, background: DataFrame, library: DataFrame, least: int = 5, most: int = 500) -> DataFrame:
    """term, overlap, foreground_size, term_size, background_size, odds_ratio, p_value, overlap_genes, adj_p of the terms whose genes in the background number least to most.

    The background is what of it the library knows; logarithms of factorials up to its size come from one running sum."""
    known = background.select("gene").distinct().join(library.select("gene").distinct(), "gene", "left_semi")
    fg = foreground.select("gene").distinct().join(known, "gene", "left_semi")
    sizes = known.agg(F.count(F.lit(1)).alias("background_size")).join(F.broadcast(fg.agg(F.count(F.lit(1)).alias("foreground_size"))))  # one row each
    rows = library.join(known, "gene", "left_semi").join(fg.withColumn("_in", F.lit(1)), "gene", "left")
    hit = F.col("_in").isNotNull()
    terms = rows.groupBy("term").agg(F.count(F.lit(1)).alias("term_size"), F.count_if(hit).alias("overlap"), F.concat_ws(";", F.array_sort(F.collect_list(F.when(hit, F.col("gene"))))).alias("overlap_genes"))
    terms = terms.where(F.col("term_size").between(least, most)).join(F.broadcast(sizes))
    # ln(i!) at place i + 1 of one array, from a running sum
    logs = sizes.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("background_size"))).alias("i"))
    logs = logs.withColumn("t", F.sum(F.when(F.col("i") > 0, F.ln(F.greatest("i", F.lit(1)).cast("double"))).otherwise(F.lit(0.0))).over(Window.orderBy("i")))
    table_row = logs.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("_t"))
    terms = terms.join(F.broadcast(table_row))
    N, n, K, k, t = (F.col(c) for c in ("background_size", "foreground_size", "term_size", "overlap", "_t"))
    tail = F.aggregate(F.sequence(k, F.least(K, n)), F.lit(0.0), lambda s, i: s + F.when(n - i <= N - K, F.exp(_log_choose(t, K, i) + _log_choose(t, N - K, n - i) - _log_choose(t, N, n))).otherwise(F.lit(0.0)))
    p = F.when(n == 0, F.lit(1.0)).when(k == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))
    half = F.lit(0.5)
    odds = ((k + half) * (N - K - n + k + half)) / ((K - k + half) * (n - k + half))
    return benjamini_hochberg(terms.select("term", "overlap", "foreground_size", "term_size", "background_size", odds.alias("odds_ratio"), F.round(p, 12).alias("p_value"), "overlap_genes"))
