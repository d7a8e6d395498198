"""Text samples as a cohort: counted features of each document, and class effects from exact integer sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running
from .attribution import welch_t

WORD = r"([^\x20\x09-\x0D]+)"
UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
FEATURES = ("chars", "bytes", "words", "lines", "distinct_share", "digit_share", "upper_share")
#: Parts of a million stand for shares, so that sums of features are sums of integers.
SHARE = 1_000_000


def _of(characters: str, text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measured(text: str = "text") -> dict[str, Column]:
    """Integer features of a text by name; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(1))
    n, chars = F.size(words), F.length(t)
    share = lambda part, whole: F.when(whole > 0, F.floor(part.cast("long") * SHARE / whole)).otherwise(F.lit(0))
    lines = F.when(chars > 0, _of("\n", t) + 1).otherwise(F.lit(0))
    found = chars, F.octet_length(t), n, lines, share(F.size(F.array_distinct(words)), n), share(_of(DIGITS, t), chars), share(_of(UPPER, t), chars)
    return {name: c.cast("long") for name, c in zip(FEATURES, found, strict=True)}


def agreed_labels(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """key, y of every key whose labels, 0 or 1, all agree; a label is never guessed."""
    both = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("_most"), F.count_if(F.col(label).isNull()).alias("_none"))
    return both.where((F.col("y") == F.col("_most")) & (F.col("_none") == 0) & F.col("y").isin(0, 1)).select(key, F.col("y").cast("int").alias("y"))


def effects(samples: DataFrame, labels: DataFrame, features: tuple[str, ...] = FEATURES, cohort: str = "source", key: str = "doc_id", digest: str = "digest") -> DataFrame:
    """cohort, feature, n1, n0, mean1, mean0, t (Welch), g (Hedges), auc, direction, n_cohorts, n_agree: class effects in each cohort.

    Samples of one cohort and class with the same digest are copies and count once. ``n_agree`` counts the cohorts, this one included,
    whose effect has the same sign. Sums are of integers, and areas come from running counts over the values of a feature, so results
    are exact, a cohort of any size spreads over all tasks and no sample is ranked in a window. Samples without a label are left out;
    t is null under two samples a class, g and auc without both classes."""
    known = samples.join(labels, key).groupBy(cohort, digest, "y").agg(*[F.min(f).alias(f) for f in features])
    tall = known.select(cohort, "y", F.explode(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*map(F.col, features)))).alias("feature", "v"))
    seen = tall.groupBy(cohort, "feature", "v").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    wide = lambda c: c.cast("decimal(38,0)")
    below = running(seen, [F.col("v")], by=(cohort, "feature"), position=None, through0=("sum", "n0"))
    sums = [F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum(wide(F.col("n1")) * wide(2 * F.col("through0") - F.col("n0"))).alias("_u2")]
    for y in ("1", "0"):
        sums += [F.sum(wide(F.col(f"n{y}")) * F.col("v")).alias(f"_s{y}"), F.sum(wide(F.col(f"n{y}")) * F.col("v") * F.col("v")).alias(f"_q{y}")]
    m = below.groupBy(cohort, "feature").agg(*sums)
    for y in ("1", "0"):
        n, s, q = F.col(f"n{y}"), F.col(f"_s{y}"), F.col(f"_q{y}")
        m = m.withColumn(f"mean{y}", F.when(n > 0, s.cast("double") / n)).withColumn(f"var{y}", F.when(n > 1, (wide(n) * q - s * s).cast("double") / (n.cast("double") * (n - 1))))
    n1, n0 = F.col("n1"), F.col("n0")
    pooled = F.sqrt(((n1 - 1) * F.col("var1") + (n0 - 1) * F.col("var0")) / (n1 + n0 - 2))
    g = F.when((n1 > 1) & (n0 > 1), F.when(pooled > 0, (F.col("mean1") - F.col("mean0")) / F.when(pooled > 0, pooled)).otherwise(F.lit(0.0)) * (1 - F.lit(3.0) / (4 * (n1 + n0) - 9)))
    auc = F.when((n1 > 0) & (n0 > 0), F.col("_u2").cast("double") / (2.0 * n1 * n0))
    shown = m.select(cohort, "feature", "n1", "n0", "mean1", "mean0", welch_t().alias("t"), g.alias("g"), auc.alias("auc"), F.signum(F.col("mean1") - F.col("mean0")).cast("long").alias("direction"))
    both = shown.where("direction is not null").groupBy("feature", "direction").agg(F.count(F.lit(1)).alias("n_agree"))
    cohorts = shown.where("direction is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("n_cohorts"))
    return shown.join(F.broadcast(cohorts), "feature", "left").join(F.broadcast(both), ["feature", "direction"], "left").select(*shown.columns, "n_cohorts", "n_agree")  # a few rows a feature
