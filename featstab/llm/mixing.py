"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule, the piecewise-linear course of its weight over the training. The schedules' integrals give
the sources' shares, water-filled so that none is repeated more often than allowed. Within a source, documents follow each other in
a keyed random order and take up an interval of its words, once per repetition; inverting the source's cumulative demand at the
interval's middle gives the training position, and documents are range-sorted by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

#: Bits of the random number that orders a source's documents: wide enough that only rows equal in key and text share one.
BITS = 60
WORD = r"[^\x20\x09-\x0D]+"
FLAT, RISING, FALLING = ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5))


@dataclass(frozen=True)
class Curriculum:
    """``weights`` of the sources in code point order (null last), repeating; ``schedules``: for each weight the knots (time, factor)
    from time 0 to 1, factors of mean 1 leave the weight as it is; ``share`` of all words to take; ``limit`` of repetition."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    schedules: tuple[tuple[tuple[float, float], ...], ...] = (FLAT, RISING, FALLING)
    share: float = 1.5
    limit: float = 2.0

    def integral(self, k: int) -> float:
        """Of schedule ``k`` over the training."""
        knots = self.schedules[k]
        return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))

    def time(self, k: int, u: Column) -> Column:
        """When schedule ``k`` has asked for the part ``u`` of its whole demand."""
        knots, total, spent = self.schedules[k], self.integral(k), 0.0
        y, found = u * F.lit(total), F.lit(1.0)
        parts = []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            area, slope, rest = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0), y - F.lit(spent)
            inverse = rest / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
            spent += area
            if area > 0:
                parts.append((y <= F.lit(spent), F.lit(t0) + inverse))
        for test, value in reversed(parts):
            found = F.when(test, value).otherwise(found)
        return found


def words(text: str = "text") -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Each row as the struct ``_row``, with its size, source and a random number of BITS bits keyed by key and text."""
    mark = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")))
    return docs.select(F.struct("*").alias("_row"), words(text).alias("_size"), F.col(source).cast("string").alias("_source"), F.conv(F.substring(F.md5(mark.cast("binary")), 1, BITS // 4), 16, 10).cast("long").alias("_h"))


def demand(rows: DataFrame, plan: Curriculum) -> DataFrame:
    """A row per source: ``_rank``, number of rows, size, weight class and target."""
    sources = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_all"))
    n, every = len(plan.weights), Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w * plan.integral(k % len(plan.schedules)))) for k, w in enumerate(plan.weights))), F.col("_class") + 1)
    sources = sources.withColumn("_rank", rank).withColumn("_class", F.pmod("_rank", F.lit(n))).withColumn("_w", weight)
    sources = sources.withColumn("_cap", plan.limit * F.col("_all")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    spent, gone = F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = (plan.share * F.sum("_all").over(every) - spent) / (F.sum("_w").over(every) - gone)
    sources = sources.withColumn("_level", level).withColumn("_level", F.max(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.col("_level"))).over(every))
    target = F.round(F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))), 6)
    return sources.select("_source", "_rank", "_n", "_all", "_class", target.alias("_target"))


def scheduled(rows: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """``rows`` of sized() with source size, target and ``_plays``: (repetition, words, position), without empty ones.

    A document's start in its source is a two-level sum: rows fall into about sqrt(n) intervals of the random number; interval
    totals are summed along the source and rows within their interval, so neither window grows with a hot source but as a root. Rows
    equal in key and text share an interval."""
    sources = keep(demand(rows, plan), "sources")  # a row per source; its known size lets Spark broadcast it where that is small
    placed = rows.join(sources, rows["_source"].eqNullSafe(sources["_source"])).drop("_source")
    placed = placed.withColumn("_bin", F.floor(F.col("_h") * F.ceil(F.sqrt(F.col("_n").cast("double"))).cast("double") / F.lit(float(1 << BITS))))
    bins = placed.groupBy("_rank", "_bin").agg(F.sum("_size").alias("_sum"))
    along = Window.partitionBy("_rank").orderBy("_bin")
    bins = bins.select("_rank", "_bin", (F.sum("_sum").over(along) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("_rank", "_bin").orderBy("_h", "_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_start", F.sum("_size").over(inside) - F.col("_size")).join(bins, ["_rank", "_bin"])
    start, quota = F.col("_before") + F.col("_start"), F.floor("_target")

    def play(e: Column) -> Column:
        first = start + e * F.col("_all")
        taken = F.greatest(F.least(quota - first, F.col("_size")), F.lit(0).cast("long"))
        u = (first.cast("double") + taken / 2) / F.when(quota > 0, quota.cast("double"))
        time = plan.time(0, u)
        for k in range(1, len(plan.weights)):
            time = F.when(F.col("_class") == k, plan.time(k % len(plan.schedules), u)).otherwise(time)
        return F.struct(e.alias("repetition"), taken.alias("words"), time.alias("position"))

    repetitions = F.sequence(F.lit(0).cast("long"), F.lit(max(0, int(-(-plan.limit // 1)) - 1)).cast("long"))
    return placed.withColumn("_plays", F.filter(F.transform(repetitions, play), lambda p: p["words"] > 0))


def mix(docs: DataFrame, plan: Curriculum = Curriculum(), text: str = "text", key: str = "doc_id", source: str = "source", chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` as the mix takes them, range-sorted by training position: repeated, left out, or cut.

    At most one document per source is taken in part: its first words, joined by single spaces, and ``chars`` (if there is such a
    column) their length. Null and empty texts have size 0 and are never taken. Null sources are a source of their own, the last.
    Rows that repeat a key are documents of their own. Columns keep their names and types, whatever they are. An empty table gives
    an empty result. The random number follows from key and text, so reruns agree."""
    rows = scheduled(sized(docs, text, key, source), plan).select("_row", "_size", F.explode("_plays").alias("_play"))
    cut = F.col("_play.words") < F.col("_size")
    short = F.array_join(F.slice(F.regexp_extract_all(F.col("_row")[text], F.lit(WORD), F.lit(0)), 1, F.col("_play.words").cast("int")), " ")
    changed = {text: F.when(cut, short).otherwise(F.col("_row")[text])}
    if chars in docs.columns:
        changed[chars] = F.when(cut, F.length(short).cast(docs.schema[chars].dataType)).otherwise(F.col("_row")[chars])
    rows = rows.orderBy("_play.position", F.col("_row")[key], "_play.repetition")
    return rows.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size, source target and words taken of every document, range-sorted by its first training position."""
    docs = table(spark, sf_dir, "documents")
    small = keep(sized(docs).select(F.struct(F.col("_row.doc_id").alias("doc_id")).alias("_row"), "_size", "_source", "_h"), "sizes")
    found = scheduled(small)
    taken = F.aggregate("_plays", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    found = found.select(F.col("_row.doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_all").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"), F.try_element_at(F.col("_plays"), F.lit(1))["position"].alias("position"))
    return found.orderBy(F.col("position").asc_nulls_last(), "doc_id").withColumn("position", F.round("position", 9))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), ''))[1:15])::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS own
  FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, rank, round(least(cap, coalesce(max(CASE WHEN cap >= own * weight THEN own END) OVER () * weight, cap)), 6) AS target FROM l
), p AS (
  SELECT doc_id, size, source_size, target, rank % 3 AS class, floor(target)::BIGINT AS quota,
         (sum(size) OVER (PARTITION BY rank ORDER BY h, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(least(quota - start, size), 0)::BIGINT AS one, greatest(least(quota - start - source_size, size), 0)::BIGINT AS two FROM p
), u AS (SELECT *, CASE WHEN one > 0 THEN (start::DOUBLE + one / 2.0::DOUBLE) / quota::DOUBLE END AS x FROM q)
SELECT doc_id, size, source_size, target, one + two AS taken,
       round(CASE WHEN x IS NULL THEN NULL WHEN class = 0 THEN x WHEN class = 1 THEN (sqrt(0.25::DOUBLE + 2.0::DOUBLE * x) - 0.5::DOUBLE) / 1.0::DOUBLE
                        ELSE (sqrt(greatest(2.25::DOUBLE - 2.0::DOUBLE * x, 0)) - 1.5::DOUBLE) / -1.0::DOUBLE END, 9) AS position
FROM u
"""
