"""Preprocessing learned on training rows alone: detection floor, one probe per gene, scaling.

What a single training set learns comes from one aggregation of its rows by probe (floor_state, probe_state). Repeated folds learn from
cells (fold_floors, fold_probes): values are summed up once for each test fold and class, and a training set's moments are merged
from the cells of the other folds, so no value is copied for every set that it trains. Filtering, collapsing and scaling work on the
small tables that result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TOLERANCE
from .splits import by_sample

FOLD = ("repeat", "fold")


def floor_state(train: DataFrame, fraction: float = 0.5, least_share: float = 0.01, by: tuple[str, ...] = FOLD) -> DataFrame:
    """by, floor, floor_share, n_minority, threshold: the smallest training value, the share of values on it, and how many samples must
    exceed it. A share under ``least_share`` means that there is no floor: floor null, threshold 0."""
    low = train.groupBy(*by).agg(F.min("x").alias("floor"))  # a row per training set
    on_it = F.when(F.col("x") <= F.col("floor") + TOLERANCE, 1.0).otherwise(0.0)
    share = train.join(low, list(by)).groupBy(*by).agg(F.avg(on_it).alias("floor_share"), F.max("floor").alias("floor"))
    classes = train.groupBy(*by, "y").agg(F.countDistinct("sample_id").alias("n")).groupBy(*by).agg(F.min("n").alias("n_minority"))
    found = share.join(classes, list(by))
    has = F.col("floor_share") >= least_share
    return found.select(*by, F.when(has, F.col("floor")).alias("floor"), "floor_share", "n_minority", F.when(has, F.ceil(fraction * F.col("n_minority"))).otherwise(0).cast("long").alias("threshold"))


def probe_state(train: DataFrame, floor: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    """A row per training set and probe: detections, moments of all rows and of each class."""
    one, zero = F.when(F.col("y") == 1, F.col("x")), F.when(F.col("y") == 0, F.col("x"))
    found = train.join(floor.select(*by, "floor"), list(by)).groupBy(*by, "probe_id", "gene").agg(
        F.sum((F.col("x") > F.col("floor") + TOLERANCE).cast("long")).alias("n_detected"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.var_pop("x").alias("variance"),
        F.count(one).alias("n1"), F.count(zero).alias("n0"), F.avg(one).alias("mean1"), F.avg(zero).alias("mean0"), F.var_samp(one).alias("var1"), F.var_samp(zero).alias("var0"),
    )
    return found


def _others(n_splits: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda f: f != F.col("fold"))


def fold_floors(values: DataFrame, folds: DataFrame, n_splits: int, fraction: float = 0.5, least_share: float = 0.01) -> DataFrame:
    """floor_state() of every training set of the folds, labels as they have them: (repeat, fold) is the test fold that a set leaves out.

    Minima of samples give the floors, of which a repeat has two at most; values are then counted at each different floor. Samples are
    summed up once for each test fold and class, and a training set takes the other folds' sums."""
    lows = values.groupBy("sample_id").agg(F.min("x").alias("low"), F.count(F.lit(1)).alias("n"))
    own = folds.select("repeat", "fold", "sample_id", "y")
    cells = own.join(lows.hint("merge"), "sample_id").groupBy(*FOLD, "y").agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_samples"))
    sets = cells.select("repeat", F.explode(_others(n_splits)).alias("set"), "y", "low", "n", "n_samples").withColumnRenamed("set", "fold")
    floors = sets.groupBy(*FOLD).agg(F.min("low").alias("floor"), F.sum("n").alias("n"))
    classes = sets.groupBy(*FOLD, "y").agg(F.sum("n_samples").alias("n")).groupBy(*FOLD).agg(F.min("n").alias("n_minority"))
    different = floors.agg(F.array_sort(F.collect_set("floor")).alias("_floors"))  # one row
    on_it = values.join(F.broadcast(different)).select("sample_id", F.explode(F.filter("_floors", lambda f: F.col("x") <= f + TOLERANCE)).alias("floor"))
    on_it = on_it.groupBy("sample_id", "floor").agg(F.count(F.lit(1)).alias("at"))
    at = own.join(on_it.hint("merge"), "sample_id").groupBy(*FOLD, "floor").agg(F.sum("at").alias("at"))
    at = at.select("repeat", F.explode(_others(n_splits)).alias("set"), "floor", "at").withColumnRenamed("set", "fold")
    counted = at.join(floors.select(*FOLD, "floor"), [*FOLD, "floor"]).groupBy(*FOLD).agg(F.sum("at").alias("at"))
    found = floors.join(counted, list(FOLD)).join(classes, list(FOLD)).withColumn("floor_share", F.col("at") / F.col("n"))
    has = F.col("floor_share") >= least_share
    return found.select(*FOLD, F.when(has, F.col("floor")).alias("floor"), "floor_share", "n_minority", F.when(has, F.ceil(fraction * F.col("n_minority"))).otherwise(0).cast("long").alias("threshold"))


def _merged(cells: Column) -> Column:
    """Struct (n, mean, m2, low, high) of cells of the same fields; a set of equal values has no deviation, to the last bit."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(s: Column, c: Column) -> Column:
        n = s["n"] + c["n"]
        gap, share = c["mean"] - s["mean"], c["n"] / n
        return F.struct(n.alias("n"), (s["mean"] + gap * share).alias("mean"), (s["m2"] + c["m2"] + gap * gap * s["n"] * share).alias("m2"))

    total = F.aggregate(cells, zero, add)
    low, high = F.array_min(F.transform(cells, lambda c: c["low"])), F.array_max(F.transform(cells, lambda c: c["high"]))
    made = F.transform(F.array(F.struct(total.alias("t"), low.alias("low"), high.alias("high"))), lambda x: F.struct(x["t"]["n"].alias("n"), F.when(x["low"] == x["high"], x["low"]).otherwise(x["t"]["mean"]).alias("mean"), F.when(x["low"] == x["high"], F.lit(0.0)).otherwise(x["t"]["m2"]).alias("m2")))
    return F.element_at(made, 1)


def fold_probes(values: DataFrame, folds: DataFrame, floors: DataFrame, n_splits: int) -> DataFrame:
    """probe_state() of every training set of the folds, ``floors`` of fold_floors().

    A probe's values of one repeat, test fold and class are a cell, with detections over the repeat's lower and higher floor."""
    two = floors.groupBy("repeat").agg(F.min("floor").alias("_low"), F.max("floor").alias("_high"))
    held = by_sample(folds.join(F.broadcast(two), "repeat"), "repeat", "fold", "y", "_low", "_high")  # a row per repeat
    over = lambda floor: F.sum((F.col("x") > F.col(floor) + TOLERANCE).cast("long"))
    placed = values.select("sample_id", "probe_id", "gene", "x").join(held, "sample_id").select("probe_id", "gene", "x", F.inline("_folds"))
    cells = placed.groupBy("repeat", "probe_id", "gene", "fold", "y").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.min("x").alias("low"), F.max("x").alias("high"), over("_low").alias("over_low"), over("_high").alias("over_high"),
    )
    cell = F.struct("fold", "y", "n", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("mean")).alias("mean"), (F.col("var") * F.col("n")).alias("m2"), "low", "high", "over_low", "over_high")
    probes = cells.groupBy("repeat", "probe_id", "gene").agg(F.array_sort(F.collect_list(cell)).alias("_c"))
    sets = floors.join(F.broadcast(two), "repeat").select(*FOLD, "floor", (F.col("floor") == F.col("_low")).alias("_is_low"))
    rows = probes.join(sets, "repeat").withColumn("_c", F.filter("_c", lambda c: c["fold"] != F.col("fold")))
    of = lambda y: F.filter("_c", lambda c: c["y"] == y)
    rows = rows.select(*FOLD, "probe_id", "gene", "floor", F.aggregate("_c", F.lit(0).cast("long"), lambda s, c: s + F.when(F.col("_is_low"), c["over_low"]).otherwise(c["over_high"])).alias("_over"), _merged(F.col("_c")).alias("a"), _merged(of(1)).alias("b1"), _merged(of(0)).alias("b0"))
    one = lambda b: F.when(F.col(f"{b}.n") > 0, F.col(f"{b}.mean"))
    sample = lambda b: F.when(F.col(f"{b}.n") > 1, F.col(f"{b}.m2") / (F.col(f"{b}.n") - 1))
    return rows.where("a.n > 0").select(
        *FOLD, "probe_id", "gene", F.when(F.col("floor").isNotNull(), F.col("_over")).alias("n_detected"), F.col("a.n").alias("n"), F.col("a.mean").alias("mean"), F.sqrt(F.col("a.m2") / F.col("a.n")).alias("sd"), (F.col("a.m2") / F.col("a.n")).alias("variance"),
        F.col("b1.n").alias("n1"), F.col("b0.n").alias("n0"), one("b1").alias("mean1"), one("b0").alias("mean0"), sample("b1").alias("var1"), sample("b0").alias("var0"),
    )


def detected(state: DataFrame, floor: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    """Probes that enough training samples exceed the floor on; all of them where there is no floor."""
    rows = state.join(floor.select(*by, "threshold", F.col("floor").alias("_floor")), list(by))
    return rows.where(F.col("_floor").isNull() | (F.col("n_detected") >= F.col("threshold"))).drop("_floor", "threshold")


def collapsed(state: DataFrame, rule: str = "mean", by: tuple[str, ...] = FOLD) -> DataFrame:
    """One probe per gene: that of the largest training mean or variance, ties to the smaller probe id. Probes without a gene go."""
    if rule not in ("mean", "variance"):
        raise ValueError(rule)
    order = Window.partitionBy(*by, "gene").orderBy(F.round(rule, 9).desc(), "probe_id")
    return state.where(F.col("gene").isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def scaling(state: DataFrame) -> DataFrame:
    """``scale``: the standard deviation, 1 where it is 0."""
    return state.withColumn("scale", F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)))


def fitted(train: DataFrame, fraction: float = 0.5, rule: str = "mean", by: tuple[str, ...] = FOLD) -> DataFrame:
    """The whole learned state: a row per training set and gene with its probe, mean, scale and class moments."""
    floor = floor_state(train, fraction, by=by)
    return scaling(collapsed(detected(probe_state(train, floor, by), floor, by), rule, by))


def applied(values: DataFrame, state: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    """Values of the selected probes as z, scaled with the learned mean and scale."""
    learned = state.select(*by, "probe_id", F.col("mean").alias("_mean"), F.col("scale").alias("_scale"))
    return values.join(learned, [*by, "probe_id"]).withColumn("z", (F.col("x") - F.col("_mean")) / F.col("_scale")).drop("_mean", "_scale")


def diagnostics(state: DataFrame, all_probes: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    """by, n_probes, n_genes, n_used: how much the learned state keeps."""
    totals = all_probes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_probes"), F.countDistinct("gene").alias("n_genes"))
    return totals.join(state.groupBy(*by).agg(F.count(F.lit(1)).alias("n_used")), list(by))
