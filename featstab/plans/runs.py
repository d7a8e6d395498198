"""Configured runs: every model on every fold, resumable, with tables, analysis and a manifest.

A run lives in a folder that driver and executors share. Fits are stored under the identity of all that decides them (data, folds,
preprocessing, model, permutations), so a folder never gives back fits of other settings. Configurations, repeats and folds are key
columns of one plan; fits are written wave by wave, so a run that is stopped goes on with those that are missing, and one of more repeats
or replicates adds to them.
"""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kept import kept
from ..operators import attribution, cohort, consensus, metrics, models, preprocess, replication, splits, stability
from ..sources import tables
from . import provenance
from .provenance import Folder, History

REQUIRED = ("name", "seed", "cv", "preprocessing", "top_k", "store_top", "n_perm", "bootstrap", "configs")
#: Fits of a wave, unless the configuration says otherwise.
WAVE = 512
FOLD = ("repeat", "fold")


def checked(config: dict | None) -> dict:
    """The configuration with its defaults; anything missing or contradictory is an error."""
    if not config:
        raise ValueError("the configuration is empty")
    if missing := [k for k in REQUIRED if k not in config]:
        raise ValueError(f"missing keys: {missing}")
    if config.get("cohort", "discovery") != "discovery":
        raise ValueError("runs may use the discovery cohort only")
    if config["store_top"] < max(config["top_k"]):
        raise ValueError("store_top is under the largest top_k")
    ids = [c["id"] for c in config["configs"]]
    if len(set(ids)) != len(ids) or "ttest" in ids:
        raise ValueError("ids repeat, or take the name of the t-test")
    found = config | {"labels": config.get("labels", "observed"), "configs": [c | {"role": c.get("role", "primary")} for c in config["configs"]]}
    if found["labels"] not in ("observed", "permuted"):
        raise ValueError("labels are observed or permuted")
    for c in found["configs"]:
        models.resolved(c["model"], **c.get("parameters", {}))
        models.checked_explainers(c["model"], c["explainers"])
    if top := found.get("baseline", {}).get("ttest_lr"):
        found["configs"].append({"id": "ttest_lr", "model": "logreg", "explainers": [], "top": int(top), "role": "baseline"})
    return found


def load_config(path: str) -> dict:
    import yaml

    with open(path) as f:
        return checked(yaml.safe_load(f))


def pipelines(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(f"{c['id']}|{e}", c["id"], c["model"], e, c["role"], i) for i, c in enumerate(config["configs"]) for e in c["explainers"]]
    return spark.createDataFrame([*rows, ("ttest|ttest", "ttest", "ttest", "ttest", "baseline", len(rows))], "pipeline string, config string, model string, explainer string, role string, position int")


def identity_of(values: DataFrame) -> str:
    """Of a tall cohort's cells, whatever their order."""
    row = values.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("sample_id", "probe_id", "gene", "y", "x").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}-{row['h']}"


class Clock:
    """Seconds of each stage."""

    def __init__(self):
        self.told, self.last = {}, time.perf_counter()

    def lap(self, name: str) -> None:
        now = time.perf_counter()
        self.told[name] = round(self.told.get(name, 0.0) + now - self.last, 3)
        self.last = now


def fitted(packed: DataFrame, config: dict, deciding: dict, folder: Folder) -> tuple[DataFrame, list[str]]:
    """Fits of all configurations on all folds, and the identities under which the folder has them.

    Configuration, repeat (or replicate) and fold are key columns: what is wanted but not stored is one anti-join, and a job runs as many
    of these fits as a wave holds, whatever their configuration; each wave is stored before the next begins."""
    spark = packed.sparkSession
    keys = {c["id"]: provenance.identity({**deciding, "config": {k: v for k, v in c.items() if k != "role"}}) for c in config["configs"]}
    names = spark.createDataFrame(list(keys.items()), "config string, identity string")
    wanted = packed.select(*FOLD).distinct().select(*FOLD, F.explode(F.array(*map(F.lit, keys))).alias("config")).join(F.broadcast(names), "config")
    if folder.has("fits"):
        wanted = wanted.join(stored_fits(spark, folder, list(keys.values())).select("identity", *FOLD).distinct(), ["identity", *FOLD], "left_anti")
    missing = [tuple(r) for r in wanted.select("config", *FOLD, "identity").orderBy(*FOLD, "config").collect()]  # a row a fit
    wave = int(config.get("wave", WAVE))
    for i in range(0, len(missing), wave):
        now = spark.createDataFrame(missing[i : i + wave], "config string, repeat int, fold int, identity string")
        found = models.fit_folds(packed.join(F.broadcast(now.drop("identity")), list(FOLD)), config["configs"], config["n_perm"], config["seed"])  # a wave's rows
        found.join(F.broadcast(names), "config").write.mode("append").partitionBy("identity").parquet(f"{folder.uri}/fits")
    return stored_fits(spark, folder, list(keys.values())), list(keys.values())


def stored_fits(spark: SparkSession, folder: Folder, keys: list[str] | None = None) -> DataFrame:
    """Fits of these identities, else of those that the folder's manifest names: a folder may hold fits of other settings too."""
    own = folder.get_json("manifest.json")["fits"] if keys is None else keys
    return spark.read.schema(f"{models.SCHEMA}, identity string").parquet(f"{folder.uri}/fits").where(F.col("identity").isin(own))


def run_matrix(values: DataFrame, config: dict, folder: str | Path | Folder, tree: str | Path = ".", titles: DataFrame | None = None) -> Folder:
    """Run the configuration on a tall cohort into ``folder``; fits that the folder has already are not run again.

    Tables (Parquet): rankings, predictions, fold_metrics, timings, diagnostics, pipelines, pooled_metrics (not for permuted labels),
    and the analysis. ``tree`` is the working tree whose state the manifest records. A configuration with ``subset`` ({kind: full, month or
    random_control; month: yy-mm}) runs on those samples alone; ``titles`` (sample_id, y, title) tell the months."""
    config, folder, spark, clock = checked(config), Folder.of(folder), values.sparkSession, Clock()
    if part := config.get("subset"):
        if titles is None:
            raise ValueError("a subset needs titles")
        chosen = cohort.subset(titles, part["kind"], part.get("month", ""), config["seed"]).select("sample_id")
        values = values.join(kept(chosen), "sample_id", "left_semi")
    if exclude := config.get("exclude_genes"):
        values = cohort.without_genes(values, exclude)
    n_splits, labels = config["cv"]["n_splits"], kept(tables.samples(values))
    if bad := splits.too_small_classes(labels, n_splits).collect():
        raise ValueError(f"classes are too small: {bad}")
    data = identity_of(values)
    if config["labels"] == "permuted":
        folds = kept(splits.null_folds(labels, n_splits, config["cv"]["n_repeats"], config["seed"]))
    else:
        folds = kept(splits.stratified_folds(labels, n_splits, config["cv"]["n_repeats"], config["seed"]))
    how = config["preprocessing"]
    floors = kept(preprocess.fold_floors(values, folds, n_splits, how.get("min_detect_frac_of_minority", 0.5)))
    probes = kept(preprocess.fold_probes(values, folds, floors, n_splits))
    state = kept(preprocess.scaling(preprocess.collapsed(preprocess.detected(probes, floors), how.get("collapse_rule", "mean"))))
    clock.lap("preprocess")
    deciding = {k: config.get(k) for k in ("seed", "preprocessing", "labels", "exclude_genes", "n_perm")} | {"data": data, "n_splits": n_splits}
    own_y = folds.select("repeat", "sample_id", "y")  # a null has labels of its own in every replicate
    z, test = (preprocess.applied(rows, state).drop("y").join(own_y, ["repeat", "sample_id"]) for rows in (splits.training(values, folds, n_splits), splits.testing(values, folds)))
    fits, keys = fitted(kept(models.packed(z, test)), config, deciding, folder)
    clock.lap("fit")
    shown = models.attributions(fits).withColumn("importance", F.round("importance", 9)).unionByName(attribution.ttest(state).withColumn("config", F.lit("ttest")).withColumn("explainer", F.lit("ttest")))
    ranked = attribution.ranked(shown.withColumn("pipeline", F.concat_ws("|", "config", "explainer")), ("pipeline", *FOLD))
    top = attribution.positive_top(ranked, config["store_top"]).join(state.select(*FOLD, "gene", F.col("probe_id").alias("probe"), F.col("n_detected").alias("n_detected_train")), [*FOLD, "gene"])
    folder.write("rankings", top)
    predicted = folder.write("predictions", models.predictions(fits))
    used = models.measures(fits).where("name = 'used'").select("config", *FOLD, F.col("value").cast("long").alias("n_features_used"))
    folder.write("fold_metrics", metrics.classification(predicted, ["config", *FOLD]).join(used, ["config", *FOLD], "left"))
    folder.write("timings", models.measures(fits).where(F.col("name").endswith("_s")).select("config", *FOLD, F.regexp_replace("name", "_s$", "").alias("stage"), F.col("value").alias("seconds")))
    folder.write("diagnostics", preprocess.diagnostics(state, probes).join(floors, list(FOLD)))
    folder.write("pipelines", pipelines(spark, config))
    if config["labels"] != "permuted":
        boot = metrics.bootstrap(predicted, splits.Draws(labels, config["bootstrap"]["n_boot"], config["seed"]), ["config", "repeat"])
        intervals = metrics.percentile_interval(boot, ["config", "repeat"], ["roc_auc", "ap_normal", "balanced_accuracy"])
        folder.write("pooled_metrics", metrics.classification(predicted, ["config", "repeat"]).join(intervals, ["config", "repeat"]))
    clock.lap("tables")
    n_genes = values.where("gene is not null").select("gene").distinct().count()
    analyse(spark, folder, config, n_genes)
    clock.lap("analysis")
    classes = {str(r["y"]): r["count"] for r in labels.groupBy("y").count().collect()}
    described(folder, config, tree, clock, data=data, fits=keys, n_genes=n_genes, n_probes=values.select("probe_id").distinct().count(), samples=classes, n_folds=n_splits * config["cv"]["n_repeats"], models={c["id"]: models.resolved(c["model"], **c.get("parameters", {})) for c in config["configs"]})
    return folder


def described(folder: Folder, config: dict, tree: str | Path, clock: Clock, **more: object) -> None:
    """config.yaml, then the manifest, which is written last: a folder with one is a whole run."""
    import yaml

    folder.put("config.yaml", yaml.safe_dump(_plain(config), sort_keys=True))
    stored = [n for n in folder.names() if folder.has(n)]
    folder.put_json("manifest.json", {"config": config, "config_id": provenance.identity(config), "history": History(tree).state(), "software": provenance.software(), "seconds": clock.told, "stored": [*stored, "manifest.json"], **more})


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list | tuple) else value


def analyse(spark: SparkSession, folder: Folder, config: dict, d: int) -> None:
    """Stability, consensus and performance tables of a run's stored tables, and its candidate lists."""
    rankings, pipes = folder.read(spark, "rankings"), folder.read(spark, "pipelines")
    sets = kept(stability.members(rankings, config["top_k"]))
    level = kept(stability.repeat_level(sets, pipes, d))
    numbers = ("roc_auc", "ap_normal", "balanced_accuracy", "sensitivity", "specificity", "n_features_used")
    out = {
        "repeat_level_stability": level, "stability_summary": stability.summarise_repeats(level), "pooled_resampling": stability.pooled_resampling(sets, d), "pairwise_jaccard": stability.pairwise_jaccard(sets),
        "frozen_list_candidates": consensus.frozen_lists(rankings, pipes, *_sizes(config)),
        "fold_metric_summary": folder.read(spark, "fold_metrics").groupBy("config").agg(*(f(n).alias(f"{n}_{s}") for n in numbers for s, f in (("mean", F.avg), ("sd", F.stddev_samp)))),
    } | {f"gene_table_k{k}": consensus.gene_table(rankings, pipes, k) for k in config["top_k"]}
    for name, table in out.items():
        folder.write(f"analysis/{name}", table)


def _sizes(config: dict) -> tuple[int, int]:
    """The headline size (25 if it is there) and the largest."""
    ks = sorted(config["top_k"])
    return (25 if 25 in ks else ks[0]), ks[-1]


def run_experiment(values: DataFrame, config: dict, model: str, explainer: str, folder: str | Path | Folder, tree: str | Path = ".") -> Folder:
    """A single pipeline: run_matrix() of one configuration, with its stored rankings, predictions, a row per fold (``runs``), pooled
    metrics and ``stability`` over all runs and within repeats, there against the whole universe and the genes eligible in any fold."""
    folder = Folder.of(folder)
    own = config | {"configs": [{"id": model, "model": model, "explainers": [explainer], "parameters": config.get("parameters", {})}]}
    run_matrix(values, own, folder / "matrix", tree)
    spark, whole, clock = values.sparkSession, folder / "matrix", Clock()
    pipeline = f"{model}|{explainer}"
    rankings = folder.write("rankings_top", whole.read(spark, "rankings").where(F.col("pipeline") == pipeline))
    folder.write("predictions", whole.read(spark, "predictions"))
    seconds = whole.read(spark, "timings").groupBy("config", *FOLD).agg(F.sum("seconds").alias("fold_seconds"))
    folder.write("runs", whole.read(spark, "fold_metrics").join(whole.read(spark, "diagnostics"), list(FOLD)).join(seconds, ["config", *FOLD], "left"))
    folder.write("pooled_metrics", whole.read(spark, "pooled_metrics"))
    manifest = whole.get_json("manifest.json")
    eligible = fits_genes(spark, whole)
    folder.write("stability", stability.scopes(stability.members(rankings, config["top_k"]), manifest["n_genes"], eligible))
    described(folder, checked(own), tree, clock, n_eligible_genes=eligible, **{k: manifest[k] for k in ("data", "n_genes", "samples")})
    return folder


def fits_genes(spark: SparkSession, folder: Folder) -> int:
    """Genes that any fold of the run's own fits has."""
    return stored_fits(spark, folder).where("kind = 'attribution'").select("gene").distinct().count()


def run_null(values: DataFrame, config: dict, folder: str | Path | Folder, replicates: int = 30, tree: str | Path = ".") -> Folder:
    """One run over permuted labels: each replicate, with labels and folds of its own, stands under ``repeat``.

    Replicates are repeats of run_matrix(): one plan prepares them all, and fits that are stored, of a run that was stopped or of one of
    fewer replicates, are not run again."""
    return run_matrix(values, config | {"labels": "permuted", "cv": config["cv"] | {"n_repeats": replicates}}, folder, tree)


def compare_with_null(spark: SparkSession, observed: str | Path | Folder, null: str | Path | Folder) -> DataFrame:
    """stability.against_null() of a run's repeats and a null's replicates, for every statistic of repeat_level_stability."""
    level = [Folder.of(x).read(spark, "analysis/repeat_level_stability") for x in (observed, null)]
    return stability.against_null(*level, ("phi", "jaccard", "kuncheva"))


class UniverseError(ValueError):
    """Settings of one fold rank different genes."""


def rank_agreement(rows: DataFrame, reference: str, k: int) -> DataFrame:
    """setting, repeat, fold, rho, jaccard, n_genes of (setting, repeat, fold, gene, importance) against the reference setting.

    Every setting must rank the reference's genes in every fold, each once: a missing, surplus or repeated gene is a UniverseError."""
    rows = kept(rows.select("setting", *FOLD, "gene", F.round("importance", 9).alias("importance")))
    if twice := rows.groupBy("setting", *FOLD, "gene").count().where("count > 1").limit(1).collect():
        raise UniverseError(f"a gene is ranked twice by one setting, e.g. {twice[0].asDict()}")
    ref = rows.where(F.col("setting") == reference).select(*FOLD, "gene", F.col("importance").alias("reference"))
    settings = rows.select("setting").distinct()
    both = ref.join(settings).join(rows, ["setting", *FOLD, "gene"], "full_outer")  # a few settings
    if lost := both.where("importance is null or reference is null").limit(1).collect():
        raise UniverseError(f"genes differ between settings, e.g. {lost[0].asDict()}")
    rho = replication.spearman(both, "importance", "reference", ["setting", *FOLD]).withColumnRenamed("n", "n_genes")
    ranked = attribution.ranked(rows, ("setting", *FOLD)).where(F.col("rank") <= k).select("setting", *FOLD, "gene")
    top = ranked.join(ranked.where(F.col("setting") == reference).select(*FOLD, "gene", F.lit(1).alias("_ref")), [*FOLD, "gene"], "left")
    overlap = top.groupBy("setting", *FOLD).agg(F.count("_ref").alias("_both"), F.count(F.lit(1)).alias("_k"))
    return rho.join(overlap, ["setting", *FOLD]).select("setting", *FOLD, "rho", (F.col("_both") / (2 * F.col("_k") - F.col("_both"))).alias("jaccard"), "n_genes")


def run_regularisation(values: DataFrame, config: dict, grid: list[float], reference: float, auc_floor: float, folder: str | Path | Folder, k: int, tree: str | Path = ".") -> DataFrame:
    """The same folds at every C; stores stability_by_C, pooled_metrics_by_C, rank_agreement and verdict, which it returns (setting, phi, band, ..., verdict)."""
    if reference not in grid:
        raise ValueError("the reference is not in the grid")
    if k not in config["top_k"]:
        raise ValueError("k is not in top_k")
    spark, folder = values.sparkSession, Folder.of(folder)
    name = lambda c: f"C={c:g}"
    own = config | {"configs": [{"id": name(c), "model": "logreg", "explainers": ["coef"], "parameters": {"C": c}} for c in grid]}
    whole = run_matrix(values, own, folder / "matrix", tree)
    setting = F.split("pipeline", r"\|")[0].alias("setting")
    by_c = folder.write("stability_by_C", whole.read(spark, "analysis/pooled_resampling").where("pipeline <> 'ttest|ttest'").select(setting, "*"))
    pooled = folder.write("pooled_metrics_by_C", whole.read(spark, "pooled_metrics").withColumnRenamed("config", "setting"))
    folder.write("rank_agreement", rank_agreement(models.attributions(stored_fits(spark, whole)).withColumnRenamed("config", "setting"), name(reference), k))
    auc = pooled.groupBy("setting").agg(F.min("roc_auc").alias("auc"))
    verdict = folder.write("verdict", stability.verdict(by_c.where(F.col("k") == k).select("setting", "phi").join(auc, "setting"), F.col("setting") == name(reference), auc_floor))
    described(folder, checked(own), tree, Clock(), grid=grid, reference=reference, k=k)
    return verdict


def compare_runs(spark: SparkSession, a: str | Path | Folder, b: str | Path | Folder, k: int) -> DataFrame:
    """One row: mean absolute change of resampling phi, Jaccard and overlap of the top genes by frequency, rank correlation of the
    frequencies over the genes of either, and of worst pooled AUC the change."""
    a, b = Folder.of(a), Folder.of(b)
    phi = lambda f, n: f.read(spark, "analysis/repeat_level_stability").where((F.col("dimension") == "resampling") & (F.col("k") == k)).groupBy("group").agg(F.avg("phi").alias(n))
    change = phi(a, "p").join(phi(b, "q"), "group").agg(F.avg(F.abs(F.col("q") - F.col("p"))).alias("mean_abs_phi_change"))
    one, two = a.read(spark, f"analysis/gene_table_k{k}"), b.read(spark, f"analysis/gene_table_k{k}")
    head = lambda t, n: t.where(F.col("position") <= k).select("gene", F.lit(1).alias(n))
    top = head(one, "p").join(head(two, "q"), "gene", "full_outer").agg(F.count_if(F.col("p").isNotNull() & F.col("q").isNotNull()).alias("top_overlap"), F.count(F.lit(1)).alias("_either"))
    rho = replication.spearman(consensus.compared(one, two), "freq_a", "freq_b").select(F.col("rho").alias("spearman_frequency"), F.col("n").alias("n_genes"))
    worst = lambda f, n: f.read(spark, "pooled_metrics").agg(F.min("roc_auc").alias(n))
    joined = change.join(top).join(rho).join(worst(a, "auc_a")).join(worst(b, "auc_b"))  # one row each
    return joined.withColumn("top_jaccard", F.col("top_overlap") / F.col("_either")).drop("_either")
