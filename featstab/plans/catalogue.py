"""The registered queries of the study, each over whole tables; featstab.plans.oracle has the same names in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kept import kept, shared
from ..functions.prefix import running
from ..functions.scalars import rounded
from ..operators import attribution, cohort, consensus, enrichment, metrics, models, preprocess, replication, splits, stability
from ..sources import tables
from . import external, study
from .study import FOLD, KS, N_BOOT, N_SPLITS, SEED, Study

D = tables.N_GENES
LARGE = 10
PANELS = (("G1", "primary"), ("G4", "primary"), ("G9", "extended"), ("G99", "extended"))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


#: Decimals of doubles: nine where they are fractions of counts, many of which end in a half of the sixth decimal.
FRACTIONS = ("rank_features", "auc_ranking", "auc_effects", "gene_level_replication", "classification_metrics", "pooled_metrics_by_repeat", "fold_metric_summary", "document_cohort_metrics")
DIGITS = dict.fromkeys(FRACTIONS, 9) | {"list_level_replication": 7}  # means of effects that have nine themselves


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(make(spark, sf_dir), DIGITS.get(make.__name__, 6))

    run.__name__, run.__doc__ = make.__name__, make.__doc__
    QUERIES[make.__name__] = run
    return run


def values(spark: SparkSession, sf: str) -> DataFrame:
    return tables.cohort(spark, sf)


@shared
def the_study(spark: SparkSession, sf: str, **how) -> Study:
    return Study(values(spark, sf), **how)


@shared
def sets(spark: SparkSession, sf: str) -> DataFrame:
    return stability.members(the_study(spark, sf).rankings, KS)


def shown(*columns: str) -> list:
    return [F.col(c) for c in columns]


@query
def slice_phi_by_repeat(spark, sf):
    """The flagship: folds, preprocessing, Welch ranking, top 10, phi of each repeat."""
    top = stability.members(the_study(spark, sf).ttest_rankings, (LARGE,))
    return stability.set_statistics(top, ["repeat"], ["fold"], D).select("repeat", "phi", "kuncheva", "jaccard")


@query
def cohort_profile(spark, sf):
    return cohort.profile(values(spark, sf), tables.FLOOR)


@query
def duplicate_columns(spark, sf):
    v = values(spark, sf)
    return cohort.duplicate_columns(v.select("probe_id", "sample_id", "x").union(v.where("p = 3").select(F.lit("copy_at"), "sample_id", "x")))


@query
def class_counts(spark, sf):
    return tables.samples(values(spark, sf)).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query
def class_crosstab(spark, sf):
    return tables.external_arrays(values(spark, sf)).select("sample_id", "sample_group", F.substring_index("title", "_", -1).alias("replicate")).distinct().groupBy("sample_group").pivot("replicate", ["repA", "repB"]).agg(F.count(F.lit(1))).na.fill(0)


@query
def usable_probes(spark, sf):
    return cohort.usable_probes(tables.annotation(spark, sf))


def _line_probes(spark, sf, parity):
    rows = tables.load(spark, sf, "lineitem").where(F.col("l_suppkey") % 2 == parity)
    return rows.select(F.concat(F.col("l_partkey"), F.lit("_at")).alias("probe_id"))


@query
def feature_universe(spark, sf):
    return cohort.feature_universe(cohort.usable_probes(tables.annotation(spark, sf)), _line_probes(spark, sf, 0), _line_probes(spark, sf, 1)).select("probe_id", "gene")


@query
def missing_probes(spark, sf):
    return cohort.missing_probes(cohort.usable_probes(tables.annotation(spark, sf)), _line_probes(spark, sf, 0).where("probe_id not like '1%'"))


@query
def annotation_profile(spark, sf):
    return cohort.annotation_profile(cohort.usable_probes(tables.annotation(spark, sf)))


@query
def first_entrez(spark, sf):
    return cohort.first_entrez(cohort.usable_probes(tables.annotation(spark, sf)))


@query
def derive_labels(spark, sf):
    return cohort.derive_labels(tables.descriptions(spark, sf))


@query
def label_violations(spark, sf):
    return cohort.label_violations(tables.descriptions(spark, sf))


@query
def processing_month(spark, sf):
    return tables.titles(spark, sf).select("sample_id", cohort.processing_month().alias("month"))


@query
def subset_month(spark, sf):
    return cohort.subset(tables.titles(spark, sf), "month", "95-03").select("sample_id", "y")


@query
def subset_random_control(spark, sf):
    return cohort.subset(tables.titles(spark, sf), "random_control", "95-03").select("sample_id", "y")


@query
def exclude_genes(spark, sf):
    return cohort.without_genes(values(spark, sf), ["G0", "G1"]).groupBy("gene").agg(F.countDistinct("probe_id").alias("n_probes"), F.avg("x").alias("mean"))


@query
def sample_metadata_pivot(spark, sf):
    """Key-value characteristics of each conversation as columns: the turns of each role."""
    rows = tables.load(spark, sf, "conversations").select("conv_id", F.concat(F.col("role"), F.lit(": "), F.col("turn")).alias("v"))
    part = F.split("v", ":", 2)
    rows = rows.select("conv_id", part[0].alias("key"), F.trim(part[1]).cast("long").alias("value"))
    return rows.groupBy("conv_id").pivot("key", ["assistant", "user"]).agg(F.min("value"))


@query
def stratified_folds(spark, sf):
    return the_study(spark, sf).folds


@query
def fold_balance(spark, sf):
    return the_study(spark, sf).folds.groupBy(*FOLD, "y").agg(F.count(F.lit(1)).alias("n"))


@query
def fold_overlap_check(spark, sf):
    return splits.overlap(the_study(spark, sf).folds, N_SPLITS)


@query
def too_small_classes(spark, sf):
    return splits.too_small_classes(tables.load(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("y")), 60)


@query
def permuted_labels(spark, sf):
    return splits.permuted_labels(tables.samples(values(spark, sf)), SEED, 0)


@query
def permutation_table(spark, sf):
    return the_study(spark, sf).moves


@query
def bootstrap_weights(spark, sf):
    return splits.bootstrap_weights(tables.samples(values(spark, sf)), N_BOOT, SEED)


@query
def floor_filter_state(spark, sf):
    return the_study(spark, sf).floor


@query
def floor_filter_kept(spark, sf):
    return the_study(spark, sf).kept.select(*FOLD, "probe_id", "n_detected")


@query
def n_detected_train(spark, sf):
    return the_study(spark, sf).probes.select(*FOLD, "probe_id", "n_detected", "n")


@query
def probe_collapse_max_mean(spark, sf):
    return preprocess.collapsed(the_study(spark, sf).kept, "mean").select(*FOLD, "gene", "probe_id")


@query
def probe_collapse_max_variance(spark, sf):
    return preprocess.collapsed(the_study(spark, sf).kept, "variance").select(*FOLD, "gene", "probe_id")


@query
def fold_scaling_stats(spark, sf):
    return the_study(spark, sf).state.select(*FOLD, "gene", "probe_id", "mean", "scale")


@query
def fold_zscores(spark, sf):
    return the_study(spark, sf).test_z.select(*FOLD, "sample_id", "gene", "z")


@query
def preprocess_diagnostics(spark, sf):
    s = the_study(spark, sf)
    return preprocess.diagnostics(s.state, s.probes)


@query
def welch_t_by_fold(spark, sf):
    return the_study(spark, sf).state.select(*FOLD, "gene", attribution.welch_t().alias("t"))


@query
def welch_zero_variance_cases(spark, sf):
    """Constant probes: equal in both classes, and apart."""
    v = values(spark, sf).where("p < 3").withColumn("x", F.when(F.col("p") == 0, F.lit(1.0)).when(F.col("p") == 1, F.col("y") * 2.0).otherwise(F.col("y") * -2.0))
    train = v.withColumn("repeat", F.lit(0)).withColumn("fold", F.lit(0))
    state = preprocess.probe_state(train, preprocess.floor_state(train))
    return state.select("probe_id", attribution.welch_t().alias("t"))


@query
def rank_features(spark, sf):
    return the_study(spark, sf).rankings.select("pipeline", *FOLD, "gene", "importance", "rank")


@query
def topk_positive(spark, sf):
    return attribution.positive_top(the_study(spark, sf).rankings, 5).select("pipeline", *FOLD, "gene", "rank")


@query
def ttest_lr_top(spark, sf):
    """The genes that the t-test baseline fits on: the head of the full ranking, positive or not."""
    return the_study(spark, sf).ttest_rankings.where(F.col("rank") <= KS[0]).select(*FOLD, "gene", "rank")


@query
def linear_coef_rank(spark, sf):
    return attribution.ranked(attribution.coefficients(the_study(spark, sf).weights)).select(*FOLD, "gene", "importance", "signed", "rank")


@query
def linear_shap_importance(spark, sf):
    s = the_study(spark, sf)
    return s.shap.select(*FOLD, "gene", "importance", "signed")


@query
def linear_permutation_importance(spark, sf):
    s = the_study(spark, sf)
    return s.permutation.select(*FOLD, "gene", "importance", "signed")


@query
def balanced_brier(spark, sf):
    f = attribution.margins(*(lambda s: (s.train_z, s.weights))(the_study(spark, sf)))
    return f.groupBy(*FOLD).agg(attribution.balanced_brier(attribution.sigmoid(F.col("f")), F.col("y")).alias("loss"))


@query
def auc_ranking(spark, sf):
    return the_study(spark, sf).train_auc


@query
def group_definitions(spark, sf):
    """Of the pipelines that the rankings have."""
    return stability.group_definitions(study.pipelines(spark).join(the_study(spark, sf).rankings.select("pipeline").distinct(), "pipeline", "left_semi"))


@query
def stats_variable_sizes(spark, sf):
    """Sets of every pipeline within a fold, of whatever size."""
    return stability.set_statistics(sets(spark, sf), ["k", "repeat", "fold"], ["pipeline"], D)


@query
def nogueira_kuncheva_jaccard(spark, sf):
    return stability.set_statistics(sets(spark, sf), ["pipeline", "k", "repeat"], ["fold"], D).select("pipeline", "k", "repeat", "phi", "kuncheva", "jaccard")


@query
def repeat_level_stability(spark, sf):
    return stability.repeat_level(sets(spark, sf), study.pipelines(spark), D)


@query
def summarize_repeats(spark, sf):
    return stability.summarise_repeats(stability.repeat_level(sets(spark, sf), study.pipelines(spark), D))


@query
def stability_summary_scopes(spark, sf):
    return stability.scopes(sets(spark, sf), D)


@query
def pooled_resampling(spark, sf):
    return stability.pooled_resampling(sets(spark, sf), D)


@query
def pairwise_jaccard(spark, sf):
    return stability.pairwise_jaccard(sets(spark, sf))


@shared
def _table(spark, sf, k, **how):
    return consensus.gene_table(the_study(spark, sf, **how).rankings, study.pipelines(spark), k)


@query
def gene_table_k5(spark, sf):
    return _table(spark, sf, 5)


@query
def gene_table_k10(spark, sf):
    return _table(spark, sf, 10)


@shared
def lists(spark, sf):
    """The frozen lists; this cohort has 24 genes, so the sizes are 5 and 10 under the names of 25 and 50."""
    found = consensus.frozen_lists(the_study(spark, sf).rankings, study.pipelines(spark), *KS)
    name = F.when(F.col("list") == "S_top5", "S_top25").when(F.col("list") == "S_top10", "S_top50").otherwise(F.col("list"))
    return found.withColumn("list", name)


@query
def frozen_lists(spark, sf):
    return lists(spark, sf)


@query
def universe_frequency(spark, sf):
    return consensus.universe_frequency(_table(spark, sf, 5), tables.probe_map(values(spark, sf)))


@query
def run_comparison_full_outer(spark, sf):
    return consensus.compared(_table(spark, sf, 5), _table(spark, sf, 5, rule="variance"))


@query
def run_comparison_spearman(spark, sf):
    both = consensus.compared(_table(spark, sf, 5), _table(spark, sf, 5, rule="variance"))
    return replication.spearman(both, "freq_a", "freq_b")


@query
def phi_band_verdict(spark, sf):
    """Collapse rules as settings: pooled phi of the t-test ranking and the worst fold AUC."""
    out = None
    for rule in ("mean", "variance"):
        s = the_study(spark, sf, rule=rule)
        phi = stability.set_statistics(stability.members(s.ttest_rankings, (5,)), ["k"], ["repeat", "fold"], D).select("phi")
        auc = metrics.roc_auc(s.predictions, ["repeat"]).agg(F.min("roc_auc").alias("auc"))
        part = phi.join(F.broadcast(auc)).select(F.lit(rule).alias("setting"), "phi", "auc")  # one row each
        out = part if out is None else out.union(part)
    return stability.verdict(out, F.col("setting") == "mean", 0.9)


@query
def classification_metrics(spark, sf):
    return metrics.classification(the_study(spark, sf).predictions, list(FOLD))


@query
def pooled_metrics_by_repeat(spark, sf):
    return metrics.classification(the_study(spark, sf).predictions, ["repeat"])


@query
def fold_metric_summary(spark, sf):
    m = metrics.classification(the_study(spark, sf).predictions, list(FOLD))
    names = ("roc_auc", "ap_cancer", "ap_normal", "balanced_accuracy", "f1_normal")
    return m.groupBy().agg(*(f(n).alias(f"{n}_{s}") for n in names for s, f in (("mean", F.avg), ("sd", F.stddev_samp))))


@query
def predicted_once(spark, sf):
    return metrics.predicted_once(the_study(spark, sf).predictions, ["repeat"])


@shared
def _boot(spark, sf):
    return metrics.bootstrap(the_study(spark, sf).predictions, splits.Draws(tables.samples(values(spark, sf)), N_BOOT, SEED), ["repeat"])


@query
def bootstrap_metrics(spark, sf):
    return _boot(spark, sf)


@query
def bootstrap_intervals(spark, sf):
    return metrics.percentile_interval(_boot(spark, sf), ["repeat"], ["roc_auc", "ap_normal", "balanced_accuracy"])


@shared
def disc(spark, sf):
    return study.whole(tables.discovery_half(values(spark, sf)))


@shared
def ext(spark, sf, variant="mean"):
    probes = disc(spark, sf).select("probe_id").distinct()
    return study.external_units(spark, sf, variant).join(probes, "probe_id", "left_semi").withColumnRenamed("unit_id", "sample_id")


@query
def auc_effects(spark, sf):
    return attribution.class_auc(disc(spark, sf), "x", ("gene",))


@query
def hedges_g(spark, sf):
    return replication.hedges_g(disc(spark, sf))


@query
def within_cohort_z(spark, sf):
    return replication.within_cohort_z(disc(spark, sf)).select("sample_id", "gene", "z")


@query
def external_units_mean(spark, sf):
    return study.external_units(spark, sf).select("unit_id", "probe_id", "subtype", "y", "n_arrays", "x")


@query
def external_units_repA(spark, sf):
    return study.external_units(spark, sf, "repA").select("unit_id", "probe_id", "subtype", "y", "n_arrays", "x")


@query
def unit_errors(spark, sf):
    return replication.unit_errors(tables.external_arrays(values(spark, sf)).withColumn("title", F.when(F.col("sample_id") % 33 == 0, "no number").otherwise(F.col("title"))))


@shared
def frozen(spark, sf):
    v = values(spark, sf)
    return consensus.frozen_table(replication.effects(disc(spark, sf)), _table(spark, sf, 5), lists(spark, sf), tables.probe_map(v))


@query
def freeze_gene_table(spark, sf):
    return frozen(spark, sf)


@shared
def _pairs(spark, sf, variant="mean", groups=()):
    """gene, s, e_disc, auc_ext, e_ext, g and list flags."""
    e = ext(spark, sf, variant)
    if groups:
        e = e.where(F.col("subtype").isin(*groups, "Healthy"))
    auc = attribution.class_auc(e, "x", ("gene",)).select("gene", F.col("auc").alias("auc_ext"))
    g = replication.hedges_g(e).select("gene", F.col("g").alias("g_ext"))
    f = frozen(spark, sf).withColumnRenamed("e", "e_disc")
    return f.join(auc, "gene").join(g, "gene").withColumn("e_ext", F.round(F.col("auc_ext") - 0.5, 9))


@query
def gene_level_replication(spark, sf):
    p = _pairs(spark, sf)
    return p.select("gene", "probe_id", "e_disc", "s", "auc_ext", "e_ext", (F.signum("e_disc") * F.col("e_ext")).alias("aligned_effect"))


@query
def c1_c2(spark, sf):
    return replication.c1_c2(_pairs(spark, sf))


@query
def direction_consistency(spark, sf):
    return replication.direction(_pairs(spark, sf))


@shared
def _subtypes(spark, sf):
    out = None
    for name, groups in (("Luminal", ["Luminal A", "Luminal B"]), ("HER2", ["Her2"]), ("TNBC", ["TNBC"])):
        part = _pairs(spark, sf, groups=tuple(groups)).withColumn("subtype", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def direction_interval(spark, sf):
    """The share of genes whose effect keeps its sign, with its exact interval."""
    return replication.exact_interval(replication.direction(_pairs(spark, sf)))


@query
def gene_level_summary(spark, sf):
    """The row of the second cohort's primary analysis, without its intervals."""
    return external.gene_level(frozen(spark, sf), ext(spark, sf)).drop("fraction_lo", "fraction_hi")


@query
def signature_intervals(spark, sf):
    """Percentile interval of each list's signature in the second cohort."""
    rows = _by_list(spark, sf)
    scores = replication.signature(replication.within_cohort_z(ext(spark, sf)), rows.select("list", "gene", "e_disc"), ["list"])
    return external.signature_intervals(kept(scores), study.N_BOOT_UNITS, SEED)


@query
def list_notes(spark, sf):
    """Every list with its number of genes, and a note where it is too small for statistics."""
    return external.list_level(frozen(spark, sf), ext(spark, sf), disc(spark, sf)).select("list", "n_genes", "n_up", "note")


@query
def panel_constants(spark, sf):
    """The composition panel, and how many usable probes of the annotation each of its genes has."""
    panel = spark.createDataFrame([(g, "core") for g in external.CORE_PANEL] + [(g, "wide") for g in external.WIDE_PANEL], "gene string, panel string")
    probes = cohort.usable_probes(tables.annotation(spark, sf)).groupBy("gene").agg(F.count(F.lit(1)).alias("n_probes"))
    return F.broadcast(panel).join(probes, "gene", "left").na.fill(0, ["n_probes"])


@query
def alternative_universe(spark, sf):
    """phi over all runs against the whole universe and against the genes eligible in any fold."""
    s = the_study(spark, sf)
    eligible = s.state.select("gene").distinct().count()
    return stability.scopes(sets(spark, sf), D + 6, eligible).select("pipeline", "k", "scope", "phi", "phi_alt")


@query
def misordered_samples(spark, sf):
    """Places where a matrix's columns and its metadata, which lacks one sample, name different samples."""
    v = tables.samples(values(spark, sf)).select("sample_id")
    place = lambda rows, name: running(rows, [F.col("sample_id")], position="pos").withColumnRenamed("sample_id", name)
    return place(v, "column").join(place(v.where("sample_id <> 7"), "sample"), "pos", "full_outer").where(~F.col("column").eqNullSafe(F.col("sample")))


@query
def subtype_replication(spark, sf):
    out = _subtypes(spark, sf)
    return replication.c1_c2(out, ["subtype"]).join(replication.direction(out, ["subtype"]).drop("n"), "subtype")


@query
def repA_replication(spark, sf):
    return replication.c1_c2(_pairs(spark, sf, "repA"))


@query
def bootstrap_c1(spark, sf):
    """Percentile intervals of C1 and C2 over resamples of the external units."""
    e = ext(spark, sf)
    w = splits.Draws(tables.samples(e), study.N_BOOT_UNITS, SEED)
    auc = replication.weighted_auc(e, w).withColumnRenamed("auc", "auc_ext")
    rows = auc.join(frozen(spark, sf).select("gene", "s", F.col("e").alias("e_disc")), "gene")
    return metrics.percentile_interval(replication.c1_c2(rows, ["b"]), [], ["c1", "c2_stability", "c2_partial"])


@shared
def _by_list(spark, sf):
    long = F.explode(F.array(*(F.when(F.col(f"in_{n}"), F.lit(n)) for n in ("S_cons", "S_top25", "S_top50"))))
    rows = _pairs(spark, sf).withColumn("list", long).where("list is not null")
    return rows


@query
def list_level_replication(spark, sf):
    rows = _by_list(spark, sf)
    sign = F.signum("e_disc")
    base = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n_genes"), F.avg(sign * F.col("e_ext")).alias("mean_aligned_effect"), F.avg(sign * F.col("g_ext")).alias("mean_aligned_g"), F.count_if(F.col("e_disc") > 0).alias("n_up"), F.count_if(F.col("e_disc") < 0).alias("n_down"))
    rho = replication.spearman(rows, "e_disc", "e_ext", ["list"]).select("list", F.when(F.col("n") > 2, F.col("rho")).alias("spearman"))
    genes = rows.select("list", "gene", "e_disc")
    auc = None
    for tag, cohort_rows in (("ext", ext(spark, sf)), ("disc", disc(spark, sf))):
        score = replication.signature(replication.within_cohort_z(cohort_rows), genes, ["list"])
        part = metrics.roc_auc(score, ["list"], f"signature_auc_{tag}")
        auc = part if auc is None else auc.join(part, "list")
    out = base.join(rho, "list").join(auc, "list").join(replication.direction(rows, ["list"]).drop("n"), "list")
    return out.where("n_genes >= 2")


@query
def signature_score(spark, sf):
    genes = frozen(spark, sf).where("in_S_top25").select("gene", F.col("e").alias("e_disc"))
    return replication.signature(replication.within_cohort_z(disc(spark, sf)), genes)


PANEL_GENES = tuple(g for g, _ in PANELS)


@query
def panel_score(spark, sf):
    return replication.panel_score(replication.within_cohort_z(disc(spark, sf)), PANEL_GENES)


@query
def panel_membership(spark, sf):
    s = consensus.universe_frequency(_table(spark, sf, 5), tables.probe_map(values(spark, sf)))
    return replication.panel_membership(lists(spark, sf), s, spark.createDataFrame(list(PANELS), "gene string, panel string"))


@query
def composition_block(spark, sf):
    """Panel and signature in both cohorts, and the signature without its panel component."""
    genes = frozen(spark, sf).where("in_S_top25").select("gene", F.col("e").alias("e_disc"))
    out = None
    for tag, rows in (("discovery", disc(spark, sf)), ("external", ext(spark, sf))):
        z = replication.within_cohort_z(rows)
        both = replication.signature(z, genes).join(replication.panel_score(z, PANEL_GENES).drop("y"), "sample_id").withColumn("cohort", F.lit(tag))
        left = replication.residual_scores(both, "score", "panel").withColumn("cohort", F.lit(tag))
        rho = replication.spearman(both, "score", "panel", ["cohort", "y"]).groupBy("cohort").pivot("y", [0, 1]).agg(F.first("rho"))
        part = metrics.roc_auc(both.withColumn("score", F.col("panel")), ["cohort"], "panel_auc").join(metrics.roc_auc(both, ["cohort"], "signature_auc"), "cohort").join(metrics.roc_auc(left, ["cohort"], "residual_auc"), "cohort")
        part = part.join(rho.withColumnRenamed("0", "spearman_normal").withColumnRenamed("1", "spearman_cancer"), "cohort")
        out = part if out is None else out.unionByName(part)
    return out


@query
def spearman_matrix(spark, sf):
    """Rank correlation of the first probe with each of the others."""
    v = disc(spark, sf)
    first = v.where("gene = 'G0'").select("sample_id", F.col("x").alias("x0"))
    return replication.spearman(v.where("gene <> 'G0'").join(first, "sample_id"), "x", "x0", ["gene"])


@query
def probe_correlation(spark, sf):
    """The largest Pearson correlation of each probe with a later one."""
    return replication.largest_correlations(values(spark, sf)).where("max_r is not null")


@shared
def _enriched(spark, sf):
    """Terms of the frozen list of 50 against all frozen genes."""
    f = frozen(spark, sf)
    return enrichment.enrich(f.where("in_S_top50").select("gene"), f.select("gene"), tables.library(spark, sf))


@query
def enrichment_terms(spark, sf):
    return _enriched(spark, sf)


@query
def enrichment_summary(spark, sf):
    """Per foreground and library: sizes, terms tested, significant ones, least adjusted p."""
    found = _enriched(spark, sf).agg(F.max("foreground_size").alias("n_foreground"), F.max("background_size").alias("n_background"), F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("adj_p") < 0.05).alias("n_significant"), F.min("adj_p").alias("min_adj_p"))
    return found.select(F.lit("S_top50").alias("foreground"), F.lit("parts").alias("library"), "*")


@query
def benjamini_hochberg(spark, sf):
    """Adjusted p of Welch's t of every probe on the whole cohort, by the normal tail's leading terms."""
    train = values(spark, sf).withColumn("repeat", F.lit(0)).withColumn("fold", F.lit(0))
    t = F.abs(attribution.welch_t())
    state = preprocess.probe_state(train, preprocess.floor_state(train))
    rows = state.select(F.col("probe_id").alias("term"), F.round(F.least(F.lit(1.0), F.exp(-t * t / 2) * 2 / (t + F.sqrt(t * t + 8 / F.lit(3.141592653589793)))), 12).alias("p_value"))
    return enrichment.benjamini_hochberg(rows)


@shared
def _null(spark, sf):
    """Stability of the t-test ranking in every replicate, all of them in one plan."""
    v = values(spark, sf)
    folds = splits.null_folds(tables.samples(v), N_SPLITS, study.N_NULL, SEED)
    only = study.pipelines(spark).where("pipeline = 'ttest|ttest'")
    return stability.repeat_level(stability.members(Study(v, folds=kept(folds)).ttest_rankings, KS), only, D)


@query
def null_repeat_level(spark, sf):
    return _null(spark, sf)


@query
def compare_observed_null(spark, sf):
    """Observed phi and Jaccard of the repeats against the permutation null of the same dimension, group and k."""
    observed = stability.repeat_level(stability.members(the_study(spark, sf).ttest_rankings, KS), study.pipelines(spark).where("pipeline = 'ttest|ttest'"), D)
    return stability.against_null(observed, _null(spark, sf))


@query
def customer_cohort_profile(spark, sf):
    """A cohort from orders: customers as samples, brands as features, spending as values; class moments and Welch t."""
    load = lambda n: tables.load(spark, sf, n)
    spent = load("lineitem").join(load("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(load("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    spent = spent.groupBy("o_custkey", "p_brand").agg(F.sum("l_extendedprice").alias("v"))
    rows = spent.join(load("customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y")), F.col("o_custkey") == F.col("c_custkey")).withColumn("x", F.round(F.log(1 + F.col("v")), 9))
    one, zero = F.when(F.col("y") == 1, F.col("x")), F.when(F.col("y") == 0, F.col("x"))
    m = rows.groupBy(F.col("p_brand").alias("gene")).agg(F.count(one).alias("n1"), F.count(zero).alias("n0"), F.avg(one).alias("mean1"), F.avg(zero).alias("mean0"), F.var_samp(one).alias("var1"), F.var_samp(zero).alias("var0"))
    return m.select("gene", "n1", "n0", "mean1", "mean0", attribution.welch_t().alias("t"))


@query
def document_cohort_metrics(spark, sf):
    """A cohort from labelled documents: the share of distinct words as a score of quality."""
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    rows = tables.load(spark, sf, "documents").join(tables.load(spark, sf, "labels"), "doc_id").where(F.size(words) > 0)
    score = F.round(F.size(F.array_distinct(words)) / F.size(words), 6)
    return metrics.classification(rows.select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("y"), score.alias("score"), (score > 0.4).cast("int").alias("pred"), F.lit("documents").alias("cohort")), ["cohort"], spread=True)


CONFIGS = [
    {"id": "logreg", "model": "logreg", "explainers": ("coef", "shap", "perm")},
    {"id": "svm", "model": "svm", "explainers": ("coef", "shap", "perm")},
    {"id": "rf", "model": "rf", "explainers": ("shap", "perm", "support")},
    {"id": "xgb", "model": "xgb", "explainers": ("shap", "perm", "support")},
    {"id": "ttest_lr", "model": "logreg", "top": 5},
    *({"id": f"logreg_C{c:g}", "model": "logreg", "explainers": ("coef",), "parameters": {"C": c}} for c in (0.01, 0.1, 10.0, 100.0)),
]


@shared
def packed_folds(spark, sf):
    """Every fold of every repeat."""
    s = the_study(spark, sf)
    return models.packed(s.train_z, s.test_z)


@shared
def fits(spark, sf):
    """Every configuration on every fold with its attributions; ensembles of the default numbers of trees."""
    return models.fit_folds(packed_folds(spark, sf), CONFIGS, study.N_PERM)


@shared
def linear_fits(spark, sf):
    """Logistic regression at every strength, coefficients alone."""
    return models.fit_folds(packed_folds(spark, sf), [c | {"explainers": ("coef",)} for c in CONFIGS if c["id"].startswith("logreg")], 0)


@shared
def scored_fits(spark, sf):
    """Every configuration on every fold, predictions alone; ensembles of the default numbers of trees."""
    return models.fit_folds(packed_folds(spark, sf), [c | {"explainers": ()} for c in CONFIGS], 0)


@query
def model_cv_metrics(spark, sf):
    """Logistic regression, squared-hinge machine, forest, boosted trees, t-test top-k regression: metrics pooled by repeat."""
    return metrics.classification(models.predictions(scored_fits(spark, sf)), ["config", "repeat"])


@query
def model_rankings(spark, sf):
    rows = models.attributions(fits(spark, sf)).where("explainer <> 'support'").withColumn("importance", F.round("importance", 9))
    return attribution.ranked(rows, ("config", "explainer", *FOLD)).where("importance > 0 and rank <= 10")


@query
def tree_support(spark, sf):
    return models.attributions(fits(spark, sf)).where("explainer = 'support'").groupBy("config", *FOLD).agg(F.sum("importance").cast("long").alias("n_used"))


@query
def model_stability(spark, sf):
    """Stability dimensions of the fitted models, the regularisation settings among them."""
    rows = models.attributions(fits(spark, sf)).where("explainer <> 'support'").withColumn("importance", F.round("importance", 9))
    ranked = attribution.ranked(rows, ("config", "explainer", *FOLD)).withColumn("pipeline", F.concat_ws("|", "config", "explainer"))
    model = F.when(F.col("config").startswith("logreg"), "logreg").otherwise(F.col("config"))
    pipes = ranked.select("pipeline", "explainer", model.alias("model"), F.when(F.col("config").startswith("logreg_C"), "sensitivity").otherwise("primary").alias("role"), F.lit(0).alias("position")).distinct()
    return stability.repeat_level(stability.members(ranked, KS), pipes, D)


@query
def c_grid_rank_agreement(spark, sf):
    """Spearman of absolute coefficients with those at C = 1, per setting and fold."""
    rows = models.attributions(linear_fits(spark, sf)).where("explainer = 'coef' and config like 'logreg%'").select("config", *FOLD, "gene", F.round("importance", 9).alias("importance"))
    ref = rows.where("config = 'logreg'").select(*FOLD, "gene", F.col("importance").alias("reference"))
    return replication.spearman(rows.join(ref, [*FOLD, "gene"]), "importance", "reference", ["config", *FOLD])


@query
def frozen_lr_transfer(spark, sf):
    """A regression on the frozen genes of the discovery half, applied to the external units after their own scaling: metrics with
    bootstrap intervals."""
    genes = frozen(spark, sf).where("in_S_top25").select("gene")
    return external.transfer(disc(spark, sf), ext(spark, sf), genes, study.N_BOOT_UNITS, SEED)


@query
def phi_by_k_pivot(spark, sf):
    """Mean phi per group as a column for each k, beside its spread over repeats at the larger."""
    level = stability.repeat_level(sets(spark, sf), study.pipelines(spark), D).where("dimension = 'resampling'")
    wide = level.groupBy("group").pivot("k", list(KS)).agg(F.avg("phi")).withColumnsRenamed({str(k): f"phi_k{k}" for k in KS})
    spread = level.where(F.col("k") == KS[-1]).groupBy("group").agg(F.min("phi").alias("low"), F.max("phi").alias("high"))
    return wide.join(spread, "group")


@query
def top_genes_by_frequency(spark, sf):
    """The genes that head the table, with every pipeline's own frequency."""
    head = _table(spark, sf, 5).where("position <= 8").select("gene", "position")
    freq = consensus.frequencies(the_study(spark, sf).rankings, 5)
    return head.join(freq, "gene").groupBy("gene", "position").pivot("pipeline", ["mdiff|coef", "mdiff|shap", "mdiff|perm", "auc|coef", "ttest|ttest"]).agg(F.first("freq")).na.fill(0.0).withColumnsRenamed({p[0]: p[0].replace("|", "_") for p in study.PIPELINES})


@query
def performance_summary(spark, sf):
    """Pooled metrics over repeats with the means of their bootstrap bounds."""
    m = metrics.classification(the_study(spark, sf).predictions, ["repeat"])
    ci = metrics.percentile_interval(_boot(spark, sf), ["repeat"], ["roc_auc", "balanced_accuracy"])
    names = ("roc_auc", "roc_auc_lo", "roc_auc_hi", "balanced_accuracy", "balanced_accuracy_lo", "balanced_accuracy_hi")
    return m.join(ci, "repeat").agg(F.count(F.lit(1)).alias("n_repeats"), *(F.avg(n).alias(n) for n in names))


@query
def regime_diagnostics(spark, sf):
    """Per regularisation setting, over folds: steps and convergence of the solver, norm of the coefficients, least margin on the
    training rows, how far the largest coefficients stand above the median, and their rank correlation with the class difference."""
    found = linear_fits(spark, sf)
    told = models.measures(found).groupBy("config", *FOLD).pivot("name", ["steps", "converged", "norm", "margin"]).agg(F.first("value"))
    rows = models.attributions(found).where("explainer = 'coef'")
    ranked = attribution.ranked(rows, ("config", *FOLD))
    fold = ranked.groupBy("config", *FOLD).agg(F.max(F.when(F.col("rank") == 5, F.col("importance"))).alias("top"), F.median("importance").alias("mid"))
    gap = the_study(spark, sf).weights.select(*FOLD, "gene", F.round(F.abs("w"), 9).alias("difference"))
    rho = replication.spearman(rows.withColumn("importance", F.round("importance", 9)).join(gap, [*FOLD, "gene"]), "importance", "difference", ["config", *FOLD]).drop("n")
    all_ = told.join(fold, ["config", *FOLD]).join(rho, ["config", *FOLD])
    return all_.groupBy("config").agg(
        F.avg("steps").alias("mean_steps"), F.sum((F.col("converged") < 1).cast("long")).alias("n_unconverged"), F.avg("norm").alias("mean_norm"), F.min("margin").alias("min_margin"), F.avg(F.col("top") / F.when(F.col("mid") > 0, F.col("mid"))).alias("top_to_median"),
        F.avg("rho").alias("rho_class_difference"), F.count(F.lit(1)).alias("n_folds"),
    )


@query
def c_grid_top_overlap(spark, sf):
    """Jaccard of the top genes by absolute coefficient with those at C = 1, per setting and fold; genes are the same in both."""
    rows = attribution.ranked(models.attributions(linear_fits(spark, sf)).where("explainer = 'coef'"), ("config", *FOLD)).where(F.col("rank") <= KS[0]).select("config", *FOLD, "gene")
    ref = rows.where("config = 'logreg'").select(*FOLD, "gene", F.lit(1).alias("_ref"))
    shared_genes = rows.join(ref, [*FOLD, "gene"], "left").groupBy("config", *FOLD).agg(F.count("_ref").alias("n_shared"))
    return shared_genes.withColumn("jaccard", F.col("n_shared") / (2 * KS[0] - F.col("n_shared")))
