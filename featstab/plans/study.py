"""The study's steps chained: from a tall cohort to learned folds, rankings of closed-form pipelines, scores and tables.

Repeats, folds, pipelines and k are columns; nothing here loops over them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kept import kept
from ..operators import attribution, membership, preprocess, replication, splits
from ..sources import tables

#: Folds, repeats, permutations of a gene, bootstrap draws of metrics and of the second cohort's units, replicates of the null.
N_SPLITS, N_REPEATS, SEED, N_PERM, N_BOOT, N_BOOT_UNITS, N_NULL = 5, 20, 42, 10, 2000, 1000, 30
KS = (5, 10)
PIPELINES = (("mdiff|coef", "mdiff", "coef", "primary"), ("mdiff|shap", "mdiff", "shap", "primary"), ("mdiff|perm", "mdiff", "perm", "primary"), ("auc|coef", "auc", "coef", "primary"), ("ttest|ttest", "ttest", "ttest", "baseline"))
FOLD = ("repeat", "fold")


def pipelines(spark: SparkSession) -> DataFrame:
    """The table of closed-form pipelines."""
    return spark.createDataFrame([(*p, i) for i, p in enumerate(PIPELINES)], "pipeline string, model string, explainer string, role string, position int")


class Study:
    """Lazy tables over one cohort; each property is a plan, computed when asked for.

    What is learned, ranked and predicted is small next to the values and read by several steps, so it is written once; values,
    training rows and their z-scores never are."""

    def __init__(self, values: DataFrame, n_repeats: int = N_REPEATS, seed: int = SEED, fraction: float = 0.5, rule: str = "mean", folds: DataFrame | None = None):
        self.values, self.fraction, self.rule = values, fraction, rule
        self.labels = tables.samples(self.values)
        self.folds = splits.stratified_folds(self.labels, N_SPLITS, n_repeats, seed) if folds is None else folds

    @property
    def train(self) -> DataFrame:
        return splits.training(self.values, self.folds, N_SPLITS)

    @cached_property
    def floor(self) -> DataFrame:
        return kept(preprocess.fold_floors(self.values, self.folds, N_SPLITS, self.fraction))

    @cached_property
    def probes(self) -> DataFrame:
        return kept(preprocess.fold_probes(self.values, self.folds, self.floor, N_SPLITS))

    @property
    def kept(self) -> DataFrame:
        return preprocess.detected(self.probes, self.floor)

    @cached_property
    def state(self) -> DataFrame:
        return kept(preprocess.scaling(preprocess.collapsed(self.kept, self.rule)))

    @property
    def weights(self) -> DataFrame:
        return attribution.mean_difference(self.state)

    @property
    def train_z(self) -> DataFrame:
        return preprocess.applied(self.train, self.state)

    @property
    def test_z(self) -> DataFrame:
        return preprocess.applied(splits.testing(self.values, self.folds), self.state)

    @property
    def moves(self) -> DataFrame:
        return splits.permutations(splits.training(self.labels.select("sample_id"), self.folds, N_SPLITS), N_PERM, SEED)

    @cached_property
    def at_once(self) -> DataFrame:
        """repeat, fold, gene, auc, shap, shap_signed, raw of every training set, from packed columns; from rows where a set is too large for a task."""
        n = self.labels.count()
        genes = self.state.groupBy(*FOLD).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if membership.what(n, genes) <= membership.MOST_BYTES:
            return kept(membership.fold_attributions(self.values, self.folds, self.state, draws=(N_PERM, SEED)))
        z, w = self.train_z, self.weights
        shap = attribution.linear_shap(z, w).select(*FOLD, "gene", F.col("importance").alias("shap"), F.col("signed").alias("shap_signed"))
        raw = attribution.linear_permutation(z, w, self.moves).select(*FOLD, "gene", F.col("signed").alias("raw"))
        return kept(attribution.class_auc(z).join(shap, [*FOLD, "gene"]).join(raw, [*FOLD, "gene"]))

    @property
    def train_auc(self) -> DataFrame:
        return self.at_once.where("auc is not null").select(*FOLD, "gene", "auc")

    @property
    def shap(self) -> DataFrame:
        return attribution.shown(self.at_once, F.col("shap"), F.col("shap_signed"))

    @property
    def permutation(self) -> DataFrame:
        return attribution.permutation_importance(self.at_once)

    @cached_property
    def rankings(self) -> DataFrame:
        """repeat, fold, pipeline, model, explainer, gene, importance, signed, rank of all closed-form pipelines."""
        parts = {
            "mdiff|coef": attribution.coefficients(self.weights), "mdiff|shap": self.shap, "mdiff|perm": self.permutation,
            "auc|coef": attribution.auc_importance(self.train_auc), "ttest|ttest": attribution.ttest(self.state),
        }
        out = None
        for name, model, explainer, _ in PIPELINES:
            part = parts[name].select(F.lit(name).alias("pipeline"), F.lit(model).alias("model"), F.lit(explainer).alias("explainer"), "repeat", "fold", "gene", "importance", "signed")
            out = part if out is None else out.unionByName(part)
        return kept(attribution.ranked(out, ("pipeline", *FOLD)))

    @cached_property
    def ttest_rankings(self) -> DataFrame:
        return kept(attribution.ranked(attribution.ttest(self.state)).withColumn("pipeline", F.lit("ttest|ttest")))

    @cached_property
    def predictions(self) -> DataFrame:
        """repeat, fold, sample_id, y, score, pred of the test rows: the linear score of the mean-difference model."""
        f = attribution.margins(self.test_z, self.weights)
        return kept(f.select(*FOLD, "sample_id", "y", F.round(attribution.sigmoid(F.col("f")), 9).alias("score"), (F.col("f") > 0).cast("int").alias("pred")))


def whole(values: DataFrame, fraction: float = 0.5) -> DataFrame:
    """A cohort collapsed to one probe per gene, learned on all of its samples."""
    train = values.withColumn("repeat", F.lit(0)).withColumn("fold", F.lit(0))
    state = preprocess.fitted(train, fraction)
    return values.join(state.select("probe_id"), "probe_id", "left_semi")


def external_units(spark: SparkSession, sf_dir: str, variant: str = "mean") -> DataFrame:
    return replication.units(tables.external_arrays(tables.cohort(spark, sf_dir)), variant)

