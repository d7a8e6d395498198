"""The second cohort: its loaders behind the freeze, the freeze itself, and the analysis of what replicates, stored as one run."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kept import kept
from ..operators import attribution, cohort, consensus, enrichment, metrics, replication, splits
from ..sources import geo, tables
from . import provenance, study
from .provenance import FREEZE, FROZEN, Folder, FreezeError, Gate, History
from .report import freeze_text

LISTS = ("S_cons", "S_top25", "S_top50")
# The composition panel, its core and its extension.
CORE_PANEL = ("ADIPOQ", "PLIN1", "FABP4")
WIDE_PANEL = ("LEP", "LPL", "CFD", "ADH1B", "CIDEC", "PLIN4", "CD36", "GPD1")
#: Subtypes that are compared with the healthy units by themselves.
SUBTYPES = {"Luminal (A+B)": ("Luminal A", "Luminal B"), "HER2": ("Her2",), "TNBC": ("TNBC",)}


class CohortError(ValueError):
    """A cohort's files contradict each other."""


@dataclass(frozen=True)
class Cohort:
    """``values``: sample_id, probe_id, gene, y, x over the universe's probes; ``samples``: metadata with y; ``entrez`` by gene."""

    values: DataFrame
    samples: DataFrame
    entrez: DataFrame


def load_discovery(spark: SparkSession, matrix: str, universe: DataFrame, expected: str | None = None) -> Cohort:
    """The discovery cohort of a series matrix, restricted to the ``universe`` (probe_id, gene, entrez).

    Checked in this order, each failing with an error: the file's fingerprint (``expected``), the order of columns and samples, the
    labels, and that no probe of the universe is missing."""
    if expected:
        provenance.require_fingerprint(matrix, expected)
    header, values = geo.read_series_matrix(spark, matrix)
    if wrong := geo.misplaced(spark, matrix).limit(3).collect():
        raise geo.OrderError(f"columns and samples differ: {[tuple(r) for r in wrong]}")
    samples = kept(geo.sample_table(header))
    labels = cohort.checked_labels(samples)
    values = kept(values.join(universe.select("probe_id", "gene"), "probe_id"))  # of the universe only
    if lost := cohort.missing_probes(universe, values).limit(3).collect():
        raise CohortError(f"probes of the universe are absent, e.g. {[r[0] for r in lost]}")
    return Cohort(values.join(labels, "sample_id").select("sample_id", "probe_id", "gene", "y", "x"), samples.join(labels, "sample_id"), cohort.first_entrez(universe))


def load_external(gate: Gate, spark: SparkSession, matrix: str, groups: DataFrame, variant: str = "mean", expected: str | None = None) -> DataFrame:
    """Units of the second cohort, over the frozen probes: the gate has verified the freeze before any file is opened.

    ``groups``: sample_id, sample_group, title of every array."""

    def read() -> DataFrame:
        if expected:
            provenance.require_fingerprint(matrix, expected)
        if wrong := geo.misplaced(spark, matrix).limit(3).collect():
            raise geo.OrderError(f"columns and samples differ: {[tuple(r) for r in wrong]}")
        values = geo.read_series_matrix(spark, matrix)[1]
        arrays = kept(values.join(gate.frozen(spark).select("gene", "probe_id"), "probe_id").join(groups, "sample_id"))
        if bad := replication.unit_errors(arrays).limit(3).collect():
            raise CohortError(f"tumour arrays without a number: {[r[0] for r in bad]}")
        return replication.units(arrays, variant)

    return gate.open(read)


def create_freeze(values: DataFrame, run: str | Path | Folder, folder: str | Path | Folder, history: History, entrez: DataFrame | None = None, headline: int = 25, references: dict | None = None) -> dict:
    """Freeze what the second cohort will be asked: effects of every gene on the whole discovery cohort, one probe each, with the
    run's frequencies, consensus columns and list flags. Needs a tree without changes, now and when the run was made."""
    run, folder, spark = Folder.of(run), Folder.of(folder), values.sparkSession
    if history.has_changes():
        raise FreezeError("the working tree has changes: commit them first")
    manifest = run.get_json("manifest.json")
    if manifest["history"]["changed"]:
        raise FreezeError("the run was made from a tree with changes")
    rankings, pipes = run.read(spark, "rankings"), run.read(spark, "pipelines")
    ks = sorted(manifest["config"]["top_k"])
    effects = replication.effects(study.whole(values, manifest["config"]["preprocessing"].get("min_detect_frac_of_minority", 0.5)))
    table = kept(consensus.gene_table(rankings, pipes, headline))
    lists = kept(named_lists(consensus.frozen_lists(rankings, pipes, headline, ks[-1]), headline, ks[-1]))
    frozen = consensus.frozen_table(effects, table, lists, tables.probe_map(values))
    for k in ks:
        s = consensus.universe_frequency(consensus.gene_table(rankings, pipes, k), tables.probe_map(values)).withColumnRenamed("s", f"s_k{k}")
        frozen = frozen.join(s, "gene", "left")
    if entrez is not None:
        frozen = frozen.join(entrez, "gene", "left")
    stored = folder.write(FROZEN, frozen)
    parts = {f"{FROZEN}/{n}": folder.digest(f"{FROZEN}/{n}") for n in (folder / FROZEN).names() if n.endswith(".parquet")}
    members: dict[str, list[str]] = {name: [] for name in LISTS}
    for r in lists.orderBy("list", "position").collect():  # as long as the lists
        members[r["list"]].append(r["gene"])
    document = {
        "when": datetime.datetime.now(datetime.UTC).isoformat(), "commit": history.commit(), "files": parts, "run": {"folder": run.uri, "config_id": manifest["config_id"], "commit": manifest["history"]["commit"], "n_folds": manifest["n_folds"]},
        "data": manifest["data"], "n_genes": manifest["n_genes"], "n_eligible_genes": stored.count(), "top_k": ks, "headline_k": headline, "models": manifest["models"], "software": provenance.software(), "lists": members,
        "n_primary_pipelines": pipes.where("role = 'primary'").count(), "references": references or {},
        "rule": "no gene, size, threshold, preprocessing step or endpoint changes once the second cohort is open, and its results are reported whatever they are",
    }
    folder.put_json(FREEZE, document)
    folder.put("freeze.md", freeze_text(document))
    return document


def named_lists(lists: DataFrame, headline: int, largest: int) -> DataFrame:
    """The lists under their names in frozen tables, whatever the sizes."""
    name = F.when(F.col("list") == f"S_top{headline}", "S_top25").when(F.col("list") == f"S_top{largest}", "S_top50").otherwise(F.col("list"))
    return lists.withColumn("list", name)


def pairs(frozen: DataFrame, units: DataFrame) -> DataFrame:
    """The frozen columns of every gene with s, e_disc, and its effect in the second cohort: auc_ext, e_ext, g_ext, aligned_effect.
    ``units``: sample_id, gene, y, x."""
    auc = attribution.class_auc(units, "x", ("gene",)).select("gene", F.col("auc").alias("auc_ext"))
    g = replication.hedges_g(units).select("gene", F.col("g").alias("g_ext"))
    rows = frozen.withColumnRenamed("e", "e_disc").join(auc, "gene").join(g, "gene").withColumn("e_ext", F.round(F.col("auc_ext") - 0.5, 9))
    return rows.withColumn("aligned_effect", F.signum("e_disc") * F.col("e_ext"))


def gene_level(frozen: DataFrame, units: DataFrame, n_boot: int = 0, seed: int = 42) -> DataFrame:
    """One row: C1 and C2 with percentile intervals (if ``n_boot``), rank correlation of the effects, direction with its exact interval."""
    p = kept(pairs(frozen, units))
    point = replication.c1_c2(p).join(replication.spearman(p, "e_disc", "e_ext").select(F.col("rho").alias("spearman_effects")))
    agree = replication.exact_interval(replication.direction(p)).drop("n")
    counts = tables.samples(units).agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("y") == 0).alias("n_normal"))
    out = point.join(agree).join(counts)  # one row each
    if n_boot:
        draws = replication.weighted_auc(units, splits.Draws(tables.samples(units), n_boot, seed)).withColumnRenamed("auc", "auc_ext")
        rows = draws.join(p.select("gene", "s", "e_disc"), "gene")
        out = out.join(metrics.percentile_interval(replication.c1_c2(rows, ["b"]), [], ["c1", "c1_selected", "c2_stability", "c2_partial"]))
    return out


def signature_intervals(scores: DataFrame, n_boot: int, seed: int, by: tuple[str, ...] = ("list",)) -> DataFrame:
    """by, signature_auc_lo, signature_auc_hi: percentile interval of a score's AUC over stratified resamples of its samples; predicted
    is what lies over the median."""
    boot = metrics.bootstrap(scores.withColumn("pred", F.lit(0)), splits.Draws(tables.samples(scores), n_boot, seed), list(by))
    return metrics.percentile_interval(boot.withColumnRenamed("roc_auc", "signature_auc"), list(by), ["signature_auc"])


def list_level(frozen: DataFrame, units: DataFrame, disc: DataFrame, n_boot: int = 0, seed: int = 42) -> DataFrame:
    """A row for each list: what its genes' effects and their signature do in the second cohort; a list of under two genes has a note."""
    p = kept(pairs(frozen, units))
    rows = p.withColumn("list", F.explode(F.array(*(F.when(F.col(f"in_{n}"), F.lit(n)) for n in LISTS)))).where("list is not null")
    sizes = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n_genes"))
    rows = kept(rows.join(sizes.where("n_genes >= 2").select("list"), "list"))
    sign = F.signum("e_disc")
    out = rows.groupBy("list").agg(F.avg(sign * F.col("e_ext")).alias("mean_aligned_effect"), F.avg(sign * F.col("g_ext")).alias("mean_aligned_g"), F.count_if(F.col("e_disc") > 0).alias("n_up"), F.count_if(F.col("e_disc") < 0).alias("n_down"))
    rho = replication.spearman(rows, "e_disc", "e_ext", ["list"]).select("list", F.when(F.col("n") > 2, F.col("rho")).alias("spearman"))
    genes = rows.select("list", "gene", "e_disc")
    scores = {tag: kept(replication.signature(replication.within_cohort_z(c), genes, ["list"])) for tag, c in (("ext", units), ("disc", disc))}
    out = out.join(rho, "list").join(replication.exact_interval(replication.direction(rows, ["list"])).drop("n"), "list")
    for tag, score in scores.items():
        out = out.join(metrics.roc_auc(score, ["list"], f"signature_auc_{tag}"), "list")
    if n_boot:
        out = out.join(signature_intervals(scores["ext"], n_boot, seed).withColumnsRenamed({f"signature_auc_{e}": f"signature_auc_ext_{e}" for e in ("lo", "hi")}), "list")
    named = frozen.sparkSession.createDataFrame([(n,) for n in LISTS], "list string")
    note = F.when(F.coalesce("n_genes", F.lit(0)) < 2, F.lit("too few genes for statistics of a list"))
    return named.join(sizes, "list", "left").join(out, "list", "left").withColumn("n_genes", F.coalesce("n_genes", F.lit(0).cast("long"))).withColumn("note", note)


def composition(frozen: DataFrame, cohorts: dict[str, DataFrame], panel: tuple[str, ...], listed: str = "S_top25") -> DataFrame:
    """A row per cohort: AUC of the panel, of the signature, and of what is left of it without its panel component, and their rank
    correlation within each class. A cohort without any gene of the panel is an error."""
    genes = frozen.where(f"in_{listed}").select("gene", F.col("e").alias("e_disc"))
    out = None
    for tag, rows in cohorts.items():
        z = replication.within_cohort_z(rows)
        both = kept(replication.signature(z, genes).join(replication.panel_score(z, panel).drop("y"), "sample_id").withColumn("cohort", F.lit(tag)))
        left = replication.residual_scores(both, "score", "panel").withColumn("cohort", F.lit(tag))
        rho = replication.spearman(both, "score", "panel", ["cohort", "y"]).groupBy("cohort").pivot("y", [0, 1]).agg(F.first("rho"))
        part = metrics.roc_auc(both.withColumn("score", F.col("panel")), ["cohort"], "panel_auc").join(metrics.roc_auc(both, ["cohort"], "signature_auc"), "cohort").join(metrics.roc_auc(left, ["cohort"], "residual_auc"), "cohort")
        part = part.join(rho.withColumnRenamed("0", "spearman_normal").withColumnRenamed("1", "spearman_cancer"), "cohort")
        out = part if out is None else out.unionByName(part)
    return out


def transfer(disc: DataFrame, units: DataFrame, genes: DataFrame, n_boot: int = 0, seed: int = 42) -> DataFrame:
    """One row: metrics, with intervals if ``n_boot``, of a logistic regression on the discovery cohort's own z, applied to the second's,
    and the second's units, all and normal ones."""
    from ..operators import models

    shown = lambda rows: replication.within_cohort_z(rows.join(genes, "gene", "left_semi")).withColumn("repeat", F.lit(0)).withColumn("fold", F.lit(0))
    numbered = units.withColumn("sample_id", F.pmod(F.xxhash64(F.col("sample_id").cast("string")), F.lit(1 << 62)))
    found = models.fit_folds(models.packed(shown(disc), shown(numbered)), [{"id": "logreg", "model": "logreg", "explainers": ()}], 0, seed)
    predicted = kept(models.predictions(found).drop("repeat", "fold"))
    sizes = predicted.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 0).alias("n_normal"))
    out = metrics.classification(predicted, ["config"]).join(sizes, "config")
    if n_boot:
        boot = metrics.bootstrap(predicted, splits.Draws(tables.samples(predicted), n_boot, seed), ["config"])
        out = out.join(metrics.percentile_interval(boot, ["config"], ["roc_auc", "ap_normal", "balanced_accuracy"]), "config")
    return out


def run_external(gate: Gate, discovery: DataFrame, units_of: Callable[[str], DataFrame], folder: str | Path | Folder, n_boot: int = 1000, seed: int = 42, panel: tuple[str, ...] = CORE_PANEL + WIDE_PANEL, tree: str | Path = ".") -> Folder:
    """The whole analysis of the second cohort, stored: per_gene_external_effects, list_level_replication, sensitivity_gene_level,
    frozen_transfer, composition (if a panel gene is there), composition_panel, summary and manifest.

    ``discovery`` is the tall discovery cohort; ``units_of`` gives the units (unit_id, subtype, y, probe_id, gene, n_arrays, x) of a variant."""
    spark, folder = discovery.sparkSession, Folder.of(folder)
    frozen = kept(gate.frozen(spark))
    probes = frozen.select("probe_id")
    disc = kept(discovery.join(probes, "probe_id", "left_semi"))
    of = lambda variant: kept(gate.open(lambda: units_of(variant)).join(probes, "probe_id", "left_semi").withColumnRenamed("unit_id", "sample_id"))
    units = of("mean")
    effects = folder.write("per_gene_external_effects", pairs(frozen, units).select("gene", "probe_id", "e_disc", "s", "auc_ext", "e_ext", "aligned_effect"))
    primary = folder.write("primary_gene_level", gene_level(frozen, units, n_boot, seed))
    folder.write("list_level_replication", list_level(frozen, units, disc, n_boot, seed))
    few = min(n_boot, 200)
    rows = [gene_level(frozen, of("repA"), few, seed).withColumn("tag", F.lit("first arrays only"))]
    rows += [gene_level(frozen, units.where(F.col("subtype").isin(*names, replication.HEALTHY)), few, seed).withColumn("tag", F.lit(f"{label} and healthy")) for label, names in SUBTYPES.items() if units.where(F.col("subtype").isin(*names)).limit(1).collect()]
    folder.write("sensitivity_gene_level", reduce(DataFrame.unionByName, rows))
    moved = folder.write("frozen_transfer", transfer(disc, units, frozen.where("in_S_top25").select("gene"), n_boot, seed))
    present = [r["gene"] for r in frozen.where(F.col("gene").isin(*panel)).select("gene").orderBy("gene").collect()]  # of the panel
    if present:
        folder.write("composition", composition(frozen, {"external": units, "discovery": disc}, tuple(present)))
    lists = frozen.select("gene", F.explode(F.array_compact(F.array(*(F.when(F.col(f"in_{n}"), F.lit(n)) for n in LISTS)))).alias("list"))
    kinds = spark.createDataFrame([(g, "core" if g in CORE_PANEL else "wide") for g in panel], "gene string, panel string")
    member = replication.panel_membership(lists, frozen.select("gene", "s"), kinds)
    folder.write("composition_panel", member.join(effects.select("gene", "e_disc", "e_ext"), "gene", "left"))
    counts = units.select("sample_id", "y", "n_arrays").distinct().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 0).alias("normal"), F.count_if(F.col("y") == 1).alias("tumour")).first().asDict()
    folder.put_json("summary.json", {"primary_gene_level": primary.first().asDict(), "frozen_transfer": moved.first().asDict(), "panel_genes": present, "n_boot": n_boot})
    folder.put_json("manifest.json", {"freeze_commit": gate.document["commit"], "history": History(tree).state(), "software": provenance.software(), "units": counts, "stored": folder.names()})
    return folder


def run_enrichment(gate: Gate, libraries: dict[str, DataFrame], folder: str | Path | Folder, least_consensus: int = 10) -> DataFrame:
    """Terms of each frozen list against the frozen genes, per library: a stored table for each pair and ``enrichment_summary``, which
    is returned (foreground, library, n_foreground, n_background, n_terms, n_significant, min_adj_p). The consensus list takes part
    from ``least_consensus`` genes on."""
    spark, folder, out = next(iter(libraries.values())).sparkSession, Folder.of(folder), None
    frozen = kept(gate.frozen(spark))
    sizes = frozen.agg(*(F.count_if(F.col(f"in_{n}")).alias(n) for n in ("S_top50", "S_cons"))).first()
    lists = ["S_top50", *(["S_cons"] if sizes["S_cons"] >= least_consensus else [])]
    for library, terms in libraries.items():
        for name in lists:
            found = folder.write(f"{name}__{library}", enrichment.enrich(frozen.where(f"in_{name}").select("gene"), frozen.select("gene"), terms))
            part = found.agg(F.coalesce(F.max("foreground_size"), F.lit(0)).alias("n_foreground"), F.coalesce(F.max("background_size"), F.lit(0)).alias("n_background"), F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("adj_p") < 0.05).alias("n_significant"), F.min("adj_p").alias("min_adj_p"))
            part = part.select(F.lit(name).alias("foreground"), F.lit(library).alias("library"), "*")
            out = part if out is None else out.unionByName(part)
    summary = folder.write("enrichment_summary", out)
    folder.put_json("manifest.json", {"freeze_commit": gate.document["commit"], "libraries": sorted(libraries), "lists": {n: sizes[n] for n in lists}, "software": provenance.software(), "correction": "Benjamini-Hochberg within a library and list"})
    return summary
