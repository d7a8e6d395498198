"""Reports of stored runs: a few tables made by plans over what runs have stored, and their Markdown.

Only what a report shows is collected: its tables have a row per pipeline, group or list, and heads of gene tables are as long as asked.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .provenance import Folder

MEASURES = ("roc_auc", "roc_auc_lo", "roc_auc_hi", "ap_normal", "balanced_accuracy", "sensitivity", "specificity", "f1_normal")
COMPARED = ("dimension", "group", "statistic", "observed_n", "observed_median", "observed_least", "observed_most", "null_n", "null_median", "null_p2_5", "null_p97_5", "null_most", "median_difference", "share_above")


def performance(spark: SparkSession, run: Folder) -> DataFrame:
    """config and the mean over repeats of each measure and of the bounds of its intervals."""
    return run.read(spark, "pooled_metrics").groupBy("config").agg(*(F.avg(m).alias(m) for m in MEASURES)).orderBy("config")


def resampling(spark: SparkSession, run: Folder, k: int) -> DataFrame:
    """group, mean phi at every k, and at ``k`` the median, range, deviation over repeats and mean size of the sets."""
    own = run.read(spark, "analysis/stability_summary").where("dimension = 'resampling'")
    by_k = own.groupBy("group").pivot("k", _ks(run)).agg(F.first("phi_mean"))
    by_k = by_k.select("group", *[F.col(f"`{n}`").alias(f"phi_k{n}") for n in _ks(run)])
    at_k = own.where(F.col("k") == k).select("group", *(F.col(c) for c in ("phi_median", "phi_min", "phi_max", "phi_sd", "mean_set_size")))
    return by_k.join(at_k, "group", "left").orderBy("group")


def within_folds(spark: SparkSession, run: Folder) -> DataFrame:
    """dimension, group and mean phi at every k of all comparisons within folds."""
    own = run.read(spark, "analysis/stability_summary").where("dimension <> 'resampling'")
    return own.groupBy("dimension", "group").pivot("k", _ks(run)).agg(F.first("phi_mean")).select("dimension", "group", *[F.col(f"`{n}`").alias(f"phi_k{n}") for n in _ks(run)]).orderBy("dimension", "group")


def date_sensitivity(spark: SparkSession, full: str | Path | Folder, month: str | Path | Folder, control: str | Path | Folder, k: int) -> DataFrame:
    """group and mean resampling phi at k: of all samples, of those of one processing month, and of as many random ones."""
    out = None
    for name, run in (("all_samples", full), ("one_month", month), ("as_many_random", control)):
        part = Folder.of(run).read(spark, "analysis/stability_summary").where((F.col("dimension") == "resampling") & (F.col("k") == k)).select("group", F.col("phi_mean").alias(name))
        out = part if out is None else out.join(part, "group", "left")
    return out.orderBy("group")


def _ks(run: Folder) -> list[int]:
    return sorted(run.get_json("manifest.json")["config"]["top_k"])


def markdown(table: DataFrame, digits: int = 3) -> str:
    """A table of a few rows; null is empty."""
    rows = table.collect()
    cell = lambda v: "" if v is None else f"{v:.{digits}f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|")
    if not rows:
        return "No rows."
    return "\n".join("| " + " | ".join(line) + " |" for line in (table.columns, ["-"] * len(table.columns), *([cell(v) for v in r] for r in rows)))


def sections(spark: SparkSession, run: Folder, k: int, head: int = 30, null: DataFrame | None = None, external: Folder | None = None, enriched: Folder | None = None, dates: DataFrame | None = None) -> dict[str, DataFrame]:
    """Title and table of every part for which there is something stored."""
    genes = run.read(spark, f"analysis/gene_table_k{k}")
    found = {"Performance (held-out folds, mean of repeats)": performance(spark, run), "Resampling stability (phi, mean of repeats)": resampling(spark, run, k), "Agreement within folds (phi)": within_folds(spark, run)}
    if null is not None:
        found[f"Observed and permuted labels (k = {k})"] = null.where(F.col("k") == k).select(*COMPARED).orderBy("statistic", "dimension", "group")
    shown = ("gene", "mean_selection_frequency", "n_pipelines_ge50", "n_models_ge50", "n_explainers_ge50", "median_rank", "best_rank", "ttest_frequency", "frac_signed_positive", "consensus")
    found[f"The {head} most selected genes (k = {k})"] = genes.where(F.col("position") <= head).orderBy("position").select(*shown)
    found["Consensus"] = genes.agg(F.count_if("consensus").alias("genes_of_the_consensus"), F.count(F.lit(1)).alias("genes_ever_selected"))
    if external is not None:
        for title, name in (("Second cohort: all genes", "primary_gene_level"), ("Second cohort: lists", "list_level_replication"), ("Second cohort: transfer of the frozen model", "frozen_transfer")):
            found[title] = external.read(spark, name)
        if external.has("composition"):
            found["Composition"] = external.read(spark, "composition")
    if enriched is not None:
        found["Enrichment"] = enriched.read(spark, "enrichment_summary").orderBy("library", "foreground")
    if dates is not None:
        found[f"Processing date (resampling phi, k = {k})"] = dates
    return found


def write_report(spark: SparkSession, run: str | Path | Folder, k: int, folder: str | Path | Folder | None = None, **more: object) -> str:
    """report.md in ``folder`` (else the run's): where the results come from, then the sections. Returns the text. A rerun over the same
    tables gives the same text."""
    run = Folder.of(run)
    told = run.get_json("manifest.json")
    lines = [f"# {told['config']['name']}", "", f"{told['n_folds']} folds, {told['n_genes']} genes of {told['n_probes']} probes, samples by class {told['samples']}; settings `{told['config_id'][:12]}`, data `{told['data']}`, commit `{(told['history'].get('commit') or 'none')[:12]}`{' with changes' if told['history'].get('changed') else ''}."]
    for title, table in sections(spark, run, k, **more).items():
        lines += ["", f"## {title}", "", markdown(table)]
    text = "\n".join(lines) + "\n"
    (Folder.of(folder) if folder is not None else run).put("report.md", text)
    return text


def freeze_text(document: dict) -> str:
    """A freeze's document for readers."""
    run = document["run"]
    lines = [
        "# Freeze", "", f"Made {document['when']} on commit `{document['commit']}`, from a tree without changes. {document['rule'][0].upper()}{document['rule'][1:]}.", "",
        f"Run: `{run['folder']}`, settings `{run['config_id']}`, commit `{run['commit']}`, {run['n_folds']} folds. Data: `{document['data']}`. Genes: {document['n_genes']}, of which {document['n_eligible_genes']} are frozen with an effect. Lists are taken at k = {document['headline_k']} of {document['top_k']}; {document['n_primary_pipelines']} pipelines decide the consensus.",
        "", "## Models", "", *(f"- `{name}`: {how}" for name, how in sorted(document["models"].items())), "", "## Lists", "",
    ]
    for name, genes in document["lists"].items():
        lines.append(f"- {name} ({len(genes)}): {', '.join(genes) or 'none'}")
    lines += ["", "## Files", "", *(f"- `{name}`: SHA-256 `{digest}`" for name, digest in sorted(document["files"].items())), "", "## Software", "", *(f"- {name} {version}" for name, version in sorted(document["software"].items()))]
    return "\n".join(lines) + "\n"
