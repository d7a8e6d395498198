"""Reports over stored runs, subsets as a setting, and the command line's commands."""

import pytest
import yaml

from featstab import cli
from featstab.plans import external, report, runs
from featstab.plans.provenance import Folder
from featstab.sources import tables

CONFIG = {
    "name": "small", "seed": 3, "cv": {"n_splits": 3, "n_repeats": 2}, "preprocessing": {}, "top_k": [3, 5], "store_top": 8, "n_perm": 1, "bootstrap": {"n_boot": 20},
    "configs": [{"id": "logreg", "model": "logreg", "explainers": ["coef", "shap"]}],
}


def command(spark, *words):
    return cli.execute(spark, cli.parser().parse_args(list(map(str, words))))


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    """Runs made by the commands."""
    folder = tmp_path_factory.mktemp("report")
    (folder / "c.yaml").write_text(yaml.safe_dump(CONFIG))
    for kind in ("month", "random_control"):
        (folder / f"{kind}.yaml").write_text(yaml.safe_dump(CONFIG | {"subset": {"kind": kind, "month": "04-12"}}))
        command(spark, "matrix", "--tables", sf, "--config", folder / f"{kind}.yaml", "--folder", folder / kind)
    command(spark, "matrix", "--tables", sf, "--config", folder / "c.yaml", "--folder", folder / "run")
    command(spark, "null", "--tables", sf, "--config", folder / "c.yaml", "--folder", folder / "null", "--replicates", 2)
    return folder


def test_report_of_a_run_and_its_null(spark, stored):
    text = command(spark, "report", "--folder", stored / "run", "--null", stored / "null", "--k", 5)
    assert text == (stored / "run" / "report.md").read_text() == command(spark, "report", "--folder", stored / "run", "--null", stored / "null", "--k", 5)
    titles = [line for line in text.splitlines() if line.startswith("## ")]
    assert len(titles) == 6 and "6 folds, 24 genes of 64 probes" in text
    lines = text.splitlines()
    shown = lines[lines.index("## Performance (held-out folds, mean of repeats)") + 4].split(" | ")
    pooled = Folder.of(stored / "run").read(spark, "pooled_metrics").where("config = 'logreg'").toPandas()
    assert shown[0] == "| logreg" and float(shown[1]) == pytest.approx(pooled["roc_auc"].mean(), abs=1e-3)
    genes = lines[lines.index("## The 30 most selected genes (k = 5)") + 4 :]
    first = Folder.of(stored / "run").read(spark, "analysis/gene_table_k5").where("position = 1").first()
    assert genes[0].startswith(f"| {first.gene} | ")


def test_subsets_and_their_table(spark, sf, stored):
    month, control, full = (Folder.of(stored / n).get_json("manifest.json")["samples"] for n in ("month", "random_control", "run"))
    assert month == control and sum(month.values()) < sum(full.values())
    samples = {n: {r.sample_id for r in Folder.of(stored / n).read(spark, "predictions").select("sample_id").distinct().collect()} for n in ("month", "random_control")}
    assert all(i % 3 for i in samples["month"]) and samples["month"] != samples["random_control"]
    table = report.date_sensitivity(spark, stored / "run", stored / "month", stored / "random_control", 5)
    rows = table.collect()
    assert {r.group for r in rows} == {"logreg|coef", "logreg|shap", "ttest|ttest"} and all(-1 <= r[c] <= 1 for r in rows for c in table.columns[1:])
    text = report.write_report(spark, stored / "run", 5, stored / "elsewhere", dates=table)
    assert "## Processing date (resampling phi, k = 5)" in text and (stored / "elsewhere" / "report.md").exists()
    with pytest.raises(ValueError, match="titles"):
        runs.run_matrix(tables.cohort(spark, sf), CONFIG | {"subset": {"kind": "month", "month": "04-12"}}, stored / "none")


def test_markdown(spark):
    table = spark.createDataFrame([("a|b", 0.12345, None, 3), ("c", 2.0, "x", None)], "name string, v double, s string, n int")
    assert report.markdown(table).splitlines() == ["| name | v | s | n |", "| - | - | - | - |", "| a\\|b | 0.123 |  | 3 |", "| c | 2 | x |  |"]
    assert report.markdown(table.where("false")) == "No rows."


def test_freeze_text():
    document = {
        "when": "2026-01-01", "commit": "abc", "rule": "no change", "run": {"folder": "f", "config_id": "i", "commit": "abc", "n_folds": 6}, "data": "d", "n_genes": 5, "n_eligible_genes": 4, "headline_k": 3, "top_k": [3], "n_primary_pipelines": 2,
        "models": {"m": {"C": 1}}, "lists": {name: [] for name in external.LISTS} | {"S_top25": ["G1", "G2"]}, "files": {"t/a": "ff"}, "software": {"python": "3"},
    }
    text = report.freeze_text(document)
    assert "- S_top25 (2): G1, G2" in text and "(0): none" in text and "`t/a`: SHA-256 `ff`" in text and "No change." in text


def test_commands_want_their_arguments(spark, tmp_path):
    with pytest.raises(SystemExit):
        command(spark, "matrix", "--folder", tmp_path)
