import gzip
import random
import shutil
import subprocess
from functools import partial

import pytest
from pyspark.sql import functions as F

from featstab.functions import kept as kept_module
from featstab.operators import cohort, models
from featstab.plans import external, provenance, runs
from featstab.plans.provenance import Folder, History
from featstab.sources import files, geo, tables

PROBES = {"201_at": "ALPHA", "202_s_at": "BETA", "203_x_at": "GAMMA", "204_at": "ALPHA", "AFFX-ctl_at": None}
SAMPLES = [f"S{7 * i + 3}" for i in range(9)]


def matrix(folder, columns=None, tissues=None, described=None):
    """A gzipped series matrix of nine samples, four normal, over five probes."""
    random.seed(3)
    cancer = [i >= 4 for i in range(9)]
    tissues = tissues or ["Breast Cancer" if c else "normal breast" for c in cancer]
    line = lambda key, cells: key + "\t" + "\t".join(f'"{c}"' for c in cells)
    rows = [
        line("!Series_title", ["made up"]), line("!Sample_title", [f"{'Breast cancer' if c else 'Normal'} {i}" for i, c in enumerate(cancer)]), line("!Sample_geo_accession", SAMPLES),
        line("!Sample_source_name_ch1", ["a cancer" if c else "a healthy donor" for c in cancer]), line("!Sample_characteristics_ch1", [f"tissue: {t}" for t in tissues]),
        line("!Sample_characteristics_ch1", [f"stage: {i}" if c else f"donor: {i}" for i, c in enumerate(cancer)]), line("!Sample_description", described or ["some cancer" if c else "none" for c in cancer]),
        "!series_matrix_table_begin", line('"ID_REF"', columns or SAMPLES),
    ]
    rows += [line(f'"{p}"', [round(random.gauss(6, 1), 3) if p != "203_x_at" or i else "" for i in range(9)]) for p in PROBES]
    path = folder / "made_up_series_matrix.txt.gz"
    path.write_bytes(gzip.compress("\n".join([*rows, "!series_matrix_table_end", ""]).encode()))
    return str(path)


def universe(spark):
    return spark.createDataFrame([(p, g, str(i)) for i, (p, g) in enumerate(PROBES.items()) if g], "probe_id string, gene string, entrez string")


def test_series_matrix(spark, tmp_path):
    path = matrix(tmp_path)
    header, values = geo.read_series_matrix(spark, path)
    assert values.count() == 45 and values.where("probe_id = '203_x_at' and x is null").first().sample_id == "S3"
    assert {r.sample_id for r in values.collect()} == set(SAMPLES) and geo.misplaced(spark, path).count() == 0
    table = {r.sample_id: r for r in geo.sample_table(header).collect()}
    assert table["S3"]["tissue"] == "normal breast" and table["S59"]["donor|stage"] == "8" and table["S3"]["donor|stage"] == "0" and table["S3"]["source_name"] == "a healthy donor"
    assert {r.probe_id for r in geo.read_probe_ids(spark, path).collect()} == set(PROBES)


def test_platform_and_missing_table(spark, tmp_path):
    path = tmp_path / "platform.txt"
    path.write_text('^Annotation\n!platform_table_begin\nID\tDescription\tGene symbol\tGene ID\n201_at\tx\tALPHA\t31\n202_s_at\t\tB"ETA///DELTA\t32///40\n203_x_at\ty\t\t\n204_at\tshort\n!platform_table_end\n')
    assert {(r.probe_id, r.symbol, r.entrez) for r in geo.read_platform(spark, str(path)).collect()} == {("201_at", "ALPHA", "31"), ("202_s_at", 'B"ETA///DELTA', "32///40"), ("203_x_at", "", ""), ("204_at", "", "")}
    path.write_text("!Series_title\t1\n")
    with pytest.raises(Exception, match="no table"):
        geo.rows(spark, str(path)).collect()


def test_discovery_loader_checks_everything(spark, tmp_path):
    path = matrix(tmp_path)
    got = external.load_discovery(spark, path, universe(spark), provenance.fingerprint(path))
    assert got.values.count() == 36 and {(r.sample_id, r.y) for r in got.values.select("sample_id", "y").distinct().collect()} == {(s, int(i >= 4)) for i, s in enumerate(SAMPLES)}
    assert {(r.gene, r.entrez) for r in got.entrez.collect()} == {("ALPHA", "0"), ("BETA", "1"), ("GAMMA", "2")}
    with pytest.raises(ValueError, match="expected file"):
        external.load_discovery(spark, path, universe(spark), "0" * 64)
    with pytest.raises(geo.OrderError):
        external.load_discovery(spark, matrix(tmp_path, columns=SAMPLES[1:] + SAMPLES[:1]), universe(spark))
    with pytest.raises(cohort.LabelError):
        external.load_discovery(spark, matrix(tmp_path, described=["none"] * 9), universe(spark))
    with pytest.raises(cohort.LabelError):
        external.load_discovery(spark, matrix(tmp_path, tissues=["another tissue"] * 9), universe(spark))
    with pytest.raises(external.CohortError):
        external.load_discovery(spark, matrix(tmp_path), universe(spark).union(spark.createDataFrame([("999_at", "X", "9")])))


CONFIG = {
    "name": "small", "seed": 7, "cv": {"n_splits": 3, "n_repeats": 1}, "preprocessing": {"min_detect_frac_of_minority": 0.5, "collapse_rule": "mean"}, "top_k": [3, 5], "store_top": 8, "n_perm": 2, "bootstrap": {"n_boot": 10},
    "configs": [{"id": "logreg", "model": "logreg", "explainers": ["coef", "perm"]}, {"id": "rf", "model": "rf", "explainers": ["shap"], "parameters": {"n_trees": 5}}],
}


def fit_times(folder):
    """Files of fits by time."""
    return sorted((str(p), p.stat().st_mtime_ns) for p in folder.rglob("fits/*/*.parquet"))


def test_run_recovers_signal_and_resumes_by_fold(spark, sf, tmp_path):
    values = tables.cohort(spark, sf)
    folder = runs.run_matrix(values, CONFIG | {"baseline": {"ttest_lr": 4}}, tmp_path / "run")
    read = partial(folder.read, spark)
    top = {r.gene for r in read("rankings").where("pipeline = 'logreg|coef' and rank <= 5").collect()}
    assert {"G0", "G2", "G4"} <= top  # raised by the planted shift, so their probes have the largest means too
    assert {"probe", "n_detected_train"} <= set(read("rankings").columns)
    assert read("pooled_metrics").where("config = 'logreg'").first().roc_auc > 0.7
    assert {(r.config, r.n_features_used) for r in read("fold_metrics").where("config <> 'rf'").collect()} == {("logreg", 24), ("ttest_lr", 4)}
    assert read("predictions").groupBy("config", "repeat", "sample_id").count().where("count <> 1").count() == 0
    assert {r.stage for r in read("timings").collect()} == {"fit", "explain", "shap", "perm"}
    assert all(read(f"analysis/{n}").count() > 0 for n in ("repeat_level_stability", "gene_table_k5", "fold_metric_summary", "frozen_list_candidates"))
    manifest = folder.get_json("manifest.json")
    assert manifest["n_folds"] == 3 and manifest["models"]["rf"] == {"n_trees": 5} and set(manifest["seconds"]) == {"preprocess", "fit", "tables", "analysis"} and "top_k" in folder.get("config.yaml")
    rows, before = sorted(map(str, read("predictions").collect())), fit_times(tmp_path / "run")
    for path, _ in before[:1]:  # one file of fits is lost: its folds alone are fitted again
        lost = spark.read.parquet(path).select("config", "repeat", "fold").distinct().count()
        (tmp_path / "run" / path).unlink()
    runs.run_matrix(values, CONFIG | {"baseline": {"ttest_lr": 4}}, folder)
    after = fit_times(tmp_path / "run")
    assert lost and set(before[1:]) <= set(after) and len(after) > len(before) - 1
    assert sorted(map(str, read("predictions").collect())) == rows


def test_a_folder_never_gives_back_fits_of_other_settings(spark, sf, tmp_path):
    values = tables.cohort(spark, sf)
    small = CONFIG | {"top_k": [3], "configs": [{"id": "logreg", "model": "logreg", "explainers": ["coef"], "parameters": {"C": 0.001}}]}
    scores = lambda place: sorted((r.sample_id, r.fold, round(r.score, 9)) for r in place.read(spark, "predictions").collect())
    first = scores(runs.run_matrix(values, small, tmp_path / "one"))
    changed = small | {"configs": [small["configs"][0] | {"parameters": {"C": 100.0}}], "seed": 8}
    second = scores(runs.run_matrix(values, changed, tmp_path / "one"))
    assert first != second == scores(runs.run_matrix(values, changed, tmp_path / "two"))
    shifted = values.withColumn("x", F.when(F.col("sample_id") == 0, F.col("x") + 1).otherwise(F.col("x")))
    assert scores(runs.run_matrix(shifted, changed, tmp_path / "one")) != second


def test_a_run_stopped_in_its_first_write_goes_on(spark, sf, tmp_path):
    values = tables.cohort(spark, sf)
    small = CONFIG | {"top_k": [3], "configs": CONFIG["configs"][:1], "wave": 2}
    place = runs.run_matrix(values, small, tmp_path / "run")
    key = next((tmp_path / "run" / "fits").iterdir())
    for f in [*key.iterdir()]:
        f.unlink()
    (key / "_temporary" / "0").mkdir(parents=True)
    (tmp_path / "run" / "manifest.json").unlink()
    runs.run_matrix(values, small, place)
    assert place.has("manifest.json") and place.read(spark, "predictions").select("fold").distinct().count() == 3


def test_config_errors():
    for change in ({"store_top": 2}, {"configs": CONFIG["configs"][:1] * 2}, {"configs": [{"id": "a", "model": "rf", "explainers": ["coef"]}]}, {"cohort": "external"}, {"labels": "guessed"}):
        with pytest.raises(ValueError):
            runs.checked(CONFIG | change)
    for bad in (None, {}, {k: v for k, v in CONFIG.items() if k != "seed"}):
        with pytest.raises(ValueError):
            runs.checked(bad)


def test_identity_and_files(tmp_path):
    assert provenance.identity({"a": 1, "b": [2, {"c": None}]}) == provenance.identity({"b": [2, {"c": None}], "a": 1})
    different = [{"a": 1}, {"a": 1.0}, {"a": "1"}, {"a": [1]}, {"a": [1, []]}, {"a": [[1]]}, {"a": None}, {}, {"a": {"b": 1}}, {"a.b": 1, "c": 2}]
    assert len({provenance.identity(x) for x in different}) == len(different)
    (tmp_path / "f").write_bytes(b"abc")
    assert provenance.fingerprint(tmp_path / "f") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    for name in ("20240101T000000Z_x_00000000", "20250101T000000Z_x_00000000", "20260101T000000Z_y_00000000", "20270101T000000Z_x_unfinished"):
        (tmp_path / name).mkdir()
        if "unfinished" not in name:
            Folder.of(tmp_path / name).put_json("manifest.json", {})
    assert provenance.latest(tmp_path, "_x_").uri.endswith("20250101T000000Z_x_00000000") and provenance.latest(tmp_path).uri.endswith("_y_00000000")
    with pytest.raises(FileNotFoundError):
        provenance.latest(tmp_path, "_z_")


@pytest.fixture(scope="module")
def discovery_run(spark, sf, tmp_path_factory):
    """The discovery half, and a run on it from a tree without changes."""
    folder = tmp_path_factory.mktemp("discovery")
    tree = folder / "tree"
    tree.mkdir()
    git = lambda *words: subprocess.run(["git", "-C", str(tree), "-c", "user.name=a", "-c", "user.email=a@example.org", *words], check=True, capture_output=True)
    git("init", "-q")
    (tree / "code").write_text("1")
    git("add", "code")
    git("commit", "-qm", "first")
    disc = tables.discovery_half(tables.cohort(spark, sf))
    return tree, disc, runs.run_matrix(disc, CONFIG, folder / "run", tree)


@pytest.fixture
def history(discovery_run, tmp_path):
    """A copy of the tree that a test may change."""
    shutil.copytree(discovery_run[0], tmp_path / "tree")
    return History(tmp_path / "tree")


@pytest.fixture
def frozen_run(discovery_run, tmp_path, history):
    _, disc, run = discovery_run
    return disc, run, external.create_freeze(disc, run, tmp_path / "freeze", history, headline=3)


def test_freeze_gate(spark, sf, tmp_path, history, frozen_run):
    disc, run, document = frozen_run
    place = Folder.of(tmp_path / "freeze")
    assert document["commit"] == history.commit() and set(document["lists"]) == set(external.LISTS) and document["lists"]["S_top25"]
    gate = external.Gate(place, history.holds)
    frozen = gate.frozen(spark)
    assert {"e", "g", "s", "s_k3", "s_k5", "in_S_cons", "consensus"} <= set(frozen.columns) and frozen.count() == document["n_eligible_genes"]
    with pytest.raises(provenance.FreezeError, match="no freeze"):
        external.Gate(tmp_path / "none", history.holds)
    with pytest.raises(provenance.FreezeError, match="history"):
        external.Gate(place, lambda commit: False)
    place.put_json("freeze.json", document | {"commit": "0" * 40})
    with pytest.raises(provenance.FreezeError, match="history"):
        external.Gate(place, history.holds)
    place.put_json("freeze.json", document)
    part = next(p for p in (tmp_path / "freeze" / "frozen_genes").iterdir() if p.suffix == ".parquet")
    part.with_name("part-more.parquet").write_bytes(part.read_bytes())
    with pytest.raises(provenance.FreezeError, match="changed"):
        external.Gate(place, history.holds)
    part.with_name("part-more.parquet").unlink()
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(provenance.FreezeError, match="changed"):
        external.Gate(place, history.holds)
    (tmp_path / "tree" / "code").write_text("2")
    with pytest.raises(provenance.FreezeError, match="changes"):
        external.create_freeze(disc, run, tmp_path / "freeze2", history)


def test_external_analysis_end_to_end(spark, sf, tmp_path, history, frozen_run):
    disc, _, document = frozen_run
    gate = external.Gate(tmp_path / "freeze", history.holds)
    arrays = tables.external_arrays(tables.cohort(spark, sf))
    from featstab.operators import replication

    out = external.run_external(gate, disc, lambda variant: replication.units(arrays, variant), tmp_path / "external", n_boot=20, panel=("G1", "G4", "G99"), tree=history.tree)
    read = partial(out.read, spark)
    assert read("per_gene_external_effects").count() == document["n_eligible_genes"]
    primary = read("primary_gene_level").first()
    assert primary.c1_lo <= primary.c1 <= primary.c1_hi and primary.fraction_lo <= primary.fraction <= primary.fraction_hi and -1 <= primary.spearman_effects <= 1
    lists = {r["list"]: r for r in read("list_level_replication").collect()}
    assert set(lists) == set(external.LISTS)
    for r in lists.values():
        assert (r.note is None) == (r.n_genes >= 2) and (r.note is not None or r.signature_auc_ext_lo <= r.signature_auc_ext <= r.signature_auc_ext_hi)
    tags = {r.tag for r in read("sensitivity_gene_level").collect()}
    assert "first arrays only" in tags and len(tags) >= 3
    moved = read("frozen_transfer").first()
    assert moved.roc_auc_lo <= moved.roc_auc <= moved.roc_auc_hi and moved.roc_auc > 0.6
    assert {r.cohort for r in read("composition").collect()} == {"external", "discovery"}
    panel = {r.gene: r for r in read("composition_panel").collect()}
    assert panel["G99"].e_ext is None and not panel["G99"].in_universe and panel["G1"].e_ext is not None
    assert out.get_json("summary.json")["panel_genes"] == ["G1", "G4"] and out.get_json("manifest.json")["freeze_commit"] == document["commit"]
    summary = external.run_enrichment(gate, {"made_up": tables.library(spark, sf)}, tmp_path / "enrichment").collect()
    assert [(r.foreground, r.library) for r in summary] == [("S_top50", "made_up")] and summary[0].n_background <= document["n_eligible_genes"]
    groups = spark.createDataFrame([("S1", "TNBC", "TUM1_repA"), ("S2", "Healthy", "x")], "sample_id string, sample_group string, title string")
    assert callable(external.load_external) and groups.count() == 2


def test_external_loader_restricts_to_frozen_probes(spark, tmp_path, history, frozen_run):
    gate = external.Gate(tmp_path / "freeze", history.holds)
    probes = [r.probe_id for r in gate.frozen(spark).select("probe_id").orderBy("probe_id").limit(2).collect()]
    rows = ["!Sample_geo_accession\tA1\tA2\tA3", "!series_matrix_table_begin", "ID_REF\tA1\tA2\tA3", f"{probes[0]}\t1\t3\t7", f"{probes[1]}\t2\t2\t9", "other_at\t0\t0\t0", "!series_matrix_table_end", ""]
    (tmp_path / "m.txt").write_text("\n".join(rows))
    groups = spark.createDataFrame([("A1", "TNBC", "TUM5_repA"), ("A2", "TNBC", "TUM5_repB"), ("A3", "Healthy", "h")], "sample_id string, sample_group string, title string")
    found = lambda variant: {(r.unit_id, r.probe_id): (r.x, r.n_arrays, r.y) for r in external.load_external(gate, spark, str(tmp_path / "m.txt"), groups, variant).collect()}
    assert found("mean") == {("TUM5", probes[0]): (2.0, 2, 1), ("TUM5", probes[1]): (2.0, 2, 1), ("A3", probes[0]): (7.0, 1, 0), ("A3", probes[1]): (9.0, 1, 0)}
    assert found("repA")[("TUM5", probes[0])] == (1.0, 1, 1)
    with pytest.raises(external.CohortError):
        external.load_external(gate, spark, str(tmp_path / "m.txt"), groups.withColumn("title", F.lit("no number")))


def test_small_sources(spark, tmp_path):
    (tmp_path / "u.tsv").write_text('probe_id\tgene\n1_at\tG"1\n2_at\t\n')
    assert {(r.probe_id, r.gene) for r in files.feature_universe(spark, str(tmp_path / "u.tsv")).collect()} == {("1_at", 'G"1'), ("2_at", "")}
    (tmp_path / "l.gmt").write_text("A\tabout\tG1\tG2\tG2\nB\t\tG3\n")
    want = {("A", "G1"), ("A", "G2"), ("B", "G3")}
    assert {tuple(r) for r in files.gmt_library(spark, str(tmp_path / "l.gmt")).collect()} == want
    (tmp_path / "l.json").write_text('{"source": "x", "terms": {"A": ["G1", "G2"], "B": ["G3"]}}')
    assert {tuple(r) for r in files.cached_library(spark, str(tmp_path / "l.json")).collect()} == want
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert files.result_table(spark, str(tmp_path / "t.csv"), "a int, b string").first().a == 1


def test_null_regularisation_comparison_and_experiment(spark, sf, tmp_path):
    values = tables.cohort(spark, sf)
    small = CONFIG | {"configs": CONFIG["configs"][:1], "n_perm": 1}
    observed = runs.run_matrix(values, small, tmp_path / "observed")
    null = runs.run_null(values, small, tmp_path / "null", 2)
    assert not null.has("pooled_metrics") and null.has("rankings")
    rows = runs.compare_with_null(spark, observed, null).collect()
    assert rows and all(r.null_n == 2 for r in rows if r.dimension == "resampling") and {r.statistic for r in rows} >= {"phi", "jaccard"}
    for r in rows:
        assert r.observed_least <= r.observed_median <= r.observed_most and r.mean_difference == pytest.approx(r.observed_mean - r.null_mean) and 0 <= r.share_above <= 1
    verdict = runs.run_regularisation(values, small, [0.1, 1.0], 1.0, 0.5, tmp_path / "grid", 5).collect()
    assert {r.setting for r in verdict} == {"C=0.1", "C=1"} and len({r.verdict for r in verdict}) == 1
    agree = Folder.of(tmp_path / "grid").read(spark, "rank_agreement").collect()
    assert len(agree) == 6 and all(r.rho == pytest.approx(1) and r.jaccard == 1 for r in agree if r.setting == "C=1") and all(r.n_genes == 24 for r in agree)
    with pytest.raises(ValueError):
        runs.run_regularisation(values, small, [0.1], 1.0, 0.5, tmp_path / "grid2", 5)
    lost = spark.createDataFrame([(s, 0, 0, g, 1.0) for s, g in (("a", "G1"), ("a", "G2"), ("b", "G1"))], "setting string, repeat int, fold int, gene string, importance double")
    with pytest.raises(runs.UniverseError):
        runs.rank_agreement(lost, "a", 1)
    with pytest.raises(runs.UniverseError, match="twice"):
        runs.rank_agreement(lost.union(lost.where("setting = 'a'")), "a", 1)
    again = runs.run_regularisation(values, small | {"seed": 77}, [0.1, 1.0], 1.0, 0.5, tmp_path / "grid", 5)  # other settings in the same folder
    agree = Folder.of(tmp_path / "grid").read(spark, "rank_agreement").collect()
    assert again.count() == 2 and len(agree) == 6 and all(r.n_genes == 24 for r in agree)
    same = runs.compare_runs(spark, observed, observed, 5).first()
    assert same.mean_abs_phi_change == 0 and same.top_jaccard == 1 and same.spearman_frequency == pytest.approx(1) and same.auc_a == same.auc_b
    single = runs.run_experiment(values, small, "logreg", "coef", tmp_path / "experiment")
    assert all(single.has(n) for n in ("rankings_top", "predictions", "runs", "pooled_metrics", "stability", "manifest.json", "config.yaml"))
    stability = single.read(spark, "stability").collect()
    assert {r.scope for r in stability} == {"all_runs", "repeat_0"} and all(r.phi_alt == r.phi for r in stability)  # all genes are eligible


def test_null_goes_on_where_it_stopped(spark, sf, tmp_path, monkeypatch):
    values, whole, asked = tables.cohort(spark, sf), models.fit_folds, []
    small = CONFIG | {"configs": CONFIG["configs"][:1], "n_perm": 0, "wave": 4}

    def counting(rows, *how):
        asked.append(sorted({tuple(r) for r in rows.select("config", "repeat", "fold").distinct().collect()}))
        if len(asked) == 3:
            raise RuntimeError("stopped")
        return whole(rows, *how)

    monkeypatch.setattr(models, "fit_folds", counting)
    with pytest.raises(RuntimeError, match="stopped"):
        runs.run_null(values, small, tmp_path / "null", 4)
    first = [k for wave in asked[:2] for k in wave]
    asked.clear()
    asked.extend([[]] * 3)
    null = runs.run_null(values, small, tmp_path / "null", 4)
    rest = [k for wave in asked[3:] for k in wave]
    n_splits = CONFIG["cv"]["n_splits"]
    assert len(first) == 8 and len(rest) == 4 * n_splits - 8 and not set(first) & set(rest)
    before = sorted(map(tuple, null.read(spark, "rankings").where("repeat < 4").select("pipeline", "repeat", "fold", "gene", "rank").collect()))
    del asked[3:]
    more = runs.run_null(values, small, tmp_path / "null", 5)  # a replicate more runs its own fits alone
    assert {k[1] for wave in asked[3:] for k in wave} == {4}
    assert sorted(map(tuple, more.read(spark, "rankings").where("repeat < 4").select("pipeline", "repeat", "fold", "gene", "rank").collect())) == before
    fresh = runs.run_null(values, small | {"wave": 1000}, tmp_path / "fresh", 4)
    assert sorted(map(tuple, fresh.read(spark, "rankings").select("pipeline", "repeat", "fold", "gene", "rank").collect())) == before


def test_shared_steps_follow_the_files(spark, tmp_path):
    calls = []

    @kept_module.shared
    def step(spark, sf_dir):
        calls.append(sf_dir)
        return spark.read.parquet(f"{sf_dir}/t.parquet")

    write = lambda n: spark.range(n).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    write(3)
    assert [step(spark, str(tmp_path)).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    write(5)
    assert step(spark, str(tmp_path)).count() == 5 and len(calls) == 2
    kept_module.forget()
    assert step(spark, str(tmp_path)).count() == 5 and len(calls) == 3
