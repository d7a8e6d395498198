"""Known answers and edge cases of the study's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featstab.functions.scalars import average_rank, percent_rank, scaled_rank
from featstab.operators import attribution, cohort, consensus, enrichment, metrics, preprocess, replication, splits, stability


def members(spark, sets, pipeline="a|coef"):
    return spark.createDataFrame([(3, pipeline, 0, i, g) for i, s in enumerate(sets) for g in s], "k int, pipeline string, repeat int, fold int, gene string")


def statistics(spark, sets, d):
    return stability.set_statistics(members(spark, sets), ["pipeline", "k", "repeat"], ["fold"], d).first()


def test_stability_known_answers(spark):
    r = statistics(spark, ["123", "1234", "12345"], 10)
    assert r.phi == pytest.approx(0.7222222, abs=1e-7) and r.jaccard == pytest.approx(0.7166667, abs=1e-7) and r.kuncheva is None
    r = statistics(spark, ["123", "456"], 6)
    assert (r.phi, r.kuncheva, r.jaccard) == (-1, -1, 0)
    half = [{f"g{i}" for i in range(10)}, {f"g{i}" for i in range(5, 15)}]
    r = statistics(spark, half, 1000)
    assert r.kuncheva == pytest.approx(4900 / 9900) and r.phi == pytest.approx(r.kuncheva)
    assert statistics(spark, ["123"], 10).phi is None


def test_identical_sets_and_full_universe(spark):
    assert statistics(spark, ["12", "12"], 10).phi == 1
    assert statistics(spark, ["12", "12"], 2).phi is None


RANKINGS = "pipeline string, explainer string, repeat int, fold int, rank int, gene string, importance double, signed double"
PIPES = "pipeline string, model string, explainer string, role string, position int"


def rankings(spark):
    by = {"a|coef": ["u1", "u2", "x"], "a|shap": ["u1", "u2", "y"], "b|shap": ["u1", "z", "u2"], "ttest|ttest": ["u1", "q", "r"]}
    rows = [(p, p.split("|")[1], r, f, i + 1, g, 1 / (i + 1), 1.0 if g[0] == "u" else -1.0) for p, genes in by.items() for r in range(2) for f in range(3) for i, g in enumerate(genes)]
    pipes = [("a|coef", "a", "coef", "primary", 0), ("a|shap", "a", "shap", "primary", 1), ("b|shap", "b", "shap", "primary", 2), ("ttest|ttest", "ttest", "ttest", "baseline", 3)]
    return spark.createDataFrame(rows, RANKINGS), spark.createDataFrame(pipes, PIPES)


def test_consensus(spark):
    r, p = rankings(spark)
    table = {x.gene: x for x in consensus.gene_table(r, p, 2).collect()}
    assert (table["u1"].mean_selection_frequency, table["u1"].n_pipelines_ge50, table["u1"].n_models_ge50, table["u1"].n_explainers_ge50) == (1.0, 3, 2, 2)
    assert [g for g, x in sorted(table.items()) if x.consensus] == ["u1", "u2"]
    assert table["q"].mean_selection_frequency == 0 and table["q"].mean_rank is None
    lists = consensus.frozen_lists(r, p, 2, 3).where("list = 'S_cons'").orderBy("position").collect()
    assert [x.gene for x in lists] == ["u1", "u2"]


def test_dimensions(spark):
    r, p = rankings(spark)
    level = stability.repeat_level(stability.members(r, [3]), p, 100).collect()
    assert {x.dimension for x in level} == {"resampling", "model", "explainer", "combined", "baseline"}
    own = next(x for x in level if x.group == "a|coef" and x.repeat == 0)
    assert own.phi == 1 and own.n_units == 3
    logreg = spark.createDataFrame([("l|coef", "logreg", "coef", "primary", 0), ("m|coef", "logreg", "coef", "sensitivity", 1)], PIPES)
    assert {x.dimension for x in stability.group_definitions(logreg).collect()} == {"sensitivity"}


def test_bands(spark):
    rows = spark.createDataFrame([(0.399,), (0.40,), (0.749,), (0.75,), (None,)], "phi double").select(stability.phi_band(F.col("phi")).alias("b")).collect()
    assert [r.b for r in rows] == ["poor", "intermediate_to_good", "intermediate_to_good", "excellent", None]


def test_ranks(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "x double")
    rows = df.select(average_rank("x").alias("a"), scaled_rank("x").alias("s"), percent_rank("x").alias("p")).orderBy("a").collect()
    assert [r.a for r in rows] == [1, 2.5, 2.5, 4] and [r.s for r in rows] == [0, 0.5, 0.5, 1] and [r.p for r in rows] == [0.25, 0.625, 0.625, 1]
    ranked = attribution.ranked(spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 3.0), ("d", 0.5)], "gene string, importance double"), ()).orderBy("rank")
    assert [r.gene for r in ranked.collect()] == ["c", "a", "b", "d"]


def test_bh_and_enrichment(spark):
    rows = enrichment.benjamini_hochberg(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "term string, p_value double"))
    assert {r.term: round(r.adj_p, 12) for r in rows.collect()} == {"a": 0.02, "b": 0.04, "c": 0.04, "d": 0.02}
    genes = lambda a, b: spark.createDataFrame([(f"g{i}",) for i in range(a, b)], "gene string")
    library = spark.createDataFrame([("A", f"g{i}") for i in range(10)] + [("B", f"g{i}") for i in range(40, 50)] + [("C", f"g{i}") for i in range(50)], "term string, gene string")
    got = {r.term: r for r in enrichment.enrich(genes(0, 8), genes(0, 50), library).collect()}
    tail = sum(math.comb(10, i) * math.comb(40, 8 - i) for i in range(8, 9)) / math.comb(50, 8)
    assert (got["A"].overlap, got["A"].background_size, got["A"].term_size) == (8, 50, 10) and got["A"].p_value == pytest.approx(tail, rel=1e-3, abs=1e-12)
    assert got["B"].p_value == 1 and got["C"].p_value == pytest.approx(1)


def test_direction_and_interval(spark):
    rows = spark.createDataFrame([(1.0, 1.0 if i < 12 else -1.0) for i in range(20)], "e_disc double, e_ext double")
    r = replication.direction(rows).first()
    assert (r.n, r.n_consistent, r.fraction) == (20, 12, 0.6)
    low, high = replication.binomial_interval(12, 20)
    assert low == pytest.approx(0.3605426, abs=1e-6) and high == pytest.approx(0.8088099, abs=1e-6)
    assert replication.binomial_interval(0, 5)[0] == 0 and replication.binomial_interval(5, 5)[1] == 1


def test_confusion_and_metrics(spark):
    y, s = [0, 0, 0, 0, 1, 1, 1, 1, 1, 1], [0.1, 0.2, 0.3, 0.6, 0.4, 0.55, 0.7, 0.8, 0.9, 0.95]
    rows = spark.createDataFrame([("c", i, a, b, int(b >= 0.5)) for i, (a, b) in enumerate(zip(y, s, strict=True))], "c string, sample_id int, y int, score double, pred int")
    r = metrics.classification(rows, ["c"]).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (3, 1, 1, 5)
    assert r.roc_auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a, l in zip(s, y, strict=True) if l for b, m in zip(s, y, strict=True) if not m]))
    assert r.balanced_accuracy == pytest.approx((5 / 6 + 3 / 4) / 2)


def test_floor_and_collapse(spark):
    rows = []
    for i in range(20):
        y = int(i >= 4)
        for probe, x in (("always_floor", 2.0), ("rare_noise", 5.0 if i == 7 else 2.0), ("minority_only", 6.0 if y == 0 else 2.0), ("common", 7.0)):
            rows.append((0, 0, i, y, probe, probe, x))
    train = spark.createDataFrame(rows, "repeat int, fold int, sample_id int, y int, probe_id string, gene string, x double")
    floor = preprocess.floor_state(train)
    assert (floor.first().floor, floor.first().threshold) == (2.0, 2)
    kept = preprocess.detected(preprocess.probe_state(train, floor), floor)
    assert {r.probe_id for r in kept.collect()} == {"minority_only", "common"}
    assert [preprocess.floor_state(train, f).first().threshold for f in (1.0, 0.25)] == [4, 1]
    high = preprocess.floor_state(train.withColumn("x", F.col("x") + F.col("sample_id") / 1000 + F.length("probe_id")))
    assert high.first().floor is None or high.first().floor_share >= 0.01


def test_collapse_ties_go_to_the_smaller_probe(spark):
    rows = [(0, 0, p, g, m, v) for p, g, m, v in (("pA", "G1", 1.0, 0.0), ("pB", "G1", 7.0, 4.0), ("pD", "G2", 6.0, 0.0), ("pC", "G2", 6.0, 0.0))]
    state = spark.createDataFrame(rows, "repeat int, fold int, probe_id string, gene string, mean double, variance double")
    for rule in ("mean", "variance"):
        assert {r.gene: r.probe_id for r in preprocess.collapsed(state, rule).collect()} == {"G1": "pB", "G2": "pC"}
    with pytest.raises(ValueError):
        preprocess.collapsed(state, "median")


def test_learned_tables_do_not_see_test_rows(spark, sf):
    from featstab.plans.study import Study
    from featstab.sources import tables

    values = tables.cohort(spark, sf).where("p < 8")
    study = Study(values)
    held = study.folds.where("repeat = 0 and fold = 0").select("sample_id")
    spoilt = values.join(held.withColumn("t", F.lit(1)), "sample_id", "left").withColumn("x", F.when(F.col("t") == 1, 99.0).otherwise(F.col("x"))).drop("t")
    # values reach the sums in another order, so their last bits may differ
    whole = lambda df: df.select(*(F.round(c, 12).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    a, b = (whole(Study(v).state.where("repeat = 0 and fold = 0")) for v in (values, spoilt))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_folds_do_not_depend_on_partitions(spark, sf):
    from featstab.sources import tables

    labels = tables.samples(tables.cohort(spark, sf))
    a, b = splits.stratified_folds(labels.repartition(7)), splits.stratified_folds(labels.coalesce(1))
    assert a.exceptAll(b).count() == 0
    sizes = a.groupBy("repeat", "fold", "y").count().groupBy("repeat", "y").agg((F.max("count") - F.min("count")).alias("d"))
    assert sizes.agg(F.max("d")).first()[0] <= 1
    moved = splits.permuted_labels(labels, 1, 0)
    assert moved.groupBy("y").count().exceptAll(labels.groupBy("y").count()).count() == 0 and moved.exceptAll(labels).count() > 0


def test_labels_and_probes(spark):
    good = [("1", " Breast Cancer", "cancer tissue", "Breast cancer, T1", "x CANCER"), ("2", "normal breast", "healthy", "Normal, N1", "control")]
    names = "sample_id string, tissue string, source_name string, title string, description string"
    assert {r.sample_id: r.y for r in cohort.checked_labels(spark.createDataFrame(good, names)).collect()} == {"1": 1, "2": 0}
    bad = spark.createDataFrame([*good, ("3", "normal breast", "healthy", "Normal", "cancer"), ("4", None, "a", "b", "c")], names)
    assert {(r.sample_id, r.field) for r in cohort.label_violations(bad).collect()} == {("3", "description"), ("4", "tissue")}
    with pytest.raises(cohort.LabelError):
        cohort.checked_labels(bad)
    chip = spark.createDataFrame([("1000_at", "GENEA", "1"), ("1001_at", "GENEB///GENEC", "2///3"), ("1002_s_at", "---", "---"), ("AFFX-x_at", "CTRL", "9"), ("1003_at", " GENEA ", "1")], "probe_id string, symbol string, entrez string")
    assert {(r.probe_id, r.gene) for r in cohort.usable_probes(chip).collect()} == {("1000_at", "GENEA"), ("1003_at", "GENEA")}


def test_units(spark):
    titles = [("GSM1", "TUM001_repA", "TNBC"), ("GSM2", "TUM001_repB", "TNBC"), ("TUM", "TUM002", "Luminal A"), ("GSM3", "n", "Healthy"), ("GSM4", "n", "Healthy"), ("GSM5", "line", "CellLine")]
    p1, p2 = (1, 3, 5, 7, 8, 100), (2, 2, 2, 1, 1, 50)
    rows = [(s, t, g, p, p, float(x[i])) for i, (s, t, g) in enumerate(titles) for p, x in (("p1", p1), ("p2", p2))]
    arrays = spark.createDataFrame(rows, "sample_id string, title string, sample_group string, probe_id string, gene string, x double")
    got = {(r.unit_id, r.probe_id): r for r in replication.units(arrays).collect()}
    assert {u for u, _ in got} == {"GSM3", "GSM4", "TUM001", "TUM002"} and got["TUM001", "p1"].x == 2 and got["TUM001", "p1"].n_arrays == 2
    assert {r.unit_id: r.x for r in replication.units(arrays, "repA").where("probe_id = 'p1'").collect()}["TUM001"] == 1
    with pytest.raises(ValueError):
        replication.units(arrays, "other")
    assert replication.unit_errors(arrays.withColumn("title", F.lit("x"))).count() == 3


def test_fold_cells_learn_what_a_pass_over_each_training_set_does(spark, sf):
    """Also where a class is constant within the training rows alone, labels are null replicates', and there is no floor."""
    from featstab.operators import preprocess, splits
    from featstab.sources import tables

    values = tables.cohort(spark, sf).where("p < 6 or p > 60")
    folds = splits.stratified_folds(tables.samples(values), 5, 2, 42)
    held = folds.where("repeat = 0 and fold = 1").select("sample_id", F.lit(1).alias("t"))
    constant = values.join(held, "sample_id", "left").withColumn("x", F.when((F.col("p") == 2) & F.col("t").isNull(), F.lit(0.1)).when((F.col("p") == 3) & F.col("t").isNull(), 0.3 * F.col("y")).otherwise(F.col("x"))).drop("t")
    for rows, own in ((constant, folds), (values.withColumn("x", F.col("x") + F.col("sample_id") / 1e4), folds), (values, splits.null_folds(tables.samples(values), 5, 2, 42))):
        labelled = rows.drop("y").join(own.select("sample_id", "repeat", "y").distinct(), "sample_id")
        others = own.select("repeat", "sample_id", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda f: f != F.col("fold"))).alias("fold"))
        train = labelled.join(others, ["repeat", "sample_id"])
        floor = preprocess.floor_state(train)
        fast = preprocess.fold_floors(rows, own, 5)
        shown = lambda df: sorted(tuple("null" if r[c] is None else f"{r[c]:.9f}" if isinstance(r[c], float) else str(r[c]) for c in sorted(df.columns)) for r in df.collect())
        assert shown(fast) == shown(floor)
        a, b = preprocess.fold_probes(rows, own, fast, 5), preprocess.probe_state(train, floor)
        assert shown(a) == shown(b)
        assert a.where("sd = 0").count() == b.where("sd = 0").count() and a.where("var1 = 0 and var0 = 0").count() == b.where("var1 = 0 and var0 = 0").count()


def test_resampled_sums_equal_the_plain_way():
    import numpy as np

    from featstab.functions import resampled

    rng = np.random.default_rng(1)
    y, score = np.array([0] * 7 + [1] * 9), np.round(rng.random(16), 1)
    weights = np.array([np.bincount(np.concatenate([rng.choice(7, 7), 7 + rng.choice(9, 9)]), minlength=16) for _ in range(50)]).astype(float)
    for w, got, precision in zip(weights.astype(int), resampled.auc(score, y, weights), resampled.average_precision(score, y, weights, 0), strict=True):
        s, t = np.repeat(score, w), np.repeat(y, w)
        pairs = [(a > b) + (a == b) / 2 for a in s[t == 1] for b in s[t == 0]]
        assert got == pytest.approx(np.mean(pairs))
        u, steps = 1 - s, 0.0
        for v in sorted(set(u), reverse=True):
            steps += (t[u == v] == 0).sum() / (t == 0).sum() * (t[u >= v] == 0).mean()
        assert precision == pytest.approx(steps)
    assert np.isnan(resampled.auc(score, np.zeros(16), weights)).all()


def test_errors_of_rankings_and_sets(spark):
    from featstab.operators import attribution, stability

    bad = spark.createDataFrame([(0, 0, "G1", 1.0), (0, 0, "G2", float("nan"))], "repeat int, fold int, gene string, importance double")
    with pytest.raises(Exception, match="missing or not finite: G2"):
        attribution.ranked(bad).collect()
    sets = spark.createDataFrame([(0, f, f"G{g}") for f in range(2) for g in range(3)], "k int, fold int, gene string")
    assert stability.set_statistics(sets, ["k"], ["fold"], 3).first().n_distinct == 3
    with pytest.raises(Exception, match="more than 2 different genes"):
        stability.set_statistics(sets, ["k"], ["fold"], 2).collect()


def test_perfectly_separating_gene_heads_the_t_ranking():
    import numpy as np

    from featstab.operators import models

    y = np.array([0] * 5 + [1] * 5)
    z = np.stack([np.where(y == 1, 1.0, -1.0), y + np.random.default_rng(0).normal(size=10), np.zeros(10)], axis=1)
    genes = np.array(["separating", "other", "constant"])
    assert models.welch(z, y)[[0, 2]].tolist() == [1e9, 0.0]
    assert models.top_by_t(genes, z, y, 1).tolist() == [0] and models.top_by_t(genes, z, y, 3).tolist() == [0, 1, 2]
