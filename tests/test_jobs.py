"""The jobs over growing, repeated and stopped runs, and their operators against brute force."""

import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from featstab.operators import recon
from jobs import cohort_recon, document_intake
from jobs.common import configured
from jobs.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, source string, batch string, chars int"
LABELS = "doc_id long, quality int, toxic int"


def shown(rows):
    return sorted(tuple("null" if v is None else f"{v:.7f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def in_sql(name, **tables):
    with duckdb.connect() as con:
        for table, path in tables.items():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
        return con.execute(ORACLE_SQL[name]).fetchall()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_sql(spark, sf, name):
    got = QUERIES[name](spark, sf)
    names = [f.removesuffix(".parquet") for f in os.listdir(sf)]
    assert shown(got.collect()) == shown(in_sql(name, **{n: f"{sf}/{n}.parquet" for n in names}))


def intake(folder):
    return document_intake.Config(f"{folder}/documents", f"{folder}/labels", f"{folder}/samples", f"{folder}/checkpoint", f"{folder}/effects", files_a_step=1)


def add(spark, folder, docs, labels):
    spark.createDataFrame(docs, DOCS).coalesce(1).write.mode("append").parquet(f"{folder}/documents")
    spark.createDataFrame(labels, LABELS).coalesce(1).write.mode("append").parquet(f"{folder}/labels")


def state(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def made(start, stop):
    docs = [(i, f"Text {i % 7} of\nsome {'WORDS ' * (i % 5)}{i * i}", ("a", "b", "", None)[i % 4], "clash", 1) for i in range(start, stop)]
    return docs, [(i, i % 2, 0) for i in range(start, stop)]


def test_intake_takes_only_what_is_new(spark, tmp_path, caplog):
    config = intake(tmp_path)
    add(spark, tmp_path, *made(0, 40))
    with caplog.at_level(logging.INFO):
        first = shown(document_intake.run(spark, config).collect())
    assert "read 40 new documents" in caplog.text and "in 1 steps" in caplog.text
    assert first == shown(in_sql("job1_document_intake", documents=f"{tmp_path}/documents/*.parquet", labels=f"{tmp_path}/labels/*.parquet"))
    files = state(f"{tmp_path}/samples")

    assert shown(document_intake.run(spark, config).collect()) == first and state(f"{tmp_path}/samples") == files

    add(spark, tmp_path, *made(40, 70))
    # the same id again, rows without an id, a null and an empty text, copies in one cohort, labels that disagree or are missing
    odd = [(3, "another text for an old id", "a", None, 0), (None, "no id", "a", None, 0), (100, None, "a", None, 0), (101, "", "a", None, 0), (102, "copy", "b", None, 0), (103, "copy", "b", None, 0), (104, "unlabelled", "b", None, 0), (105, "both labels", "b", None, 0)]
    add(spark, tmp_path, odd, [(100, 1, 0), (101, 0, 0), (102, 1, 0), (103, 1, 0), (105, 1, 0), (105, 0, 0), (106, None, 0), (None, 1, 0)])
    caplog.clear()
    with caplog.at_level(logging.INFO):
        second = shown(document_intake.run(spark, config).collect())
    assert "read 38 new documents" in caplog.text and "in 2 steps" in caplog.text
    assert files.items() <= state(f"{tmp_path}/samples").items()
    assert spark.read.parquet(config.samples).count() == 76
    with duckdb.connect() as con:  # what came first for an id counts
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet') WHERE text IS DISTINCT FROM 'another text for an old id'")
        con.execute(f"CREATE VIEW labels AS SELECT * FROM read_parquet('{tmp_path}/labels/*.parquet')")
        assert second == shown(con.execute(ORACLE_SQL["job1_document_intake"]).fetchall())

    add(spark, tmp_path, [], [(104, 1, 0)])  # a label that comes later than its document
    late = {(r["source"], r["feature"]): r["n1"] for r in document_intake.run(spark, config).collect()}
    before = {(r[-1], r[0]): int(r[1]) for r in second}
    assert all(late[k] == n + (k[0] == "b") for k, n in before.items())


def test_intake_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    config, calls = intake(tmp_path), []
    for k in range(3):
        add(spark, tmp_path, *made(10 * k, 10 * k + 10))
    whole = document_intake.samples_of

    def stopping(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return whole(batch)

    monkeypatch.setattr(document_intake, "samples_of", stopping)
    with pytest.raises(Exception, match="stopped"):
        document_intake.run(spark, config)
    got = document_intake.run(spark, config)
    assert len(calls) == 4 and spark.read.parquet(config.samples).count() == 30
    assert shown(got.collect()) == shown(in_sql("job1_document_intake", documents=f"{tmp_path}/documents/*.parquet", labels=f"{tmp_path}/labels/*.parquet"))


def test_intake_of_nothing(spark, tmp_path):
    add(spark, tmp_path, [], [])
    assert document_intake.run(spark, intake(tmp_path)).collect() == []


def test_recon_repeats_itself(spark, sf, tmp_path):
    config = cohort_recon.Config(sf, str(tmp_path / "recon"))
    first = shown(cohort_recon.run(spark, config).collect())
    assert first == shown(cohort_recon.run(spark, config).collect())
    assert sorted(p.name for p in (tmp_path / "recon").glob("section=*")) == [f"section={s}" for s in ("classes", "copies", "labels", "matrix", "samples")]


def matrix(spark, x, ids=None):
    rows = [(int(ids[i]) if ids is not None else i, f"P{j:03d}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "sample_id long, probe_id string, x double").repartition(5)


@pytest.mark.parametrize("blocks", [(4, 3), (256, 4096)])
def test_nearest_samples_equals_corrcoef(spark, blocks):
    x = np.random.default_rng(4).normal(size=(13, 20)) + 50
    x[7] = x[2] * 3 - 1  # the same but for scale
    x[11] = 5.0  # no variance
    ids = np.arange(13) * 10
    got = {r["sample_id"]: (r["nearest"], r["r"]) for r in recon.nearest_samples(matrix(spark, x, ids), *blocks).collect()}
    with np.errstate(invalid="ignore"):
        r = np.nan_to_num(np.corrcoef(x), nan=-2)
    np.fill_diagonal(r, -2)
    assert got[110] == (None, None) and len(got) == 13
    for i in set(range(13)) - {11}:
        assert got[10 * i][0] == 10 * int(np.round(r[i], 12).argmax()) and abs(got[10 * i][1] - r[i].max()) < 1e-9


def test_nearest_samples_wants_a_whole_matrix(spark):
    whole = matrix(spark, np.eye(3))
    with pytest.raises(ValueError, match="8 values"):
        recon.nearest_samples(whole.where("sample_id <> 1 or probe_id <> 'P001'"))
    assert [r["nearest"] for r in recon.nearest_samples(whole.where("sample_id = 1")).collect()] == [None]
    assert recon.nearest_samples(whole.where("false")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_quantiles(spark, n):
    x = np.round(np.random.default_rng(n).normal(size=n), 1)
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
    got = {r["share"]: r["value"] for r in recon.exact_quantiles(rows, "x").collect()}
    assert list(got) == list(recon.QUANTILES)
    assert np.allclose([got[q] for q in recon.QUANTILES], np.quantile(x, recon.QUANTILES), atol=1e-12)
    assert {r["value"] for r in recon.exact_quantiles(rows.where("false"), "x").collect()} == {None}


def test_copies_floor_and_scale(spark):
    x = np.array([[0.0, 1, 2, 2], [0.0, 1, 2, 2], [0.00001, 1, 2, 2], [0, 0, 9, 2]])
    m = matrix(spark, x)
    assert {tuple(sorted(r["sample_id"] for r in rows)) for rows in [recon.copies(m).collect()]} == {(0, 1)}
    assert sorted(r["sample_id"] for r in recon.copies(m, 4).collect()) == [0, 1, 2]
    assert {r["measure"]: r["value"] for r in recon.floor_profile(m).collect()} == {"floor_all": 0, "floor_90": 0, "floor_50": 1, "zero_variance": 1}
    got = {r["measure"]: r["value"] for r in recon.scale(m.union(spark.createDataFrame([(9, "P000", None)], m.schema)), 1.0).collect()}
    assert got["n_missing"] == 1 and got["n_cells"] == 17 and got["share_at_least"] == 4 / 16 and got["share_below"] == 5 / 16 and got["quantile_50"] == np.quantile(x, 0.5) and abs(got["mean"] - x.mean()) < 1e-12


def test_configuration_and_command_line(spark, tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"tables": "a", "output": "b", "below_percent": 3}))
    assert configured(cohort_recon.Config, str(file), {"output": "c", "below_percent": None}) == cohort_recon.Config("a", "c", 3)
    with pytest.raises(ValueError, match="strange"):
        configured(cohort_recon.Config, None, {"tables": "a", "output": "b", "strange": 1})
    add(spark, tmp_path, *made(0, 10))
    c = intake(tmp_path)
    file.write_text(json.dumps({"documents": c.documents, "labels": c.labels, "samples": c.samples, "checkpoint": c.checkpoint, "output": "overridden"}))
    root = Path(__file__).resolve().parents[1]
    env = os.environ | {"PYTHONPATH": str(root), "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.document_intake", "--config", str(file), "--output", c.output, "--files-a-step", "2"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0 and "read 10 new documents" in done.stderr, done.stderr[-2000:]
    assert document_intake.read(spark, c).count() == 21


def test_jobs_stand_without_the_corpus_operators():
    root = Path(__file__).resolve().parents[1]
    for path in [*(root / "jobs").glob("*.py")]:
        assert "llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
