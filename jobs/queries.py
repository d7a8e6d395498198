"""The jobs as registered queries: each runs its job twice over whole tables in a folder of its own and returns the output read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from featstab.functions.kept import shared_folder

from . import cohort_recon, document_intake


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_document_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects after two runs, the second of which finds nothing new."""
    folder = _folder(spark, "job1")
    config = document_intake.Config(f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{folder}/samples", f"{folder}/checkpoint", f"{folder}/effects")
    document_intake.run(spark, config)
    return document_intake.run(spark, config)


def job2_cohort_recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections after two runs."""
    config = cohort_recon.Config(sf_dir, f"{_folder(spark, 'job2')}/recon")
    cohort_recon.run(spark, config)
    return cohort_recon.run(spark, config)


QUERIES = {f.__name__: f for f in (job1_document_intake, job2_cohort_recon)}

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_FEATURES = {
    "chars": "length(t)",
    "bytes": "strlen(t)",
    "words": f"len({_WORDS})",
    "lines": "CASE WHEN length(t) > 0 THEN length(t) - length(replace(t, chr(10), '')) + 1 ELSE 0 END",
    "distinct_share": f"CASE WHEN len({_WORDS}) > 0 THEN len(list_distinct({_WORDS})) * 1000000 // len({_WORDS}) ELSE 0 END",
    "digit_share": "CASE WHEN length(t) > 0 THEN (length(t) - length(translate(t, '0123456789', ''))) * 1000000 // length(t) ELSE 0 END",
    "upper_share": "CASE WHEN length(t) > 0 THEN (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) * 1000000 // length(t) ELSE 0 END",
}
_EFFECTS = f"""
WITH docs AS (SELECT doc_id, md5(t) AS digest, source, {", ".join(f"({e})::BIGINT AS {f}" for f, e in _FEATURES.items())} FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(nullif(source, ''), '(none)') AS source FROM documents WHERE doc_id IS NOT NULL)),
one AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY digest, source) = 1),
agreed AS (SELECT doc_id, min(quality) AS y FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING min(quality) = max(quality) AND count(*) = count(quality) AND min(quality) IN (0, 1)),
distinct_samples AS (SELECT DISTINCT source, digest, y, {", ".join(_FEATURES)} FROM one JOIN agreed USING (doc_id)),
tall AS (UNPIVOT distinct_samples ON {", ".join(_FEATURES)} INTO NAME feature VALUE v),
ranked AS (SELECT *, rank() OVER (PARTITION BY source, feature ORDER BY v) + (count(*) OVER (PARTITION BY source, feature, v) - 1) / 2.0::DOUBLE AS r FROM tall),
m AS (SELECT source, feature, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, avg(v) FILTER (y = 1) AS mean1, avg(v) FILTER (y = 0) AS mean0, var_samp(v) FILTER (y = 1) AS var1, var_samp(v) FILTER (y = 0) AS var0, sum(r) FILTER (y = 1) AS s FROM ranked GROUP BY 1, 2),
e AS (SELECT source, feature, n1, n0, mean1, mean0,
  CASE WHEN n1 < 2 OR n0 < 2 THEN NULL WHEN sqrt(var1 / n1 + var0 / n0) > 0 THEN (mean1 - mean0) / sqrt(var1 / n1 + var0 / n0) WHEN mean1 = mean0 THEN 0.0::DOUBLE ELSE sign(mean1 - mean0)::DOUBLE * 1e9::DOUBLE END AS t,
  CASE WHEN n1 > 1 AND n0 > 1 THEN CASE WHEN (n1 - 1) * var1 + (n0 - 1) * var0 > 0 THEN (mean1 - mean0) / sqrt(((n1 - 1) * var1 + (n0 - 1) * var0) / (n1 + n0 - 2)) ELSE 0.0::DOUBLE END * (1 - 3.0::DOUBLE / (4 * (n1 + n0) - 9)) END AS g,
  CASE WHEN n1 > 0 AND n0 > 0 THEN (s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) END AS auc, sign(mean1 - mean0)::BIGINT AS direction FROM m)
SELECT feature, n1, n0, {", ".join(f"round({c}, 9) + 0.0::DOUBLE AS {c}" for c in ("mean1", "mean0", "t", "g", "auc"))}, direction,
  (SELECT nullif(count(*), 0) FROM e b WHERE b.feature = e.feature AND b.direction IS NOT NULL) AS n_cohorts, (SELECT nullif(count(*), 0) FROM e b WHERE b.feature = e.feature AND b.direction = e.direction) AS n_agree, source FROM e
"""
_COHORT = """SELECT vec_id AS sample_id, 'P' || lpad(u.p::VARCHAR, 2, '0') || '_at' AS probe_id, (CASE WHEN label = 0 THEN 0 ELSE 1 END)::BIGINT AS y,
  greatest(embedding[u.p + 1]::DOUBLE + CASE WHEN u.p < 6 THEN (CASE WHEN u.p % 2 = 0 THEN 0.15::DOUBLE ELSE -0.15::DOUBLE END) * (CASE WHEN label = 0 THEN 0 ELSE 1 END) WHEN u.p >= 56 THEN -0.45::DOUBLE ELSE 0.0::DOUBLE END, -0.15::DOUBLE) AS x
  FROM embeddings, (SELECT unnest(range(64)) AS p) u"""
_DESCRIBED = """SELECT d.doc_id, CASE WHEN d.doc_id % 41 = 0 THEN 'unknown' WHEN quality = 1 THEN 'breast cancer' ELSE 'normal breast' END AS tissue, (quality = 1) <> (d.doc_id % 17 = 0) AS source_says, quality = 1 AS title_says, (quality = 1) <> (d.doc_id % 23 = 0) AS about_says FROM documents d JOIN labels USING (doc_id)"""
_QUANTILES = " UNION ALL ".join(f"SELECT 'quantile_{round(q * 100):02d}', quantile_cont(x, {q}) FROM cohort" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
_RECON = f"""
WITH cohort AS ({_COHORT}), described AS ({_DESCRIBED}), low AS (SELECT min(x) AS x FROM cohort),
probes AS (SELECT probe_id, count(*) FILTER (x = (SELECT x FROM low))::DOUBLE / count(*) AS s, min(x) = max(x) AS same FROM cohort GROUP BY 1),
matrix AS (
  SELECT 'n_samples' AS measure, count(DISTINCT sample_id)::DOUBLE AS value FROM cohort UNION ALL SELECT 'n_probes', count(DISTINCT probe_id) FROM cohort UNION ALL SELECT 'n_cells', count(*) FROM cohort
  UNION ALL SELECT 'n_missing', count(*) - count(x) FROM cohort UNION ALL SELECT 'least', min(x) FROM cohort UNION ALL SELECT 'largest', max(x) FROM cohort UNION ALL SELECT 'mean', avg(x) FROM cohort
  UNION ALL SELECT 'share_at_least', count(*) FILTER (x = (SELECT x FROM low))::DOUBLE / count(*) FROM cohort UNION ALL SELECT 'share_below', count(*) FILTER (x < 0.05::DOUBLE)::DOUBLE / count(*) FROM cohort
  UNION ALL SELECT 'n_negative', count(*) FILTER (x < 0) FROM cohort UNION ALL SELECT 'least_sample_median', min(m) FROM (SELECT median(x) AS m FROM cohort GROUP BY sample_id) UNION ALL SELECT 'largest_sample_median', max(m) FROM (SELECT median(x) AS m FROM cohort GROUP BY sample_id)
  UNION ALL {_QUANTILES} UNION ALL SELECT 'floor_all', count(*) FILTER (s = 1) FROM probes UNION ALL SELECT 'floor_90', count(*) FILTER (s >= 0.9) FROM probes UNION ALL SELECT 'floor_50', count(*) FILTER (s >= 0.5) FROM probes UNION ALL SELECT 'zero_variance', count(*) FILTER (same) FROM probes),
violations AS (SELECT unnest(CASE WHEN tissue = 'unknown' THEN ['tissue'] ELSE list_filter([CASE WHEN source_says <> (tissue = 'breast cancer') THEN 'source_name' END, CASE WHEN title_says <> (tissue = 'breast cancer') THEN 'title' END, CASE WHEN about_says <> (tissue = 'breast cancer') THEN 'description' END], lambda f: f IS NOT NULL) END) AS field FROM described),
texts AS (SELECT count(*) AS n FROM documents GROUP BY md5(coalesce(text, '')) HAVING count(*) > 1),
equal AS (SELECT n FROM (SELECT v, count(*) AS n FROM (SELECT sample_id, list(round(x, 4) ORDER BY probe_id) AS v FROM cohort GROUP BY 1) GROUP BY 1) WHERE n > 1),
correlated AS (SELECT a.sample_id AS s, b.sample_id AS o, corr(a.x, b.x) AS r FROM cohort a JOIN cohort b USING (probe_id) WHERE a.sample_id <> b.sample_id GROUP BY 1, 2),
sections AS (
  SELECT 'all' AS item, measure, value, 'matrix' AS section FROM matrix
  UNION ALL SELECT y::VARCHAR, 'samples', count(DISTINCT sample_id), 'classes' FROM cohort GROUP BY y
  UNION ALL SELECT field, 'disagreements', count(*), 'labels' FROM violations GROUP BY 1
  UNION ALL SELECT s::VARCHAR, 'largest_correlation', max(r), 'samples' FROM correlated GROUP BY 1
  UNION ALL SELECT 'all', 'shared_texts', count(*), 'copies' FROM texts UNION ALL SELECT 'all', 'documents_sharing', coalesce(sum(n), 0), 'copies' FROM texts UNION ALL SELECT 'all', 'most_documents', coalesce(max(n), 0), 'copies' FROM texts
  UNION ALL SELECT 'all', 'shared_columns', count(*), 'copies' FROM equal UNION ALL SELECT 'all', 'samples_sharing', coalesce(sum(n), 0), 'copies' FROM equal)
SELECT item, measure, round(value, 9) + 0.0::DOUBLE AS value, section FROM sections
"""
ORACLE_SQL = {"job1_document_intake": _EFFECTS, "job2_cohort_recon": _RECON}
