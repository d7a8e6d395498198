"""DuckDB SQL for the catalogue's queries, written on its own: named steps that queries are assembled from."""

from __future__ import annotations

import re

K, REPEATS, SEED, N_BOOT, N_BOOT_UNITS, N_PERM, N_NULL, D = 5, 20, 42, 2000, 1000, 10, 30, 24
TOL = "1e-9::DOUBLE"

STEPS: dict[str, str] = {
    "cohort": """SELECT vec_id AS sample_id, u.p AS p, 'P' || lpad(u.p::VARCHAR, 2, '0') || '_at' AS probe_id, 'G' || (u.p % 24)::VARCHAR AS gene,
        (CASE WHEN label = 0 THEN 0 ELSE 1 END)::BIGINT AS y,
        greatest(embedding[u.p + 1]::DOUBLE + CASE WHEN u.p < 6 THEN (CASE WHEN u.p % 2 = 0 THEN 0.15::DOUBLE ELSE -0.15::DOUBLE END) * (CASE WHEN label = 0 THEN 0 ELSE 1 END)
          WHEN u.p >= 56 THEN -0.45::DOUBLE ELSE 0.0::DOUBLE END, -0.15::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS p) u""",
    "samples": "SELECT DISTINCT sample_id, y FROM cohort",
    "pipelines": "SELECT * FROM (VALUES ('mdiff|coef','mdiff','coef','primary',0),('mdiff|shap','mdiff','shap','primary',1),('mdiff|perm','mdiff','perm','primary',2),('auc|coef','auc','coef','primary',3),('ttest|ttest','ttest','ttest','baseline',4)) t(pipeline, model, explainer, role, position)",
    "annotation": """SELECT CASE WHEN p_partkey % 50 = 0 THEN 'AFFX-' || p_partkey ELSE p_partkey || '_at' END AS probe_id,
        CASE WHEN p_partkey % 11 = 0 THEN '---' WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'G' || (p_partkey % 24) || '///G' || (p_partkey % 5) ELSE ' G' || (p_partkey % 500) || ' ' END AS symbol,
        (p_partkey % 500)::VARCHAR AS entrez FROM part""",
    "usable": "SELECT probe_id, trim(symbol) AS gene, entrez FROM annotation WHERE trim(symbol) NOT IN ('', '---') AND NOT contains(symbol, '///') AND NOT starts_with(probe_id, 'AFFX')",
    "titles": """SELECT o_orderkey AS sample_id, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END)::BIGINT AS y,
        'Breast cancer, T' || o_orderkey || CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE strftime(o_orderdate, '_%d_%m_%y') END AS title FROM orders""",
    "months": r"SELECT sample_id, y, CASE WHEN regexp_matches(title, '_(\d{1,2})_(\d{1,2})_(\d{2})$') THEN regexp_extract(title, '_(\d{1,2})_(\d{1,2})_(\d{2})$', 3) || '-' || lpad(regexp_extract(title, '_(\d{1,2})_(\d{1,2})_(\d{2})$', 2), 2, '0') END AS month FROM titles",
    "described": """SELECT d.doc_id AS sample_id, CASE WHEN d.doc_id % 41 = 0 THEN 'unknown' WHEN quality = 1 THEN ' Breast Cancer' ELSE 'normal breast' END AS tissue,
        CASE WHEN (quality = 1) <> (d.doc_id % 17 = 0) THEN 'tumour: cancer' ELSE 'healthy' END AS source_name, CASE WHEN quality = 1 THEN 'Breast cancer, T' ELSE 'Normal, N' END AS title,
        CASE WHEN (quality = 1) <> (d.doc_id % 23 = 0) THEN 'Invasive CANCER' ELSE 'control' END AS description FROM documents d JOIN labels USING (doc_id)""",
    "tissues": "SELECT *, lower(trim(tissue)) AS t FROM described",
    "permuted0": f"SELECT a.sample_id, b.y FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) n FROM samples) a JOIN (SELECT y, row_number() OVER (ORDER BY md5('{SEED}:777:0:' || sample_id), sample_id) n FROM samples) b USING (n)",
    "arrays": """SELECT sample_id, probe_id, gene, 2 * x + 5 AS x, CASE WHEN sample_id % 97 = 5 THEN 'CellLine' WHEN y = 0 THEN 'Healthy' WHEN (sample_id // 4) % 3 = 0 THEN 'TNBC' WHEN (sample_id // 4) % 3 = 1 THEN 'Her2' ELSE 'Luminal A' END AS sample_group,
        'TUM' || (sample_id // 4) || CASE WHEN sample_id % 4 = 1 THEN '_repA' ELSE '_repB' END AS title FROM cohort WHERE sample_id % 2 = 1""",
}


def _units(where: str) -> str:
    return f"""SELECT CASE WHEN sample_group = 'Healthy' THEN sample_id::VARCHAR ELSE split_part(title, '_', 1) END AS unit_id, probe_id, gene, min(sample_group) AS subtype,
        max(CASE WHEN sample_group = 'Healthy' THEN 0 ELSE 1 END)::BIGINT AS y, count(DISTINCT sample_id) AS n_arrays, avg(x) AS x FROM arrays WHERE sample_group <> 'CellLine' {where} GROUP BY 1, 2, 3"""


STEPS |= {"units": _units(""), "units_a": _units("AND NOT ends_with(title, '_repB')")}


def _auc(source: str, by: str, value: str = "x") -> str:
    comma = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    rank = f"rank() OVER ({part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {comma}{value}) - 1) / 2.0::DOUBLE"
    return f"""SELECT {comma}(sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM (SELECT *, sum(CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 0 END) OVER ({part}) AS n1,
        sum(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) OVER ({part}) AS n0, {rank} AS r FROM {source}) GROUP BY {comma}n1, n0 HAVING n1 > 0 AND n0 > 0"""


WELCH = """CASE WHEN n1 < 2 OR n0 < 2 THEN NULL WHEN sqrt(var1 / n1 + var0 / n0) > 0 THEN (mean1 - mean0) / sqrt(var1 / n1 + var0 / n0)
    WHEN mean1 = mean0 THEN 0.0::DOUBLE ELSE sign(mean1 - mean0)::DOUBLE * 1e9::DOUBLE END"""
MOMENTS = """count(CASE WHEN y = 1 THEN x END) AS n1, count(CASE WHEN y = 0 THEN x END) AS n0, avg(CASE WHEN y = 1 THEN x END) AS mean1, avg(CASE WHEN y = 0 THEN x END) AS mean0,
    var_samp(CASE WHEN y = 1 THEN x END) AS var1, var_samp(CASE WHEN y = 0 THEN x END) AS var0"""


def _learned(p: str, train: str) -> dict[str, str]:
    """Floor, probe state and detected probes of a training table."""
    return {
        f"{p}floor": f"""SELECT a."repeat", a.fold, CASE WHEN share >= 0.01 THEN low END AS floor, share AS floor_share, n_minority, CASE WHEN share >= 0.01 THEN ceil(0.5::DOUBLE * n_minority)::BIGINT ELSE 0 END AS threshold
            FROM (SELECT t."repeat", t.fold, avg(CASE WHEN x <= low + {TOL} THEN 1.0::DOUBLE ELSE 0 END) AS share, min(low) AS low FROM {train} t JOIN (SELECT "repeat", fold, min(x) AS low FROM {train} GROUP BY 1, 2) m ON t."repeat" = m."repeat" AND t.fold = m.fold GROUP BY 1, 2) a
            JOIN (SELECT "repeat", fold, min(n) AS n_minority FROM (SELECT "repeat", fold, y, count(DISTINCT sample_id) AS n FROM {train} GROUP BY 1, 2, 3) GROUP BY 1, 2) b ON a."repeat" = b."repeat" AND a.fold = b.fold""",
        f"{p}probes": f"""SELECT t."repeat", t.fold, probe_id, gene, sum(CASE WHEN x > floor + {TOL} THEN 1 END)::BIGINT AS n_found, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd, var_pop(x) AS variance, {MOMENTS}
            FROM {train} t JOIN {p}floor f ON t."repeat" = f."repeat" AND t.fold = f.fold GROUP BY 1, 2, 3, 4""",
        f"{p}kept": f"""SELECT s.*, coalesce(n_found, 0) AS n_detected FROM {p}probes s JOIN {p}floor f ON s."repeat" = f."repeat" AND s.fold = f.fold WHERE floor IS NULL OR coalesce(n_found, 0) >= threshold""",
    }


def _chosen(kept: str, rule: str) -> str:
    return f"""SELECT * EXCLUDE (i), CASE WHEN sd > 0 THEN sd ELSE 1.0::DOUBLE END AS scale FROM (SELECT *, row_number() OVER (PARTITION BY "repeat", fold, gene ORDER BY round({rule}, 9) DESC, probe_id) AS i FROM {kept}) WHERE i = 1"""


def _chain(p: str, cohort: str, repeats: int, seed: int, rule: str = "mean") -> dict[str, str]:
    f = '"repeat", fold'
    on = lambda a, b: f'{a}."repeat" = {b}."repeat" AND {a}.fold = {b}.fold'
    sigmoid = lambda x: f"1 / (1 + exp(-({x})))"
    brier = lambda q: f"(avg(CASE WHEN y = 1 THEN (1 - ({q})) * (1 - ({q})) END) + avg(CASE WHEN y = 0 THEN ({q}) * ({q}) END)) / 2"
    return {
        f"{p}folds": f"""SELECT r AS "repeat", (row_number() OVER (PARTITION BY r, y ORDER BY md5(({seed} + r)::VARCHAR || ':' || sample_id), sample_id) - 1) % {K} AS fold, sample_id, y FROM (SELECT DISTINCT sample_id, y FROM {cohort}), (SELECT unnest(range({repeats})) AS r)""",
        f"{p}train": f"""SELECT c.*, f."repeat", t.fold FROM {cohort} c JOIN {p}folds f USING (sample_id) JOIN (SELECT unnest(range({K})) AS fold) t ON t.fold <> f.fold""".replace("c.*", "c.sample_id, c.p, c.probe_id, c.gene, c.y, c.x"),
        **_learned(p, f"{p}train"),
        f"{p}state": _chosen(f"{p}kept", rule),
        f"{p}w": f"SELECT {f}, gene, (mean1 - mean0) / scale AS w FROM {p}state",
        f"{p}train_z": f"SELECT t.*, (t.x - s.mean) / s.scale AS z FROM {p}train t JOIN {p}state s ON {on('t', 's')} AND t.probe_id = s.probe_id",
        f"{p}test_z": f"""SELECT f."repeat", f.fold, c.sample_id, c.y, c.gene, (c.x - s.mean) / s.scale AS z FROM {cohort} c JOIN {p}folds f USING (sample_id) JOIN {p}state s ON {on('f', 's')} AND c.probe_id = s.probe_id""",
        f"{p}train_auc": _auc(f"{p}train_z", f'{f}, gene'),
        f"{p}margin": f"SELECT z.\"repeat\", z.fold, sample_id, y, round(sum(w * z), 9) AS f FROM {p}train_z z JOIN {p}w w ON {on('z', 'w')} AND z.gene = w.gene GROUP BY 1, 2, 3, 4",
        f"{p}moves": f"""WITH m AS (SELECT DISTINCT {f}, sample_id, r FROM {p}train, (SELECT unnest(range({N_PERM})) AS r)) SELECT a."repeat", a.fold, a.r, a.sample_id, b.from_id
            FROM (SELECT *, row_number() OVER (PARTITION BY {f}, r ORDER BY sample_id) AS i FROM m) a
            JOIN (SELECT {f}, r, sample_id AS from_id, row_number() OVER (PARTITION BY {f}, r ORDER BY md5(concat_ws(':', '{SEED}', "repeat", fold, r, sample_id)), sample_id) AS i FROM m) b ON {on('a', 'b')} AND a.r = b.r AND a.i = b.i""",
        f"{p}brier": f'SELECT {f}, {brier(sigmoid("f"))} AS loss FROM {p}margin GROUP BY 1, 2',
        f"{p}coef": f"SELECT {f}, gene, round(abs(w), 12) AS importance, round(w, 12) AS signed FROM {p}w",
        f"{p}shap": f"""SELECT z."repeat", z.fold, z.gene, round(avg(abs(w * (z - c))), 12) AS importance, round(avg(w * (z - c)), 12) AS signed FROM {p}train_z z
            JOIN (SELECT {f}, gene, avg(z) AS c FROM {p}train_z GROUP BY 1, 2, 3) m ON {on('z', 'm')} AND z.gene = m.gene JOIN {p}w w ON {on('z', 'w')} AND z.gene = w.gene GROUP BY 1, 2, 3""",
        f"{p}perm": f"""SELECT {f}, gene, round(CASE WHEN raw > 1e-12::DOUBLE THEN raw ELSE 0 END, 12) AS importance, round(raw, 12) AS signed FROM (SELECT l."repeat", l.fold, l.gene, avg(l) - max(loss) AS raw FROM (
            SELECT {f}, gene, r, {brier(sigmoid("f + (z2 - z) * w"))} AS l FROM (SELECT z."repeat", z.fold, z.gene, z.y, m.r, z.z, o.z AS z2, g.f, w.w FROM {p}train_z z JOIN {p}moves m ON {on('z', 'm')} AND z.sample_id = m.sample_id
            JOIN {p}train_z o ON {on('z', 'o')} AND z.gene = o.gene AND o.sample_id = m.from_id JOIN {p}margin g ON {on('z', 'g')} AND z.sample_id = g.sample_id JOIN {p}w w ON {on('z', 'w')} AND z.gene = w.gene) GROUP BY 1, 2, 3, 4) l JOIN {p}brier b ON {on('l', 'b')} GROUP BY 1, 2, 3)""",
        f"{p}aucimp": f"SELECT {f}, gene, round(abs(auc - 0.5), 12) AS importance, round(auc - 0.5, 12) AS signed FROM {p}train_auc",
        f"{p}tt": f"SELECT {f}, gene, round(abs({WELCH}), 12) AS importance, round({WELCH}, 12) AS signed FROM {p}state",
        f"{p}rankings": f"""SELECT *, row_number() OVER (PARTITION BY pipeline, {f} ORDER BY importance DESC, gene) AS rank FROM (SELECT 'mdiff|coef' AS pipeline, 'coef' AS explainer, * FROM {p}coef UNION ALL SELECT 'mdiff|shap', 'shap', * FROM {p}shap
            UNION ALL SELECT 'mdiff|perm', 'perm', * FROM {p}perm UNION ALL SELECT 'auc|coef', 'coef', * FROM {p}aucimp UNION ALL SELECT 'ttest|ttest', 'ttest', * FROM {p}tt)""",
        f"{p}tt_rank": f"SELECT 'ttest|ttest' AS pipeline, *, row_number() OVER (PARTITION BY {f} ORDER BY importance DESC, gene) AS rank FROM {p}tt",
        f"{p}sets": f"SELECT k, pipeline, {f}, gene FROM {p}rankings, (VALUES (5::BIGINT), (10::BIGINT)) v(k) WHERE rank <= k AND importance > 0",
        f"{p}tt_sets": f"SELECT k, pipeline, {f}, gene FROM {p}tt_rank, (VALUES (5::BIGINT), (10::BIGINT)) v(k) WHERE rank <= k AND importance > 0",
        f"{p}pred": f"""SELECT {f}, sample_id, y, round({sigmoid("f")}, 9) AS score, CASE WHEN f > 0 THEN 1 ELSE 0 END AS pred FROM (SELECT z."repeat", z.fold, sample_id, y, round(sum(w * z), 9) AS f FROM {p}test_z z JOIN {p}w w ON {on('z', 'w')} AND z.gene = w.gene GROUP BY 1, 2, 3, 4)""",
    }


def set_stats(source: str, by: str, unit: str, d: int = D) -> str:
    """All set statistics of a table of members, pairs by list intersection."""
    return f"""WITH z AS (SELECT {by}, concat_ws('|', {unit}) AS u, list(gene) AS l FROM {source} GROUP BY ALL), g AS (SELECT {by}, gene, count(*) AS c FROM {source} GROUP BY ALL),
        a AS (SELECT {by}, count(*)::DOUBLE AS m, sum(len(l))::DOUBLE AS total, min(len(l))::DOUBLE AS low, max(len(l)) AS high FROM z GROUP BY ALL), b AS (SELECT {by}, sum(c * c)::DOUBLE AS sq, count(*) AS n_distinct, max(c) AS max_count FROM g GROUP BY ALL),
        j AS (SELECT {by}, avg(len(list_intersect(z1.l, z2.l))::DOUBLE / (len(z1.l) + len(z2.l) - len(list_intersect(z1.l, z2.l)))) AS j FROM z z1 JOIN z z2 USING ({by}) WHERE z1.u < z2.u GROUP BY ALL)
        SELECT * EXCLUDE (m, total, low, high, sq, j), m::BIGINT AS n_sets, CASE WHEN m >= 2 AND total / m < {d} THEN 1 - ((total - sq / m) / (m - 1) / {d}) / ((total / m / {d}) * (1 - total / m / {d})) END AS phi,
        CASE WHEN m >= 2 AND low = high AND low < {d} THEN ({d} * ((sq - total) / 2) / (m * (m - 1) / 2) - low * low) / (low * ({d} - low)) END AS kuncheva, CASE WHEN m >= 2 THEN j END AS jaccard, CASE WHEN m >= 2 THEN total / m END AS mean_set_size
        FROM a JOIN b USING ({by}) LEFT JOIN j USING ({by})"""


STEPS |= _chain("", "cohort", REPEATS, SEED)
STEPS["v_state"] = _chosen("kept", "variance")
STEPS |= {k: v for k, v in _chain("v_", "cohort", REPEATS, SEED, "variance").items() if k not in ("v_folds", "v_train", "v_floor", "v_probes", "v_kept", "v_state")}
for _k in [k for k in STEPS if k.startswith("v_")]:
    STEPS[_k] = re.sub(r"\bv_(train|folds)\b", r"\1", STEPS[_k])
STEPS |= _chain("n_", "cohort", N_NULL, SEED)
STEPS["n_labels"] = f"""WITH r AS (SELECT b AS "repeat", sample_id, y FROM samples, (SELECT unnest(range({N_NULL})) AS b)) SELECT "repeat", u.sample_id, v.y FROM (SELECT "repeat", sample_id, row_number() OVER (PARTITION BY "repeat" ORDER BY sample_id) AS n FROM r) u
    JOIN (SELECT "repeat", y, row_number() OVER (PARTITION BY "repeat" ORDER BY md5(concat_ws(':', '{SEED}', '777', "repeat", sample_id)), sample_id) AS n FROM r) v USING ("repeat", n)"""
STEPS["n_folds"] = f"""SELECT "repeat", (row_number() OVER (PARTITION BY "repeat", y ORDER BY md5(({SEED} + 100000 * (1 + "repeat"))::VARCHAR || ':' || sample_id), sample_id) - 1) % {K} AS fold, sample_id, y FROM n_labels"""
STEPS["n_train"] = STEPS["n_train"].replace("c.y,", "f.y,")
STEPS["null_sets"] = "SELECT * FROM n_tt_sets"


def _groups() -> str:
    primary = "(SELECT * FROM pipelines WHERE role = 'primary')"
    return f"""SELECT 'model' AS dimension, 'explainer=' || explainer AS "group", pipeline FROM {primary} QUALIFY count(*) OVER (PARTITION BY explainer) >= 2
        UNION ALL SELECT 'explainer', 'model=' || model, pipeline FROM {primary} QUALIFY count(*) OVER (PARTITION BY model) >= 2 UNION ALL SELECT 'combined', 'all_primary', pipeline FROM {primary} QUALIFY count(*) OVER () >= 2
        UNION ALL SELECT 'baseline', p.pipeline || '_vs_ttest', unnest([p.pipeline, b.pipeline]) FROM {primary} p, (SELECT pipeline FROM pipelines WHERE role = 'baseline' ORDER BY position LIMIT 1) b
        UNION ALL SELECT 'sensitivity', 'logreg_coef_across_C', pipeline FROM pipelines WHERE model = 'logreg' AND explainer = 'coef' QUALIFY count(*) OVER () >= 2"""


def _repeat_level(own: str, within: str | None) -> str:
    out = f"""SELECT 'resampling' AS dimension, pipeline AS "group", k, "repeat", phi, jaccard, kuncheva, mean_set_size, n_sets AS n_units FROM {own}"""
    return out if within is None else f"""{out} UNION ALL SELECT dimension, "group", k, "repeat", avg(phi), avg(jaccard), avg(kuncheva), avg(mean_set_size), count(phi) FROM {within} GROUP BY ALL"""


STEPS |= {
    "groups": _groups(),
    "own_stats": set_stats("sets", 'k, pipeline, "repeat"', "fold"),
    "grouped_sets": "SELECT g.dimension, g.\"group\", s.* FROM sets s JOIN groups g USING (pipeline)",
    "within_stats": set_stats("grouped_sets", 'dimension, "group", k, "repeat", fold', "pipeline"),
    "level": _repeat_level("own_stats", "within_stats"),
    "tt_own": set_stats("tt_sets", 'k, pipeline, "repeat"', "fold"),
    "null_own": set_stats("null_sets", 'k, pipeline, "repeat"', "fold"),
    "tt_level": _repeat_level("tt_own", None),
    "null_level": _repeat_level("null_own", None),
}


def _gene_table(rankings: str, k: int) -> str:
    return f"""WITH t AS (SELECT r.*, p.model, p.role FROM {rankings} r JOIN pipelines p USING (pipeline) WHERE rank <= {k} AND importance > 0), n AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT "repeat", fold FROM {rankings})),
        f AS (SELECT pipeline, gene, any_value(model) AS model, any_value(explainer) AS explainer, any_value(role) = 'primary' AS prim, count(*) / any_value(n) AS freq FROM t, n GROUP BY 1, 2),
        c AS (SELECT gene, coalesce(sum(freq) FILTER (prim), 0) / 4 AS mean_selection_frequency, count(*) FILTER (prim AND freq >= 0.5) AS n_pipelines_ge50, count(DISTINCT model) FILTER (prim AND freq >= 0.5) AS n_models_ge50,
          count(DISTINCT explainer) FILTER (prim AND freq >= 0.5) AS n_explainers_ge50, coalesce(max(freq) FILTER (pipeline = 'ttest|ttest'), 0) AS ttest_frequency FROM f GROUP BY 1),
        r AS (SELECT gene, median(rank) FILTER (role = 'primary')::DOUBLE AS median_rank, min(rank) FILTER (role = 'primary') AS best_rank, avg(rank) FILTER (role = 'primary') AS mean_rank,
          avg(CASE WHEN signed > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (explainer IN ('coef', 'shap', 'ttest')) AS frac_signed_positive FROM t GROUP BY 1)
        SELECT *, n_pipelines_ge50 >= 2 AS consensus, row_number() OVER (ORDER BY round(mean_selection_frequency, 9) DESC, round(mean_rank, 9) NULLS LAST, gene) AS position FROM c LEFT JOIN r USING (gene)"""


def _metrics(source: str, by: str) -> str:
    def ap(positive: int, score: str, name: str) -> str:
        return f"""SELECT {by}, sum(p / tot * tp / (tp + fp)) AS {name} FROM (SELECT {by}, s, p, sum(p) OVER (PARTITION BY {by}) AS tot, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM (SELECT {by}, {score} AS s,
            sum(CASE WHEN y = {positive} THEN 1.0::DOUBLE ELSE 0 END) AS p, sum(CASE WHEN y = {positive} THEN 0.0::DOUBLE ELSE 1 END) AS n FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) WHERE tot > 0 GROUP BY {by}"""

    return f"""WITH c AS (SELECT {by}, sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS tn, sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS tp FROM {source} GROUP BY ALL),
        a AS ({_auc(source, by, "score")}), q AS ({ap(1, "score", "ap_cancer")}), r AS ({ap(0, "1 - score", "ap_normal")})
        SELECT {by}, tn, fp, fn, tp, tp::DOUBLE / (tp + fn) AS sensitivity, tn::DOUBLE / (tn + fp) AS specificity, (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 AS balanced_accuracy, 2 * tp::DOUBLE / (2 * tp + fp + fn) AS f1_cancer,
        2 * tn::DOUBLE / (2 * tn + fp + fn) AS f1_normal, auc AS roc_auc, ap_cancer, ap_normal FROM c JOIN a USING ({by}) JOIN q USING ({by}) JOIN r USING ({by})"""


def _weights(samples: str, n_boot: int) -> str:
    return f"""WITH n AS (SELECT y, count(*) AS n FROM {samples} GROUP BY 1), d AS (SELECT b, y, ('0x' || substr(md5(concat_ws(':', '{SEED}', b, y, draw)), 1, 8))::BIGINT % n AS i FROM n, (SELECT unnest(range({n_boot})) AS b), LATERAL (SELECT unnest(range(n)) AS draw))
        SELECT b, sample_id, count(*) AS w FROM d JOIN (SELECT sample_id, y, row_number() OVER (PARTITION BY y ORDER BY sample_id) - 1 AS i FROM {samples}) USING (y, i) GROUP BY 1, 2"""


def _whole(p: str, source: str) -> dict[str, str]:
    """A cohort collapsed on all of its samples."""
    return {f"{p}all": f'SELECT *, 0 AS "repeat", 0 AS fold FROM {source}', **_learned(p, f"{p}all"), f"{p}one": _chosen(f"{p}kept", "mean"), f"{p}rows": f"SELECT a.sample_id, a.probe_id, a.gene, a.y, a.x FROM {p}all a JOIN {p}one USING (probe_id)"}


def _c1c2(source: str, by: str = "") -> str:
    comma, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    avg_rank = lambda x: f"(rank() OVER ({part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {comma}{x}) - 1) / 2.0::DOUBLE)"
    scaled = lambda x: f"({avg_rank(x)} - 1) / (count(*) OVER ({part}) - 1)"
    key = by or "1 = 1"
    join = f"USING ({by})" if by else "ON TRUE"
    return f"""WITH b AS (SELECT *, round(sign(e_disc) * (auc_ext - 0.5), 9) AS rr, abs(e_disc) AS ee FROM {source}), k AS (SELECT {comma}s, {scaled("s")} AS S1, {scaled("rr")} AS R1, {scaled("ee")} AS A1 FROM b),
        m AS (SELECT {comma}count(*) AS n_genes, count(*) FILTER (s > 0) AS n_selected, var_pop(S1) AS ss, var_pop(A1) AS aa, covar_pop(S1, A1) AS sa, covar_pop(S1, R1) AS sr, covar_pop(A1, R1) AS ar, corr(S1, R1) AS c1, corr(S1, A1) AS rsa, corr(A1, R1) AS rra FROM k {f"GROUP BY {by}" if by else ""}),
        p AS (SELECT {comma}corr(a, c) AS c1_selected FROM (SELECT {comma}{avg_rank("s")} AS a, {avg_rank("rr")} AS c FROM b WHERE s > 0) {f"GROUP BY {by}" if by else ""} HAVING count(*) > 3)
        SELECT {comma}n_genes, n_selected, c1, (sr * aa - ar * sa) / (ss * aa - sa * sa) AS c2_stability, (ar * ss - sr * sa) / (ss * aa - sa * sa) AS c2_effect, (c1 - rsa * rra) / sqrt((1 - rsa * rsa) * (1 - rra * rra)) AS c2_partial, c1_selected FROM m LEFT JOIN p {join} WHERE {key} IS NOT NULL""".replace("WHERE 1 = 1 IS NOT NULL", "")


def _hedges(source: str, by: str = "gene") -> str:
    sp = "sqrt(((n1 - 1) * var1 + (n0 - 1) * var0) / (n1 + n0 - 2))"
    return f"SELECT {by}, CASE WHEN {sp} > 0 THEN (mean1 - mean0) / {sp} ELSE 0 END * (1 - 3.0::DOUBLE / (4 * (n1 + n0) - 9)) AS g FROM (SELECT {by}, {MOMENTS} FROM {source} GROUP BY ALL)"


def _zed(source: str) -> str:
    return f"SELECT *, (x - avg(x) OVER g) / CASE WHEN stddev_pop(x) OVER g > 0 THEN stddev_pop(x) OVER g ELSE 1 END AS z FROM {source} WINDOW g AS (PARTITION BY gene)"


def _pairs(units: str) -> str:
    return f"""SELECT f.* RENAME (e AS e_disc), auc AS auc_ext, h.g AS g_ext, round(auc - 0.5, 9) AS e_ext FROM frozen f JOIN ({_auc(units, "gene")}) USING (gene) JOIN ({_hedges(units)}) h USING (gene)"""


STEPS |= _whole("d_", "(SELECT * FROM cohort WHERE sample_id % 2 = 0)")
STEPS |= {
    "gt5": _gene_table("rankings", 5), "gt10": _gene_table("rankings", 10), "v_gt5": _gene_table("v_rankings", 5),
    "lists": "SELECT 'S_cons' AS list, position, gene FROM gt5 WHERE consensus UNION ALL SELECT 'S_top25', position, gene FROM gt5 WHERE position <= 5 UNION ALL SELECT 'S_top50', position, gene FROM gt10 WHERE position <= 10",
    "universe": "SELECT g.gene, round(coalesce(mean_selection_frequency, 0), 9) AS s FROM (SELECT DISTINCT gene FROM cohort) g LEFT JOIN gt5 USING (gene)",
    "effects": f"SELECT gene, probe_id, round(auc - 0.5, 9) AS e, g, sign(round(auc - 0.5, 9))::DOUBLE AS direction FROM ({_auc('d_rows', 'gene')}) JOIN ({_hedges('d_rows')}) USING (gene) JOIN (SELECT DISTINCT gene, probe_id FROM d_rows) USING (gene)",
    "frozen": "SELECT e.*, s, n_pipelines_ge50, mean_rank, consensus, " + ", ".join(f"gene IN (SELECT gene FROM lists WHERE list = '{n}') AS in_{n}" for n in ("S_cons", "S_top25", "S_top50")) + " FROM effects e JOIN universe USING (gene) LEFT JOIN (SELECT gene, n_pipelines_ge50, mean_rank, consensus FROM gt5) USING (gene)",
    "ext": "SELECT unit_id AS sample_id, probe_id, gene, subtype, y, x FROM units WHERE probe_id IN (SELECT probe_id FROM d_rows)",
    "ext_a": "SELECT unit_id AS sample_id, probe_id, gene, subtype, y, x FROM units_a WHERE probe_id IN (SELECT probe_id FROM d_rows)",
    "pairs": _pairs("ext"), "pairs_a": _pairs("ext_a"),
    "pairs_sub": " UNION ALL ".join(f"SELECT *, '{n}' AS subtype FROM ({_pairs(f'(SELECT * FROM ext WHERE subtype IN ({g}))')})" for n, g in (("Luminal", "'Luminal A', 'Luminal B', 'Healthy'"), ("HER2", "'Her2', 'Healthy'"), ("TNBC", "'TNBC', 'Healthy'"))),
    "d_z": _zed("d_rows"), "e_z": _zed("ext"),
    "weights": _weights("samples", N_BOOT),
    "ext_weights": _weights("(SELECT DISTINCT sample_id, y FROM ext)", N_BOOT_UNITS),
    "boot_pred": "SELECT p.*, w.b, w.w FROM pred p JOIN weights w USING (sample_id)",
    "boot": """WITH c AS (SELECT "repeat", b, (sum(CASE WHEN y = 1 AND pred = 1 THEN w ELSE 0 END)::DOUBLE / sum(CASE WHEN y = 1 THEN w ELSE 0 END) + sum(CASE WHEN y = 0 AND pred = 0 THEN w ELSE 0 END)::DOUBLE / sum(CASE WHEN y = 0 THEN w ELSE 0 END)) / 2 AS balanced_accuracy FROM boot_pred GROUP BY 1, 2),
        u AS (SELECT "repeat", b, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN y = 0 THEN w ELSE 0 END)::DOUBLE AS n FROM boot_pred GROUP BY 1, 2, 3),
        a AS (SELECT "repeat", b, sum(p * (coalesce(below, 0) + n / 2)) / (sum(p) * sum(n)) AS roc_auc FROM (SELECT *, sum(n) OVER (PARTITION BY "repeat", b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM u) GROUP BY 1, 2),
        v AS (SELECT "repeat", b, 1 - score AS s, sum(n) AS p, sum(p) AS n FROM u GROUP BY 1, 2, 3),
        q AS (SELECT "repeat", b, sum(p / tot * tp / (tp + fp)) AS ap_normal FROM (SELECT "repeat", b, p, sum(p) OVER (PARTITION BY "repeat", b) AS tot, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM v WINDOW w AS (PARTITION BY "repeat", b ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2)
        SELECT "repeat", b, roc_auc, ap_normal, balanced_accuracy FROM a JOIN q USING ("repeat", b) JOIN c USING ("repeat", b)""",
    "boot_auc": """SELECT b, gene, sum(p * (coalesce(below, 0) + n / 2)) / (sum(p) * sum(n)) AS auc_ext FROM (SELECT *, sum(n) OVER (PARTITION BY b, gene ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM
        (SELECT b, gene, x, sum(CASE WHEN y = 1 THEN w ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN y = 0 THEN w ELSE 0 END)::DOUBLE AS n FROM ext JOIN ext_weights USING (sample_id) GROUP BY 1, 2, 3)) GROUP BY 1, 2""",
    "boot_pairs": "SELECT b, gene, auc_ext, s, e AS e_disc FROM boot_auc JOIN frozen USING (gene)",
    "by_list": "SELECT p.*, list FROM pairs p JOIN lists USING (gene)",
}
_score = lambda z, genes, by: f"SELECT {by}sample_id, y, round(coalesce(avg(CASE WHEN e_disc > 0 THEN z END), 0) - coalesce(avg(CASE WHEN e_disc < 0 THEN z END), 0), 9) AS score FROM {z} JOIN {genes} USING (gene) GROUP BY ALL"
STEPS |= {
    "sig_e": _score("e_z", "by_list", "list, "), "sig_d": _score("d_z", "by_list", "list, "),
    "top_genes": "SELECT gene, e AS e_disc FROM frozen WHERE in_S_top25",
    "top_d": _score("d_z", "top_genes", ""), "top_e": _score("e_z", "top_genes", ""),
}
for _t, _z in (("d", "d_z"), ("e", "e_z")):
    STEPS[f"panel_{_t}"] = f"SELECT sample_id, y, round(avg(z), 9) AS panel FROM {_z} WHERE gene IN ('G1', 'G4', 'G9', 'G99') GROUP BY 1, 2"
    STEPS[f"both_{_t}"] = f"SELECT t.*, panel FROM top_{_t} t JOIN panel_{_t} USING (sample_id)"
    STEPS[f"left_{_t}"] = f"SELECT sample_id, y, round(score - a - b * panel, 9) AS score FROM both_{_t}, (SELECT regr_slope(score, panel) AS b, regr_intercept(score, panel) AS a FROM both_{_t})"


#: Decimals where six would split shares at the half.
DIGITS = dict.fromkeys(("rank_features", "auc_ranking", "auc_effects", "gene_level_replication", "classification_metrics", "pooled_metrics_by_repeat", "fold_metric_summary", "document_cohort_metrics"), 9) | {"list_level_replication": 7}


def assembled(select: str, doubles: str = "", digits: int = 6) -> str:
    """``select`` with the steps that it needs in front, doubles rounded as the catalogue's are."""
    if doubles:
        select = f"SELECT * REPLACE ({', '.join(f'round({d}, {digits}) + 0.0::DOUBLE AS {d}' for d in doubles.split())}) FROM ({select})"
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in re.findall(r"\b\w+\b", sql):
            if name in STEPS and name not in needed:
                needed.add(name)
                visit(STEPS[name])

    visit(select)
    order: list[str] = []

    def place(name: str) -> None:
        for other in re.findall(r"\b\w+\b", STEPS[name]):
            if other in needed and other not in order and other != name:
                place(other)
        if name not in order:
            order.append(name)

    for name in sorted(needed):
        place(name)
    steps = ",\n".join(f"{n} AS ({STEPS[n]})" for n in order)
    return f"WITH {steps}\n{select}" if steps else select


def _spearman(source: str, a: str, b: str, by: str = "") -> str:
    comma, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    rank = lambda x: f"rank() OVER ({part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {comma}{x}) - 1) / 2.0::DOUBLE"
    return f"SELECT {comma}corr(a, b) AS rho, count(*) AS n FROM (SELECT {comma}{rank(a)} AS a, {rank(b)} AS b FROM {source}) {f'GROUP BY {by}' if by else ''}"


def _composition(tag: str, t: str) -> str:
    rho = _spearman(f"both_{t}", "score", "panel", "y")
    return f"""SELECT '{tag}' AS cohort, (SELECT auc FROM ({_auc(f"(SELECT y, panel AS score FROM both_{t})", "", "score")})) AS panel_auc, (SELECT auc FROM ({_auc(f"both_{t}", "", "score")})) AS signature_auc,
        (SELECT auc FROM ({_auc(f"left_{t}", "", "score")})) AS residual_auc, (SELECT rho FROM ({rho}) WHERE y = 0) AS spearman_normal, (SELECT rho FROM ({rho}) WHERE y = 1) AS spearman_cancer"""


_LINES = "(SELECT l_partkey || '_at' AS probe_id FROM lineitem WHERE l_suppkey % 2 = {})"
_F = '"repeat", fold'
_verdict = lambda name, p: f"SELECT '{name}' AS setting, (SELECT phi FROM ({set_stats(f'(SELECT * FROM {p}tt_sets WHERE k = 5)', 'k', '\"repeat\", fold')})) AS phi, (SELECT min(auc) FROM ({_auc(f'{p}pred', '\"repeat\"', 'score')})) AS auc"
_band = lambda x: f"CASE WHEN {x} < 0.40 THEN 'poor' WHEN {x} < 0.75 THEN 'intermediate_to_good' ELSE 'excellent' END"
_STATS = "phi kuncheva jaccard mean_set_size"
_INTERVAL = lambda vs: ", ".join(f"quantile_cont({v}, {q}) AS {v}_{n}" for v in vs for n, q in (("lo", 0.025), ("hi", 0.975)))
_GENE_DOUBLES = "mean_selection_frequency ttest_frequency median_rank mean_rank frac_signed_positive"
_METRIC_DOUBLES = "sensitivity specificity balanced_accuracy f1_cancer f1_normal roc_auc ap_cancer ap_normal"
_FOLD_METRICS = ("roc_auc", "ap_cancer", "ap_normal", "balanced_accuracy", "f1_normal")
_ENRICH = """WITH lib AS (SELECT DISTINCT term, gene FROM (SELECT p_brand AS term, 'G' || (p_partkey % 500) AS gene FROM part UNION ALL SELECT p_type, 'G' || (p_partkey % 500) FROM part)),
    bg AS (SELECT gene FROM frozen WHERE gene IN (SELECT gene FROM lib)), fg AS (SELECT gene FROM frozen WHERE in_S_top50 AND gene IN (SELECT gene FROM lib)),
    s AS (SELECT (SELECT count(*) FROM bg) AS N1, (SELECT count(*) FROM fg) AS n), t AS (SELECT term, count(*) AS K1, count(f.gene) AS k, coalesce(string_agg(f.gene, ';' ORDER BY f.gene), '') AS overlap_genes FROM lib JOIN bg USING (gene) LEFT JOIN fg f USING (gene) GROUP BY 1 HAVING count(*) BETWEEN 5 AND 500),
    p AS (SELECT *, CASE WHEN k = 0 OR n = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, (SELECT sum(CASE WHEN n - i <= N1 - K1 THEN exp(lgamma(K1 + 1) - lgamma(i + 1) - lgamma(K1 - i + 1) + lgamma(N1 - K1 + 1) - lgamma(n - i + 1) - lgamma(N1 - K1 - n + i + 1) - lgamma(N1 + 1) + lgamma(n + 1) + lgamma(N1 - n + 1)) ELSE 0 END)
      FROM (SELECT unnest(range(k, least(K1, n) + 1)) AS i))), 12) END AS p_value FROM t, s),
    q AS (SELECT *, p_value * count(*) OVER () / i AS q FROM (SELECT *, row_number() OVER (ORDER BY p_value, term) AS i FROM p))
    SELECT term, k AS overlap, n AS foreground_size, K1 AS term_size, N1 AS background_size, ((k + 0.5::DOUBLE) * (N1 - K1 - n + k + 0.5::DOUBLE)) / ((K1 - k + 0.5::DOUBLE) * (n - k + 0.5::DOUBLE)) AS odds_ratio, p_value, overlap_genes, least(1.0::DOUBLE, min(q) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS adj_p FROM q"""
_CUSTOMERS = f"""SELECT gene, n1, n0, mean1, mean0, {WELCH} AS t FROM (SELECT p_brand AS gene, {MOMENTS} FROM (SELECT p_brand, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y, round(ln(1 + v), 9) AS x FROM
    (SELECT o_custkey, p_brand, sum(l_extendedprice) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) JOIN customer ON o_custkey = c_custkey) GROUP BY 1)"""
_DOCUMENTS = r"""(SELECT 'documents' AS cohort, doc_id AS sample_id, quality AS y, score, CASE WHEN score > 0.4 THEN 1 ELSE 0 END AS pred FROM (SELECT doc_id, quality, round(len(list_distinct(w))::DOUBLE / len(w), 6) AS score FROM
    (SELECT doc_id, quality, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents JOIN labels USING (doc_id)) WHERE len(w) > 0))"""

_SCOPES = lambda d: set_stats("(SELECT *, 'all_runs' AS scope FROM sets UNION ALL SELECT *, 'repeat_' || \"repeat\" FROM sets)", "pipeline, k, scope", '"repeat", fold', d)
_TAIL = lambda p, first, last: f"list_sum(list_transform(range({first}, {last} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - ({p})))))"
_EXACT = f"""SELECT * FROM (WITH RECURSIVE a AS (SELECT count(*) AS n, count(*) FILTER (sign(e_disc) = sign(e_ext)) AS k FROM pairs), r AS (SELECT 0 AS i, n, k, 0.0::DOUBLE AS a1, 1.0::DOUBLE AS a2, 0.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM a
    UNION ALL SELECT i + 1, n, k, CASE WHEN lo THEN (a1 + a2) / 2 ELSE a1 END, CASE WHEN lo THEN a2 ELSE (a1 + a2) / 2 END, CASE WHEN hi THEN (b1 + b2) / 2 ELSE b1 END, CASE WHEN hi THEN b2 ELSE (b1 + b2) / 2 END
      FROM (SELECT *, {_TAIL("(a1 + a2) / 2", "k", "n")} < 0.025 AS lo, {_TAIL("(b1 + b2) / 2", "0", "k")} > 0.025 AS hi FROM r WHERE i < 50))
    SELECT n, k AS n_consistent, k::DOUBLE / n AS fraction, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE (a1 + a2) / 2 END AS fraction_lo, CASE WHEN k = n THEN 1.0::DOUBLE ELSE (b1 + b2) / 2 END AS fraction_hi FROM r WHERE i = 50)"""

QUERIES: dict[str, tuple[str, str]] = {
    "slice_phi_by_repeat": ('SELECT "repeat", phi, kuncheva, jaccard FROM tt_own WHERE k = 10', "phi kuncheva jaccard"),
    "cohort_profile": (f"SELECT probe_id, gene, count(*) AS n, min(x) AS low, max(x) AS high, avg(x) AS mean, median(x) AS median, count(*) FILTER (x <= -0.15::DOUBLE + {TOL}) AS n_floor FROM cohort GROUP BY 1, 2", "low high mean median"),
    "duplicate_columns": ("SELECT min(probe_id) AS first, count(*) AS n FROM (SELECT probe_id, list(x ORDER BY sample_id) AS v FROM (SELECT probe_id, sample_id, x FROM cohort UNION ALL SELECT 'copy_at', sample_id, x FROM cohort WHERE p = 3) GROUP BY 1) GROUP BY v HAVING count(*) > 1", ""),
    "class_counts": ("SELECT y, count(*) AS n FROM samples GROUP BY 1", ""),
    "class_crosstab": ("SELECT sample_group, count(DISTINCT sample_id) FILTER (ends_with(title, 'repA')) AS \"repA\", count(DISTINCT sample_id) FILTER (ends_with(title, 'repB')) AS \"repB\" FROM arrays GROUP BY 1", ""),
    "usable_probes": ("SELECT * FROM usable", ""),
    "feature_universe": (f"SELECT probe_id, gene FROM usable WHERE probe_id IN {_LINES.format(0)} AND probe_id IN {_LINES.format(1)}", ""),
    "missing_probes": (f"SELECT probe_id FROM usable WHERE probe_id NOT IN (SELECT probe_id FROM {_LINES.format(0)} WHERE NOT starts_with(probe_id, '1'))", ""),
    "annotation_profile": ("SELECT (SELECT count(*) FROM usable) AS n_probes, (SELECT count(DISTINCT gene) FROM usable) AS n_genes, (SELECT count(DISTINCT entrez) FROM usable) AS n_entrez, count(*) FILTER (p >= 2) AS genes_ge2, count(*) FILTER (p >= 5) AS genes_ge5, count(*) FILTER (e > 1) AS genes_multi_entrez FROM (SELECT gene, count(*) AS p, count(DISTINCT entrez) AS e FROM usable GROUP BY 1)", ""),
    "first_entrez": ("SELECT gene, arg_min(entrez, probe_id) AS entrez FROM usable GROUP BY 1", ""),
    "derive_labels": ("SELECT sample_id, (CASE t WHEN 'breast cancer' THEN 1 ELSE 0 END)::BIGINT AS y FROM tissues WHERE t IN ('breast cancer', 'normal breast')", ""),
    "label_violations": ("SELECT sample_id, 'tissue' AS field FROM tissues WHERE t NOT IN ('breast cancer', 'normal breast') UNION ALL SELECT sample_id, field FROM (SELECT sample_id, t, unnest(['source_name', 'title', 'description']) AS field, unnest([contains(lower(source_name), 'cancer'), starts_with(lower(title), 'breast cancer'), contains(lower(description), 'cancer')]) AS says FROM tissues WHERE t IN ('breast cancer', 'normal breast')) WHERE says <> (t = 'breast cancer')", ""),
    "processing_month": ("SELECT sample_id, month FROM months", ""),
    "subset_month": ("SELECT sample_id, y FROM months WHERE month = '95-03'", ""),
    "subset_random_control": (f"SELECT sample_id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || sample_id), sample_id) AS i FROM months) m JOIN (SELECT y, count(*) AS n FROM months WHERE month = '95-03' GROUP BY 1) USING (y) WHERE i <= n", ""),
    "exclude_genes": ("SELECT gene, count(DISTINCT probe_id) AS n_probes, avg(x) AS mean FROM cohort WHERE gene NOT IN ('G0', 'G1') GROUP BY 1", "mean"),
    "sample_metadata_pivot": ("SELECT conv_id, min(turn) FILTER (role = 'assistant') AS assistant, min(turn) FILTER (role = 'user') AS \"user\" FROM conversations GROUP BY 1", ""),
    "stratified_folds": ("SELECT * FROM folds", ""),
    "fold_balance": (f"SELECT {_F}, y, count(*) AS n FROM folds GROUP BY ALL", ""),
    "fold_overlap_check": ('SELECT DISTINCT t."repeat", t.fold, t.sample_id FROM train t JOIN folds f ON t.sample_id = f.sample_id AND t."repeat" = f."repeat" AND t.fold = f.fold', ""),
    "too_small_classes": ("SELECT label::BIGINT AS y, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) < 60 OR label NOT IN (0, 1)", ""),
    "permuted_labels": ("SELECT * FROM permuted0", ""),
    "permutation_table": ("SELECT * FROM moves", ""),
    "bootstrap_weights": ("SELECT * FROM weights", ""),
    "floor_filter_state": ("SELECT * FROM floor", "floor floor_share"),
    "floor_filter_kept": (f"SELECT {_F}, probe_id, n_detected FROM kept", ""),
    "n_detected_train": (f"SELECT {_F}, probe_id, coalesce(n_found, 0) AS n_detected, n FROM probes", ""),
    "probe_collapse_max_mean": (f"SELECT {_F}, gene, probe_id FROM state", ""),
    "probe_collapse_max_variance": (f"SELECT {_F}, gene, probe_id FROM v_state", ""),
    "fold_scaling_stats": (f"SELECT {_F}, gene, probe_id, mean, scale FROM state", "mean scale"),
    "fold_zscores": (f"SELECT {_F}, sample_id, gene, z FROM test_z", "z"),
    "preprocess_diagnostics": (f"SELECT * FROM (SELECT {_F}, count(*) AS n_probes, count(DISTINCT gene) AS n_genes FROM probes GROUP BY 1, 2) JOIN (SELECT {_F}, count(*) AS n_used FROM state GROUP BY 1, 2) USING ({_F})", ""),
    "welch_t_by_fold": (f"SELECT {_F}, gene, {WELCH} AS t FROM state", "t"),
    "welch_zero_variance_cases": (f"SELECT probe_id, {WELCH} AS t FROM (SELECT probe_id, {MOMENTS} FROM (SELECT probe_id, y, CASE p WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN y * 2.0::DOUBLE ELSE y * -2.0::DOUBLE END AS x FROM cohort WHERE p < 3) GROUP BY 1)", "t"),
    "rank_features": (f"SELECT pipeline, {_F}, gene, importance, rank FROM rankings", "importance"),
    "topk_positive": (f"SELECT pipeline, {_F}, gene, rank FROM rankings WHERE rank <= 5 AND importance > 0", ""),
    "linear_coef_rank": (f"SELECT *, row_number() OVER (PARTITION BY {_F} ORDER BY importance DESC, gene) AS rank FROM coef", "importance signed"),
    "linear_shap_importance": ("SELECT * FROM shap", "importance signed"),
    "linear_permutation_importance": ("SELECT * FROM perm", "importance signed"),
    "balanced_brier": ("SELECT * FROM brier", "loss"),
    "auc_ranking": ("SELECT * FROM train_auc", "auc"),
    "group_definitions": ("SELECT * FROM groups WHERE pipeline IN (SELECT pipeline FROM rankings)", ""),
    "stats_variable_sizes": (set_stats("sets", 'k, "repeat", fold', "pipeline"), _STATS),
    "nogueira_kuncheva_jaccard": ('SELECT pipeline, k, "repeat", phi, kuncheva, jaccard FROM own_stats', "phi kuncheva jaccard"),
    "repeat_level_stability": ("SELECT * FROM level", _STATS),
    "summarize_repeats": ('SELECT dimension, "group", k, count(DISTINCT "repeat") AS n_repeats, avg(phi) AS phi_mean, median(phi) AS phi_median, min(phi) AS phi_min, max(phi) AS phi_max, stddev_samp(phi) AS phi_sd, avg(jaccard) AS jaccard_mean, median(jaccard) AS jaccard_median, avg(kuncheva) AS kuncheva_mean, avg(mean_set_size) AS mean_set_size FROM level GROUP BY ALL', "phi_mean phi_median phi_min phi_max phi_sd jaccard_mean jaccard_median kuncheva_mean mean_set_size"),
    "stability_summary_scopes": ("SELECT * EXCLUDE (max_count) FROM (" + set_stats("(SELECT *, unnest(['all_runs', 'repeat_' || \"repeat\"]) AS scope FROM sets)", "pipeline, k, scope", '"repeat", fold') + ")", _STATS),
    "pooled_resampling": ("SELECT p.* EXCLUDE (max_count), n_ge_50, n_ge_80, max_count / n_sets::DOUBLE AS max_frequency FROM (" + set_stats("sets", "k, pipeline", '"repeat", fold') + ") p JOIN (SELECT k, pipeline, count(*) FILTER (c >= 0.5 * n) AS n_ge_50, count(*) FILTER (c >= 0.8 * n) AS n_ge_80 FROM (SELECT k, pipeline, gene, count(*) AS c FROM sets GROUP BY ALL) JOIN (SELECT k, pipeline, count(*) AS n FROM (SELECT DISTINCT k, pipeline, \"repeat\", fold FROM sets) GROUP BY ALL) USING (k, pipeline) GROUP BY ALL) USING (k, pipeline)", _STATS + " max_frequency"),
    "pairwise_jaccard": ('WITH l AS (SELECT k, pipeline, "repeat", fold, list(gene) AS g FROM sets GROUP BY ALL) SELECT a.k, a.pipeline AS a, b.pipeline AS b, avg(len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))) AS jaccard FROM l a JOIN l b ON a.k = b.k AND a."repeat" = b."repeat" AND a.fold = b.fold GROUP BY ALL', "jaccard"),
    "gene_table_k5": ("SELECT * FROM gt5", _GENE_DOUBLES),
    "gene_table_k10": ("SELECT * FROM gt10", _GENE_DOUBLES),
    "frozen_lists": ("SELECT * FROM lists", ""),
    "universe_frequency": ("SELECT * FROM universe", "s"),
    "run_comparison_full_outer": ("SELECT gene, coalesce(a.mean_selection_frequency, 0) AS freq_a, coalesce(b.mean_selection_frequency, 0) AS freq_b FROM gt5 a FULL JOIN v_gt5 b USING (gene)", "freq_a freq_b"),
    "run_comparison_spearman": (_spearman("(SELECT gene, round(coalesce(a.mean_selection_frequency, 0), 9) AS fa, round(coalesce(b.mean_selection_frequency, 0), 9) AS fb FROM gt5 a FULL JOIN v_gt5 b USING (gene))", "fa", "fb"), "rho"),
    "phi_band_verdict": (f"WITH v AS ({_verdict('mean', '')} UNION ALL {_verdict('variance', 'v_')}), d AS (SELECT setting, phi, {_band('phi')} AS band, auc >= 0.9 AS auc_ok, {_band('phi')} = (SELECT {_band('phi')} FROM v WHERE setting = 'mean') AS same_band FROM v) SELECT *, CASE WHEN (SELECT bool_and(auc_ok AND same_band) FROM d) THEN 'robust' ELSE 'materially_changed' END AS verdict FROM d", "phi"),
    "classification_metrics": (_metrics("pred", _F), _METRIC_DOUBLES),
    "pooled_metrics_by_repeat": (_metrics("pred", '"repeat"'), _METRIC_DOUBLES),
    "fold_metric_summary": (f"SELECT {', '.join(f'{f}({n}) AS {n}_{s}' for n in _FOLD_METRICS for s, f in (('mean', 'avg'), ('sd', 'stddev_samp')))} FROM ({_metrics('pred', _F)})", " ".join(f"{n}_{s}" for n in _FOLD_METRICS for s in ("mean", "sd"))),
    "predicted_once": ('SELECT "repeat", sample_id, count(*) AS n FROM pred GROUP BY 1, 2 HAVING count(*) > 1', ""),
    "bootstrap_metrics": ("SELECT * FROM boot", "roc_auc ap_normal balanced_accuracy"),
    "bootstrap_intervals": (f'SELECT "repeat", {_INTERVAL(("roc_auc", "ap_normal", "balanced_accuracy"))} FROM boot GROUP BY 1', " ".join(f"{v}_{s}" for v in ("roc_auc", "ap_normal", "balanced_accuracy") for s in ("lo", "hi"))),
    "auc_effects": (_auc("d_rows", "gene"), "auc"),
    "hedges_g": (_hedges("d_rows"), "g"),
    "within_cohort_z": ("SELECT sample_id, gene, z FROM d_z", "z"),
    "external_units_mean": ("SELECT unit_id, probe_id, subtype, y, n_arrays, x FROM units", "x"),
    "external_units_repA": ("SELECT unit_id, probe_id, subtype, y, n_arrays, x FROM units_a", "x"),
    "unit_errors": ("SELECT DISTINCT sample_id FROM arrays WHERE sample_group NOT IN ('CellLine', 'Healthy') AND sample_id % 33 = 0", ""),
    "freeze_gene_table": ("SELECT * FROM frozen", "e g direction s mean_rank"),
    "gene_level_replication": ("SELECT gene, probe_id, e_disc, s, auc_ext, e_ext, sign(e_disc) * e_ext AS aligned_effect FROM pairs", "e_disc s auc_ext e_ext aligned_effect"),
    "c1_c2": (_c1c2("pairs"), "c1 c2_stability c2_effect c2_partial c1_selected"),
    "direction_consistency": ("SELECT count(*) AS n, count(*) FILTER (sign(e_disc) = sign(e_ext)) AS n_consistent, avg(CASE WHEN sign(e_disc) = sign(e_ext) THEN 1.0::DOUBLE ELSE 0 END) AS fraction FROM pairs", "fraction"),
    "subtype_replication": (f"SELECT * FROM ({_c1c2('pairs_sub', 'subtype')}) JOIN (SELECT subtype, count(*) FILTER (sign(e_disc) = sign(e_ext)) AS n_consistent, avg(CASE WHEN sign(e_disc) = sign(e_ext) THEN 1.0::DOUBLE ELSE 0 END) AS fraction FROM pairs_sub GROUP BY 1) USING (subtype)", "c1 c2_stability c2_effect c2_partial c1_selected fraction"),
    "repA_replication": (_c1c2("pairs_a"), "c1 c2_stability c2_effect c2_partial c1_selected"),
    "bootstrap_c1": (f"SELECT {_INTERVAL(('c1', 'c2_stability', 'c2_partial'))} FROM ({_c1c2('boot_pairs', 'b')})", " ".join(f"{v}_{s}" for v in ("c1", "c2_stability", "c2_partial") for s in ("lo", "hi"))),
    "list_level_replication": (f"""SELECT * FROM (SELECT list, count(*) AS n_genes, avg(sign(e_disc) * e_ext) AS mean_aligned_effect, avg(sign(e_disc) * g_ext) AS mean_aligned_g, count(*) FILTER (e_disc > 0) AS n_up, count(*) FILTER (e_disc < 0) AS n_down,
        count(*) FILTER (sign(e_disc) = sign(e_ext)) AS n_consistent, avg(CASE WHEN sign(e_disc) = sign(e_ext) THEN 1.0::DOUBLE ELSE 0 END) AS fraction FROM by_list GROUP BY 1 HAVING count(*) >= 2)
        JOIN (SELECT list, CASE WHEN n > 2 THEN rho END AS spearman FROM ({_spearman("by_list", "e_disc", "e_ext", "list")})) USING (list) JOIN (SELECT list, auc AS signature_auc_ext FROM ({_auc("sig_e", "list", "score")})) USING (list) JOIN (SELECT list, auc AS signature_auc_disc FROM ({_auc("sig_d", "list", "score")})) USING (list)""", "mean_aligned_effect mean_aligned_g fraction spearman signature_auc_ext signature_auc_disc"),
    "signature_score": ("SELECT * FROM top_d", "score"),
    "panel_score": ("SELECT * FROM panel_d", "panel"),
    "panel_membership": ("SELECT p.gene, panel, s IS NOT NULL AS in_universe, s, percentile, " + ", ".join(f"p.gene IN (SELECT gene FROM lists WHERE list = '{n}') AS in_{n}" for n in ("S_cons", "S_top25", "S_top50")) + " FROM (VALUES ('G1', 'primary'), ('G4', 'primary'), ('G9', 'extended'), ('G99', 'extended')) p(gene, panel) LEFT JOIN (SELECT gene, s, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE) / count(*) OVER () AS percentile FROM universe) USING (gene)", "s percentile"),
    "composition_block": (f"{_composition('discovery', 'd')} UNION ALL {_composition('external', 'e')}", "panel_auc signature_auc residual_auc spearman_normal spearman_cancer"),
    "spearman_matrix": (_spearman("(SELECT a.gene, a.x, b.x AS x0 FROM d_rows a JOIN d_rows b USING (sample_id) WHERE b.gene = 'G0' AND a.gene <> 'G0')", "x", "x0", "gene"), "rho"),
    "probe_correlation": ("SELECT p, max(r) AS max_r FROM (SELECT a.p AS p, b.p AS q, corr(a.x, b.x) AS r FROM cohort a JOIN cohort b USING (sample_id) WHERE a.p < b.p GROUP BY 1, 2) GROUP BY 1", "max_r"),
    "enrichment_terms": (_ENRICH, "odds_ratio p_value adj_p"),
    "enrichment_summary": (f"SELECT 'S_top50' AS foreground, 'parts' AS library, max(foreground_size) AS n_foreground, max(background_size) AS n_background, count(*) AS n_terms, count(*) FILTER (adj_p < 0.05) AS n_significant, min(adj_p) AS min_adj_p FROM ({_ENRICH})", "min_adj_p"),
    "benjamini_hochberg": (f"""SELECT term, p_value, least(1.0::DOUBLE, min(q) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS adj_p FROM (SELECT *, p_value * count(*) OVER () / i AS q FROM (SELECT *, row_number() OVER (ORDER BY p_value, term) AS i FROM
        (SELECT term, round(least(1.0::DOUBLE, exp(-t * t / 2) * 2 / (t + sqrt(t * t + 8 / 3.141592653589793::DOUBLE))), 12) AS p_value FROM (SELECT probe_id AS term, abs({WELCH}) AS t FROM (SELECT probe_id, {MOMENTS} FROM cohort GROUP BY 1)))))""", "p_value adj_p"),
    "ttest_lr_top": (f"SELECT {_F}, gene, rank FROM tt_rank WHERE rank <= 5", ""),
    "direction_interval": (_EXACT, "fraction fraction_lo fraction_hi"),
    "gene_level_summary": (f"""SELECT * FROM ({_c1c2("pairs")}), (SELECT rho AS spearman_effects FROM ({_spearman("pairs", "e_disc", "e_ext", "")})), (SELECT count(*) FILTER (sign(e_disc) = sign(e_ext)) AS n_consistent, avg(CASE WHEN sign(e_disc) = sign(e_ext) THEN 1.0::DOUBLE ELSE 0 END) AS fraction FROM pairs),
        (SELECT count(*) AS n_units, count(*) FILTER (y = 0) AS n_normal FROM (SELECT DISTINCT sample_id, y FROM ext))""", "c1 c2_stability c2_effect c2_partial c1_selected spearman_effects fraction"),
    "signature_intervals": (f"""SELECT list, {_INTERVAL(("signature_auc",))} FROM (SELECT list, b, sum(p * (coalesce(below, 0) + n / 2)) / (sum(p) * sum(n)) AS signature_auc FROM (SELECT *, sum(n) OVER (PARTITION BY list, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM
        (SELECT list, b, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN y = 0 THEN w ELSE 0 END)::DOUBLE AS n FROM sig_e JOIN (SELECT sample_id, b, w FROM ext_weights) USING (sample_id) GROUP BY 1, 2, 3)) GROUP BY 1, 2) GROUP BY 1""", "signature_auc_lo signature_auc_hi"),
    "list_notes": ("""SELECT list, coalesce(n, 0) AS n_genes, CASE WHEN n >= 2 THEN n_up END AS n_up, CASE WHEN coalesce(n, 0) < 2 THEN 'too few genes for statistics of a list' END AS note FROM (SELECT unnest(['S_cons', 'S_top25', 'S_top50']) AS list)
        LEFT JOIN (SELECT list, count(*) AS n, count(*) FILTER (e_disc > 0) AS n_up FROM by_list GROUP BY 1) USING (list)""", ""),
    "panel_constants": ("SELECT gene, panel, coalesce(n_probes, 0) AS n_probes FROM (SELECT unnest(['ADIPOQ', 'PLIN1', 'FABP4']) AS gene, 'core' AS panel UNION ALL SELECT unnest(['LEP', 'LPL', 'CFD', 'ADH1B', 'CIDEC', 'PLIN4', 'CD36', 'GPD1']), 'wide') LEFT JOIN (SELECT gene, count(*) AS n_probes FROM usable GROUP BY 1) USING (gene)", ""),
    "alternative_universe": (f"SELECT pipeline, k, scope, a.phi, b.phi AS phi_alt FROM ({_SCOPES(D + 6)}) a JOIN ({_SCOPES(D)}) b USING (pipeline, k, scope)", "phi phi_alt"),
    "misordered_samples": ("SELECT pos, c AS \"column\", s AS sample FROM (SELECT sample_id AS c, row_number() OVER (ORDER BY sample_id) AS pos FROM samples) FULL JOIN (SELECT sample_id AS s, row_number() OVER (ORDER BY sample_id) AS pos FROM samples WHERE sample_id <> 7) USING (pos) WHERE c IS DISTINCT FROM s", ""),
    "null_repeat_level": ("SELECT * FROM null_level", _STATS),
    "compare_observed_null": (f"""WITH both_sides AS (SELECT dimension, "group", k, statistic, v, true AS seen FROM (UNPIVOT (SELECT dimension, "group", k, phi, jaccard FROM tt_level) ON phi, jaccard INTO NAME statistic VALUE v)
        UNION ALL SELECT dimension, "group", k, statistic, v, false FROM (UNPIVOT (SELECT dimension, "group", k, phi, jaccard FROM null_level) ON phi, jaccard INTO NAME statistic VALUE v)),
        each AS (SELECT dimension, "group", k, statistic, {", ".join(f"{f}(v) FILTER ({'seen' if side == 'observed' else 'NOT seen'}) AS {side}_{label}" for side in ("observed", "null") for label, f in (("n", "count"), ("mean", "avg"), ("median", "median"), ("least", "min"), ("most", "max")))},
            quantile_cont(v, 0.025) FILTER (NOT seen) AS null_p2_5, quantile_cont(v, 0.975) FILTER (NOT seen) AS null_p97_5 FROM both_sides GROUP BY ALL)
        SELECT e.*, observed_mean - null_mean AS mean_difference, observed_median - null_median AS median_difference, share_above, observed_least > null_most AS all_above
        FROM each e JOIN (SELECT dimension, "group", k, statistic, avg(CASE WHEN v > null_p97_5 THEN 1.0::DOUBLE ELSE 0 END) AS share_above FROM both_sides JOIN each USING (dimension, "group", k, statistic) WHERE seen GROUP BY ALL) USING (dimension, "group", k, statistic)
        WHERE observed_n > 0 AND null_n > 0""", "observed_mean observed_median observed_least observed_most null_mean null_median null_least null_most null_p2_5 null_p97_5 mean_difference median_difference share_above"),
    "phi_by_k_pivot": ('SELECT "group", avg(phi) FILTER (k = 5) AS phi_k5, avg(phi) FILTER (k = 10) AS phi_k10, min(phi) FILTER (k = 10) AS low, max(phi) FILTER (k = 10) AS high FROM level WHERE dimension = \'resampling\' GROUP BY 1', "phi_k5 phi_k10 low high"),
    "top_genes_by_frequency": ("SELECT t.gene, position, " + ", ".join(f"count(*) FILTER (pipeline = '{p}') / {K * REPEATS}.0::DOUBLE AS {p.replace('|', '_')}" for p in ("mdiff|coef", "mdiff|shap", "mdiff|perm", "auc|coef", "ttest|ttest")) + " FROM gt5 t JOIN rankings r ON r.gene = t.gene AND r.rank <= 5 AND r.importance > 0 WHERE position <= 8 GROUP BY 1, 2", "mdiff_coef mdiff_shap mdiff_perm auc_coef ttest_ttest"),
    "performance_summary": (f"SELECT count(*) AS n_repeats, avg(roc_auc) AS roc_auc, avg(roc_auc_lo) AS roc_auc_lo, avg(roc_auc_hi) AS roc_auc_hi, avg(balanced_accuracy) AS balanced_accuracy, avg(balanced_accuracy_lo) AS balanced_accuracy_lo, avg(balanced_accuracy_hi) AS balanced_accuracy_hi FROM ({_metrics('pred', '\"repeat\"')}) JOIN (SELECT \"repeat\", {_INTERVAL(('roc_auc', 'balanced_accuracy'))} FROM boot GROUP BY 1) USING (\"repeat\")", "roc_auc roc_auc_lo roc_auc_hi balanced_accuracy balanced_accuracy_lo balanced_accuracy_hi"),
    "customer_cohort_profile": (_CUSTOMERS, "mean1 mean0 t"),
    "document_cohort_metrics": (_metrics(_DOCUMENTS, "cohort"), _METRIC_DOUBLES),
}


def oracle_sql() -> dict[str, str]:
    return {name: assembled(*q, DIGITS.get(name, 6)) for name, q in QUERIES.items()}
