import math

import numpy as np
import pytest

from featstab.llm import ann
from featstab.llm.common import table


def brute(rows, queries, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable.setdefault(len(v), []).append((i, v))
    if not usable:
        return {}
    rows = usable[min(usable, key=lambda d: (-len(usable[d]), d))]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    out = {}
    for i, v in rows:
        if i in queries:
            score = (x * np.array(v, dtype=float)).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(n + 1, int(ids[j]), float(score[j])) for n, j in enumerate(order)]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_against_brute_force(spark, folder):
    folder = f"/root/testdata/{folder}"
    rows = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    want, got = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20), found(ann.op2_kmeans_tree(spark, folder))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    right = [len({x[1] for x in got[q]} & {x[1] for x in want[q]}) / 20 for q in want]
    assert np.mean(right) >= 0.9
    scores = {(q, x[1]): x[2] for q in want for x in brute(rows, {q}, len(rows))[q]} if len(rows) < 1000 else {}
    for q, answers in got.items():
        assert [a[0] for a in answers] == [*range(1, 21)]
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(answers, answers[1:], strict=False))
        assert all(scores.get((q, a[1]), a[2]) == a[2] for a in answers)


SMALL = ann.Settings(leaf_rows=4, least_sample=2, block_rows=8, chunk=3, branch=3, recall=1.0)


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(40)] + [(100, [1.0, 2.0, 3.0, 4.0, 5.0])]
    rows += [(200, None), (220, [0.0] * 5), (240, [1.0, None, 0.0, 0.0, 0.0]), (260, [1.0, float("nan"), 0.0, 0.0, 0.0]), (280, [float("inf")] * 5), (300, [1.0, 2.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id long, block long")
    got = found(ann.search(df, df.where("vec_id % 20 = 0"), 20, SMALL))
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    assert got == want


def test_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert found(ann.search(df, df.where("vec_id = 0"), 20, SMALL)) == {0: [(1, 1, 0.5)]}
    assert ann.search(df.where("false"), df, 20, SMALL).count() == 0
    assert ann.search(df, df.where("false"), 20, SMALL).count() == 0


def test_queries_far_from_dense_clusters_get_all_their_neighbours(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 8)) * 20
    rows = [(i, (centres[i % 20] + rng.normal(size=8) * 0.01).tolist()) for i in range(1, 4000)]
    rows += [(4000 + 20 * i, (rng.normal(size=8) * 300).tolist()) for i in range(4)] + [(20, [1.0] * 8)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(df, df.where("vec_id % 20 = 0"), 20, ann.Settings(sample_rows=500, leaf_rows=4, least_sample=1, block_rows=16, recall=0.5, most=0.1, least_recall=0.1)))
    assert len(got) == len({i for i, _ in rows if i % 20 == 0}) and all(len(v) == 20 for v in got.values())


def test_sample_of_equal_rows_is_bounded(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])] * 5000 + [(k, [float(k), 1.0]) for k in range(2, 12)], "id long, v array<double>")
    total, sample = ann._sampled(df, 100, 1)
    assert total == 5010 and len(sample) == 100


def test_large_leaves_have_trees_of_their_own(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 6)) * 3
    rows = [(i, (centres[i % 60] + rng.normal(size=6) * 0.3).tolist()) for i in range(3000)] + [(i, [5.0] * 6) for i in range(3000, 3300)] + [(21, [1.0] * 6)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    settings = ann.Settings(sample_rows=200, trial_queries=60, leaf_rows=16, least_sample=20, large=100, block_rows=64, chunk=50)
    got = found(ann.search(df, df.where("vec_id % 20 = 0"), 20, settings))
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    right = [len({x[1] for x in got[q]} & {x[1] for x in want[q]}) / 20 for q in want]
    assert np.mean(right) >= 0.93
    scores = {(q, i): float((np.array(v) * np.array(dict(rows)[q])).sum()) for q in list(want)[:5] for i, v in rows if i != 21}
    assert all(scores.get((q, x[1]), x[2]) == pytest.approx(x[2]) for q, v in got.items() for x in v)
    every = found(ann.search(df, df.where("vec_id % 20 = 0"), 20, ann.Settings(sample_rows=200, trial_queries=400, leaf_rows=16, least_sample=20, large=100, block_rows=64, recall=1.0, most=1.0)))
    assert np.mean([len({x[1] for x in every[q]} & {x[1] for x in want[q]}) / 20 for q in want]) == 1.0
