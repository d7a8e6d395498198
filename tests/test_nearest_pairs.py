"""Nearest samples: two blocks' products stay in their task, whatever the number of samples and probes."""

import numpy as np
import pytest

from featstab.operators import recon

from .test_jobs import matrix


def test_best_of_a_pair_by_tiles(monkeypatch):
    monkeypatch.setattr(recon, "TILE", 3)
    rng = np.random.default_rng(1)
    x, y = np.round(rng.normal(size=(8, 4)), 0), np.round(rng.normal(size=(5, 4)), 0)  # with ties
    x[2], y[4] = np.nan, np.nan
    for same in (False, True):
        other = x if same else y
        g = np.nan_to_num(x @ other.T, nan=-np.inf)
        if same:
            np.fill_diagonal(g, -np.inf)
        for (own, near, r), m in zip(recon.best_of_pair(x, other, same), (g, g.T), strict=False):
            keep = np.flatnonzero(m.max(1) > -np.inf)
            assert own.tolist() == keep.tolist() and near.tolist() == m.argmax(1)[keep].tolist() and np.allclose(r, m.max(1)[keep])


@pytest.mark.parametrize("samples", [1, 5, 100])
def test_products_are_not_shuffled(spark, samples):
    x = np.random.default_rng(7).normal(size=(17, 6))
    got = recon.nearest_samples(matrix(spark, x), samples)
    near = {r["sample_id"]: r["nearest"] for r in got.collect()}
    r = np.corrcoef(x)
    np.fill_diagonal(r, -2)
    assert near == dict(enumerate(r.argmax(1).tolist())) and "gram" not in got._jdf.queryExecution().toString()
