"""Targets of the mix with the production number of steps, on posteriors that are far from one domain each."""

import warnings

import numpy as np
import pytest

from gridmat.llm import mixing


def _rows(spark, p, tokens):
    return spark.createDataFrame([(i, int(n), q.tolist()) for i, (n, q) in enumerate(zip(tokens, p))], "doc_id long, n_tokens long, posterior array<double>").repartition(4).cache()


@pytest.mark.parametrize("kind", ["softmax", "dirichlet"])
def test_soft_posteriors_meet_the_targets(spark, kind):
    rng = np.random.default_rng(5)
    docs = 4000
    tokens = rng.integers(1, 900, docs)
    z = rng.normal(size=(docs, 3)) + 3 * np.eye(3)[rng.choice(3, docs, p=[0.9, 0.08, 0.02])]
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True) if kind == "softmax" else rng.dirichlet([0.3, 0.3, 0.3], docs)
    rows = _rows(spark, p, tokens)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        gradients, total, target = mixing.meet_targets(rows, list(mixing.WEIGHTS), exact=True)
    rate = {r.doc_id: r.rate for r in mixing.with_rates(rows, gradients, 3).collect()}
    r = np.array([rate[i] for i in range(docs)])
    assert r.min() >= 0
    assert np.allclose((tokens * r) @ p / (tokens @ p), mixing.WEIGHTS, rtol=mixing.MET)
    assert np.allclose(total, (tokens * r) @ p) and np.allclose(target, tokens @ p * np.array(mixing.WEIGHTS))


def test_a_miss_of_the_production_steps_is_reported(spark):
    p = np.random.default_rng(5).dirichlet([0.3, 0.3, 0.3], 1000)
    rows = _rows(spark, p, np.full(1000, 100))
    with pytest.warns(UserWarning, match="the rates miss targets"):
        mixing.meet_targets(rows, list(mixing.WEIGHTS))


def test_targets_out_of_reach_are_reported_and_least_squares_kept(spark):
    tokens = np.arange(1, 51)
    rows = _rows(spark, np.full((50, 3), 1 / 3), tokens)
    with pytest.warns(UserWarning, match="the rates miss targets"):
        _, total, target = mixing.meet_targets(rows, list(mixing.WEIGHTS), exact=True)
    assert np.allclose(total, target.mean(), rtol=1e-3)
