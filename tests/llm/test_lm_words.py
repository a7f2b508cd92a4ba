"""The language model tells words apart by what stands before them, and learns by sampled noise contrast."""

import random

import numpy as np
import pytest

from cloakwork.llm import lm


def test_words_are_told_apart_in_context(spark):
    random.seed(4)
    tongues = [[f"{x}{k:03d}" for k in range(150)] for x in ("w", "v")]
    rows = [(k, " ".join(random.choices(tongues[k % 2], k=120))) for k in range(1200)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    tests = [" ".join(random.choices(t, k=40)) for t in tongues] + [" ".join(random.choices(tongues[0] + tongues[1], k=40))]
    got = {r.text: r for r in lm.score(spark.createDataFrame([(t,) for t in tests], "text string"), train, lm.F.col("text")).collect()}
    gain = [got[t].score - got[t].base_score for t in tests]
    assert min(gain[:2]) > 5 and max(gain[:2]) > gain[2] and gain[2] < 0


def test_sampled_steps_follow_the_expected_gradient():
    """Averaged over draws, a step's gradient of the targets is the data's less NOISE times the noise's, to within sampling error."""
    rng = np.random.default_rng(2)
    leaves = lm.LAST + 40
    p = rng.dirichlet(np.ones(leaves))
    model = lm.LogBilinear(np.arange(leaves) % lm.LAST, np.arange(leaves) % lm.BEFORE, np.log(p).astype(np.float32))
    model.t = rng.normal(0, 0.3, model.t.shape).astype(np.float32)
    before, last, target = rng.integers(0, lm.BEFORE, 512), rng.integers(0, lm.LAST, 512), rng.integers(0, leaves, 512)
    q = (model.r[last] + model.s[before]).astype(np.float64)
    odds = np.exp(q @ model.t.T.astype(np.float64)) / lm.NOISE
    share = odds / (1 + odds)
    expected = -(share * (lm.NOISE * p)).T @ q
    np.add.at(expected, target, (1 - share[np.arange(512), target])[:, None] * q)
    total = np.zeros_like(expected)
    for k in range(400):
        learner = lm.Learner(model)
        learner.rng = np.random.default_rng(k)
        learner._step = lambda name, rows, g: np.add.at(total, rows, g) if name == "t" else None  # noqa: B023
        learner.learn(before, last, target)
    assert np.abs(total / 400 - expected).max() < 0.12 * np.abs(expected).max()


def test_clusters():
    x = np.concatenate([np.full((20, 2), 0.0), np.full((30, 2), 5.0), np.full((1, 2), 9.0)])
    near = lm.clusters(x, np.r_[np.full(50, 1.0), 99.0], 3)
    assert len(set(near[:20])) == len(set(near[20:50])) == 1 and len(set(near.tolist())) <= 3
    assert lm.clusters(x[:2], np.ones(2), 5).max() <= 1


def test_last_group_may_be_smaller():
    model = lm.LogBilinear(np.zeros(lm.LAST, int), np.zeros(lm.LAST, int), np.full(lm.LAST, -np.log(lm.LAST), np.float32))
    for n in (1, 63, 64, 65, 130):
        learner = lm.Learner(model)
        learner.learn(*(np.zeros(n, int) for _ in range(3)))
        assert learner.touched["r"][0] == n and learner.touched["t"].sum() == n + lm.NOISE * -(-n // lm.SHARED)
        assert np.isfinite(learner.tables["t"]).all()
    assert pytest.approx(1) == np.exp(model.log_p.astype(float)).sum()
