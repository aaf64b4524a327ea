"""The label model against enumeration, and weak supervision under wrong labels."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from apexlap.llm import toxicity


def test_posterior_is_enumeration():
    """Bayes' rule over both classes and every pattern of four voters."""
    prior, fires = 0.3, np.array([[0.1, 0.2, 0.05, 0.4], [0.7, 0.6, 0.9, 0.5]])
    model = toxicity.LabelModel(prior, fires, np.ones(4))
    patterns = np.array(list(itertools.product([False, True], repeat=4)))
    for v, got in zip(patterns, model.posterior(patterns), strict=True):
        clean, toxic = (p * np.prod(np.where(v, f, 1 - f)) for p, f in ((1 - prior, fires[0]), (prior, fires[1])))
        assert abs(got - toxic / (clean + toxic)) < 1e-12


def drawn(rng, n, prior, fires):
    truth = rng.random(n) < prior
    return truth, rng.random((n, fires.shape[1])) < fires[truth.astype(int)]


def test_em_finds_accuracies_and_corrects_labels():
    rng = np.random.default_rng(3)
    fires = np.array([[0.02] * toxicity.LISTS + [0.05, 0.02, 0.05, 0.05, 0.05, 0.1], [0.5] * toxicity.LISTS + [0.6, 0.4, 0.1, 0.1, 0.1, 0.9]])
    truth, votes = drawn(rng, 6000, 0.2, fires)
    model, p = toxicity.fit_label_model(votes, correlated=False)
    assert np.abs(model.fires - fires).max() < 0.05 and abs(model.prior - 0.2) < 0.02
    wrong = votes[:, -1] != truth
    best = toxicity.LabelModel(0.2, fires, np.ones(toxicity.VOTERS)).posterior(votes)
    assert ((p >= 0.5) == (best >= 0.5)).mean() > 0.99
    assert ((p >= 0.5) == truth)[wrong].mean() > 0.8 and ((p >= 0.5) == truth).mean() > 0.97


def test_voters_that_repeat_each_other_share_their_weight():
    rng = np.random.default_rng(4)
    fires = np.array([[0.05] * toxicity.VOTERS, [0.6] * toxicity.VOTERS])
    _, votes = drawn(rng, 4000, 0.3, fires)
    votes[:, 1] = votes[:, 2] = votes[:, 0]
    model, _ = toxicity.fit_label_model(votes)
    assert model.share[:3].max() < 0.4 and model.share[3:].min() > 0.9


def test_wrong_labels_make_no_false_alarms(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    bad = ["vilest", "grubby", "rotten", "filthy", "crooked", "wretch"]
    said = [(i, " ".join([word() for _ in range(40)] + (rng.sample(bad, 3) if i % 4 == 0 else []))) for i in range(1200)]
    docs = spark.createDataFrame(said, "doc_id long, text string").repartition(3)
    flipped = {i for i in range(1200) if rng.random() < 0.1}
    labels = spark.createDataFrame([(i, int((i % 4 == 0) != (i in flipped))) for i in range(1200)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels, F.col("doc_id") % 5 != 0).collect()}
    held = [i for i in range(1200) if i % 5 == 0]
    clean, toxic = [i for i in held if i % 4], [i for i in held if i % 4 == 0]
    assert sum(got[i] for i in clean) <= 0.05 * len(clean) and sum(got[i] for i in toxic) >= 0.95 * len(toxic)
