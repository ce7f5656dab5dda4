"""Gradients of the classifiers against finite differences, fits against dense ones, twins in every language, shared ids."""

import numpy as np

from panelspark.llm import quality, toxicity
from panelspark.llm.text_features import adam, sigmoid

RNG = np.random.default_rng(4)


def entries(n, k, share=0.4):
    return np.nonzero(RNG.random((n, k)) < share)


def check_gradient(goal, x):
    _, g = goal(x)
    for i in range(len(x)):
        step = np.zeros(len(x))
        step[i] = 1e-5
        assert abs((goal(x + step)[0] - goal(x - step)[0]) / 2e-5 - g[i]) < 1e-6, i


def test_toxicity_gradient():
    y, own = (RNG.random(12) < 0.5).astype(float), entries(12, 6)
    pair, col = entries(4, 6)
    sign = RNG.choice([-1.0, 1.0], len(pair))
    check_gradient(toxicity.Objective(y, *own, pair, col, sign, 4, 6, 2.5), RNG.normal(size=7))
    check_gradient(toxicity.Objective(y, *own, pair[:0], col[:0], sign[:0], 0, 6, 2.5), RNG.normal(size=7))


def test_penalty_is_the_squared_change_of_the_score():
    """Twins as changes give the loss that whole twin texts give."""
    y = np.array([1.0, 0.0, 1.0])
    own, twin = RNG.random((3, 5)) < 0.5, RNG.random((3, 5)) < 0.5
    gained, lost = np.nonzero(twin & ~own), np.nonzero(own & ~twin)
    x = RNG.normal(size=6)
    goal = toxicity.Objective(y, *np.nonzero(own), np.concatenate([gained[0], lost[0]]), np.concatenate([gained[1], lost[1]]), np.repeat([1.0, -1.0], [len(gained[0]), len(lost[0])]), 3, 5, 4.0)
    logit = x[0] + own @ x[1:]
    want = np.mean(np.logaddexp(0, logit) - y * logit) + toxicity.RIDGE * (x[1:] @ x[1:]) / 200 + 4.0 * np.mean((own @ x[1:] - twin @ x[1:]) ** 2)
    assert abs(goal(x)[0] - want) < 1e-12


def test_quality_gradient_and_dense_fit():
    y = RNG.integers(0, 4, 40)
    row, col = entries(40, 5)
    goal = quality.Objective(y, 3, row, col, 5)
    x = RNG.normal(size=8) * 0.5
    check_gradient(goal, x)
    dense = np.zeros((40, 5))
    dense[row, col] = 1
    t, z = goal.thresholds(x), dense @ x[3:]
    steps = sigmoid(np.concatenate([np.full((40, 1), -500.0), t[None] - z[:, None], np.full((40, 1), 500.0)], axis=1))
    share = np.diff(steps, axis=1)[np.arange(40), y]
    assert abs(goal(x)[0] - (-np.log(share).mean() + quality.RIDGE * (x[3:] @ x[3:]) / 2)) < 1e-9
    best = adam(x, lambda v: goal(v)[1], steps=2000, rate=0.05)
    assert np.abs(goal(best)[1]).max() < 1e-3  # a minimum: the loss is convex in thresholds and weights


def test_twins_of_every_language_and_kind():
    both = toxicity.twins({"the", "muslim", "man"})  # all terms move at once, one place further in each twin
    assert both == [{"the", "christian", "woman"}, {"the", "jewish", "man"}, {"the", "hindu", "woman"}, {"the", "atheist", "man"}]
    tried = {w for t in toxicity.twins({"ein", "jüdisch", "text"}) for w in t} - {"ein", "text"}
    assert tried == {"muslimisch", "christlich", "hinduistisch", "atheistisch"}
    for word in ("femme", "frau", "mujer", "woman"):
        assert len(toxicity.twins({word, "x"})) == 1
    assert toxicity.twins({"no", "group"}) == [] and toxicity.twins(set()) == []


def test_fit_does_not_depend_on_the_order_of_rows(spark):
    rows = [(k, f"word{k % 7} {'scum' if k % 2 else 'fine'}") for k in range(60)] + [(k, f"other text {k}") for k in range(0, 60, 5)]
    labels = spark.createDataFrame([(k, k % 2, k % 3) for k in range(60)], "doc_id bigint, toxic int, grade int")
    fits = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string").repartition(3)
        fits.append((toxicity.fit(docs, labels), quality.fit(docs, labels)))
    assert fits[0] == fits[1]
