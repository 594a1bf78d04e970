import math

import numpy as np
from conftest_llm import empty

from segmart.llm import toxicity
from segmart.llm.toxicity import ToxicSettings, fit_chain, fit_linear


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    chain = toxicity.fit(docs, labels.where("doc_id % 4 != 0"))
    held = toxicity.toxicity(docs, chain).withColumnRenamed("toxic", "found")
    rows = held.join(labels.where("doc_id % 4 = 0 AND quality = 1"), "doc_id").select("toxic", "found", "p_kind_1").collect()
    assert all(not r.found for r in rows if not r.toxic)
    toxic = [r for r in rows if r.toxic]
    assert sum(r.found for r in toxic) >= 0.6 * len(toxic)


def test_later_models_see_earlier_probabilities():
    draw = np.random.default_rng(0)
    x = draw.integers(0, 2, (400, 3)).astype(float)
    first = x[:, 0]
    second = np.where(first == 1, x[:, 1], 0.0)
    models = fit_chain(x, {"first": first, "second": second}, ToxicSettings())
    assert [len(w) for w in models.values()] == [4, 5]
    assert models["first"][0] > 2


def test_linear_separates():
    x = np.array([[0.0], [0.0], [1.0], [1.0]])
    w = fit_linear(x, np.array([0.0, 0.0, 1.0, 1.0]), 0.1)
    assert w[0] > 0 > w[1]


def solved(matrix, right):
    """Gauss-Jordan elimination."""
    rows = [[*row, value] for row, value in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        best = max(range(i, len(rows)), key=lambda r: abs(rows[r][i]))
        rows[i], rows[best] = rows[best], rows[i]
        rows[i] = [value / rows[i][i] for value in rows[i]]
        for r in range(len(rows)):
            if r != i:
                rows[r] = [a - rows[r][i] * b for a, b in zip(rows[r], rows[i], strict=True)]
    return [row[-1] for row in rows]


def plain_linear(rows, y, penalty):
    rows = [[*row, 1.0] for row in rows]
    size = len(rows[0])
    ridge = [penalty] * (size - 1) + [1e-6]
    weights = [0.0] * size
    for _ in range(40):
        p = [1 / (1 + math.exp(-sum(a * w for a, w in zip(row, weights, strict=True)))) for row in rows]
        slope = [sum(row[i] * (q - t) for row, q, t in zip(rows, p, y, strict=True)) + ridge[i] * weights[i] for i in range(size)]
        curve = [
            [sum(row[i] * row[j] * q * (1 - q) for row, q in zip(rows, p, strict=True)) + (ridge[i] if i == j else 0) for j in range(size)]
            for i in range(size)
        ]
        weights = [w - s for w, s in zip(weights, solved(curve, slope), strict=True)]
    return weights


def plain_chain(rows, targets, fold, penalty):
    models = {}
    for name, y in targets.items():
        models[name] = plain_linear(rows, y, penalty)
        unseen = [0.0] * len(rows)
        for part in set(fold):
            kept = [i for i, f in enumerate(fold) if f != part]
            weights = plain_linear([rows[i] for i in kept], [y[i] for i in kept], penalty)
            for i, f in enumerate(fold):
                if f == part:
                    unseen[i] = 1 / (1 + math.exp(-sum(a * w for a, w in zip([*rows[i], 1.0], weights, strict=True))))
        rows = [[*row, value] for row, value in zip(rows, unseen, strict=True)]
    return models


def test_chain_equals_a_plain_one():
    draw = np.random.default_rng(8)
    x = draw.integers(0, 2, (90, 3)).astype(float)
    noise = draw.random(90) < 0.15
    targets = {"a": x[:, 0], "b": np.where(noise, 1 - x[:, 1], x[:, 1]), "c": np.where(noise, x[:, 0], np.maximum(x[:, 0], x[:, 1]))}
    settings = ToxicSettings()
    fold = toxicity.folds_of(len(x), settings).tolist()
    want = plain_chain(x.tolist(), {k: y.tolist() for k, y in targets.items()}, fold, settings.penalty)
    found = fit_chain(x, targets, settings)
    for name in targets:
        assert np.allclose(found[name], want[name], atol=1e-5)


def test_kinds_follow_the_features_and_not_the_row_itself():
    draw = np.random.default_rng(1)
    first = draw.random(200) < 0.4
    x = np.where(first[:, None], draw.random((200, 6)) < [0.7, 0.7, 0.7, 0.05, 0.05, 0.05], draw.random((200, 6)) < [0.05, 0.05, 0.05, 0.7, 0.7, 0.7])
    x = x.astype(float)
    fold = draw.integers(0, 4, 200)
    kind = toxicity.kinds_of(x, fold, 2)
    told = x[:, :3].sum(axis=1) != x[:, 3:].sum(axis=1)
    agree = (kind == first)[told].mean()
    assert max(agree, 1 - agree) > 0.95
    assert set(toxicity.kinds_of(np.zeros((5, 3)), np.arange(5) % 2, 3)) == {0}
    assert toxicity.kinds_of(np.ones((1, 2)), np.zeros(1, int), 2).tolist() == [0]


def test_edges(documents, labels, edges):
    chain = toxicity.fit(documents, labels)
    found = toxicity.toxicity(edges, chain)
    assert found.columns == ["doc_id", "p_kind_1", "p_kind_2", "p_toxic", "toxic"]
    rows = found.collect()
    assert len(rows) == 12 and not any(r.toxic for r in rows)
    assert toxicity.toxicity(empty(edges), chain).count() == 0


def test_no_labels(documents, labels, edges):
    chain = toxicity.fit(documents, empty(labels))
    assert not any(r.toxic for r in toxicity.toxicity(edges, chain).collect())
