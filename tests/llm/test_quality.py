import re
from itertools import product

import numpy as np
from conftest_llm import edge_rows, empty

from segmart.llm import quality
from segmart.llm.quality import FEATURES, LineModel, QualitySettings, fit_lines, viterbi

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + k for starts in windows.values() if len(starts) > 1 for i in starts for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(repeated), failed


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts(documents, labels):
    found = quality.line_quality(documents, quality.fit(documents, labels)).collect()
    by_id = {r.doc_id: tuple(r[name] for name in NUMBERS) for r in found}
    assert by_id == {r.doc_id: plain(r.text) for r in documents.collect()}


def test_edges(edges, documents, labels):
    model = quality.fit(documents, empty(labels))
    found = quality.line_quality(edges, model).collect()
    assert sorted((str(r.doc_id), *(r[n] for n in NUMBERS)) for r in found) == sorted(
        (str(d), *plain(t)) for d, t in edge_rows(edges)
    )
    kept = quality.keep_quality(edges, model)
    assert kept.columns == edges.columns and kept.count() == sum(not r.base_failed for r in found)
    assert quality.line_quality(empty(edges), model).count() == 0


def test_viterbi_equals_all_paths():
    draw = np.random.default_rng(0)
    model = LineModel(draw.normal(size=(FEATURES, 2)), draw.normal(size=(2, 2)), draw.normal(size=2))
    for lines in range(1, 7):
        x = draw.integers(0, 2, (lines, FEATURES)).astype(np.int8)
        scores = x @ model.emission

        def total(path, scores=scores):
            steps = sum(model.transition[a, b] for a, b in zip(path, path[1:], strict=False))
            return model.first[path[0]] + steps + sum(scores[i, y] for i, y in enumerate(path))

        assert viterbi(model, x) == list(max(product((0, 1), repeat=lines), key=total))
    assert viterbi(model, np.zeros((0, FEATURES), np.int8)) == []


def test_fit_learns_features_and_runs():
    draw = np.random.default_rng(1)
    documents, labels = [], []
    for label in (0, 1) * 30:
        x = np.zeros((draw.integers(2, 9), FEATURES), np.int8)
        x[:, 0] = 1
        x[:, 5] = draw.random(len(x)) < (0.9 if label else 0.1)
        documents.append(x)
        labels.append(label)
    model = fit_lines(documents, labels, QualitySettings(steps=80))
    assert np.mean([viterbi(model, x) == [y] * len(x) for x, y in zip(documents, labels, strict=True)]) > 0.9
    assert np.trace(model.transition) > model.transition[0, 1] + model.transition[1, 0]


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 4 != 0"))
    rows = quality.line_quality(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1)
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)
