"""Toxicity by a chain of linear classifiers, one for each category.

The labels say whether a document is toxic, not how. The earlier categories are therefore kinds of toxicity that
the labelled toxic documents fall into by themselves: clusters of what tells them from the clean ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from segmart.llm.common import columns_as
from segmart.llm.sampling import labelled_sample

_ROW_BATCH = 256
_WORD = re.compile(r"[^\W\d_]+")

OVERALL = "toxic"


@dataclass(frozen=True)
class ToxicSettings:
    """``sample_rows`` labelled documents are what the chain is fitted on."""

    sample_rows: int = 8000
    # Features: words by presence, and beginnings of words by their share, for compounding languages.
    words: int = 80
    prefixes: int = 100
    prefix_lengths: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    # A share of one in this many words counts in full.
    full_share: int = 50
    least_documents: int = 5
    folds: int = 4
    # Categories before the last one: kinds of toxic documents.
    kinds: int = 2
    penalty: float = 0.3
    threshold: float = 0.4
    seed: int = 3


@dataclass(frozen=True)
class Chain:
    """``models``: category -> weights of the features, then of the earlier categories, then the constant."""

    words: tuple[str, ...]
    prefixes: tuple[str, ...]
    models: dict[str, np.ndarray]


def words_of(text: str | None) -> dict[str, int]:
    """The distinct words of a text, lower case, with their numbers."""
    return Counter(_WORD.findall((text or "").lower()))


def prefixes_of(words: Iterable[str], lengths: Sequence[int]) -> set[str]:
    return {word[:n] for word in words for n in lengths if len(word) > n}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 12) -> np.ndarray:
    """Penalised logistic regression by Newton's method; the last weight is the constant, not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ weights)
        slope = x.T @ (p - y) + ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _predict(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ weights[:-1] + weights[-1])


def folds_of(rows: int, settings: ToxicSettings) -> np.ndarray:
    return np.random.default_rng(settings.seed).integers(0, settings.folds, rows)


def kinds_of(x: np.ndarray, fold: np.ndarray, count: int, rounds: int = 20) -> np.ndarray:
    """The kind of every row, 0 to ``count`` - 1: clusters by the angle between rows.

    The start is the largest cluster halved along its main direction until there are enough. A row is placed by
    centres that were moved by the other folds only, so its kind is no memory of its own features. Rows
    without features, and rows as near to several centres, get the first.
    """
    x = _unit(x)
    shared = _moved(x, _halved(x[x.any(axis=1)], count), rounds)
    kind = np.zeros(len(x), int)
    for part in np.unique(fold):
        held = fold == part
        kind[held] = _nearest(x[held], _moved(x[~held], shared, rounds))
    return kind


def _halved(x: np.ndarray, count: int) -> np.ndarray:
    groups = [x]
    while len(groups) < count:
        groups.sort(key=len)
        largest = groups.pop()
        spread = largest - largest.mean(axis=0) if len(largest) else largest
        if not np.abs(spread).max(initial=0) > 1e-9:
            # Equal rows are one kind; the others stay empty.
            groups += [largest] + [x[:0]] * (count - len(groups) - 1)
            break
        side = spread @ np.linalg.svd(spread, full_matrices=False)[2][0] > 0
        groups += [largest[side], largest[~side]]
    return np.array([_centre(group) for group in sorted(groups, key=len, reverse=True)])


def _centre(rows: np.ndarray) -> np.ndarray:
    return _unit(rows.sum(axis=0, keepdims=True))[0]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    # Rounded, so that a tie is a tie whatever the order of summing.
    return np.round(x @ centres.T, 9).argmax(axis=1)


def _moved(x: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Centres after so many rounds of spherical k-means; one that loses all rows stays where it is."""
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.array([x[near == k].sum(axis=0) if (near == k).any() else centre for k, centre in enumerate(centres)])
        centres = _unit(sums)
    return centres


def fit_chain(x: np.ndarray, targets: Mapping[str, np.ndarray], settings: ToxicSettings) -> dict[str, np.ndarray]:
    """Models in the order of ``targets``. Each later one sees the probabilities of the earlier ones as
    they were for documents the earlier model had not seen, not as it remembers its own examples."""
    fold = folds_of(len(x), settings)
    models = {}
    for name, y in targets.items():
        models[name] = fit_linear(x, y, settings.penalty)
        unseen = np.zeros(len(x))
        for part in range(settings.folds):
            held = fold == part
            if held.any():
                unseen[held] = _predict(x[held], fit_linear(x[~held], y[~held], settings.penalty))
        x = np.hstack([x, unseen[:, None]])
    return models


def telling(documents: Iterable[tuple[float, Iterable[str]]], least: int, count: int) -> tuple[str, ...]:
    """Features that tell most between the classes: log-odds of presence times the root of their toxic documents."""
    seen = {0.0: Counter(), 1.0: Counter()}
    sizes = Counter()
    for label, features in documents:
        seen[label].update(features)
        sizes[label] += 1
    clean, toxic = seen[0.0], seen[1.0]
    scores = {
        name: np.log((n + 0.5) / sizes[1.0] * sizes[0.0] / (clean[name] + 0.5)) * np.sqrt(n)
        for name, n in toxic.items()
        if n >= least
    }
    return tuple(sorted(scores, key=lambda name: (-scores[name], name))[:count])


def features(
    documents: Iterable[Mapping[str, int]],
    rows: int,
    words: Sequence[str],
    prefixes: Sequence[str],
    settings: ToxicSettings,
) -> np.ndarray:
    word_place = {word: i for i, word in enumerate(words)}
    prefix_place = {prefix: len(words) + i for i, prefix in enumerate(prefixes)}
    heads = {prefix[: min(settings.prefix_lengths)] for prefix in prefixes}
    shortest = min(settings.prefix_lengths)
    x = np.zeros((rows, len(words) + len(prefixes)))
    for row, document in zip(x, documents, strict=True):
        for word, count in document.items():
            if word in word_place:
                row[word_place[word]] = 1
            if word[:shortest] in heads:
                for n in settings.prefix_lengths:
                    if len(word) > n and word[:n] in prefix_place:
                        row[prefix_place[word[:n]]] += count
        total = sum(document.values())
        if total:
            row[len(words) :] = np.minimum(1, row[len(words) :] * settings.full_share / total)
    return x


def fit(
    docs: DataFrame,
    labels: DataFrame,
    settings: ToxicSettings | None = None,
) -> Chain:
    """The chain from documents labelled as toxic (1) or not (0).

    The driver gets the distinct words of a bounded sample. Without labels of both kinds nothing is toxic.
    """
    settings = settings or ToxicSettings()
    kinds = [f"kind_{k}" for k in range(1, settings.kinds + 1)]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [_packed(words_of(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(listed, pa.string())], ["label", "words"])

    sample = labelled_sample(docs, labels, "toxic", settings.sample_rows, settings.seed)
    rows = sample.selectExpr("cast(label as int) AS label", "text").mapInArrow(distinct, "label int, words string")
    # Copies count once; in a fixed order, so that the folds do not depend on the tasks.
    rows = sorted(set(map(tuple, rows.collect())))
    y = np.array([label for label, _ in rows], float)
    if len(set(y)) < 2:
        return Chain((), (), {name: np.array([0.0] * i + [-30.0]) for i, name in enumerate((*kinds, OVERALL))})
    lengths, least = settings.prefix_lengths, settings.least_documents
    words = telling(((label, _unpacked(packed)) for label, packed in rows), least, settings.words)
    # Words that tell by themselves leave their beginnings to others.
    rest = ((label, prefixes_of(_unpacked(packed).keys() - set(words), lengths)) for label, packed in rows)
    prefixes = telling(rest, least, settings.prefixes)
    x = features((_unpacked(packed) for _, packed in rows), len(rows), words, prefixes, settings)
    toxic = y == 1
    kind = np.full(len(rows), -1)
    if kinds:
        kind[toxic] = kinds_of(x[toxic], folds_of(len(rows), settings)[toxic], len(kinds))
    targets = {name: (kind == k).astype(float) for k, name in enumerate(kinds)}
    return Chain(words, prefixes, fit_chain(x, targets | {OVERALL: y}, settings))


def _packed(words: Mapping[str, int]) -> str:
    return " ".join(f"{word} {count}" for word, count in sorted(words.items()))


def _unpacked(packed: str) -> dict[str, int]:
    parts = packed.split()
    return dict(zip(parts[::2], map(int, parts[1::2]), strict=True))


def predict(chain: Chain, documents: Sequence[Mapping[str, int]], settings: ToxicSettings) -> dict[str, np.ndarray]:
    x = features(documents, len(documents), chain.words, chain.prefixes, settings)
    found = {}
    for name, weights in chain.models.items():
        found[name] = _predict(x, weights)
        x = np.hstack([x, found[name][:, None]])
    return found


def toxicity(
    docs: DataFrame,
    chain: Chain,
    id_column: str = "doc_id",
    text_column: str = "text",
    settings: ToxicSettings | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, a probability p_kind_<n> for each kind, p_toxic, toxic.

    The words of the whole text count, wherever they stand. A null or empty text has none and gets the
    constant of each model. Repeated rows and rows without id are scored one by one; an empty table
    gives no rows. Nothing is shuffled; the chain is a few hundred weights.
    """
    settings = settings or ToxicSettings()
    names = [f"p_{name}" for name in chain.models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROW_BATCH):
                batch = whole.slice(start, _ROW_BATCH)
                found = predict(chain, [words_of(text) for text in batch.column(1).to_pylist()], settings)
                flagged = pa.array(found[OVERALL] >= settings.threshold)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *map(pa.array, found.values()), flagged], ["doc_id", *names, "toxic"]
                )

    source = columns_as(docs, doc_id=id_column, text=text_column)
    kind = source.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{name} double" for name in names)
    return source.mapInArrow(run, f"doc_id {kind}, {columns}, toxic boolean")
