"""Line quality: a linear-chain conditional random field marks lines as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.llm.common import columns_as, named
from segmart.llm.sampling import labelled_sample

_ROW_BATCH = 256
_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_SPACE = b" \t\n\x0b\x0c\r"

# Base rules of the contract.
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
WINDOW = 5

FEATURES = 17
CONTENT, BOILERPLATE = 0, 1


@dataclass(frozen=True)
class QualitySettings:
    """``sample_rows`` labelled documents of at most ``sample_lines`` lines are what the model is fitted on."""

    sample_rows: int = 3000
    sample_lines: int = 300
    steps: int = 150
    rate: float = 0.1
    penalty: float = 1e-3
    least_content: float = 0.5
    seed: int = 5


@dataclass(frozen=True)
class LineModel:
    """Log-potentials: of a label at a line's features, of a label after another, of the first label."""

    emission: np.ndarray
    transition: np.ndarray
    first: np.ndarray


def _repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur at least twice in the text."""
    if len(words) <= WINDOW:
        return 0
    index: dict[bytes, int] = {}
    one = np.fromiter((index.setdefault(word, len(index)) for word in words), np.int64, len(words))
    if len(index) == len(words):
        return 0

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        # Numbers for pairs: exact, and small enough to be paired again.
        return np.unique(x * (y.max() + 1) + y, return_inverse=True)[1]

    two = joined(one[:-1], one[1:])
    four = joined(two[:-2], two[2:])
    five = joined(four[:-1], one[4:])
    often = np.bincount(five)[five] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(WINDOW):
        covered[shift : shift + len(often)] |= often
    return int(covered.sum())


def _line_features(line: bytes, words: list[bytes], repeated: bool) -> list[int]:
    count, size = len(words), len(line)
    symbols = size - len(line.translate(None, _SYMBOLS))
    upper = size - len(line.translate(None, _UPPER))
    digits = size - len(line.translate(None, _DIGITS))
    pipes, calls = line.count(b"|"), line.count(b"!")
    letters = sum(map(len, words))
    last = words[-1][-1:]
    return [
        1,
        count <= 2,
        2 < count < 8,
        8 <= count < 20,
        count >= 20,
        10 * symbols > 2 * count,
        10 * symbols > 5 * count,
        10 * upper > 3 * letters,
        10 * upper > 6 * letters,
        10 * pipes > 3 * count,
        10 * calls > 3 * count,
        10 * digits > 2 * letters,
        repeated,
        letters > 12 * count,
        letters < 3 * count,
        last in b".!?",
        repeated and count >= 8,
    ]


def measure(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), line features, words per line."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, _SPACE)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    features, counts, dup = [], [], 0
    for line in data.split(b"\n"):
        line_words = line.split()
        if line_words:
            repeated = line in seen
            dup += repeated
            seen.add(line)
            features.append(_line_features(line, line_words, repeated))
            counts.append(len(line_words))
    matrix = np.array(features, np.int8).reshape(-1, FEATURES)
    return (len(words), chars, symbols, dup, _repeated_words(words)), matrix, np.array(counts, np.int64)


def viterbi(model: LineModel, features: np.ndarray) -> list[int]:
    """The most probable labels of a document's lines; ties go to content."""
    scores = (features @ model.emission).tolist()
    if not scores:
        return []
    (cc, cb), (bc, bb) = model.transition.tolist()
    content, boiler = (model.first + scores[0]).tolist()
    back = []
    for score_content, score_boiler in scores[1:]:
        from_content = content + cc >= boiler + bc, content + cb >= boiler + bb
        back.append(from_content)
        content, boiler = (
            score_content + (content + cc if from_content[0] else boiler + bc),
            score_boiler + (content + cb if from_content[1] else boiler + bb),
        )
    labels = [CONTENT if content >= boiler else BOILERPLATE]
    for from_content in reversed(back):
        labels.append(CONTENT if from_content[labels[-1]] else BOILERPLATE)
    return labels[::-1]


def fit_lines(documents: list[np.ndarray], labels: list[int], settings: QualitySettings) -> LineModel:
    """Maximum likelihood with a small penalty, by forward and backward sums over all documents at once."""
    # Longest first: the documents that have a line t are then the first ones.
    pairs = sorted(((d, y) for d, y in zip(documents, labels, strict=True) if len(d)), key=lambda pair: -len(pair[0]))
    lengths = np.array([len(d) for d, _ in pairs])
    gold = np.repeat([y for _, y in pairs], lengths)
    lines = np.concatenate([d for d, _ in pairs]).astype(np.float64)
    document = np.repeat(np.arange(len(pairs)), lengths)
    place = np.concatenate([np.arange(n) for n in lengths])
    active = [int((lengths > t).sum()) for t in range(lengths[0])]
    truth = np.eye(2)[gold]
    observed = np.diag([float(((gold == y) & (place > 0)).sum()) for y in (CONTENT, BOILERPLATE)])
    weights = np.zeros(FEATURES * 2 + 4 + 2)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, settings.steps + 1):
        emission, transition, first = _parts(weights)
        scores = np.zeros((lengths[0], len(pairs), 2))
        scores[place, document] = lines @ emission
        forward = np.zeros_like(scores)
        forward[0] = first + scores[0]
        for t in range(1, lengths[0]):
            n = active[t]
            came = forward[t - 1, :n, :, None] + transition
            forward[t, :n] = np.logaddexp(came[:, 0], came[:, 1]) + scores[t, :n]
        ends = forward[lengths - 1, np.arange(len(pairs))]
        norm = np.logaddexp(ends[:, 0], ends[:, 1])
        backward = np.zeros_like(scores)
        expected = np.zeros((2, 2))
        for t in range(lengths[0] - 2, -1, -1):
            n = active[t + 1]
            goes = transition + (scores[t + 1, :n] + backward[t + 1, :n])[:, None, :]
            expected += np.exp(forward[t, :n, :, None] + goes - norm[:n, None, None]).sum(axis=0)
            backward[t, :n] = np.logaddexp(goes[:, :, 0], goes[:, :, 1])
        marginal = np.exp(forward[place, document] + backward[place, document] - norm[document, None])
        wrong = truth - marginal
        change = np.concatenate(
            [(lines.T @ wrong).ravel(), (observed - expected).ravel(), wrong[place == 0].sum(axis=0)]
        )
        change = change / len(lines) - settings.penalty * weights
        mean, square = 0.9 * mean + 0.1 * change, 0.999 * square + 0.001 * change**2
        weights = weights + settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return LineModel(*(part.copy() for part in _parts(weights)))


def _parts(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = FEATURES * 2
    return weights[:cut].reshape(FEATURES, 2), weights[cut : cut + 4].reshape(2, 2), weights[cut + 4 :]


def fit(docs: DataFrame, labels: DataFrame, settings: QualitySettings | None = None) -> LineModel:
    """The model from documents labelled as good (1) or bad (0): a label stands for all lines of its document.

    The lines' features are made on the executors; the driver gets those of a bounded sample. Without
    labels of both kinds every line counts as content.
    """
    settings = settings or QualitySettings()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels_, packed = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matrix = measure(text)[1]
                if 0 < len(matrix) <= settings.sample_lines:
                    labels_.append(label)
                    packed.append(matrix.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels_, pa.int32()), pa.array(packed, pa.binary())], ["label", "lines"]
            )

    sample = labelled_sample(docs, labels, "quality", settings.sample_rows, settings.seed)
    # In a fixed order, so that sums and thus the model do not depend on the tasks.
    rows = sorted(map(tuple, sample.select("label", "text").mapInArrow(features, "label int, lines binary").collect()))
    if len({label for label, _ in rows}) < 2:
        return LineModel(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    matrices = [np.frombuffer(lines, np.int8).reshape(-1, FEATURES) for _, lines in rows]
    return fit_lines(matrices, [CONTENT if label else BOILERPLATE for label, _ in rows], settings)


_COLUMNS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
    ("n_lines", pa.int64()),
    ("n_content_lines", pa.int64()),
    ("content_share", pa.float64()),
    ("line_labels", pa.string()),
]
_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_content_lines long, content_share double, line_labels string"
)


def _judge(model: LineModel, least_content: float, text: str | None) -> tuple:
    numbers, features, counts = measure(text)
    labels = np.array(viterbi(model, features), np.int64)
    content = labels == CONTENT
    share = float(counts[content].sum() / counts.sum()) if len(counts) else 0.0
    failed = numbers[0] < LEAST_WORDS or 100 * numbers[4] > MOST_REPEATED * numbers[0]
    shown = "".join("CB"[label] for label in labels)
    return (*numbers, failed, not failed and share >= least_content, len(counts), int(content.sum()), share, shown)


def line_quality(
    docs: DataFrame,
    model: LineModel,
    id_column: str = "doc_id",
    text_column: str = "text",
    settings: QualitySettings | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base_failed, kept and the lines' labels (C or B).

    A document is kept if it passes the base rules and at least ``least_content`` of its words are in
    lines marked as content. A null or empty text has no words and fails. Repeated rows and rows
    without id are judged one by one; an empty table gives no rows. Nothing is shuffled.
    """
    settings = settings or QualitySettings()
    judge = partial(_judge, model, settings.least_content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROW_BATCH):
                batch = whole.slice(start, _ROW_BATCH)
                columns = zip(*map(judge, batch.column(1).to_pylist()), strict=True)
                arrays = [pa.array(values, kind) for values, (_, kind) in zip(columns, _COLUMNS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *[name for name, _ in _COLUMNS]])

    source = columns_as(docs, doc_id=id_column, text=text_column)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")


def keep_quality(
    docs: DataFrame, model: LineModel, text_column: str = "text", settings: QualitySettings | None = None
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    judge = partial(_judge, model, (settings or QualitySettings()).least_content)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([judge(text)[6] for text in texts], dtype=bool)

    return docs.where(kept(named(text_column)))
