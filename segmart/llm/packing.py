"""Packing along a space-filling curve: neighbouring documents share training sequences."""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmart.llm.common import columns_as, materialise

_ROW_BATCH = 128
_CACHED_PIECES = 600_000
_CACHED_LETTERS = 48


@dataclass(frozen=True)
class PackSettings:
    length: int = 2048
    end_id: int = 1
    # Hashed vector, projected dimensions and bits for each of them; the key has dimensions * bits bits.
    hashed: int = 256
    dimensions: int = 4
    bits: int = 15
    seed: int = 11


class PieceTokenizer:
    """Ids of whole texts by the tokenizers library.

    Texts of printable Latin characters go as a whole through the merges of the same file in tiktoken,
    which has the same ids for them and needs less than half of the time. In other texts, a blank before a
    visible character always begins a new word of a byte-level splitter, so the pieces between such
    blanks are encoded once and kept while there is room, plain Latin words by the same merges and whatever
    else there is by the library itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merges, added = _latin_encoding(path)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.pieces: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if self.merges is None:
            return self._by_pieces(texts)
        plain = [_LATIN.fullmatch(text) is not None and not self.added.search(text) for text in texts]
        encode = self.merges.encode_ordinary
        others = iter(self._by_pieces([text for text, whole in zip(texts, plain) if not whole]))
        return [
            np.frombuffer(array("I", encode(text)), np.uint32) if whole else next(others)
            for text, whole in zip(texts, plain)
        ]

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        cut = [_pieces(text) for text in texts]
        used = set(chain.from_iterable(cut))
        missing = list(used.difference(self.pieces))
        if len(self.pieces) + len(missing) > _CACHED_PIECES:
            self.pieces = {piece: ids for piece, ids in self.pieces.items() if piece in used}
        rest = missing
        if self.merges is not None:
            rest = [piece for piece in missing if not _PLAIN_WORD.fullmatch(piece)]
            encode = self.merges.encode_ordinary
            self.pieces.update((piece, array("I", encode(piece)).tobytes()) for piece in set(missing).difference(rest))
        for start in range(0, len(rest), 8192):
            part = rest[start : start + 8192]
            coded = self.library.encode_batch_fast(part, add_special_tokens=False)
            self.pieces.update((piece, array("I", x.ids).tobytes()) for piece, x in zip(part, coded, strict=True))
        known = self.pieces.__getitem__
        ids = [np.frombuffer(b"".join(map(known, pieces)), np.uint32) for pieces in cut]
        for piece in missing:
            if len(piece) > _CACHED_LETTERS:
                del self.pieces[piece]
        return ids


# One word of a byte-level splitter, without an apostrophe that could part it.
_PLAIN_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
# Characters whose classes are the same in any version of Unicode, and no very long run of white space.
_LATIN = re.compile(r"(?:[!-~¡-ɏ]+|[ \t\n\r]{1,1000}(?![ \t\n\r]))*+")
# The splitter of byte-level files.
_SPLITTER = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _latin_encoding(path: str):
    """The file's merges as ranks of byte strings behind the byte-level splitter, and its added tokens.

    No merges if the file splits or normalises otherwise, or if they are not in the order of its ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, splitter = content["model"], content.get("pre_tokenizer") or {}
    added = [token["content"] for token in content.get("added_tokens", [])]
    whole = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
    if not whole or content.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None, added
    vocab, merges = model["vocab"], model["merges"]
    pairs = [merge.split(" ") if isinstance(merge, str) else merge for merge in merges]
    made = [vocab[left + right] for left, right in pairs]
    own = {text: token for text, token in vocab.items() if text not in added}
    if made != sorted(made) or len(made) + 256 != len(own):
        return None, added
    # Byte-level files write visible Latin-1 bytes as themselves and the others from U+0100 on, in order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in set(shown)]
    byte_of = {chr(byte): byte for byte in shown} | {chr(256 + i): byte for i, byte in enumerate(hidden)}
    ranks = {bytes(map(byte_of.__getitem__, text)): token for text, token in own.items()}
    return tiktoken.Encoding("merges", pat_str=_SPLITTER, mergeable_ranks=ranks, special_tokens={}), added


_RUN_OF_SPACE = re.compile(r"\s\s")
# A comma or full stop that does not follow a Latin letter or a digit may belong to a longer mark.
_UNSURE_MARK = re.compile(r"[,.](?<![A-Za-z0-9À-ÖØ-öø-ɏ].)(?=\s|\Z)")


def _pieces(text: str) -> list[str]:
    """Cuts ``text`` where the splitter of byte-level tokenizers is certain to."""
    if "\0" not in text and not _RUN_OF_SPACE.search(text):
        # Single white space only: a blank goes with the word after it, a line feed stands alone.
        marked = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        if not _UNSURE_MARK.search(text):
            marked = marked.replace(",\0", "\0,\0").replace(".\0", "\0.\0")
        return marked.split("\0")
    pieces: list[str] = []
    for i, word in enumerate(text.split(" ")):
        if i and word and not word[0].isspace():
            pieces.append(" " + word)
        elif pieces:
            # A blank inside a longer run of white space is no certain border.
            pieces[-1] += " " + word
        else:
            pieces.append(" " * (i > 0) + word)
    return pieces


@functools.lru_cache(maxsize=2)
def _tokenizer(name: str) -> PieceTokenizer:
    import public_tokenizers

    return PieceTokenizer(public_tokenizers.path(name))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of unsigned ``points`` along the Hilbert curve of ``bits`` bits a dimension.

    Skilling's transposition (AIP Conf. Proc. 707, 2004), over all rows at once.
    """
    x = points.astype(np.int64).T.copy()
    dimensions = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dimensions):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dimensions):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        gray = np.where(x[-1] & bit, gray ^ (bit - 1), gray)
        bit >>= 1
    x ^= gray
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dimensions):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class Curve:
    """Documents to curve keys: token counts hashed with signs, projected, cut into cells."""

    def __init__(self, settings: PackSettings, largest_id: int) -> None:
        draw = np.random.default_rng(settings.seed)
        self.settings = settings
        self.slot = draw.integers(0, settings.hashed, largest_id + 1)
        self.sign = draw.choice([-1.0, 1.0], largest_id + 1)
        self.axes = draw.standard_normal((settings.hashed, settings.dimensions))

    def keys(self, documents: list[np.ndarray]) -> np.ndarray:
        hashed = self.settings.hashed
        ids = np.concatenate(documents)
        rows = np.repeat(np.arange(len(documents)) * hashed, [len(x) for x in documents])
        vectors = np.bincount(rows + self.slot[ids], self.sign[ids], len(documents) * hashed).reshape(-1, hashed)
        # Roots keep a few frequent tokens from deciding the place; unit length makes it one of content, not size.
        vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        places = (vectors / np.where(norms > 0, norms, 1)) @ self.axes
        cells = 1 << self.settings.bits
        return hilbert_keys(np.clip(((places / 8) + 0.5) * cells, 0, cells - 1).astype(np.int64), self.settings.bits)


def tokenized(docs: DataFrame, tokenizer: str, settings: PackSettings) -> DataFrame:
    """row, doc_id, curve_key, n_tokens (with the end id), ids (little-endian unsigned 32-bit, compact)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(tokenizer)
        curve = Curve(settings, max(coder.library.get_vocab_size(with_added_tokens=True), settings.end_id))
        for whole in batches:
            for start in range(0, whole.num_rows, _ROW_BATCH):
                batch = whole.slice(start, _ROW_BATCH)
                ids = coder.encode_all([text or "" for text in batch.column(1).to_pylist()])
                closed = [np.append(x, settings.end_id).astype("<u4") for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(curve.keys(ids), pa.int64()),
                        pa.array([len(x) for x in closed], pa.int64()),
                        pa.array([_narrow(x) for x in closed], pa.binary()),
                    ],
                    ["doc_id", "curve_key", "n_tokens", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, curve_key long, n_tokens long, ids binary")
    return coded.select(F.monotonically_increasing_id().alias("row"), "*")


def _narrow(ids: np.ndarray) -> bytes:
    """16 bits for each id where they fit, else 32; the width shows in the length."""
    return ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else ids.tobytes()


def _wide(packed: bytes, count: int) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * count else "<u4").astype("<u4")


def placed(lengths: DataFrame) -> DataFrame:
    """``row``, curve_key, n_tokens with ``at``: the tokens before the row along the curve.

    Rows are range-partitioned by key, ties by row, so that neither a hot key nor a hot document lands
    in one task. Sums within the partitions and over the partitions' totals, one row for each of them,
    give the place of every row.
    """
    order = ["curve_key", "row"]
    # The partition is written with its rows: what is read back is what was sorted.
    ranged = materialise(
        lengths.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "pack-order"
    )
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = totals.select(
        "part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before_part")
    )
    within = Window.partitionBy("part").orderBy(*order)
    inside = F.sum("n_tokens").over(within) - F.col("n_tokens")
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "part").select(
        "row", (F.col("before_part") + F.col("inside")).alias("at")
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    settings: PackSettings | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    Documents follow one another along the curve and are cut wherever a sequence is full, so every
    sequence but the last is full and each id lies in one piece. A null or empty text is its end id
    alone. Repeated rows, rows of one id and rows without id are documents of their own. An empty
    table gives no pieces. A document of any length is cut like any other.
    """
    settings = settings or PackSettings()
    source = columns_as(docs, doc_id=id_column, text=text_column)
    coded = materialise(tokenized(source, tokenizer, settings), "pack-ids")
    order = placed(coded.select("row", "curve_key", "n_tokens"))
    joined = coded.select("row", "doc_id", "n_tokens", "ids").join(order, "row")
    size = settings.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _ROW_BATCH):
                batch = whole.slice(first, _ROW_BATCH)
                rows, starts, lengths, ids, totals, sequences, offsets = ([] for _ in range(7))
                columns = (batch.column(name).to_pylist() for name in ("n_tokens", "ids", "at"))
                for i, (count, packed, at) in enumerate(zip(*columns, strict=True)):
                    values = _wide(packed, count)
                    start = 0
                    while start < count:
                        sequence, offset = divmod(at + start, size)
                        length = min(size - offset, count - start)
                        rows.append(i)
                        starts.append(start)
                        lengths.append(length)
                        ids.append(values[start : start + length].tobytes())
                        totals.append(count)
                        sequences.append(sequence)
                        offsets.append(offset)
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows, pa.int32())),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(totals, pa.int64()),
                        pa.array(sequences, pa.int64()),
                        pa.array(offsets, pa.int64()),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "n_tokens", "ids", "at").mapInArrow(
        cut,
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
