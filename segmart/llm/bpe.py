"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels."""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.llm.common import columns_as

_ROW_BATCH = 128
_CACHED_PIECES = 300_000
_CACHED_LETTERS = 48
# Keys beside the symbols, which have one character each.
_LABEL, _LAST = "token", "token at the end"


class MergeAutomaton:
    """The automaton of all token sequences that byte-pair encoding can produce.

    It starts as one state with a loop for every base symbol. Each merge (u, v), in order of rank, puts
    in a gadget: where u then v could be read, the arc u now leads to a copy of its target without the
    arc v, and a new arc uv leads to where v led. A text has exactly one path, its encoding.

    A state is thus a chain of copies, each with the arc it lost and the rank at which it lost it. The
    chain of a token's target is its own losses and, below its birth, those of its right part. An arc
    uv is at a state if u was there when uv was born. So whether arc t leaves a state follows from the
    ranks of the losses along both chains; `arc` computes it once for each pair and keeps it.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        self.vocab, self.end = vocab, end
        size = max(vocab.values()) + 1
        self.birth = [-1] * size
        self.left: list[int] = [-1] * size
        self.right: list[int] = [-1] * size
        self.lost: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        for rank, (u_text, v_text) in enumerate(merges):
            u, v, token = vocab[u_text], vocab[v_text], vocab[u_text + v_text]
            if not self._leaves(u, v):
                continue  # u is never followed by v here, so the gadget would be empty
            self.lost[u, v] = rank
            self.birth[token], self.left[token], self.right[token] = rank, u, v
        made = {u + v for u, v in merges}
        alive = [text for text, token in vocab.items() if text not in made or self.birth[token] >= 0]
        # Labels of arcs by their symbols: node[symbol] is the next node, node[_LABEL] the token that ends there.
        self.labels: dict = {}
        for text in alive:
            stem = text.removesuffix(end) if end else text
            node = self.labels
            for symbol in stem:
                node = node.setdefault(symbol, {})
            if stem == text:
                node[_LABEL] = vocab[text]
            if stem != text or not end:
                node[_LAST] = vocab[text]
        self.longest = max(map(len, alive))

    def _leaves(self, u: int, t: int) -> bool:
        before_u = None
        while u >= 0:
            arc, before_arc = t, None
            while arc >= 0:
                rank = self.lost.get((u, arc))
                if (
                    rank is not None
                    and (before_u is None or rank < before_u)
                    and (before_arc is None or rank <= before_arc)
                ):
                    return False
                before_arc, arc = self.birth[arc], self.left[arc]
            before_u, u = self.birth[u], self.right[u]
        return True

    def arc(self, u: int, t: int) -> bool:
        """Does arc t leave the state that u leads to?"""
        known = self.arcs.get(u << 32 | t)
        if known is None:
            if len(self.arcs) > 1_000_000:
                self.arcs.clear()
            known = self.arcs[u << 32 | t] = self._leaves(u, t)
        return known

    def encode(self, word: str) -> list[int]:
        """Ids of a pre-split word in byte symbols. Every prefix has one path, so one token ends at each place."""
        size, arcs = len(word), self.arcs
        last: list[int | None] = [None] * (size + 1)
        width = [0] * (size + 1)
        for start in range(size):
            before = last[start]
            if start and before is None:
                continue
            node, stop = self.labels, start
            for symbol in word[start : start + self.longest]:
                node = node.get(symbol)
                if node is None:
                    break
                stop += 1
                if last[stop] is None:
                    token = node.get(_LABEL if stop < size else _LAST)
                    if token is not None:
                        leaves = not start or arcs.get(before << 32 | token)
                        if leaves is None:
                            leaves = self.arc(before, token)
                        if leaves:
                            last[stop], width[stop] = token, stop - start
        ids, place = [], size
        while place:
            ids.append(last[place])
            place -= width[place]
        return ids[::-1]


class _Pieces(dict):
    """piece -> its ids; what is not there is encoded, and kept while there is room."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        packed = self._encode(piece)
        if len(piece) <= _CACHED_LETTERS:
            if len(self) >= _CACHED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class WordEncoder:
    """Encodes whole texts with a tokenizer file of kind "BPE with word ends".

    The file's own normalizer and splitter cut a text into words; the automaton encodes them. Special
    tokens in a text are recognised, as the library does. Blanks and line feeds end a word in any
    case, so pieces between them are encoded once and kept while there is room.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        content = _content(path)
        model = content["model"]
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.special = _special(content)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        merges = [tuple(merge) for merge in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.pieces = _Pieces(self._piece)
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = array("I", self.automaton.encode(word)).tobytes()
            if len(word) <= _CACHED_LETTERS:
                if len(self.words) >= _CACHED_PIECES:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            # Nothing to split or compose: one word, in lower case.
            return self._word(piece.lower())
        ids = []
        for part in self.special_pattern.split(piece):
            if part in self.special:
                ids.append(array("I", [self.special[part]]).tobytes())
            elif part:
                words = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))
                ids += [self._word(word) for word, _ in words]
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


class LabelDecoder:
    """Emits the labels of the arcs that ids stand for. Without a decoder of its own, a file joins them with blanks."""

    def __init__(self, path: str) -> None:
        content = _content(path)
        labels = {token: text for text, token in content["model"]["vocab"].items()}
        labels |= {token: text for text, token in _special(content).items()}
        self.labels = [labels.get(i, "").encode() for i in range(max(labels) + 1)]

    def decode(self, ids: bytes) -> str:
        return b" ".join(map(self.labels.__getitem__, memoryview(ids).cast("I"))).decode()


def _content(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def _special(content: dict) -> dict[str, int]:
    return {token["content"]: token["id"] for token in content["added_tokens"]}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> LabelDecoder:
    return LabelDecoder(path)


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit).

    ``tokenizer`` names a file every executor has. A null or empty text has no tokens, a text of any
    length is encoded whole; nothing is shuffled, and a task holds one small batch and its caches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(_tokenizer_path(tokenizer))
        for whole in batches:
            for start in range(0, whole.num_rows, _ROW_BATCH):
                batch = whole.slice(start, _ROW_BATCH)
                ids = [coder.encode(text or "") for text in batch.column(1).to_pylist()]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
                )

    source = columns_as(docs, doc_id=id_column, text=text_column)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of ``encode`` with their decoded text; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = decoder(_tokenizer_path(tokenizer))
        for whole in batches:
            for start in range(0, whole.num_rows, _ROW_BATCH):
                batch = whole.slice(start, _ROW_BATCH)
                texts = [coder.decode(ids or b"") for ids in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids binary, decoded string"
    )


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
