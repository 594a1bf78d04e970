import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import empty
from tokenizers import Tokenizer

from segmart.llm.packing import PackSettings, PieceTokenizer, digest, hilbert_keys, pack

NAME = "byte_bpe_50k.json"
TEXTS = [
    "", " ", "  a", "a\tb \n c  d   ", "<|endoftext|>hi <|endoftext|> x", " I'm we'll 123", "日本 語 x  y", "\n\n a", " \n",
    "x \x1c y", "a \x85b", "\nab\n", " ab ", "a\0b c", "a\n'll b", "a, b. c.\nd, ., e.. f", "é, ñ. x×, y", ", a", "a,b. c",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def test_pieces_give_the_ids_of_the_library(documents, library):
    texts = TEXTS + [r.text for r in documents.limit(150).collect()]
    coder = PieceTokenizer(public_tokenizers.path(NAME))
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def check(rows, docs, library):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
    sequences = defaultdict(list)
    total = 0
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        mine = sorted(pieces[doc_id, len(ids)], key=lambda r: (r.start, r.sequence_id))
        copies = sum(r.start == 0 for r in mine)
        assert sum(r.length for r in mine) == copies * len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == total
    assert sorted(sequences) == list(range(-(-total // 2048)))
    for number, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or number == max(sequences)


def test_documents(spark, documents, library):
    rows = digest(pack(documents, NAME)).collect()
    check(rows, [(r.doc_id, r.text) for r in documents.collect()], library)


def test_edges(edges, library):
    docs = [(r.doc_id, r.text) for r in edges.collect()]
    check(digest(pack(edges, NAME)).collect(), docs, library)
    assert pack(empty(edges), NAME).count() == 0


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_keys_walk_to_neighbours(dimensions, bits):
    points = np.array(list(product(range(1 << bits), repeat=dimensions)))
    keys = hilbert_keys(points, bits)
    assert sorted(keys) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_similar_documents_are_neighbours(spark):
    draw = np.random.default_rng(2)
    topics = [[f"{t}{w}" for w in range(30)] for t in ("alpha", "beta", "gamma", "delta")]
    rows = [(i, " ".join(draw.choice(topics[i % 4], 200))) for i in range(80)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string"), NAME, settings=PackSettings(length=512))
    order = [r.doc_id % 4 for r in pieces.where("start = 0").orderBy("sequence_id", "offset").collect()]
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) > 60


def test_mixed_texts_give_the_ids_of_the_library(documents, library):
    """Texts that are encoded whole, and others that just miss being so."""
    draw = np.random.default_rng(3)
    letters = " \n\t\r  '''.,!?-_0123456789²¼ª×÷aábcdeéfsdmtllvereXÀÖŁŒſ<|>endoftext\xa0 \x0b\x00ñ漢Жά"
    base = "".join(r.text or "" for r in documents.limit(40).collect())
    texts = ["a" * 20_000, " " * 3000 + "b", "'s" * 2000, "." * 3000, "<|endoftext|>"]
    for i in range(3000):
        mixed = "".join(letters[j] for j in draw.integers(0, len(letters), draw.integers(1, 30)))
        at = int(draw.integers(0, len(base) - 60))
        texts.append(base[at : at + 30] + mixed + base[at + 30 : at + 60] if i % 3 else mixed)
    found = PieceTokenizer(public_tokenizers.path(NAME)).encode_all(texts)
    for ids, want in zip(found, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids
