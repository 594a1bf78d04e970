import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import empty
from tokenizers import Tokenizer

from segmart.llm.bpe import LabelDecoder, MergeAutomaton, WordEncoder, decode, digest, encode

NAME = "word_bpe_49k.json"
PATH = public_tokenizers.path(NAME)
TEXTS = [
    "", "  ", "a\tb\x1cc", "<|endoftext|>hi<|startoftext|> x", "I'm we'll DON'T 123", "ΑΣ ΟΔΟΣ", "éé", "日本語テキスト",
    "İstanbul ß ﬁ", "aaaa aaaaa " + "a" * 300, "Ω x̸= ≠", "hahahahahaha mississippi", "😀😀!!", "Ᲊ Ɤ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_labels_of_the_library(documents, library):
    draw = random.Random(4)
    texts = TEXTS + [r.text for r in documents.limit(100).collect()]
    texts += [" ".join("".join(draw.choices("abcdefghinorstu", k=draw.randint(1, 12))) for _ in range(200)) for _ in range(20)]
    texts += ["".join(chr(draw.choice([draw.randint(32, 126), draw.randint(160, 1500)])) for _ in range(200)) for _ in range(20)]
    coder, labels = WordEncoder(PATH), LabelDecoder(PATH)
    for text in texts:
        wanted = library.encode(text, add_special_tokens=False).ids
        packed = coder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == wanted
        assert labels.decode(packed) == library.decode(wanted, skip_special_tokens=False)


def plain_merges(word, ranks):
    parts = list(word)
    while len(parts) > 1:
        pairs = [(ranks.get((a, b), 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        rank, i = min(pairs)
        if rank == 10**9:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@pytest.mark.parametrize("seed", range(6))
def test_automaton_of_small_dictionaries(seed):
    """Every word of a small alphabet, with dictionaries trained on random text."""
    draw = random.Random(seed)
    words = ["".join(draw.choices("ab" if seed % 2 else "abc", k=12)) for _ in range(40)]
    merges, split = [], [list(w) for w in words]
    for _ in range(12):
        pairs = {}
        for parts in split:
            for pair in zip(parts, parts[1:], strict=False):
                pairs[pair] = pairs.get(pair, 0) + 1
        if not pairs:
            break
        merges.append(max(pairs, key=lambda pair: (pairs[pair], pair)))
        ranks = {pair: i for i, pair in enumerate(merges)}
        split = [plain_merges(w, ranks) for w in words]
    vocab = {text: i for i, text in enumerate(dict.fromkeys([*"abc", *(a + b for a, b in merges)]))}
    automaton = MergeAutomaton(vocab, merges, "")
    names = {i: text for text, i in vocab.items()}
    for length in range(1, 9):
        for _ in range(150):
            word = "".join(draw.choices("ab" if seed % 2 else "abc", k=length))
            assert [names[i] for i in automaton.encode(word)] == plain_merges(word, ranks)


def test_edges(edges, library):
    found = digest(decode(encode(edges, NAME), NAME)).collect()
    wanted = []
    for r in edges.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        wanted.append(
            (r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        )
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert encode(empty(edges), NAME).count() == 0
