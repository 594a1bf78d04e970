"""The trie against one built with dictionaries."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from conftest_llm import empty

from segmart.llm.trie import prefix_trie

SMALL = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def expected(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            said = (role or "", text or "")
            turns[conv_id].append((turn is not None, turn or 0, digest(said), said))
    own = {c: [t[-1] for t in sorted(members)] for c, members in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + said[h:])
        for depth in range(len(whole) + 1):
            members[whole[:depth]].append(c)
        ends[whole].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        words = len(node[-1][1].encode().split()) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += not children[node]
            saved[node[:depth]] += (len(members[node]) - 1) * words
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def result(df):
    return sorted(tuple(row[name] for name in NAMES) for row in df.collect())


def table(spark, rows):
    extra = [(*row, 1, b"", "x") for row in rows]
    return spark.createDataFrame(
        extra, "conv_id long, turn long, role string, text string, part int, path binary, words string"
    )


def test_conversations(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert result(prefix_trie(df)) == expected(rows)


@pytest.fixture(scope="module")
def odd_rows():
    """Copies, shared openings, conversations that are the start of others, lengths around those of a matrix."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"common turn {t} " * (t % 4)) for c in range(0, 400, 3) for t in range(c % 11)]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(60) for t in range(9)]
    rows += [(2000 + c, t, "user", f"same {t if t < 12 else t * (c % 3)}") for c in range(30) for t in range(8 + c)]
    rows += [(3000, t, "user", "long " * (t % 50)) for t in range(300)] + [(3001, t, "user", "long " * (t % 50)) for t in range(299)]
    rows += [(-5, 0, "user", "below zero"), (-20, 0, "user", "first below"), (-20, 1, "user", "second below"), (-5, 3, None, None)]
    rows += [(4001, None, "user", "no turn"), (4001, 0, None, "text"), (4001, 0, "user", None), (4001, 2, "a", " \t\x0b")]
    rows += [(4002, 1, "b", "tie"), (4002, 1, "a", "tie"), (4002, 1, "a", "tie"), (4003, 1, "ab", "c"), (4004, 1, "a", "bc")]
    return rows + [(None, 0, "user", "no conversation"), (None, None, None, None), (4005, 0, "user", "w " * 60000)]


@pytest.mark.parametrize("ranges", [1, 2, 7, 150])
def test_every_cut_gives_the_same_trie(spark, odd_rows, ranges):
    assert result(prefix_trie(table(spark, odd_rows), ranges)) == expected(odd_rows)


def test_only_turnless(spark):
    rows = [(c, 0, "user", "x") for c in range(21, 40)]
    rows = [row for row in rows if zlib.crc32(str(row[0]).encode()) % 4]
    assert result(prefix_trie(table(spark, rows))) == expected(rows)
    assert {depth for _, depth, *_ in expected(rows)} == {0}


def test_empty_table(spark, odd_rows):
    df = table(spark, odd_rows)
    assert result(prefix_trie(empty(df))) == [] == result(prefix_trie(df.where("conv_id IS NULL")))
