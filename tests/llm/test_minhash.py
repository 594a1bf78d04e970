import random

import numpy as np
import pytest
from conftest_llm import empty

from segmart.llm.components import components
from segmart.llm.minhash import NearSettings, drop_near_copies, near_duplicates, shingle_set, signature
from segmart.llm.minhash import _families as families


def brute_force(rows, percent=85):
    """component of every row by comparing all pairs of texts."""
    sets = [set(shingle_set(text).tolist()) for _, text in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and rows[i][0] is not None and rows[j][0] is not None:
                parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return sorted(
        ((d, len(sets[i]), None if d is None else least[top(i)], d is None or d == least[top(i)]) for i, (d, _) in enumerate(rows)),
        key=str,
    )


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)


def variants(seed, groups, copies, length):
    """Copies of originals with a few words changed: around the threshold, both with it and with one another."""
    draw = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [f"w{draw.randrange(5000)}" for _ in range(length)]
        for _ in range(copies):
            changed = list(words)
            for _ in range(draw.randrange(0, max(2, length // 35))):
                changed[draw.randrange(length)] = f"x{draw.randrange(10**6)}"
            rows.append((draw.randrange(10**9), " ".join(changed)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_rows", [512, 4])
def test_components_equal_brute_force(spark, block_rows):
    rows = variants(3, groups=6, copies=25, length=120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df, settings=NearSettings(block_rows=block_rows))) == brute_force(rows)


def test_edges(edges):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert result(near_duplicates(edges)) == brute_force(rows)
    kept = drop_near_copies(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 1, 3, 4, 5, 7, 9, 10]


def test_texts_of_one_id_are_dropped_one_by_one(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long), (2, long + " tail"), (2, "a text of its own that nobody else has"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df)) == brute_force(rows)
    kept = drop_near_copies(df).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([rows[0], *rows[2:]], key=str)


def test_empty_table(edges):
    assert near_duplicates(empty(edges)).count() == 0


def test_shingles():
    assert len(shingle_set("a b c d e f")) == 2
    assert (shingle_set("A b\tC d e") == shingle_set("a  b c\nd E")).all()
    assert len(shingle_set("a b")) == 1 and len(shingle_set(" \n")) == 0
    # Only A-Z are folded and only six characters part words.
    assert len(shingle_set("É b c d e") | shingle_set("é b c d e")) == 1 or (
        shingle_set("É b c d e") != shingle_set("é b c d e")
    ).all()
    assert len(shingle_set("a b c d e f")) == 1
    assert len(shingle_set("a b c d e a b c d e")) == 5


def test_signature_estimates_similarity():
    settings = NearSettings(bands=64, rows=8)
    a, b = families(settings)
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 1 << 63, 3000, np.uint64)
    x, y = signature(pool[:2000], a, b), signature(pool[1000:], a, b)
    assert abs((x == y).mean() - 1 / 3) < 0.08


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
