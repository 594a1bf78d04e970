"""The manifest against a plain recomputation, row by row."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from conftest_llm import empty

from segmart.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        start = i // 16 * 16
        yield "".join(level[start:i]), "".join(level[i + 1 : start + 16])
        i //= 16


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([member[2] for member in sorted(groups[s], key=lambda m: m[:3])]) for s in order}
    top = up([trees[s][-1][0] for s in order])
    found = []
    for place, source in enumerate(order):
        for i, (_, _, digest, row) in enumerate(sorted(groups[source], key=lambda m: m[:3])):
            path = [*steps(trees[source], i), *steps(top, place)]
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                changed = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            folded = leaf(changed)
            for before, after in path:
                folded = sha(before + folded + after)
            proof = sha("".join(before + after for before, after in path))
            root = top[-1][0]
            found.append((row[0], digest, trees[source][-1][0], root, proof, folded, folded == root))
    return sorted(found, key=str)


def result(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert set(names) <= set(df.columns)
    return sorted([tuple(row[name] for name in names) for row in df.collect()], key=str)


def rows_of(df):
    return [tuple(row[c] for c in COLUMNS) for row in df.select(*COLUMNS).collect()]


def test_documents(documents):
    assert result(merkle.manifest(documents)) == expected(rows_of(documents))


def test_edges_and_repeated_rows(spark, edges):
    docs = edges.withColumn("n_chars", edges["row"])
    docs = docs.unionByName(docs).unionByName(docs.where("doc_id IS NULL OR doc_id > 6"))
    assert result(merkle.manifest(docs)) == expected(rows_of(docs))


def test_scattered_ids_and_many_sources(spark):
    ids = [-(2**63), -(2**40), -65, -64, -1, 0, 1, 63, 64, 5000, 2**33, 2**62, 2**63 - 1, None]
    rows = [(i, f"s{i and i % 40}", "l", 1, f"Text {i}") for i in ids] + [(i, "hot", None, i, "A") for i in range(0, 3000, 7)]
    rows += [(i, f"é{i}", "x", None, None) for i in range(300)] + [(i, "", "x", 2, "") for i in range(17)]
    rows += [(77, "ties", "x", i % 50, "T") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert result(merkle.manifest(docs)) == expected(rows)


@pytest.mark.parametrize("rows", [[(5, None, None, None, None)], [(5, "a", None, 1, "X"), (5, "b", None, 1, "X")]])
def test_single_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert result(merkle.manifest(docs)) == expected(rows)


def test_empty_table(documents):
    assert result(merkle.manifest(empty(documents))) == []
