from collections import defaultdict

import pyspark.sql.functions as F
from conftest_llm import edge_rows, empty

from segmart.llm.exact import drop_exact_copies, exact_groups


def normal(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append((-len(text or ""), doc_id is None, doc_id))
    best = {key: min(members, key=lambda m: (m[0], m[1], m[2] or 0)) for key, members in groups.items()}
    found = []
    for doc_id, text in rows:
        size, _, keep = best[normal(text)]
        found.append((doc_id, keep, len(groups[normal(text)]), doc_id == keep and -len(text or "") == size))
    return sorted(found, key=str)


def result(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()], key=str)


def test_edges(edges):
    rows = edge_rows(edges)
    assert result(exact_groups(edges)) == expected(rows)


def test_bytes_decide_when_hashes_collide(edges):
    for weak in (lambda text: F.lit("x"), lambda text: F.substring(F.md5(text), 1, 1)):
        assert result(exact_groups(edges, content_hash=weak)) == expected(edge_rows(edges))


def test_dropping_keeps_columns_and_one_row(edges):
    kept = drop_exact_copies(edges)
    assert kept.columns == edges.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    # The repeated row ties with itself; document 2 is longer than 1, and of the blank texts 5 stays.
    assert {doc_id for doc_id, _ in rows} == {2, 5, None, 7, 8, 9, 10}


def test_of_repeated_rows_one_stays(spark):
    rows = [(1, "same text"), (1, "same text"), (2, "same text"), (1, "same\ttext"), (3, "alone")]
    rows += [(None, "no name"), (None, "no name"), (4, None), (4, None), (1, "longer  one"), (1, "longer one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, normal(r.text)) for r in drop_exact_copies(df).collect()), key=str)
    assert kept == [(1, "longerone"), (1, "sametext"), (3, "alone"), (4, ""), (None, "noname")]


def test_empty_table(spark, edges):
    assert exact_groups(empty(edges)).count() == 0
    assert drop_exact_copies(empty(edges)).count() == 0
