"""Links and components against all pairs."""

import tracemalloc

import numpy as np
import pytest
from conftest_llm import empty
from pyspark.sql import functions as F

from segmart.llm import quantised
from segmart.llm.quantised import QuantiseSettings, _first_by_hash, _k_means, _nearest, near_vectors

SMALL = "/root/testdata/sf0.001"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def usable(vec_id, vector, label):
    return (
        vec_id is not None and label is not None and vector and all(v is not None and np.isfinite(v) for v in vector)
        and any(vector)
    )


def expected(rows, cosine=0.93):
    links = [set() for _ in rows]
    groups = {}
    for i, row in enumerate(rows):
        if usable(*row):
            groups.setdefault((row[2], len(row[1])), []).append(i)
    for members in groups.values():
        unit = np.array([rows[i][1] for i in members], dtype=float)
        unit /= np.abs(unit).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(unit @ unit.T >= cosine)):
            if a != b:
                links[members[a]].add(members[b])
    found = []
    for i, (vec_id, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        found.append((vec_id, len(links[i]), least, vec_id == least))
    return sorted(found, key=str)


def result(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()], key=str)


def around(rng, centre, cosine):
    """A vector at just this cosine."""
    unit = centre / np.linalg.norm(centre)
    other = rng.normal(size=len(unit))
    other -= other @ unit * unit
    return cosine * unit + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


@pytest.fixture(scope="module")
def planted():
    """Lone vectors, pairs from just below to far above the threshold, copies, a chain and a large near group."""
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=64), int(rng.integers(4))) for _ in range(900)]
    for i in range(250):
        centre, label = rows[i]
        rows.append((around(rng, centre, 0.9201 + 0.0002 * i) * (1 + i), label))
    rows += [(rows[7][0], rows[7][1])] * 40 + [(rows[8][0], 3 - rows[8][1])]
    rows += [(rows[9][0] + rng.normal(size=64) * 0.05, 1) for _ in range(150)]
    step = rows[11][0]
    for _ in range(12):
        step = around(rng, step, 0.935)
        rows.append((step, 2))
    ids = rng.permutation(len(rows)) * 3
    return [(int(i), [float(x) for x in v], label) for i, (v, label) in zip(ids, rows)]


def table(spark, rows, kind="double", label="int"):
    return spark.createDataFrame(
        [(*row, 1, "x") for row in rows], f"vec_id long, embedding array<{kind}>, label {label}, node int, cell string"
    ).repartition(5)


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert result(near_vectors(df)) == expected(rows)


def test_planted_links_and_recall(spark, planted):
    want = expected(planted)
    settings = QuantiseSettings(list_rows=8)
    found = result(near_vectors(table(spark, planted), settings))
    total = sum(row[1] for row in want)
    assert sum(row[1] for row in found) >= 0.999 * total
    assert all(f[1] <= w[1] for f, w in zip(found, want))
    # Looking as far as a link can lead loses nothing.
    assert result(near_vectors(table(spark, planted), QuantiseSettings(list_rows=8, reach=0.5))) == want


def test_blocks_and_buckets_change_nothing(spark, planted):
    rows = planted[600:]
    want = expected(rows)
    small = QuantiseSettings(list_rows=32, reach=0.5, block_rows=16, bucket_rows=300)
    assert result(near_vectors(table(spark, rows), small)) == want


def test_rounds_change_nothing_and_drop_their_shuffles(spark, planted, monkeypatch):
    rows = planted[600:]
    kept = spark.conf.get(CLEANUP)
    moved, rounds = [], []
    stored = quantised.materialise

    def watched(df, name):
        rounds.extend([name] if name == "quantised-survivors" else [])
        assert spark.conf.get(CLEANUP) == "true"
        return stored(df, name)

    monkeypatch.setattr(quantised, "materialise", watched)
    in_blocks = quantised._in_blocks
    monkeypatch.setattr(quantised, "_in_blocks", lambda *a: moved.append(in_blocks(*a)) or moved[-1])
    small = QuantiseSettings(list_rows=32, reach=0.5, block_rows=16, bucket_rows=300, round_rows=1, round_share=3)
    assert result(near_vectors(table(spark, rows), small)) == expected(rows)
    classes = len({(tuple(v), label) for _, v, label in rows})
    assert len(rounds) == -(-moved[0].count() // (3 * classes)) > 3
    assert spark.conf.get(CLEANUP) == kept


def test_few_residents_are_not_copied_for_many_visitors(spark):
    """Forty blocks of visitors came to a list of one block of residents, which moved forty times."""
    classes = spark.createDataFrame(
        [(1, 2, i.to_bytes(2, "big"), 0 if i < 10 else 1, [0, 1], b"c", 0.1, b"ab", 0.2, 0.3) for i in range(400)],
        "label int, length int, node binary, home int, probes array<int>, code binary, code_error float, bytes binary, step float, byte_error float",
    )
    entries = quantised._in_blocks(classes, quantised._lists(classes, QuantiseSettings(block_rows=10)))
    found = {tuple(r) for r in entries.groupBy("cell", "resident").count().collect()}
    assert found == {(0, True, 10), (0, False, 400), (1, True, 390 * 39), (1, False, 400 * 39)}
    # Every block of residents meets every visitor once.
    met = entries.where("NOT resident AND cell = 1").groupBy("node").agg(F.countDistinct("resident_block").alias("n"), F.count("*").alias("m"))
    assert {tuple(r) for r in met.select("n", "m").collect()} == {(39, 39)}


def test_edges(spark, planted):
    nan, inf = float("nan"), float("inf")
    one = planted[0][1]
    rows = planted[:60] + [
        (-1, None, 1), (-2, [], 1), (-3, [0.0] * 64, 1), (-4, [-0.0] * 64, 1), (-5, [nan, *one[1:]], 1), (-6, [inf, *one[1:]], 1),
        (-7, [None, *one[1:]], 1), (-8, one, None), (None, one, planted[0][2]), (None, None, None), (-9, [1.0, 2.0], 1),
        (-10, [1.0, 2.1], 1), (-11, [1.0, 2.0, 3.0], 1), (-11, [1.0, 2.0, 3.1], 1), (-12, [1e300, 2e300], 1), (-13, [5e-324, 0.0], 1),
        (-14, [5e-324, 0.0], 1), (-14, [5e-324, 0.0], 1), (-15, [1.0], 1), (-16, [-1.0], 1), (-17, one, planted[0][2]),
    ]
    want = expected([r if r[0] != -12 else (-12, [1.0, 2.0], 1) for r in rows])
    found = result(near_vectors(table(spark, rows), QuantiseSettings(reach=0.5)))
    # Whatever has no id is kept.
    assert found == [row if row[0] is not None else (None, 0, None, True) for row in want]


def test_other_types_and_empty_table(spark, planted):
    rows = [(i, [float(np.float32(x)) for x in v], f"label {label}") for i, v, label in planted[:200]]
    df = table(spark, rows, "float", "string")
    assert result(near_vectors(df, QuantiseSettings(reach=0.5))) == expected(rows)
    assert result(near_vectors(empty(df))) == []


def test_fit_holds_a_bounded_part_of_the_distances():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(8192, 8)).astype(np.float32)
    tracemalloc.start()
    centres = _k_means(points, 2048, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All distances would be 67 MB, and as much again for each step on the way to them.
    assert centres.shape == (2048, 8) and peak < 40e6
    distance = ((points[:500, None].astype(float) - centres[None]) ** 2).sum(axis=2)
    found = _nearest(points[:500], centres)
    assert np.allclose(distance[np.arange(500), found], distance.min(axis=1), atol=1e-4)


@pytest.mark.parametrize("spread", [True, False])
def test_sample_is_the_first_by_hash(spark, monkeypatch, spread):
    rows = [(i.to_bytes(16, "big"), [float(i), 1.0]) for i in range(5000)]
    df = spark.createDataFrame(rows, "node binary, embedding array<double>").withColumn("hash", F.xxhash64("node"))
    if not spread:
        df = df.where("hash > 0")
    want = [r.embedding for r in df.orderBy("hash", "node").limit(200).collect()]
    ordered = []
    order_by = type(df).orderBy
    monkeypatch.setattr(type(df), "orderBy", lambda self, *by: ordered.append(self.count()) or order_by(self, *by))
    assert _first_by_hash(df.drop("hash"), 5000, 200).to_pylist() == want
    assert ordered[0] < 500 and (len(ordered) == 1) == spread
