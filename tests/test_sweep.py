"""Many k-means fits at once against one after the other."""

import numpy as np
import pytest

from segmart.operators import sweep


def plain(points, centres, rounds=300, tolerance=1e-4):
    """Lloyd's iterations of one model, and its cost."""
    centres = np.array(centres, dtype=float)

    def distances():
        return ((points[:, None] - centres) ** 2).sum(axis=2)

    for _ in range(rounds - 1):
        nearest = distances().argmin(axis=1)
        new = np.array([points[nearest == i].mean(axis=0) if (nearest == i).any() else c for i, c in enumerate(centres)])
        moved = np.sqrt(((new - centres) ** 2).sum(axis=1)).max()
        centres = new
        if moved <= tolerance:
            break
    return distances().min(axis=1).sum()


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(5)
    return np.concatenate([draw.normal(centre, 1.0, size=(200, 3)) for centre in ((0, 0, 0), (9, 0, 3), (0, 9, -4), (7, 7, 7))])


def table(spark, points):
    return spark.createDataFrame([(p.tolist(), 1) for p in points], "point array<double>, sums int").repartition(6)


def test_same_costs_as_single_fits_from_equal_starts(spark, points):
    starts = sweep.sample_starts(points, range(1, 8), 3, seed=4)
    found = sweep.lloyd_sweep(table(spark, points).cache(), starts)
    assert len(starts) == 1 + 6 * 3 and [len(s) for s in starts[:5]] == [1, 2, 2, 2, 3]
    assert found.costs == pytest.approx([plain(points, s) for s in starts], rel=1e-9)
    assert found.moved <= 1e-4 and found.scans < 300


def test_scans_are_those_of_the_slowest_model(spark, points, monkeypatch):
    starts, scans = sweep.sample_starts(points, [1, 4, 6], 2, seed=1), []
    one_scan = sweep.one_scan
    monkeypatch.setattr(sweep, "one_scan", lambda df, models: scans.append(len(models)) or one_scan(df, models))
    found = sweep.lloyd_sweep(table(spark, points).cache(), starts, max_scans=4)
    # Models that have come to rest no longer take part; the last scan is for the costs of all.
    assert len(scans) == found.scans <= 4 and scans[0] == scans[-1] == 5 and scans[2] <= 5


def test_costs_of_given_centres_and_empty_clusters(spark, points):
    models = [np.array([[0.0, 0, 0]]), np.array([[0.0, 0, 0], [1e6, 1e6, 1e6], [9, 0, 3]])]
    df = table(spark, points)
    want = [((points[:, None] - m) ** 2).sum(axis=2).min(axis=1).sum() for m in models]
    assert sweep.model_costs(df, models) == pytest.approx(want)
    centres = sweep.lloyd_sweep(df, models, max_scans=3).centres[1]
    assert centres[1].tolist() == [1e6] * 3 and centres[2].tolist() != [9, 0, 3]


def test_few_distinct_points(spark):
    same = np.array([[1.0, 2.0]] * 5 + [[3.0, 2.0]])
    starts = sweep.sample_starts(same, [1, 2, 5], 2, seed=0)
    assert [len(s) for s in starts] == [1, 2, 2, 2, 2]
    assert sweep.lloyd_sweep(table(spark, same), starts).costs[1:] == pytest.approx([0, 0, 0, 0])


def test_blocks_of_models_with_equally_many_centres():
    models = [np.zeros((k, 2)) for k in (1, 2, 2, 3, 2)]
    assert sweep._blocks(models) == [(0, 1, 1), (1, 2, 2), (5, 1, 3), (8, 1, 2)]


def test_one_scan_writes_over_its_distances(points):
    """The largest arrays are one of points by centres and those of the nearest centres."""
    import tracemalloc

    import pyarrow as pa

    draw = np.random.default_rng(3)
    models = [points[draw.choice(len(points), k, replace=False)] for k in range(1, 41)]
    batch = pa.RecordBatch.from_pydict({"point": pa.array(list(points), pa.list_(pa.float64()))})
    run = sweep._partial(models)
    tracemalloc.start()
    found = list(run(iter([batch])))[0].to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    stacked, at, want = np.concatenate(models), 0, {}
    for model in models:
        distances = ((points[:, None] - model) ** 2).sum(axis=2)
        nearest = distances.argmin(axis=1)
        for i in range(len(model)):
            if (nearest == i).any():
                want[at + i] = ((nearest == i).sum(), distances[nearest == i, i].sum(), points[nearest == i].sum(axis=0))
        at += len(model)
    assert found["centre"] == sorted(want) and found["n"] == [want[c][0] for c in found["centre"]]
    assert found["cost"] == pytest.approx([want[c][1] for c in found["centre"]], abs=1e-6)
    assert np.allclose(found["sums"], [want[c][2] for c in found["centre"]])
    assert peak < 2.5 * 8 * len(points) * len(stacked)


def test_first_points_are_those_of_a_full_sort(spark):
    from pyspark.sql import functions as F

    from segmart.operators.model import first_points

    many = spark.range(5000).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("point")).repartition(9)
    same = spark.range(900).select(F.array(F.lit(2.0)).alias("point"))
    for df in (many, same, many.limit(30)):
        want = df.orderBy(F.xxhash64("point"), "point").limit(40).collect()
        assert first_points(df, 40).collect() == want
    sorted_rows = first_points(many, 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in sorted_rows.split("Filter", 1)[-1] and "Filter" in sorted_rows


def test_refined_starts_are_at_rest_on_their_sample(spark, points):
    starts = sweep.sample_starts(points[::3], range(1, 7), 2, seed=2)
    refined = sweep.refined_starts(spark, points[::3], starts)
    assert [r.shape for r in refined] == [s.shape for s in starts]
    # On the sample itself nothing is left: a scan that finds all at rest, and one for the costs.
    there = sweep.lloyd_sweep(table(spark, points[::3]).cache(), refined)
    assert there.scans == 2 and there.costs == pytest.approx([plain(points[::3], s) for s in starts], rel=1e-9)
    df = table(spark, points).cache()
    assert sweep.lloyd_sweep(df, refined).scans < sweep.lloyd_sweep(df, starts).scans


def test_refining_needs_no_package_in_the_workers(spark, points, monkeypatch, tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    frame = type(spark.range(1))
    sent, map_in_arrow = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, schema: sent.append(f) or map_in_arrow(df, f, schema))
    sweep.refined_starts(spark, points, sweep.sample_starts(points, [2], 1, seed=1))
    (tmp_path / "task").write_bytes(cloudpickle.dumps(sent[0]))
    load = f"from pyspark import cloudpickle; cloudpickle.loads(open({str(tmp_path / 'task')!r}, 'rb').read())"
    assert subprocess.run([sys.executable, "-c", load], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}).returncode == 0
