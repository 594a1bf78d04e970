"""k-means of many models at once: one scan of the points advances every centre of every model."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "point"
# Distances held at a time, points by centres.
_CELLS = 500_000


@dataclass(frozen=True)
class Sweep:
    """Final centres and within-cluster sums of squares of every model, scans made, and the largest last step."""

    centres: list[np.ndarray]
    costs: list[float]
    scans: int
    moved: float


def _blocks(models: Sequence[np.ndarray]) -> list[tuple[int, int, int]]:
    """(first centre, models, centres of each) of every run of models with equally many centres."""
    blocks, at = [], 0
    for k, run in itertools.groupby(map(len, models)):
        n = len(list(run))
        blocks.append((at, n, k))
        at += n * k
    return blocks


def _partial(models: Sequence[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts, squared distances and sums of the points nearest to each centre, over one partition."""
    stacked = np.concatenate(models)
    squares, blocks = (stacked**2).sum(axis=1), _blocks(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, costs, sums = np.zeros(len(stacked)), np.zeros(len(stacked)), np.zeros_like(stacked)
        step = max(1, _CELLS // len(stacked))
        for batch in batches:
            points = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for start in range(0, len(points), step):
                some = points[start : start + step]
                # In place: one array of points by centres is computed, and read once for the nearest ones.
                distances = (2 * some) @ stacked.T
                np.subtract((some**2).sum(axis=1)[:, None], distances, out=distances)
                distances += squares
                np.maximum(distances, 0.0, out=distances)
                nearest = np.concatenate(
                    [
                        distances[:, first : first + n * k].reshape(len(some), n, k).argmin(axis=2) + np.arange(first, first + n * k, k)
                        for first, n, k in blocks
                    ],
                    axis=1,
                )
                rows = np.arange(len(some))[:, None]
                counts += np.bincount(nearest.ravel(), minlength=len(stacked))
                costs += np.bincount(nearest.ravel(), distances[rows, nearest].ravel(), minlength=len(stacked))
                distances.fill(0.0)
                distances[rows, nearest] = 1.0
                sums += distances.T @ some
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"centre": used, "n": counts[used], "cost": costs[used], "sums": pa.array(list(sums[used]), pa.list_(pa.float64()))}
        )

    return run


def one_scan(points: DataFrame, models: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, costs and sums by centre, all models' centres one after the other.

    Each task adds up its points, one aggregate adds up the tasks, and the driver gets one row a centre.
    """
    size, width = sum(len(m) for m in models), models[0].shape[1]
    partial = points.select(POINT).mapInArrow(_partial(models), "centre long, n double, cost double, sums array<double>")
    total = partial.groupBy("centre").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")
    )
    counts, costs, sums = np.zeros(size), np.zeros(size), np.zeros((size, width))
    for row in total.collect():
        counts[row["centre"]], costs[row["centre"]], sums[row["centre"]] = row["n"], row["cost"], row["sums"]
    return counts, costs, sums


def model_costs(points: DataFrame, models: Sequence[np.ndarray]) -> list[float]:
    """Within-cluster sum of squares of given centres, one scan for all models."""
    costs = one_scan(points, models)[1]
    return [float(part.sum()) for part in np.split(costs, np.cumsum([len(m) for m in models])[:-1])]


def _advanced(centres: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, float]:
    """The means of the centres' points and the longest step; a centre without points stays."""
    new, filled = centres.copy(), counts > 0
    new[filled] = sums[filled] / counts[filled][:, None]
    return new, float(np.sqrt(((new - centres) ** 2).sum(axis=1)).max())


def refined_starts(
    spark: SparkSession, sample: np.ndarray, starts: Sequence[np.ndarray], max_scans: int = 300, tolerance: float = 1e-4
) -> list[np.ndarray]:
    """Every model's start after Lloyd's iterations on the sample, one task a model.

    From there the scans of all points have little left to do, however many a poor start would take.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model in (i for batch in batches for i in batch.column(0).to_pylist()):
            centres = np.array(starts[model], dtype=float)
            for _ in range(max_scans):
                nearest = ((centres**2).sum(axis=1) - 2 * sample @ centres.T).argmin(axis=1)
                counts = np.bincount(nearest, minlength=len(centres))[:, None]
                sums = np.stack([np.bincount(nearest, column, len(centres)) for column in sample.T], axis=1)
                before, centres = centres, np.where(counts > 0, sums / np.maximum(counts, 1), centres)
                if np.sqrt(((centres - before) ** 2).sum(axis=1)).max() <= tolerance:
                    break
            yield pa.RecordBatch.from_pydict({"model": [model], "centres": pa.array([centres.ravel()], pa.list_(pa.float64()))})

    each = spark.range(len(starts), numPartitions=max(1, len(starts)))
    refined = {row["model"]: row["centres"] for row in each.mapInArrow(run, "model long, centres array<double>").collect()}
    return [np.array(refined[i]).reshape(np.shape(start)) for i, start in enumerate(starts)]


def lloyd_sweep(
    points: DataFrame, starts: Sequence[np.ndarray], max_scans: int = 300, tolerance: float = 1e-4
) -> Sweep:
    """Lloyd's iterations of all models from their starts.

    A model stops once none of its centres moves by more than ``tolerance``; the others go on, so the scans
    are those of the slowest model, and the last one of them measures the costs of the final centres. A
    centre without points stays where it is. Points are an array column ``point`` without nulls.
    """
    centres = [np.array(start, dtype=float) for start in starts]
    moving, scans, last = list(range(len(centres))), 0, [0.0] * len(centres)
    while moving and scans < max_scans - 1:
        counts, _, sums = one_scan(points, [centres[i] for i in moving])
        scans, at, still = scans + 1, 0, []
        for i in moving:
            own = slice(at, at + len(centres[i]))
            at = own.stop
            centres[i], last[i] = _advanced(centres[i], counts[own], sums[own])
            if last[i] > tolerance:
                still.append(i)
        moving = still
    return Sweep(centres, model_costs(points, centres), scans + 1, max(last, default=0.0))


def sample_starts(sample: np.ndarray, ks: Sequence[int], restarts: int, seed: int) -> list[np.ndarray]:
    """k-means++ starts from a sample of points, one for each k and restart; no more than distinct points."""
    sample = np.unique(sample, axis=0)
    starts = []
    for k in ks:
        for restart in range(restarts if k > 1 else 1):
            draw = np.random.default_rng([seed, k, restart])
            chosen = [sample[draw.integers(len(sample))]]
            nearest = ((sample - chosen[0]) ** 2).sum(axis=1)
            while len(chosen) < min(k, len(sample)):
                chosen.append(sample[draw.choice(len(sample), p=nearest / nearest.sum())])
                nearest = np.minimum(nearest, ((sample - chosen[-1]) ** 2).sum(axis=1))
            starts.append(np.array(chosen))
    return starts
