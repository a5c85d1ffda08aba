"""K-means on coordinates: first centres of all starts, and Lloyd's rounds of all starts and all numbers of clusters, in one
scan each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .blocks import with_curve_position

MAX_ROUNDS = 300
#: A run has settled when none of its centres moves further than this, in degrees.
TOLERANCE = 1e-4
_CELLS = 4_000_000
#: Neighbouring locations that are assigned together where one centre is closest to their whole box, and how many locations a
#: task looks at together.
_RUN, _TOGETHER = 256, 200_000

Run = tuple[int, int]
"""Number of clusters, start."""


class KMeansResult(NamedTuple):
    points: DataFrame
    """Input rows with ``kmeans_cluster``; null for rows without coordinates."""
    centres: DataFrame
    """``cluster_id, lon, lat``, one row per cluster."""
    summary: DataFrame
    """One row: ``k, inertia``."""


def _positions(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Distinct locations with their number of rows, the same optimum from fewer points, and a hash of each.

    They lie along a Z-order curve, so that neighbours in the table are neighbours on the map.
    """
    places = df.select(F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")).dropna()
    counted = places.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    along = with_curve_position(cut(counted), "x", "y").repartitionByRange("z").sortWithinPartitions("z")
    return cut(along.select("x", "y", "w", F.xxhash64("x", "y").alias("hash")))


def _mixed(values: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes, by the finaliser of the splitmix generator."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


def _drawn(chosen: list[np.ndarray], number: int, seed: int):
    """For each start the location that wins the race for the next centre in this task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[float, float, float]] = {}
        for batch in batches:
            x, y, w = (batch[c].to_numpy() for c in ("x", "y", "w"))
            hashes = batch["hash"].to_numpy().astype(np.uint64)
            for start, centres in enumerate(chosen):
                rate = w
                if len(centres):
                    gap = np.full(len(x), np.inf)
                    for cx, cy in centres:
                        np.minimum(gap, (x - cx) ** 2 + (y - cy) ** 2, out=gap)
                    rate = w * gap
                salt = np.uint64(((seed + start) << 20 | number) * 0x9E3779B97F4A7C15 % 2**64)
                with np.errstate(divide="ignore"):
                    time = -np.log(_mixed(hashes ^ salt)) / rate
                if len(time):
                    i = int(time.argmin())
                    if np.isfinite(time[i]):
                        best[start] = min(best.get(start, (np.inf, 0.0, 0.0)), (float(time[i]), float(x[i]), float(y[i])))
        yield pd.DataFrame([(s, *v) for s, v in best.items()], columns=["start", "time", "x", "y"]).astype(
            {"start": "int32", "time": float, "x": float, "y": float})

    return run


def _first_centres(places: DataFrame, most: int, starts: int, seed: int) -> list[np.ndarray]:
    """For each start up to ``most`` centres, each drawn with odds of its rows times its squared distance to those before.

    A draw is a race: every location has an exponential time from its hash, its rate are its odds, and the first one wins.
    So a draw is a minimum, one scan draws for all starts, and partitioning does not matter.
    """
    chosen = [np.empty((0, 2)) for _ in range(starts)]
    for number in range(most):
        table = places.mapInPandas(_drawn(chosen, number, seed), "start int, time double, x double, y double")
        for r in table.groupBy("start").agg(F.min(F.struct("time", "x", "y")).alias("first")).collect():
            chosen[r.start] = np.vstack([chosen[r.start], [r["first"].x, r["first"].y]])
    return chosen


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
    """Coordinates and weights of many batches together."""
    held, rows = [], 0
    for batch in batches:
        if len(batch):
            held.append([batch[c].to_numpy() for c in ("x", "y", "w")])
            rows += len(batch)
        if rows >= _TOGETHER:
            yield [np.concatenate(c) for c in zip(*held)]
            held, rows = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _sums(centres: dict[Run, np.ndarray]):
    """Per run and centre: weight, weighted coordinates and cost of the points closest to it; one row each a task.

    Neighbouring locations whose whole box is closest to one centre are added by their totals; only the others are
    compared one by one.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {key: np.zeros((len(c), 4)) for key, c in centres.items()}
        for x, y, w in _gathered(batches):
            starts = np.arange(0, len(x), _RUN)
            sizes = np.diff(np.append(starts, len(x)))
            weight = np.add.reduceat(w, starts)
            mx, my = (np.add.reduceat(w * v, starts) / weight for v in (x, y))
            spread = np.add.reduceat(w * ((x - np.repeat(mx, sizes)) ** 2 + (y - np.repeat(my, sizes)) ** 2), starts)
            sides = [(np.minimum.reduceat(v, starts)[:, None], np.maximum.reduceat(v, starts)[:, None]) for v in (x, y)]
            for key, c in centres.items():
                low, high = np.zeros((len(starts), len(c))), np.zeros((len(starts), len(c)))
                for i, (least, most) in enumerate(sides):
                    low += np.maximum(np.maximum(least - c[None, :, i], c[None, :, i] - most), 0.0) ** 2
                    high += np.maximum(c[None, :, i] - least, most - c[None, :, i]) ** 2
                # With a hair to spare, so that ties are left to the points.
                alone = (low <= high.min(axis=1, keepdims=True) * (1 + 1e-9)).sum(axis=1) == 1
                near, own = high[alone].argmin(axis=1), weight[alone]
                cost = spread[alone] + own * ((mx[alone] - c[near, 0]) ** 2 + (my[alone] - c[near, 1]) ** 2)
                for i, v in enumerate((own, own * mx[alone], own * my[alone], cost)):
                    totals[key][:, i] += np.bincount(near, v, len(c))
                left = np.flatnonzero(np.repeat(~alone, sizes))
                step = max(1, _CELLS // max(1, len(c)))
                for at in range(0, len(left), step):
                    part = left[at:at + step]
                    gap = (x[part, None] - c[None, :, 0]) ** 2 + (y[part, None] - c[None, :, 1]) ** 2
                    near = gap.argmin(axis=1)
                    own = w[part]
                    for i, v in enumerate((own, own * x[part], own * y[part], own * gap.min(axis=1))):
                        totals[key][:, i] += np.bincount(near, v, len(c))
        yield pd.DataFrame([(k, start, i, *map(float, row)) for (k, start), t in totals.items() for i, row in enumerate(t)],
                           columns=["k", "start", "centre", "w", "wx", "wy", "cost"])

    return run


def _settled(places: DataFrame, runs: Sequence[Run], seed: int) -> dict[Run, tuple[float, np.ndarray]]:
    """Inertia and centres of every run. Each round is one job over the locations, in which all open runs advance.

    What reaches the driver is one row per run and centre.
    """
    first = _first_centres(places, max(k for k, _ in runs), 1 + max(s for _, s in runs), seed)
    centres = {(k, s): first[s][:k] for k, s in runs}
    open_runs, cost = dict(centres), {}
    for _ in range(MAX_ROUNDS):
        table = places.mapInPandas(_sums(open_runs), "k int, start int, centre int, w double, wx double, wy double, cost double")
        rows = table.groupBy("k", "start", "centre").agg(*[F.sum(c).alias(c) for c in ("w", "wx", "wy", "cost")]).collect()
        moved = {key: c.copy() for key, c in open_runs.items()}
        cost.update({key: 0.0 for key in open_runs})
        for r in rows:
            cost[r.k, r.start] += r.cost
            if r.w > 0:
                moved[r.k, r.start][r.centre] = r.wx / r.w, r.wy / r.w
        still = {key: c for key, c in moved.items() if np.hypot(*(c - open_runs[key]).T).max(initial=0) > TOLERANCE}
        # A settled run keeps the centres that its cost was measured with.
        centres.update(still)
        open_runs = still
        if not open_runs:
            break
    return {key: (cost[key], centres[key]) for key in centres}


def nearest_centre(centres: np.ndarray, x: Column, y: Column) -> Column:
    """Number of the closest centre, the lower of equally close ones."""
    gaps = F.array(*[F.struct(((x - float(cx)) * (x - float(cx)) + (y - float(cy)) * (y - float(cy))).alias("gap"), F.lit(i).alias("i"))
                     for i, (cx, cy) in enumerate(centres)])
    return F.when(x.isNotNull() & y.isNotNull(), F.array_min(gaps)["i"])


def run_kmeans(df: DataFrame, k: int = 8, seed: int = 42, starts: int = 20, lon: str = "longitude",
               lat: str = "latitude") -> KMeansResult:
    """The best of several seeded starts by total squared distance to the centres.

    With fewer than ``k`` locations there are as many centres as locations.
    """
    runs = _settled(_positions(df, lon, lat), [(k, s) for s in range(starts)], seed)
    inertia, best = min(((cost, c) for cost, c in runs.values()), key=lambda r: r[0])
    spark = df.sparkSession
    centres = [(i, float(x), float(y)) for i, (x, y) in enumerate(best)]
    labelled = df.withColumn("kmeans_cluster", nearest_centre(best, F.col(lon), F.col(lat)) if centres else F.lit(None).cast("int"))
    return KMeansResult(labelled, spark.createDataFrame(centres, "cluster_id int, lon double, lat double"),
                        spark.createDataFrame([(k, float(inertia))], "k int, inertia double"))


def elbow(df: DataFrame, k_values: Sequence[int] = tuple(range(2, 15)), seed: int = 42, starts: int = 10,
          lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """``k, inertia`` for a range of cluster numbers, the best of ``starts`` starts each."""
    runs = _settled(_positions(df, lon, lat), [(k, s) for k in k_values for s in range(starts)], seed)
    best = [(k, float(min(runs[k, s][0] for s in range(starts)))) for k in k_values]
    return df.sparkSession.createDataFrame(best, "k int, inertia double").orderBy("k")
