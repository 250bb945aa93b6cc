"""Logistic regression over held-out groups, all fits at once: each Newton step is one job that adds up the fits' gradients and curvatures by partition; only sums, as large as the models, reach the driver.

Missing values take the median of the fit's own training rows and columns are scaled by their mean and population deviation, before a row of the group left out is seen. Medians are the lower
middle value (``percentile_approx``, exact up to ``RANKS`` rows). Classes are balanced by weight, L2 by 1 / c on all weights but the intercept's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.scratch import written

RANKS = 10_000
PARTS = "fit int, sums binary"


@dataclass
class Fits:
    """One model for each group left out."""

    groups: list[int]
    fill: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    constant: np.ndarray


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.column_stack([batch.column(f"x{k}").to_numpy(zero_copy_only=False).astype(float) for k in range(width)]) if width else np.zeros((batch.num_rows, 0))


def _totals(table: DataFrame, fits: int, shape: tuple[int, ...], part: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray], width: int) -> np.ndarray:
    """Sums over all rows of part(x, y, grp, fit), an array of the shape: added up by partition, then by fit, one array at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((fits, *shape))
        seen = False
        for batch in batches:
            x, y, grp = _matrix(batch, width), batch.column("y").to_numpy(), batch.column("grp").to_numpy()
            seen |= batch.num_rows > 0
            for k in range(fits):
                held[k] += part(x, y, grp, k)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(fits), pa.int32()), pa.array([h.tobytes() for h in held], pa.binary())], ["fit", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("fit").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(raw).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h.tobytes() for h in held.values()], pa.binary())], ["fit", "sums"])

    out = np.zeros((fits, *shape))
    for r in table.mapInArrow(run, PARTS).repartition("fit").mapInArrow(add, PARTS).collect():  # a row for each fit
        out[r.fit] = np.frombuffer(bytes(r.sums)).reshape(shape)
    return out


def fitted(rows: DataFrame, names: list[str], group: str = "fold", target: str = "target", c: float = 1.0, steps: int = 25) -> tuple[Fits, DataFrame]:
    """A model for each group, of all rows of other groups, and the table (row_id, grp, y, x0..) they were fitted on. Rows without group or target are left out."""
    width = len(names)
    own = rows.where(F.col(group).isNotNull() & F.col(target).isNotNull()).repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "row_id")
    table = written(own.select("row_id", F.col(group).cast("int").alias("grp"), F.col(target).cast("int").alias("y"), *[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f"x{k}") for k, f in enumerate(names)]), "linear")
    groups = sorted(r.grp for r in table.select("grp").distinct().collect())  # one row for each group
    n, fill = len(groups), np.zeros((len(groups), width))
    if width and not table.where(" or ".join(f"x{k} is null" for k in range(width))).isEmpty():
        folds = F.explode(F.array(*[F.struct(F.lit(k).alias("fit"), F.lit(g).alias("out")) for k, g in enumerate(groups)]))
        by_fit = table.withColumn("f", folds).where("grp != f.out").groupBy("f.fit").agg(*[F.percentile_approx(f"x{k}", 0.5, RANKS).alias(f"m{k}") for k in range(width)])
        for r in by_fit.collect():  # one row for each group
            fill[r.fit] = [0.0 if r[f"m{k}"] is None else r[f"m{k}"] for k in range(width)]

    def filled(x: np.ndarray, k: int) -> np.ndarray:
        return np.where(np.isnan(x), fill[k], x)

    # two rows: sums of the columns with each class's count, and sums of squares about the fit's fill values
    def first(x: np.ndarray, y: np.ndarray, grp: np.ndarray, k: int) -> np.ndarray:
        own = grp != groups[k]
        d = filled(x[own], k) - fill[k]
        out = np.zeros((2, width + 2))
        out[0, :width], out[1, :width] = d.sum(axis=0), (d * d).sum(axis=0)
        out[0, width:] = [(y[own] == 0).sum(), (y[own] == 1).sum()]
        return out

    sums = _totals(table, n, (2, width + 2), first, width)
    count = sums[:, 0, width:]
    total = np.maximum(count.sum(axis=1, keepdims=True), 1)
    mean = sums[:, 0, :width] / total
    std = np.sqrt(np.maximum(sums[:, 1, :width] / total - mean * mean, 0))
    mean, std = mean + fill, np.where(std > 1e-12, std, 1.0)
    live = (count > 0).all(axis=1)
    balance = total / (2 * np.maximum(count, 1))
    w, ridge = np.zeros((n, width + 1)), np.append(np.ones(width), 1e-9) / c

    def step(x: np.ndarray, y: np.ndarray, grp: np.ndarray, k: int) -> np.ndarray:
        own = grp != groups[k]
        if not live[k] or not own.any():
            return np.zeros((width + 2, width + 1))
        a = np.column_stack([(filled(x[own], k) - mean[k]) / std[k], np.ones(own.sum())])
        p = 1 / (1 + np.exp(-np.clip(a @ w[k], -30, 30)))
        weight = balance[k][y[own]]
        return np.vstack([(a.T * (weight * p * (1 - p))) @ a, a.T @ (weight * (p - y[own]))])

    for _ in range(steps):
        sums = _totals(table, n, (width + 2, width + 1), step, width) if live.any() else np.zeros((n, width + 2, width + 1))
        moved = 0.0
        for k in np.flatnonzero(live):
            change = np.linalg.solve(sums[k, :-1] + np.diag(ridge), sums[k, -1] + ridge * w[k])
            w[k] -= change
            moved = max(moved, float(np.abs(change).max()))
        if moved < 1e-8:
            break
    return Fits(groups, fill, mean, std, w, np.where(count[:, 1] > 0, 1.0, np.where(count[:, 0] > 0, 0.0, 0.5)) * ~live), table


def scored(table: DataFrame, fits: Fits) -> DataFrame:
    """(fold, row_id, y, score): each row by the model that left its group out; a model of one class gives that class."""
    width = fits.mean.shape[1]
    place = {g: k for k, g in enumerate(fits.groups)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, k = _matrix(batch, width), np.array([place[g] for g in batch.column("grp").to_pylist()], int)
            a = (np.where(np.isnan(x), fits.fill[k], x) - fits.mean[k]) / fits.std[k]
            m = (a * fits.weights[k, :-1]).sum(axis=1) + fits.weights[k, -1]
            score = np.where(fits.weights[k].any(axis=1), 1 / (1 + np.exp(-np.clip(m, -30, 30))), fits.constant[k])
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("row_id"), batch.column("y"), pa.array(score)], ["fold", "row_id", "y", "score"])

    kind = table.schema["row_id"].dataType.simpleString()
    return table.mapInArrow(run, f"fold int, row_id {kind}, y int, score double")


def held_out(rows: DataFrame, names: list[str], group: str = "fold", target: str = "target", c: float = 1.0) -> DataFrame:
    """Held-out scores of all groups."""
    fits, table = fitted(rows, names, group, target, c)
    return scored(table, fits)
