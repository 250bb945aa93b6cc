"""Selection of features and parameters by held-out folds: size sweeps, stratified group folds, a Parzen-estimator sampler, nested tuning.

Every fit is a ``trees.Fit`` over one binned table: all sizes and folds of a sweep, and all (outer fold, trial, inner fold) fits of a generation of trials, grow together, a level of all of them a job.
What the driver keeps is counts by group, trials and splits, never rows. The same seed gives the same trials, folds and trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import features as X
from tidewatch.operators import trees as T
from tidewatch.sources.scratch import written


def group_counts(table: DataFrame) -> dict[Any, tuple[int, int]]:
    """Rows of each class by group; as many entries as there are groups."""
    rows = table.groupBy("grp").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).collect()
    return {r.grp: (r.n0, r.n1) for r in sorted(rows)}


def stratified_groups(counts: dict[Any, tuple[int, int]], k: int, seed: int) -> dict[Any, int]:
    """A fold for each group, whole groups in one fold: groups in seeded order, the most uneven first, each to the fold that leaves the folds' shares of both classes most even (the smaller fold on ties, then the first)."""
    total = np.maximum(np.sum(list(counts.values()), axis=0), 1) if counts else np.ones(2)
    groups = sorted(counts)
    np.random.default_rng(seed).shuffle(groups)
    groups.sort(key=lambda g: -float(np.std(counts[g])))
    held, out = np.zeros((k, 2)), {}
    for g in groups:
        best = None
        for f in range(k):
            held[f] += counts[g]
            spread = float((held / total).std(axis=0).mean())
            held[f] -= counts[g]
            if best is None or (round(spread, 12), held[f].sum(), f) < best:
                best = round(spread, 12), held[f].sum(), f
        held[best[2]] += counts[g]
        out[g] = best[2]
    return out


@dataclass(frozen=True)
class Space:
    """A parameter's range: whole numbers or not, by logarithm or not."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def inner(self, v: float) -> float:
        return math.log(v) if self.log else v

    def outer(self, u: float) -> float:
        v = math.exp(u) if self.log else u
        return int(min(max(round(v), self.low), self.high)) if self.whole else min(max(v, self.low), self.high)


#: The search space of the boosted trees.
SPACE = {
    "rate": Space(0.005, 0.5, log=True), "rounds": Space(100, 1000, whole=True), "depth": Space(2, 12, whole=True), "least_rows": Space(5, 100, whole=True), "l2": Space(1e-6, 10.0, log=True), "share": Space(0.3, 1.0),
}


def suggest(space: dict[str, Space], done: list[tuple[dict, float]], rng: np.random.Generator, startup: int = 5, candidates: int = 24, share: float = 0.25) -> dict[str, float]:
    """The next trial: at random until ``startup`` are done, then, parameter by parameter, the candidate drawn from a Parzen estimate of the best trials at which their density is largest against that of the others."""
    if len(done) < startup:
        return {name: s.outer(rng.uniform(s.inner(s.low), s.inner(s.high))) for name, s in space.items()}
    order = sorted(range(len(done)), key=lambda k: (-done[k][1], k))
    n = max(1, math.ceil(share * math.sqrt(len(done))))
    out = {}
    for name, s in space.items():
        low, high = s.inner(s.low), s.inner(s.high)
        sides = []
        for some in (order[:n], order[n:]):
            at = np.sort([s.inner(done[k][0][name]) for k in some] + [(low + high) / 2])  # the last is the prior's
            ends = np.concatenate([[low], at, [high]])
            sides.append((at, np.clip(np.maximum(ends[1:-1] - ends[:-2], ends[2:] - ends[1:-1]), (high - low) / min(100, 1 + len(at)), high - low)))
        at, width = sides[0]
        pick = rng.integers(len(at), size=candidates)
        u = np.clip(rng.normal(at[pick], width[pick]), low, high)
        density = [np.log(np.mean(np.exp(-0.5 * ((u[:, None] - a) / w) ** 2) / w, axis=1) + 1e-300) for a, w in sides]
        out[name] = s.outer(float(u[np.argmax(density[0] - density[1])]))
    return out


def fit_of(params: dict[str, float], out: frozenset, width: int, rng: np.random.Generator) -> T.Fit:
    """A fit with a trial's parameters; ``share`` of the features, drawn once for the fit."""
    n = max(1, round(params.get("share", 1.0) * width))
    chosen = None if n >= width else tuple(sorted(int(f) for f in rng.choice(width, n, replace=False)))
    return T.Fit(out, chosen, int(params["rounds"]), int(params["depth"]), float(params["rate"]), int(params["least_rows"]), float(params["l2"]))


def judged(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics of each fit's scored rows."""
    return X.metrics(scored.withColumn("p", (F.col("score") >= threshold).cast("int")), ["fit"])


def held_out(rows: DataFrame, names: list[str], fit: T.Fit, group: str = "fold", target: str = "target", bins: int = 255) -> tuple[DataFrame, T.Model, DataFrame]:
    """(grp, row_id, y, score) of each group by a model of the others, the model of all folds, and its binned table."""
    cuts = T.cut_points(rows, names, bins)
    table = written(T.binned(rows, names, cuts, group, target), "binned")
    model = T.boosted(table, names, cuts, [replace(fit, out=frozenset({g})) for g in group_counts(table)])
    return T.scores(table, model).select("grp", "row_id", "y", "margin", "score"), model, table


def size_sweep(rows: DataFrame, names: list[str], ranked: list[str], sizes: list[int], fit: T.Fit, group: str = "fold", target: str = "target", bins: int = 255) -> DataFrame:
    """(n_features, f1, std_f1, recall, min_recall, n_below): held-out results by the first n features of a ranking, all sizes and folds fitted together; groups without a target row count for F1 alone."""
    cuts = T.cut_points(rows, names, bins)
    table = written(T.binned(rows, names, cuts, group, target), "binned")
    groups = list(group_counts(table))
    fits = [replace(fit, out=frozenset({g}), features=tuple(sorted(names.index(f) for f in ranked[:n]))) for n in sizes for g in groups]
    found = judged(T.scores(table, T.boosted(table, names, cuts, fits)))
    size_of = F.element_at(F.array(*map(F.lit, sizes)), (F.floor(F.col("fit") / max(len(groups), 1)) + 1).cast("int"))
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("recall"))
    return found.groupBy(size_of.alias("n_features")).agg(F.avg("f1").alias("f1"), F.stddev_samp("f1").alias("std_f1"), F.avg(recall).alias("recall"), F.min(recall).alias("min_recall"), F.count_if(recall < 0.5).alias("n_below"))


def feature_sets(rows: DataFrame, names: list[str], sets: dict[str, list[str]], fit: T.Fit, group: str = "fold", target: str = "target", bins: int = 255) -> DataFrame:
    """(variant, n_features, pooled metrics over all held-out rows) of named feature sets; all sets and folds are fitted together."""
    cuts = T.cut_points(rows, names, bins)
    table = written(T.binned(rows, names, cuts, group, target), "binned")
    groups = list(group_counts(table))
    fits = [replace(fit, out=frozenset({g}), features=tuple(names.index(f) for f in some)) for some in sets.values() for g in groups]
    scored = T.scores(table, T.boosted(table, names, cuts, fits))
    at = F.floor(F.col("fit") / max(len(groups), 1)).cast("int")
    of = lambda values: F.get(F.array(*map(F.lit, values)), at)
    scored = scored.select(of(list(sets)).alias("variant"), of([len(v) for v in sets.values()]).alias("n_features"), "y", (F.col("score") >= 0.5).cast("int").alias("p"))
    return X.metrics(scored, ["variant", "n_features"])


def nested(rows: DataFrame, names: list[str], space: dict[str, Space], trials: int, inner: int = 5, parallel: int = 4, seed: int = 42, group: str = "fold", target: str = "target", bins: int = 255, sampler: Callable = suggest) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested held-out tuning: (outcome by outer group, trials, held-out scores).

    For each outer group the trials' mean F1 over stratified inner folds of the other groups chooses parameters; a model of all other groups with them scores the outer one. Trials come in
    generations of ``parallel``, and all fits of a generation, of all outer groups, grow together.
    """
    spark = rows.sparkSession
    cuts = T.cut_points(rows, names, bins)
    table = written(T.binned(rows, names, cuts, group, target), "binned")
    counts = group_counts(table)
    inner_of = {o: stratified_groups({g: c for g, c in counts.items() if g != o}, inner, seed) for o in counts}
    done: dict[Any, list[tuple[dict, float]]] = {o: [] for o in counts}
    for first in range(0, trials, parallel):
        plan, fits, held = [], [], []
        for o in counts:
            for t in range(first, min(first + parallel, trials)):
                params = sampler(space, done[o][:first], np.random.default_rng([seed, int(list(counts).index(o)), t]))
                for f in range(inner):
                    valid = frozenset(g for g, k in inner_of[o].items() if k == f)
                    plan.append((o, t, params, f))
                    fits.append(fit_of(params, valid | {o}, len(names), np.random.default_rng([seed, t])))
                    held.append(valid)
        keep = [k for k, v in enumerate(held) if v]
        model = T.boosted(table, names, cuts, [fits[k] for k in keep])
        f1 = {keep[r.fit]: r.f1 for r in judged(T.scores(table, model, [held[k] for k in keep])).collect()}  # one row for each fit
        for o in counts:
            for t in range(first, min(first + parallel, trials)):
                own = [k for k, p in enumerate(plan) if p[0] == o and p[1] == t]
                done[o].append((plan[own[0]][2], float(np.mean([f1.get(k, 0.0) for k in own if held[k]] or [0.0]))))
    best = {o: max(range(len(some)), key=lambda k: (some[k][1], -k)) for o, some in done.items()}
    finals = [fit_of(done[o][best[o]][0], frozenset({o}), len(names), np.random.default_rng([seed, best[o]])) for o in counts]
    scored = written(T.scores(table, T.boosted(table, names, cuts, finals)), "scores")
    kinds = ", ".join(f"{p} {'long' if s.whole else 'double'}" for p, s in space.items())
    typed = lambda params: [int(params[p]) if s.whole else float(params[p]) for p, s in space.items()]
    tried = spark.createDataFrame([(o, t, *typed(p), score, t == best[o]) for o, some in done.items() for t, (p, score) in enumerate(some)], f"grp long, trial int, {kinds}, inner_f1 double, chosen boolean")
    outcome = judged(scored).join(F.broadcast(spark.createDataFrame([(k, o) for k, o in enumerate(counts)], "fit int, grp long")), "fit").drop("fit").join(tried.where("chosen").drop("chosen"), "grp")
    return outcome, tried, scored.drop("fit")


def parameter_importance(tried: DataFrame, space: dict[str, Space], parts: int = 8) -> DataFrame:
    """(param, importance): the share of the variance of trials' scores that a parameter's equal slices of its range tell alone, over all trials; the shares are scaled to sum to one."""
    slice_of = lambda p, s: F.least(F.lit(parts - 1), F.floor(parts * ((F.ln(p) if s.log else F.col(p)) - s.inner(s.low)) / max(s.inner(s.high) - s.inner(s.low), 1e-12)).cast("int"))
    long = tried.select("inner_f1", F.explode(F.array(*[F.struct(F.lit(p).alias("param"), slice_of(p, s).alias("slice")) for p, s in space.items()])).alias("s")).select("inner_f1", "s.*")
    cells = long.groupBy("param", "slice").agg(F.count("*").alias("n"), F.avg("inner_f1").alias("m"))
    total = cells.groupBy("param").agg((F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n") - F.pow(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 2)).alias("v"))
    every = total.agg(F.sum("v").alias("s"))
    return total.crossJoin(F.broadcast(every)).select("param", F.coalesce(F.try_divide("v", "s"), F.lit(0.0)).alias("importance"))
