"""Boosted trees by distributed histograms: many fits over one table at once, level by level.

A fit (``Fit``) trains on all rows but those of the groups it leaves out, so held-out folds, inner folds, parameter trials and feature subsets are all fits
over one table of binned rows, and no row is copied for them. A level of all trees is one job: each partition adds the gradients of its rows up by
(fit, node, feature, bin), these cells are summed by Spark, and running sums over bins give each node's best split. Only splits reach the driver, one for each node: a model's own size. Margins
are added up from the trees so far, from a written table every ``KEEP`` rounds.

Missing values have a bin of their own and go left or right as each split learns. Rows count by balanced class weights, n / (2 n_class) of the fit's rows, unless the fit gives the target's; a fit whose rows have one class has no trees
and a margin of infinity. Ties of splits go to the smaller feature number and bin, so that a result does not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.scratch import written

#: Rounds after which margins are written.
KEEP = 20
CELLS = "fit int, node int, feature int, bin int, g double, h double, n long"


@dataclass(frozen=True)
class Fit:
    """A model to fit: groups left out, features used (all by default) and its parameters."""

    out: frozenset = frozenset()
    features: tuple[int, ...] | None = None
    rounds: int = 300
    depth: int = 4
    rate: float = 0.05
    least_rows: int = 20
    l2: float = 0.0
    #: Leaves of a tree at most: the splits of greatest gain, each when its node is a leaf, as trees that grow leaf by leaf have them.
    leaves: int | None = None
    #: Weight of target rows against others; by default both classes weigh the same in the fit's rows, "ratio" is their ratio there.
    positive: float | str | None = None


@dataclass
class Tree:
    """Nodes as columns: feature (-1 at a leaf), the last bin that goes left, where missing values go, children, leaf value, rows' weight and gain."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, v in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, value), (self.cover, cover), (self.gain, 0.0)):
            column.append(v)
        return len(self.feature) - 1

    def cut_to(self, leaves: int) -> None:
        """Keep the splits that growing leaf by leaf would make first: of all leaves that can split, the one of greatest gain, until there are as many leaves. A node's gain depends on its own rows alone, so growing level by level and cutting gives that very tree."""
        open_, kept = [0], 1
        while kept < leaves and (able := [n for n in open_ if self.feature[n] >= 0]):
            node = max(able, key=lambda n: (self.gain[n], -n))
            open_.remove(node)
            open_ += [self.left[node], self.right[node]]
            kept += 1
        for n in open_:
            self.feature[n] = -1

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins is in."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, missing, left, right = (np.array(c) for c in (self.feature, self.bin, self.missing_left, self.left, self.right))
        while len(inner := np.flatnonzero(feature[at] >= 0)):
            node = at[inner]
            b = bins[inner, feature[node]]
            at[inner] = np.where(np.where(b == 0, missing[node], b <= cut[node]), left[node], right[node])
        return at


@dataclass
class Model:
    """The fitted trees of each fit, its class weights, and what is needed to bin new rows."""

    names: list[str]
    cuts: list[list[float]]
    fits: list[Fit]
    trees: list[list[Tree]]
    weights: list[tuple[float, float] | None]
    constant: list[float]


def cut_points(rows: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """Distinct quantiles of each feature over all rows: at most bins - 1 a feature."""
    shares = [k / bins for k in range(1, bins)]
    known = [F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in names]
    got = rows.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"q{k}") for k, x in enumerate(known)]).first()
    return [sorted(set(q or [])) for q in got]


def binned(rows: DataFrame, names: list[str], cuts: list[list[float]], group: str, target: str) -> DataFrame:
    """(row_id, grp, y, bins): a byte a feature, 0 for missing, k + 1 for values over k cuts."""
    edges = [np.array(c) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(names)), np.uint8)
            for k in range(len(names)):
                x = batch.column(3 + k).to_numpy(zero_copy_only=False).astype(float)
                out[:, k] = np.where(np.isnan(x), 0, np.searchsorted(edges[k], x, "left") + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in out], pa.binary())], ["row_id", "grp", "y", "bins"])

    own = rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "row_id")  # small files would be one task in every job to come
    own = own.select(F.col("row_id").cast("long").alias("row_id"), F.col(group).cast("long").alias("grp"), F.col(target).cast("int").alias("y"), *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(names)])
    return own.mapInArrow(run, "row_id long, grp long, y int, bins binary")


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _weights(table: DataFrame, fits: list[Fit]) -> tuple[list[tuple[float, float] | None], list[float]]:
    """Class weights of each fit, and the margin of one that has a single class. One row for each group that a fit leaves out."""
    named = sorted({g for f in fits for g in f.out})
    total = {r.y: r.n for r in table.groupBy("y").agg(F.count("*").alias("n")).collect()}
    by = {(r.grp, r.y): r.n for r in table.where(F.col("grp").isin(named)).groupBy("grp", "y").agg(F.count("*").alias("n")).collect()} if named else {}
    weights: list[tuple[float, float] | None] = []
    constant = []
    for f in fits:
        n0, n1 = (total.get(c, 0) - sum(by.get((g, c), 0) for g in f.out) for c in (0, 1))
        balanced = f.positive is None
        ratio = 1.0 if balanced or not n1 else n0 / n1 if f.positive == "ratio" else float(f.positive)
        weights.append((((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)) if balanced else (1.0, ratio)) if n0 and n1 else None)
        constant.append(0.0 if (n0 > 0) == (n1 > 0) else np.inf if n1 else -np.inf)
    return weights, constant


def _trained(batch: pa.RecordBatch, fit: Fit) -> np.ndarray:
    grp = batch.column("grp").to_numpy(zero_copy_only=False)
    return np.flatnonzero(~np.isin(grp, list(fit.out))) if fit.out else np.arange(batch.num_rows)


def _margins(batch: pa.RecordBatch, bins: np.ndarray, k: int, trees: list[Tree]) -> np.ndarray:
    held = np.array(batch.column("margins").to_pylist(), float).reshape(batch.num_rows, -1)[:, k] if "margins" in batch.schema.names else np.zeros(batch.num_rows)
    for t in trees:
        held = held + np.array(t.value)[t.nodes_of(bins)]
    return held


def _cells(table: DataFrame, model: Model, since: int, growing: dict[int, tuple[Tree, list[int]]], most: int) -> DataFrame:
    """Sums of gradients by (fit, node, feature, bin) over the rows of each fit's growing tree, at the nodes of its last level."""
    width, fits, weights = len(model.names), model.fits, model.weights
    trees = {k: model.trees[k][since:] for k in growing}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            bins, y = _bytes(batch.column("bins"), width), batch.column("y").to_numpy()
            for k, (tree, level) in growing.items():
                own = _trained(batch, fits[k])
                if not len(own):
                    continue
                p = 1 / (1 + np.exp(-np.clip(_margins(batch, bins, k, trees[k])[own], -500, 500)))
                w = np.where(y[own] == 1, weights[k][1], weights[k][0])
                place = np.full(len(tree.feature), -1)
                place[level] = np.arange(len(level))
                node = place[tree.nodes_of(bins[own])]
                here = node >= 0
                cols = np.arange(width) if fits[k].features is None else np.array(fits[k].features)
                at = ((node[here][:, None] * width + cols) * most + bins[own][here][:, cols]).ravel()
                if k not in sums:
                    sums[k] = np.zeros((3, len(level) * width * most))
                for row, v in enumerate((w * (p - y[own]), w * p * (1 - p), np.ones(len(own)))):
                    sums[k][row] += np.bincount(at, np.repeat(v[here], len(cols)), sums[k].shape[1])
        for k, s in sums.items():
            at = np.flatnonzero(s[2])
            node, feature, b = np.unravel_index(at, (len(growing[k][1]), width, most))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k), pa.int32()), *(pa.array(c.astype(np.int32)) for c in (node, feature, b)), pa.array(s[0][at]), pa.array(s[1][at]), pa.array(s[2][at].astype(np.int64))], ["fit", "node", "feature", "bin", "g", "h", "n"]
            )

    return table.mapInArrow(run, CELLS)


def _splits(cells: DataFrame, fits: list[Fit]) -> DataFrame:
    """Each node's totals and best split. Bins are ordered within (fit, node, feature), missing values are tried on both sides."""
    of_fit = lambda values: F.get(F.array(*map(F.lit, values)), F.col("fit"))  # noqa: E731  a value for each fit
    key = ["fit", "node", "feature"]
    cells = cells.repartition(*key).groupBy(*key, "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    whole = Window.partitionBy(*key)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    real = lambda c: F.when(F.col("bin") > 0, F.col(c)).otherwise(0)
    rows = cells.withColumns({f"{c}l": F.sum(real(c)).over(upto) for c in "ghn"} | {f"{c}t": F.sum(c).over(whole) for c in "ghn"} | {f"{c}m": F.sum(F.when(F.col("bin") == 0, F.col(c)).otherwise(0)).over(whole) for c in "ghn"})
    rows = rows.where("bin > 0").withColumns({"least": of_fit([f.least_rows for f in fits]), "l2": of_fit([float(f.l2) for f in fits])})
    side = F.explode(F.when(F.col("nm") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    rows = rows.withColumn("missing_left", side)
    left = {c: F.col(f"{c}l") + F.when(F.col("missing_left"), F.col(f"{c}m")).otherwise(0) for c in "ghn"}
    right = {c: F.col(f"{c}t") - left[c] for c in "ghn"}
    score = lambda g, h: F.coalesce(F.try_divide(g * g, h + F.col("l2")), F.lit(0.0))
    gain = score(left["g"], left["h"]) + score(right["g"], right["h"]) - score(F.col("gt"), F.col("ht"))
    fine = (left["n"] >= F.col("least")) & (right["n"] >= F.col("least")) & (left["n"] > 0) & (right["n"] > 0)
    rows = rows.withColumns({"gain": F.when(fine & (gain > 1e-9), F.round(gain, 8)), "gl": left["g"], "hl": left["h"]})
    best = F.max_by(F.struct("feature", "bin", "missing_left", "gl", "hl", "gain"), F.struct("gain", -F.col("feature"), -F.col("bin"), F.col("missing_left")))
    return rows.groupBy("fit", "node").agg(F.max_by(F.struct("gt", "ht"), -F.col("feature")).alias("t"), best.alias("s"))


def fitted(rows: DataFrame, names: list[str], fits: list[Fit], group: str = "fold", target: str = "target", bins: int = 255) -> tuple[Model, DataFrame]:
    """The model of all fits, and the binned table. Rows without a target are left out of fits by being absent: filter them first."""
    cuts = cut_points(rows, names, bins)
    table = written(binned(rows, names, cuts, group, target), "binned")
    return boosted(table, names, cuts, fits), table


def boosted(table: DataFrame, names: list[str], cuts: list[list[float]], fits: list[Fit]) -> Model:
    """Trees of all fits over a binned table, a level of all of them a job."""
    weights, constant = _weights(table, fits)
    model = Model(names, cuts, fits, [[] for _ in fits], weights, constant)
    most, since = max((len(c) for c in cuts), default=0) + 2, 0
    for round_ in range(max((f.rounds for f in fits), default=0)):
        growing: dict[int, tuple[Tree, list[int]]] = {}
        for k, f in enumerate(fits):
            if weights[k] and round_ < f.rounds:
                tree = Tree()
                growing[k] = tree, [tree.add(0.0, 0.0)]
        grown = {k: tree for k, (tree, _) in growing.items()}
        for depth in range(max((fits[k].depth for k in growing), default=0)):
            growing = {k: v for k, v in growing.items() if v[1] and depth < fits[k].depth}
            if not growing:
                break
            levels: dict[int, list[int]] = {k: [] for k in growing}
            for r in _splits(_cells(table, model, since, growing, most), fits).collect():  # one row for each open node
                tree, level = growing[r.fit]
                node, f = level[r.node], fits[r.fit]
                value = lambda g, h, f=f: -f.rate * g / (h + f.l2) if h + f.l2 > 0 else 0.0
                tree.cover[node], tree.value[node] = r.t.ht, value(r.t.gt, r.t.ht)
                if r.s.gain is not None:
                    tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = r.s.feature, r.s.bin, r.s.missing_left, r.s.gain
                    tree.left[node] = tree.add(value(r.s.gl, r.s.hl), r.s.hl)
                    tree.right[node] = tree.add(value(r.t.gt - r.s.gl, r.t.ht - r.s.hl), r.t.ht - r.s.hl)
                    levels[r.fit] += [tree.left[node], tree.right[node]]
            growing = {k: (tree, sorted(levels[k])) for k, (tree, _) in growing.items()}
        for k, tree in grown.items():
            if fits[k].leaves is not None:
                tree.cut_to(fits[k].leaves)
            model.trees[k].append(tree)
        if (round_ + 1) % KEEP == 0 and round_ + 1 < max(f.rounds for f in fits):
            table, since = written(_with_margins(table, model, since), "margins"), round_ + 1
    return model


def _with_margins(table: DataFrame, model: Model, since: int) -> DataFrame:
    width = len(model.names)
    trees = [t[since:] for t in model.trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _bytes(batch.column("bins"), width)
            m = np.column_stack([_margins(batch, bins, k, some) for k, some in enumerate(trees)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "grp", "y", "bins")), pa.array(list(m), pa.list_(pa.float64()))], ["row_id", "grp", "y", "bins", "margins"])

    return table.mapInArrow(run, "row_id long, grp long, y int, bins binary, margins array<double>")


def scores(table: DataFrame, model: Model, held: list[frozenset] | None = None) -> DataFrame:
    """(fit, row_id, grp, y, margin, score) of the rows that each fit leaves out, or of those of other groups: ``held`` by fit; an empty set takes all rows."""
    width, trees, constant = len(model.names), model.trees, model.constant
    wanted = held if held is not None else [f.out for f in model.fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, grp = _bytes(batch.column("bins"), width), batch.column("grp").to_numpy(zero_copy_only=False)
            for k, groups in enumerate(wanted):
                own = np.flatnonzero(np.isin(grp, list(groups))) if groups else np.arange(len(grp))
                if not len(own):
                    continue
                m = np.full(len(own), constant[k])
                for t in trees[k]:
                    m = m + np.array(t.value)[t.nodes_of(bins[own])]
                some = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k), pa.int32()), *(some.column(c) for c in ("row_id", "grp", "y")), pa.array(m), pa.array(1 / (1 + np.exp(-np.clip(m, -500, 500))))], ["fit", "row_id", "grp", "y", "margin", "score"])

    return table.select("row_id", "grp", "y", "bins").mapInArrow(run, "fit int, row_id long, grp long, y int, margin double, score double")


def importance(spark, model: Model) -> DataFrame:
    """(fit, feature, splits, gain): how often each feature splits in each fit, and what it gains in all. Features that never split have no row."""
    rows = [(k, model.names[f], float(g)) for k, trees in enumerate(model.trees) for t in trees for f, g in zip(t.feature, t.gain, strict=True) if f >= 0]
    return spark.createDataFrame(rows, "fit int, feature string, g double").groupBy("fit", "feature").agg(F.count("*").alias("splits"), F.sum("g").alias("gain"))


PATH = "fit int, path long, value double, parts array<struct<feature: int, low: int, high: int, missing: boolean, share: double>>"


def paths(spark, model: Model) -> DataFrame:
    """(fit, path, value, parts): each leaf's way from its root as a row, one part for each feature on it: the bins that go this way, whether missing values do, and the share of the rows' weight that does."""
    rows, n = [], 0
    for k, trees in enumerate(model.trees):
        for t in trees:
            todo: list[tuple[int, dict]] = [(0, {})]
            while todo:
                node, parts = todo.pop()
                f = t.feature[node]
                if f < 0:
                    rows.append((k, n, float(t.value[node]), [(g, *p) for g, p in sorted(parts.items())]))
                    n += 1
                    continue
                low, high, missing, share = parts.get(f, (1, 255, True, 1.0))
                for child, a, b, m in ((t.left[node], low, min(high, t.bin[node]), t.missing_left[node]), (t.right[node], max(low, t.bin[node] + 1), high, not t.missing_left[node])):
                    part = t.cover[child] / t.cover[node] if t.cover[node] > 0 else 0.0
                    todo.append((child, parts | {f: (a, b, missing and m, share * part)}))
    return spark.createDataFrame(rows, PATH)


def attributions(table: DataFrame, model: Model, held: list[frozenset] | None = None) -> DataFrame:
    """(fit, row_id, base, margin, phi): each feature's additive part of a row's margin (Shapley values of the trees, absent features weighted by cover), by number of the feature.

    For a leaf with parts of share r, of which a row meets some (z is 1 or 0), feature i gets value (z_i - r_i) times the sum over sizes s of the elementary
    sums e_s of the other parts, where a part counts z if in the subset and r if not, weighted s! (m - s - 1)! / m!. Rows meet the paths of their fit; all of it is SQL, sums per feature.
    """
    spark = table.sparkSession
    ways = paths(spark, model)
    wanted = held if held is not None else [f.out for f in model.fits]
    own = F.array(*[F.when(F.col("grp").isin(list(g)) if g else F.lit(True), F.lit(k)) for k, g in enumerate(wanted)])
    rows = table.select("row_id", "grp", "bins", F.explode(F.array_compact(own)).alias("fit"))
    met = "transform(parts, p -> named_struct('f', p.feature, 'r', p.share, 'z', if(b[p.feature] = 0, if(p.missing, 1D, 0D), if(b[p.feature] between p.low and p.high, 1D, 0D))))"
    # bins as an array of numbers once per row and not once per path
    rows = rows.withColumn("b", F.expr(f"transform(sequence(1, {len(model.names)}), k -> cast(conv(hex(substring(bins, k, 1)), 16, 10) as int))")).select("row_id", "fit", "b")
    rows = rows.join(F.broadcast(ways), "fit").select("row_id", "fit", "value", F.expr(met).alias("q"))  # paths: as many as the model has leaves
    sums = "aggregate(filter(q, (o, j) -> j != k), array(1D), (c, o) -> zip_with(transform(concat(c, array(0D)), x -> x * o.r), concat(array(0D), c), (x, y) -> x + y * o.z))"
    weight = "factorial(s) * factorial(size(q) - s - 1) / double(factorial(size(q)))"
    each = f"transform(q, (e, k) -> struct(e.f as f, value * (e.z - e.r) * aggregate({sums}, named_struct('t', 0D, 's', 0), (a, x) -> named_struct('t', a.t + x * {weight.replace('(s)', '(a.s)').replace('- s -', '- a.s -')}, 's', a.s + 1), a -> a.t) as v))"
    base = "value * aggregate(q, 1D, (a, e) -> a * e.r)"
    leaf = "value * aggregate(q, 1D, (a, e) -> a * e.z)"
    parts = rows.select("row_id", "fit", F.expr(base).alias("base"), F.expr(leaf).alias("leaf"), F.expr(each).alias("each"))
    whole = parts.groupBy("fit", "row_id").agg(F.sum("base").alias("base"), F.sum("leaf").alias("margin"))
    phi = parts.select("fit", "row_id", F.explode("each").alias("e")).groupBy("fit", "row_id", F.col("e.f").alias("feature")).agg(F.sum("e.v").alias("v"))
    phi = phi.groupBy("fit", "row_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "v"))).alias("phi"))
    return whole.join(phi, ["fit", "row_id"], "left")
