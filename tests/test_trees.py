"""Distributed trees against a plain booster, attributions against all subsets, and tuning."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from tidewatch.operators import trees as T

NAMES = list("abcd")


def data(n=160, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 4)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    x[r.random((n, 4)) < 0.1] = np.nan
    return x, y, np.arange(n) % 5


def frame(spark, x, y, g, parts=3):
    rows = [(i, int(g[i]), int(y[i]), *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "row_id long, fold int, target int, a double, b double, c double, d double").repartition(parts)


def plain(b, y, fit: T.Fit):
    """The same trees, a node at a time, every split tried on the rows themselves."""
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    w, margin, out = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0)), np.zeros(len(y)), []
    for _ in range(fit.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def grow(rows, depth, g=g, h=h):
            best = None
            score = lambda s: g[s].sum() ** 2 / (h[s].sum() + fit.l2) if len(s) else 0.0
            if depth < fit.depth:
                for f in range(b.shape[1]) if fit.features is None else fit.features:
                    v = b[rows, f]
                    for cut in np.unique(v[v > 0]):
                        for ml in (False, True) if (v == 0).any() else (False,):
                            left = np.where(v == 0, ml, v <= cut)
                            a, c = rows[left], rows[~left]
                            if min(len(a), len(c)) >= max(fit.least_rows, 1):
                                gain = round(score(a) + score(c) - score(rows), 8)
                                if gain > 1e-9 and (best is None or (gain, -f, -cut, ml) > best[0]):
                                    best = (gain, -f, -cut, ml), a, c
            if best is None:
                return ("leaf", -fit.rate * g[rows].sum() / (h[rows].sum() + fit.l2), rows)
            return ("node", -best[0][1], -best[0][2], best[0][3], grow(best[1], depth + 1), grow(best[2], depth + 1))

        tree = grow(np.arange(len(y)), 0)

        def apply(t):
            if t[0] == "leaf":
                margin[t[2]] += t[1]
            else:
                apply(t[4])
                apply(t[5])

        apply(tree)
        out.append(tree)
    return out, margin


def same(t: T.Tree, node: int, want) -> None:
    if want[0] == "leaf":
        assert t.feature[node] < 0 and t.value[node] == pytest.approx(want[1], abs=1e-9)
    else:
        assert (t.feature[node], t.bin[node], t.missing_left[node]) == (want[1], want[2], want[3])
        same(t, t.left[node], want[4])
        same(t, t.right[node], want[5])


def test_trees_are_those_of_a_plain_booster(spark, monkeypatch):
    monkeypatch.setattr(T, "KEEP", 2)
    x, y, g = data()
    fits = [T.Fit(frozenset({k}), None, 3, 3, 0.3, 5, 0.5) for k in range(2)] + [T.Fit(rounds=2, depth=2, rate=0.1, least_rows=10), T.Fit(frozenset({1, 3}), (0, 2), 1, 2, 0.5, 1, 0.1)]
    model, table = T.fitted(frame(spark, x, y, g), NAMES, fits, bins=16)
    b = np.zeros(x.shape, int)
    for k, c in enumerate(model.cuts):
        b[:, k] = np.where(np.isnan(x[:, k]), 0, np.searchsorted(c, x[:, k], "left") + 1)
    scored = {(r.fit, r.row_id): r.margin for r in T.scores(table, model, [frozenset()] * 4).collect()}
    for k, fit in enumerate(fits):
        own = np.flatnonzero(~np.isin(g, list(fit.out)))
        want, margin = plain(b[own], y[own], fit)
        assert len(model.trees[k]) == fit.rounds
        for t, w in zip(model.trees[k], want, strict=True):
            same(t, 0, w)
        np.testing.assert_allclose([scored[k, i] for i in own.tolist()], margin, atol=1e-9)
    held = T.scores(table, model).where("fit = 0").collect()
    assert {r.grp for r in held} == {0} and len(held) == (g == 0).sum()
    gains = {(r.fit, r.feature): (r.splits, r.gain) for r in T.importance(spark, model).collect()}
    assert gains[0, "a"][0] == sum(f == 0 for t in model.trees[0] for f in t.feature) and gains[0, "a"][1] > 0


def test_one_class_and_empty(spark):
    x, y, g = data(40)
    model, table = T.fitted(frame(spark, x, np.ones(40, int), g), NAMES, [T.Fit(rounds=2)], bins=8)
    assert model.trees == [[]] and {r.score for r in T.scores(table, model, [frozenset()]).collect()} == {1.0}
    model, table = T.fitted(frame(spark, x, y, g).limit(0), NAMES, [T.Fit(rounds=2)], bins=8)
    assert model.trees == [[]] and T.scores(table, model).isEmpty()


def test_attributions_add_up_and_are_shapley_values(spark):
    x, y, g = data(60, 3)
    model, table = T.fitted(frame(spark, x, y, g), NAMES, [T.Fit(frozenset({0}), None, 4, 3, 0.3, 3, 0.1)], bins=8)
    bins = {r.row_id: list(r.bins) for r in table.collect()}
    margin = {r.row_id: r.margin for r in T.scores(table, model).collect()}
    rows = T.attributions(table, model).collect()
    assert {r.row_id for r in rows} == set(margin)

    def value(t, b, known, node=0):
        f = t.feature[node]
        if f < 0:
            return t.value[node]
        left, right = t.left[node], t.right[node]
        if f in known:
            goes = t.missing_left[node] if b[f] == 0 else b[f] <= t.bin[node]
            return value(t, b, known, left if goes else right)
        return sum(t.cover[c] / t.cover[node] * value(t, b, known, c) for c in (left, right))

    for r in rows:
        assert r.base + sum((r.phi or {}).values()) == pytest.approx(margin[r.row_id], abs=1e-9) and r.margin == pytest.approx(margin[r.row_id], abs=1e-9)
        for f in range(4):
            want = 0.0
            for n in range(4):
                for s in combinations([o for o in range(4) if o != f], n):
                    want += factorial(n) * factorial(3 - n) / factorial(4) * sum(value(t, bins[r.row_id], {*s, f}) - value(t, bins[r.row_id], set(s)) for t in model.trees[0])
            assert (r.phi or {}).get(f, 0.0) == pytest.approx(want, abs=1e-9)


def test_group_folds_are_even_and_whole():
    from tidewatch.operators import tuning as U

    r = np.random.default_rng(2)
    counts = {g: (int(r.integers(5, 40)), int(r.integers(0, 12))) for g in range(40)}
    folds = U.stratified_groups(counts, 5, 1)
    assert set(folds) == set(counts) and set(folds.values()) == set(range(5)) and folds == U.stratified_groups(counts, 5, 1)
    sums = np.array([[sum(counts[g][c] for g in folds if folds[g] == f) for c in (0, 1)] for f in range(5)])
    assert (sums.std(axis=0) / sums.mean(axis=0) < 0.1).all()
    assert U.stratified_groups({}, 3, 1) == {} and U.stratified_groups({7: (1, 0)}, 3, 1) == {7: 0}


def test_sampler_closes_in():
    from tidewatch.operators import tuning as U

    space = {"a": U.Space(1e-3, 10, log=True), "b": U.Space(0, 50, whole=True)}
    goal = lambda p: -((np.log(p["a"]) - np.log(0.1)) ** 2) - ((p["b"] - 30) / 10) ** 2
    ends = []
    for seed in range(10):
        done = []
        for t in range(40):
            p = U.suggest(space, done, np.random.default_rng([seed, t]))
            assert 1e-3 <= p["a"] <= 10 and isinstance(p["b"], int) and 0 <= p["b"] <= 50
            done.append((p, goal(p)))
        ends.append(np.mean([s for _, s in done[-10:]]) - np.mean([s for _, s in done[:10]]))
    assert np.mean(ends) > 1 and sum(e > 0 for e in ends) >= 9  # the last trials are far better than the first


def test_nested_tuning_and_sweeps(spark):
    from tidewatch.operators import tuning as U

    x, y, g = data(200, 5)
    rows = frame(spark, x, y, g).drop("c", "d")
    space = {"rate": U.Space(0.1, 0.5, log=True), "rounds": U.Space(1, 3, whole=True), "depth": U.Space(1, 3, whole=True), "least_rows": U.Space(2, 20, whole=True), "l2": U.Space(0.01, 1, log=True)}
    outcome, tried, scored = U.nested(rows, ["a", "b"], space, trials=4, inner=2, parallel=2, bins=8)
    a = sorted(outcome.collect())
    assert [r.grp for r in a] == list(range(5)) and sum(r.tp + r.fp + r.fn + r.tn for r in a) == 200 and scored.count() == 200
    t = tried.collect()
    assert len(t) == 20 and sum(r.chosen for r in t) == 5
    for o in range(5):
        own = [r for r in t if r.grp == o]
        assert max(own, key=lambda r: (r.inner_f1, -r.trial)).chosen and len({r.rate for r in own}) == 4
    again = sorted(U.nested(rows.repartition(7), ["a", "b"], space, trials=4, inner=2, parallel=2, bins=8)[0].collect())
    assert [(r.grp, r.tp, r.fp, r.rate) for r in again] == [(r.grp, r.tp, r.fp, r.rate) for r in a]
    shares = {r.param: r.importance for r in U.parameter_importance(tried, space).collect()}
    assert set(shares) == set(space) and sum(shares.values()) == pytest.approx(1) and min(shares.values()) >= 0
    curve = {r.n_features: r for r in U.size_sweep(rows, ["a", "b"], ["a", "b"], [1, 2], T.Fit(rounds=4, depth=2, rate=0.5, least_rows=2, l2=0.1), bins=8).collect()}
    assert curve[2].f1 > curve[1].f1 + 0.1  # the class needs both


def test_plateau_rule(spark):
    from tidewatch.operators import reports as R

    curve = spark.createDataFrame([(2, 0.8, 0.6), (4, 0.898, 0.2), (8, 0.897, 0.7), (16, 0.9, 0.4)], "n_features int, f1 double, min_recall double")
    assert R.plateau(curve).first().n_features == 8  # 4 is near the best too, but its worst fold is under the floor
    assert R.plateau(curve, floor=0.9).first().n_features == 16 and R.plateau(curve, slack=0.2, floor=0.0).first().n_features == 2


def test_leaf_by_leaf(spark):
    """A tree cut to its leaves is the one that splits the leaf of greatest gain each time."""
    x, y, g = data(200, 7)
    fits = [T.Fit(rounds=1, depth=6, rate=1.0, least_rows=3, l2=0.1, leaves=n) for n in (1, 2, 5, 9)] + [T.Fit(rounds=1, depth=6, rate=1.0, least_rows=3, l2=0.1)]
    model, _ = T.fitted(frame(spark, x, y, g), NAMES, fits, bins=16)
    full = model.trees[4][0]
    for fit, (t,) in zip(fits[:4], model.trees, strict=False):
        splits, open_ = [], [0]
        while len(open_) < fit.leaves:
            node = max((n for n in open_ if full.feature[n] >= 0), key=lambda n: full.gain[n])
            splits.append(node)
            open_ = [n for n in open_ if n != node] + [full.left[node], full.right[node]]
        reached, todo = [], [0]
        while todo:
            n = todo.pop()
            if t.feature[n] >= 0:
                reached.append(n)
                todo += [t.left[n], t.right[n]]
        assert sorted(reached) == sorted(splits) and t.value == full.value


def test_target_weights(spark):
    x, y, g = data(100, 8)
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    rows = frame(spark, x, y, g)
    model, _ = T.fitted(rows, NAMES, [T.Fit(rounds=0), T.Fit(rounds=0, positive="ratio"), T.Fit(rounds=0, positive=3.0)], bins=8)
    assert model.weights == [(100 / (2 * n0), 100 / (2 * n1)), (1.0, n0 / n1), (1.0, 3.0)]


def test_feature_sets(spark):
    from tidewatch.operators import tuning as U

    x, y, g = data(200, 5)
    fit = T.Fit(rounds=4, depth=2, rate=0.5, least_rows=2, l2=0.1)
    got = {r.variant: r for r in U.feature_sets(frame(spark, x, y, g), NAMES, {"both": ["a", "b"], "one": ["b"], "noise": ["c", "d"]}, fit, bins=8).collect()}
    assert {v.n_features for v in got.values()} == {1, 2} and all(r.tp + r.fp + r.fn + r.tn == 200 for r in got.values())
    assert got["both"].f1 > max(got["one"].f1, got["noise"].f1) + 0.1
