"""Queries of the distributed trees: held-out folds, attributions, gains, size sweeps, nested tuning. Trees have no SQL of their own; tests hold them against a plain booster and against all subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import features as X
from tidewatch.operators import reports as R
from tidewatch.operators import trees, tuning
from tidewatch.plans.registry import ALL, query
from tidewatch.sources import tables as T

FIT = trees.Fit(rounds=4, depth=3, rate=0.4, least_rows=5, l2=1.0)
BINS = 32


def _matrix(spark, sf_dir):
    return T.features(spark, sf_dir, len(ALL))


@query()
def loso_boosting(spark, sf_dir):
    """Metrics of held-out folds by boosted trees; all folds grow together."""
    scored = tuning.held_out(_matrix(spark, sf_dir), ALL, FIT, bins=BINS)[0]
    return X.metrics(scored.withColumn("p", (F.col("score") >= 0.5).cast("int")), ["grp"]).withColumnRenamed("grp", "fold")


@query()
def tree_attributions(spark, sf_dir):
    """Mean absolute attribution of each feature over held-out rows, and the largest error of the parts' sum against the margin."""
    _, model, table = tuning.held_out(_matrix(spark, sf_dir), ALL, FIT, bins=BINS)
    rows = trees.attributions(table, model)
    gap = F.abs(F.col("margin") - F.col("base") - F.coalesce(F.expr("aggregate(map_values(phi), 0D, (a, v) -> a + v)"), F.lit(0.0)))
    parts = rows.select(gap.alias("gap"), F.explode("phi").alias("feature", "v"))
    n = rows.agg(F.count("*").alias("n"))
    g = parts.groupBy("feature").agg(F.sum(F.abs("v")).alias("v"), F.max("gap").alias("gap"))
    name = F.element_at(F.array(*map(F.lit, model.names)), F.col("feature") + 1)
    return g.crossJoin(F.broadcast(n)).select(name.alias("feature"), (F.col("v") / F.col("n")).alias("mean_abs"), F.round("gap", 9).alias("gap"))


@query()
def gain_importance(spark, sf_dir):
    """Splits and gains of each feature, over all folds' trees."""
    model = tuning.held_out(_matrix(spark, sf_dir), ALL, FIT, bins=BINS)[1]
    return trees.importance(spark, model).groupBy("feature").agg(F.sum("splits").alias("splits"), F.sum("gain").alias("gain"), F.count("*").alias("folds"))


@query()
def size_sweep(spark, sf_dir):
    """Held-out F1 by number of features, in the order of their ANOVA score, and the number that the plateau rule picks."""
    rows = _matrix(spark, sf_dir)
    ranked = [r.feature for r in X.anova(rows, ALL).orderBy(F.desc(F.round("f", 9)), "feature").collect()]  # one row for each feature
    curve = tuning.size_sweep(rows, ALL, ranked, [2, 4, 8, 16, 64], trees.Fit(rounds=3, depth=2, rate=0.3, least_rows=5, l2=1.0), bins=BINS)
    pick = R.plateau(curve, floor=0.0).select(F.col("n_features").alias("picked"))
    return curve.crossJoin(F.broadcast(pick))


@query()
def leafwise_boosting(spark, sf_dir):
    """Metrics of held-out folds by trees that grow leaf by leaf, the target weighted by the ratio of classes in each fold's training rows."""
    fit = trees.Fit(rounds=2, depth=4, rate=0.5, least_rows=5, l2=1.0, leaves=8, positive="ratio")
    scored = tuning.held_out(_matrix(spark, sf_dir), ALL, fit, bins=BINS)[0]
    return X.metrics(scored.withColumn("p", (F.col("score") >= 0.5).cast("int")), ["grp"]).withColumnRenamed("grp", "fold")


@query()
def feature_sets(spark, sf_dir):
    """Pooled held-out metrics of feature sets: all, pruned of correlated ones, and without a family; all sets and folds are fitted together."""
    rows = _matrix(spark, sf_dir)
    gone = R.eliminated(X.correlations(rows, ALL).where("abs(r) > 0.12"), rows.agg(*[F.avg(f).alias(f) for f in ALL]).unpivot([], ALL, "feature", "f"))
    sets = {"all": ALL, "pruned": [f for f in ALL if f not in gone], "no_first_16": ALL[16:]}
    return tuning.feature_sets(rows, ALL, sets, trees.Fit(rounds=3, depth=2, rate=0.3, least_rows=5, l2=1.0), bins=BINS)


SPACE = {"rate": tuning.Space(0.05, 0.5, log=True), "rounds": tuning.Space(1, 3, whole=True), "depth": tuning.Space(1, 3, whole=True), "least_rows": tuning.Space(5, 30, whole=True), "l2": tuning.Space(1e-3, 10.0, log=True), "share": tuning.Space(0.3, 1.0)}


@query()
def nested_tuning(spark, sf_dir):
    """Each outer group's held-out metrics with the parameters its inner folds chose."""
    rows = _matrix(spark, sf_dir).withColumn("outer", F.col("fold") % 7)
    return tuning.nested(rows, ALL, SPACE, trials=6, inner=3, parallel=3, group="outer", bins=BINS)[0].withColumnRenamed("grp", "outer")
