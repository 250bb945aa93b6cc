"""Queries of reports over sessions and over held-out results, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import features as X
from tidewatch.operators import reports as P
from tidewatch.operators import windows as W
from tidewatch.plans.registry import ALL, E, E_ALL, O, A, S, query, r
from tidewatch.sources import tables as T

WIN = f"{S}, w AS (SELECT *, i // 10 AS win FROM s)"


@query(f"WITH {WIN}, g AS (SELECT session_id, win, count(*) AS n, avg(value) AS mean, avg((value < 20)::INT) AS bad FROM w GROUP BY ALL) SELECT 'enough' AS \"check\", count(*) FILTER (NOT n >= 5) = 0 AS ok, count(*) FILTER (NOT n >= 5) AS failed FROM g UNION ALL SELECT 'mean in range', count(*) FILTER (NOT mean BETWEEN 20 AND 300) = 0, count(*) FILTER (NOT mean BETWEEN 20 AND 300) FROM g UNION ALL SELECT 'some valid', count(*) FILTER (NOT bad < 1) = 0, count(*) FILTER (NOT bad < 1) FROM g")
def quality_assertions(spark, sf_dir):
    g = W.tumbling(T.samples(spark, sf_dir), 10).groupBy("session_id", "window").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg((F.col("value") < 20).cast("int")).alias("bad"))
    return P.assertions(g, {"enough": F.col("n") >= 5, "mean in range": F.col("mean").between(20, 300), "some valid": F.col("bad") < 1})


@query(f"WITH {S}, m AS (SELECT session_id, t AS t0, row_number() OVER (PARTITION BY session_id ORDER BY t) AS phase, coalesce(lead(t) OVER (PARTITION BY session_id ORDER BY t), 'inf'::DOUBLE) AS t1 FROM s WHERE code = 0), l AS (SELECT session_id, avg(value) + stddev_pop(value) AS lim FROM s GROUP BY 1) SELECT s.session_id, m.phase, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(100.0::DOUBLE * count(*) FILTER (value > lim) / count(*), 6) AS high_pct FROM s JOIN m ON m.session_id = s.session_id AND t >= t0 AND t < t1 JOIN l ON l.session_id = s.session_id GROUP BY ALL")
def phase_motion(spark, sf_dir):
    """The limit is of the whole session, before its first mark too."""
    s = T.samples(spark, sf_dir)
    marks = X.phases(s.where("code = 0").select("session_id", F.col("t").alias("t0")))
    limit = s.groupBy("session_id").agg((F.avg("value") + F.stddev_pop("value")).alias("_limit"))
    g = X.in_phases(s, marks).join(limit, "session_id").groupBy("session_id", "phase")
    return g.agg(r(F.avg("value"), "mean"), r(F.stddev_pop("value"), "std"), r(P.share(F.col("value") > F.col("_limit")), "high_pct"))


@query(f"WITH {A}, m AS (SELECT session_id, (i // 100)::INT AS phase, sqrt(x*x + y*y + z*z) AS mag FROM a), l AS (SELECT session_id, avg(mag) + 1.5 * stddev_pop(mag) AS lim FROM m GROUP BY 1) SELECT m.session_id, phase, round(avg(mag), 5) AS mean, round(stddev_pop(mag), 5) AS std, round(100.0::DOUBLE * count(*) FILTER (mag > lim) / count(*), 5) AS high_pct FROM m JOIN l ON l.session_id = m.session_id GROUP BY ALL")
def block_motion(spark, sf_dir):
    m = T.axes(spark, sf_dir).select("session_id", F.floor(F.col("i") / 100).cast("int").alias("phase"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("mag"))
    return P.motion_by_phase(m, "mag", k=1.5).select("session_id", "phase", *[r(c, c, 5) for c in ("mean", "std", "high_pct")])


@query(f"WITH {S} SELECT session_id, count(*) FILTER (code = 1) AS samples, round(count(*) FILTER (code = 1) / 700.0::DOUBLE, 9) AS seconds, round(100.0::DOUBLE * count(*) FILTER (value >= 20) / count(*), 6) AS valid_pct, round(100.0::DOUBLE * count(*) FILTER (value > 120) / count(*), 6) AS motion_pct FROM s GROUP BY 1")
def session_coverage(spark, sf_dir):
    """Length of the calibration at 700 labels a second, and how much of a session is valid or in motion."""
    c = F.count_if(F.col("code") == 1)
    return T.samples(spark, sf_dir).groupBy("session_id").agg(c.alias("samples"), F.round(c / 700.0, 9).alias("seconds"), r(P.share(F.col("value") >= 20), "valid_pct"), r(P.share(F.col("value") > 120), "motion_pct"))


@query(f"WITH {E_ALL} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS parameter, round(median({f}), 6) AS median, round(avg({f}), 6) AS mean, round(min({f}), 6) AS min, round(max({f}), 6) AS max, round(stddev_samp({f}), 6) AS std FROM e" for f in ALL) + ")")
def parameter_statistics(spark, sf_dir):
    out = P.transposed(T.features(spark, sf_dir, len(ALL)), ALL)
    return out.select("parameter", *[r(c, c) for c in ("median", "mean", "min", "max", "std")])


SCORED = f"WITH {E}, p AS (SELECT fold, target AS y, round(1 / (1 + exp(-20 * (f0 + 2 * f1 - f2))), 9) AS score FROM e)"


def _sharp(spark, sf_dir):
    e = T.features(spark, sf_dir)
    return e.select("fold", F.col("target").alias("y"), F.round(1 / (1 + F.exp(-20 * (F.col("f0") + 2 * F.col("f1") - F.col("f2")))), 9).alias("score"))


@query(f"{SCORED} SELECT fold, count(*) FILTER (score < 0.001) AS low, count(*) FILTER (score > 0.999) AS high, count(*) FILTER (score BETWEEN 0.001 AND 0.999) AS middle FROM p GROUP BY 1")
def probability_mass(spark, sf_dir):
    return _sharp(spark, sf_dir).groupBy("fold").agg(*[c.alias(k) for k, c in P.mass("score").items()])


CONFIGS = "c AS (SELECT fold, v.variant, target AS y, (f0 * v.k > f1)::INT AS p FROM e, (SELECT unnest(['a', 'b', 'c']) AS variant, unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS k) v), g AS (SELECT variant, fold, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM c GROUP BY ALL), q AS (SELECT variant, fold, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM g)"


def _variants(spark, sf_dir):
    e = T.features(spark, sf_dir)
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(k).alias("k")) for n, k in (("a", 0.5), ("b", 1.0), ("c", 2.0))]))
    rows = e.withColumn("v", grid).select("fold", "v.variant", F.col("target").alias("y"), (F.col("f0") * F.col("v.k") > F.col("f1")).cast("int").alias("p"))
    return X.metrics(rows, ["variant", "fold"])


@query(f"WITH {E}, {CONFIGS} SELECT variant, count(*) AS n_folds, round(avg(f1), 6) AS mean_f1, round(stddev_samp(f1), 6) AS std_f1, round(avg(recall), 6) AS mean_recall, round(min(recall), 6) AS min_recall, count(*) FILTER (recall < 0.5) AS n_below FROM q GROUP BY 1")
def variant_summary(spark, sf_dir):
    return P.variants(_variants(spark, sf_dir)).select("variant", "n_folds", *[r(c, c) for c in ("mean_f1", "std_f1", "mean_recall", "min_recall")], "n_below")


@query(f"WITH {E}, {CONFIGS} SELECT fold, round(max(recall) FILTER (variant = 'a'), 6) AS a, round(max(recall) FILTER (variant = 'b'), 6) AS b, round(max(recall) FILTER (variant = 'c'), 6) AS c FROM q GROUP BY 1")
def recall_matrix(spark, sf_dir):
    wide = P.matrix(_variants(spark, sf_dir), "fold", "variant", "recall", ["a", "b", "c"])
    return wide.select("fold", *[r(v, v) for v in "abc"])


GRID_SQL = ", ".join(f"({w}, {s})" for w in (10, 20) for s in (5, 10, 20) if s <= w)


@query(f"WITH {S}, g(width, step) AS (VALUES {GRID_SQL}), w AS (SELECT width, step, session_id, k AS win, code, value FROM s, g, unnest(range(greatest(0, ceil((i - width + 1) / step::DOUBLE)::BIGINT), i // step + 1)) u(k)), f AS (SELECT width, step, session_id, win, avg(value) AS mean, max((code = 2)::INT) AS y FROM w GROUP BY ALL HAVING count(*) = width) SELECT width, step, count(*) AS n_windows, sum(y)::BIGINT AS n_target, round(avg(mean) FILTER (y = 1) - avg(mean) FILTER (y = 0), 5) AS gap FROM f GROUP BY ALL")
def window_grid(spark, sf_dir):
    """A grid of window widths and steps, each step at most the width: one scan for all configurations."""
    return _grid(T.samples(spark, sf_dir), [(w, s) for w in (10, 20) for s in (5, 10, 20) if s <= w])


def _grid(s, configurations):
    rows = W.configured(s, configurations)
    g = rows.groupBy("width", "step", "session_id", "window").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max((F.col("code") == 2).cast("int")).alias("y")).where("n = width")
    gap = F.avg(F.when(F.col("y") == 1, F.col("mean"))) - F.avg(F.when(F.col("y") == 0, F.col("mean")))
    return g.groupBy("width", "step").agg(F.count("*").alias("n_windows"), F.sum("y").cast("long").alias("n_target"), r(gap, "gap", 5))


THRESHOLDS = [round(0.01 * k, 2) for k in range(1, 5)] + [round(0.05 * k, 2) for k in range(1, 20)] + [0.99]


@query(f"{SCORED}, q AS (SELECT threshold, y, (score >= threshold)::INT AS p FROM p, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS threshold)), g AS (SELECT threshold, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM q GROUP BY 1) SELECT threshold, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, row_number() OVER (ORDER BY threshold) AS place FROM g")
def precision_recall_curve(spark, sf_dir):
    """The extended grid of thresholds over pooled scores."""
    m = X.threshold_sweep(_sharp(spark, sf_dir), THRESHOLDS)
    return m.select("threshold", r("precision", "precision"), r("recall", "recall"), F.row_number().over(Window.orderBy("threshold")).cast("long").alias("place"))


@query(f"WITH {E_ALL}, l AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 9) AS s, round(stddev_pop({f}), 9) AS v FROM e" for f in ALL) + "), k AS (SELECT *, rank() OVER (ORDER BY s DESC) AS rank_a, rank() OVER (ORDER BY v DESC) AS rank_b FROM l) SELECT feature, rank_a, rank_b, rank_a - rank_b AS rank_diff, rank() OVER (ORDER BY (rank_a + rank_b) / 2.0) AS combined FROM k")
def rank_merge(spark, sf_dir):
    """Two rankings of features and their combination by mean rank; ties share the best rank."""
    e = T.features(spark, sf_dir, len(ALL))
    a = e.agg(*[F.round(F.avg(f), 9).alias(f) for f in ALL]).unpivot([], ALL, "feature", "s")
    b = e.agg(*[F.round(F.stddev_pop(f), 9).alias(f) for f in ALL]).unpivot([], ALL, "feature", "v")
    rank = lambda c: F.rank().over(Window.orderBy(c)).cast("long")  # noqa: E731  over features, not rows
    k = a.join(b, "feature", "full").withColumns({"rank_a": rank(F.desc("s")), "rank_b": rank(F.desc("v"))})
    return k.select("feature", "rank_a", "rank_b", (F.col("rank_a") - F.col("rank_b")).alias("rank_diff"), rank((F.col("rank_a") + F.col("rank_b")) / 2).alias("combined"))


@query(f"WITH {E}, g AS (SELECT fold, avg(f0) * 1000 AS a, stddev_pop(f1) * 1000 AS b FROM e GROUP BY 1) SELECT floor(median(a))::BIGINT AS a, floor(median(b))::BIGINT AS b FROM g")
def median_parameters(spark, sf_dir):
    """Medians over folds of tuned parameters, cut to whole numbers."""
    g = T.features(spark, sf_dir).groupBy("fold").agg((F.avg("f0") * 1000).alias("a"), (F.stddev_pop("f1") * 1000).alias("b"))
    return g.agg(F.floor(F.median("a")).alias("a"), F.floor(F.median("b")).alias("b"))


@query(f"WITH {S}, d AS (SELECT *, abs(value - coalesce(lag(value) {O}, value)) AS step FROM s), q AS (SELECT session_id, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (value < 20) / count(*), 6) AS off_pct, round(100.0::DOUBLE * count(*) FILTER (step > 100) / count(*), 6) AS dropout_pct, round(median(value), 6) AS median_raw, round(median(step), 6) AS median_step, round(quantile_cont(step, 0.95) FILTER (code = 1), 6) AS p95_calm, round(quantile_cont(step, 0.95) FILTER (code = 2), 6) AS p95_target, round(100.0::DOUBLE * count(*) FILTER (step > 100 AND code = 2) / greatest(1, count(*) FILTER (code = 2)), 6) AS flagged_target_pct FROM d GROUP BY 1) SELECT * FROM q")
def artifact_report(spark, sf_dir):
    d = T.samples(spark, sf_dir).withColumn("step", F.abs(W.difference()))
    of = lambda k: F.when(F.col("code") == k, F.col("step"))
    return d.groupBy("session_id").agg(
        F.count("*").alias("n"), r(P.share(F.col("value") < 20), "off_pct"), r(P.share(F.col("step") > 100), "dropout_pct"), r(F.median("value"), "median_raw"), r(F.median("step"), "median_step"),
        r(F.percentile(of(1), F.lit(0.95)), "p95_calm"), r(F.percentile(of(2), F.lit(0.95)), "p95_target"), r(P.share(F.col("step") > 100, F.col("code") == 2), "flagged_target_pct"),
    )


@query(f"WITH {S}, m AS (SELECT session_id, median(value) AS m FROM s GROUP BY 1), d AS (SELECT session_id, median(abs(value - m)) AS d FROM s JOIN m USING (session_id) GROUP BY 1), f AS (SELECT s.session_id, i, value, (value < 0 OR value > 200) AS insane, abs(value - m) > 4 * d AS far FROM s JOIN m USING (session_id) JOIN d USING (session_id)), g AS (SELECT session_id, avg(far::INT) AS share FROM f GROUP BY 1) SELECT f.session_id, i, insane OR (far AND share < 0.05) AS bad FROM f JOIN g ON g.session_id = f.session_id")
def outlier_mask(spark, sf_dir):
    return W.outliers(T.samples(spark, sf_dir), "value", 0, 200, k=4).select("session_id", "i", "bad")


@query(f"WITH {S}, n AS (SELECT *, lag(value) {O} AS b, lead(value) {O} AS f FROM s) SELECT session_id, i, round(value, 6) AS value FROM n WHERE value > b AND value >= f AND value > 80")
def local_maxima(spark, sf_dir):
    return W.maxima(T.samples(spark, sf_dir), "value", 80).select("session_id", "i", r("value", "value"))


@query(f"WITH {S}, d AS (SELECT session_id, value - lag(value) {O} AS d FROM s) SELECT session_id, count(d) AS n, round(stddev_samp(d) / sqrt(2), 6) AS sd1, round(sqrt(avg(d * d)), 6) AS rmssd FROM d GROUP BY 1 HAVING count(d) >= 2")
def poincare(spark, sf_dir):
    d = T.samples(spark, sf_dir).withColumn("d", F.col("value") - F.lag("value").over(W.order()))
    return d.groupBy("session_id").agg(F.count("d").alias("n"), r(F.stddev_samp("d") / F.sqrt(F.lit(2.0)), "sd1"), r(F.sqrt(F.avg(F.col("d") * F.col("d"))), "rmssd")).where("n >= 2")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM events GROUP BY 1")
def described_groups(spark, sf_dir):
    q = lambda p, n: r(F.percentile("value", F.lit(p)), n)
    return T.scan(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), r(F.avg("value"), "mean"), r(F.stddev_samp("value"), "std"), r(F.min("value"), "min"), q(0.25, "q25"), q(0.5, "q50"), q(0.75, "q75"), r(F.max("value"), "max"))
