"""Every query that the engine registers, and the SQL that states its result.

Sessions are surrogate: users' event values as uniform signals, suppliers' line items as three-axis series,
embeddings as a feature matrix with folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import kernels as K
from tidewatch.operators import features as X
from tidewatch.operators import linear
from tidewatch.operators import models as M
from tidewatch.operators import signals as G
from tidewatch.operators import windows as W
from tidewatch.plans.registry import ALL, E, E_ALL, NAMES, O, ORACLES, QUERIES, A, S, query, r
from tidewatch.sources import tables as T

MODE = "(SELECT code FROM (SELECT code, count(*) AS c FROM {src} q WHERE q.session_id = {o}.session_id AND q.win = {o}.win GROUP BY code) ORDER BY c DESC, code LIMIT 1)"
SKEW = "(avg(value*value*value) - 3*avg(value)*avg(value*value) + 2*avg(value)*avg(value)*avg(value)) / nullif(power(stddev_pop(value), 3), 0)"
WINDOW_SQL = f"""WITH {S}, w AS (SELECT *, i // 10 AS win FROM s),
m AS (SELECT session_id, win, code, row_number() OVER (PARTITION BY session_id, win ORDER BY count(*) DESC, code) AS k FROM w GROUP BY session_id, win, code),
g AS (SELECT session_id, win, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, max(value) - min(value) AS range, median(value) AS median, regr_slope(value, i) AS slope,
 sum(value) - (arg_min(value, i) + arg_max(value, i)) / 2 AS auc, {SKEW} AS skewness, kurtosis_pop(value) AS kurtosis FROM w GROUP BY ALL HAVING count(*) = 10),
f AS (SELECT g.*, m.code AS label FROM g JOIN m ON m.session_id = g.session_id AND m.win = g.win AND m.k = 1 WHERE m.code <> 0),
b AS (SELECT session_id, avg(mean) AS bm, stddev_samp(mean) AS bs FROM f WHERE label = 1 GROUP BY 1)"""
FEATURES = ["mean", "std", "min", "max", "range", "median", "slope", "auc", "skewness", "kurtosis"]
ROUNDED = ", ".join(f"round({c}, 5) AS {c}" for c in FEATURES)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full ten-sample windows with features and majority label, transient windows left out."""
    g = W.tumbling(T.samples(spark, sf_dir), 10).groupBy("session_id", F.col("window").alias("win")).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in X.level().items()], W.majority().alias("label"))
    return g.where("n = 10 and label != 0").drop("n")


@query(f"{WINDOW_SQL} SELECT f.session_id, f.win, {ROUNDED}, label, round(CASE WHEN bm IS NULL THEN NULL WHEN coalesce(bs, 0) = 0 THEN 0 ELSE (mean - bm) / bs END, 5) AS mean_z FROM f LEFT JOIN b USING (session_id)")
def tumbling_features(spark, sf_dir):
    rows = X.baseline(_windows(spark, sf_dir), ["mean"], "label").withColumn("mean_z", X.z_score("mean"))
    return rows.select("session_id", "win", *[r(c, c, 5) for c in FEATURES], "label", r("mean_z", "mean_z", 5))


@query(f"WITH {S}, w AS (SELECT s.*, k AS win FROM s, unnest(range(greatest(0, ceil((i - 19) / 5.0)::BIGINT), i // 5 + 1)) u(k)) SELECT session_id, win, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM w GROUP BY ALL HAVING count(*) = 20")
def sliding_features(spark, sf_dir):
    g = W.sliding(T.samples(spark, sf_dir), 20, 5).groupBy("session_id", F.col("window").alias("win"))
    return g.agg(r(F.avg("value"), "mean"), r(F.stddev_pop("value"), "std"), F.count("*").alias("n")).where("n = 20")


@query(f"WITH {S}, w AS (SELECT s.*, k AS win, k * 5 + 30 AS e FROM s, unnest(range(greatest(0, ceil((i - 29) / 5.0)::BIGINT), i // 5 + 1)) u(k)) SELECT session_id, e AS window_end, round(avg(CASE WHEN i >= e - 10 THEN value END), 6) AS short_mean, round(avg(value), 6) AS long_mean FROM w GROUP BY ALL HAVING count(*) = 30")
def end_anchored_dual(spark, sf_dir):
    g = W.end_anchored(T.samples(spark, sf_dir), 10, 30, 5).groupBy("session_id", F.col("end").alias("window_end"))
    return g.agg(r(F.avg(F.when(F.col("recent"), F.col("value"))), "short_mean"), r(F.avg("value"), "long_mean"), F.count("*").alias("n")).where("n = 30").drop("n")


@query(f"""WITH {S}, w AS (SELECT *, i // 10 AS win FROM s), c AS (SELECT session_id, win, count(*) AS n, max((code = 2)::INT) AS hit FROM w GROUP BY ALL HAVING count(*) = 10),
m AS (SELECT session_id, win, code, row_number() OVER (PARTITION BY session_id, win ORDER BY count(*) DESC, code) AS k FROM w GROUP BY session_id, win, code)
SELECT c.session_id, c.win, m.code AS majority, CASE WHEN hit = 1 THEN 2 ELSE m.code END AS any_target, q.code AS center FROM c JOIN m ON m.session_id = c.session_id AND m.win = c.win AND m.k = 1 JOIN w q ON q.session_id = c.session_id AND q.i = c.win * 10 + 5""")
def window_labels(spark, sf_dir):
    g = W.tumbling(T.samples(spark, sf_dir), 10).groupBy("session_id", F.col("window").alias("win"))
    return g.agg(F.count("*").alias("n"), W.majority().alias("majority"), W.any_target().alias("any_target"), W.center().alias("center")).where("n = 10").drop("n")


@query(f"WITH {S}, w AS (SELECT session_id, i // 3 AS win, bool_and(code = 1) AS ok, count(*) AS n FROM s GROUP BY ALL) SELECT session_id, min(win) AS win FROM w WHERE ok AND n = 3 GROUP BY 1")
def first_homogeneous(spark, sf_dir):
    g = W.tumbling(T.samples(spark, sf_dir), 3).groupBy("session_id", F.col("window").alias("win")).agg(F.bool_and(F.col("code") == 1).alias("ok"), F.count("*").alias("n"))
    return g.where("ok and n = 3").groupBy("session_id").agg(F.min("win").alias("win"))


@query(f"WITH {A} SELECT session_id, i, round(x / 64, 6) AS gx, round(sqrt(x*x + y*y + z*z) / 64, 6) AS mag FROM a")
def scan_project_scale(spark, sf_dir):
    return T.axes(spark, sf_dir).select("session_id", "i", r(F.col("x") / 64, "gx"), r(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) / 64, "mag"))


@query(f"WITH {S}, d AS (SELECT session_id, i, value - avg(value) OVER (PARTITION BY session_id) AS c FROM s) SELECT session_id, i, round(c, 5) AS bipolar, round(greatest(c, 0), 5) AS unipolar FROM d")
def relu_complement(spark, sf_dir):
    d = T.samples(spark, sf_dir).withColumn("c", F.col("value") - F.avg("value").over(W.session()))
    return d.select("session_id", "i", r("c", "bipolar", 5), r(F.greatest("c", F.lit(0.0)), "unipolar", 5))


@query(f"WITH {S} SELECT session_id, i, CASE WHEN code = 2 THEN 'target' ELSE 'other' END AS label, (code = 2)::INT AS y FROM s WHERE code IN (1, 2, 3)")
def label_map_filter(spark, sf_dir):
    rows = T.samples(spark, sf_dir).where(F.col("code").isin(1, 2, 3))
    return rows.select("session_id", "i", F.when(F.col("code") == 2, F.lit("target")).otherwise(F.lit("other")).alias("label"), (F.col("code") == 2).cast("int").alias("y"))


@query(f"WITH {S}, w AS (SELECT session_id, i // 10 AS win, count(*) AS n, avg((value < 20)::INT) AS bad FROM s GROUP BY ALL) SELECT session_id, win, round(bad, 6) AS bad FROM w WHERE n = 10 AND bad <= 0.5")
def validity_gate(spark, sf_dir):
    g = W.tumbling(T.samples(spark, sf_dir), 10).groupBy("session_id", F.col("window").alias("win")).agg(F.count("*").alias("n"), F.avg((F.col("value") < 20).cast("int")).alias("bad"))
    return g.where("n = 10 and bad <= 0.5").select("session_id", "win", r("bad", "bad"))


@query(f"WITH {S}, t AS (SELECT *, row_number() {O} AS k FROM s WHERE code = 2) SELECT session_id, i, round(value, 6) AS value FROM t WHERE k > 3")
def skip_first_targets(spark, sf_dir):
    rows = T.samples(spark, sf_dir).where("code = 2").withColumn("k", F.row_number().over(W.order()))
    return rows.where("k > 3").select("session_id", "i", r("value", "value"))


@query(f"WITH {S} SELECT session_id, i, round(value - coalesce(lag(value) {O}, value), 6) AS d, abs(value - coalesce(lag(value) {O}, value)) > 100 AS dropout FROM s")
def backward_difference(spark, sf_dir):
    return T.samples(spark, sf_dir).withColumn("d", W.difference()).select("session_id", "i", r("d", "d"), (F.abs("d") > 100).alias("dropout"))


@query(f"WITH {S}, n AS (SELECT *, lag(value) {O} AS b, lead(value) {O} AS f FROM s) SELECT session_id, i, round(CASE WHEN b IS NULL THEN f - value WHEN f IS NULL THEN value - b ELSE (f - b) / 2 END, 6) AS g FROM n")
def central_gradient(spark, sf_dir):
    return T.samples(spark, sf_dir).select("session_id", "i", r(W.gradient(), "g"))


RUNS = f"{S}, c AS (SELECT *, CASE WHEN lag({{f}}) {O} IS NULL OR lag({{f}}) {O} <> {{f}} THEN 1 ELSE 0 END AS ch FROM s), q AS (SELECT *, sum(ch) {O} AS run FROM c)"


@query(f"WITH {RUNS.format(f='(value < 60)')} SELECT session_id, run::BIGINT AS run, min(i) AS first, max(i) AS last, count(*) AS n FROM q GROUP BY session_id, run HAVING bool_and(value < 60) AND count(*) >= 2")
def gaps_islands_off(spark, sf_dir):
    return W.long_runs(T.samples(spark, sf_dir), F.col("value") < 60, 2).select("session_id", "run", "first", "last", "n")


@query(f"WITH {RUNS.format(f='code')} SELECT session_id, run::BIGINT AS run, min(code) AS code, min(i) AS first, max(i) AS last, count(*) AS n FROM q GROUP BY session_id, run")
def label_segments(spark, sf_dir):
    return W.runs(T.samples(spark, sf_dir), F.col("code")).select("session_id", "run", F.col("flag").alias("code"), "first", "last", "n")


P = "CASE WHEN value BETWEEN 10 AND 400 THEN value END"


@query(f"WITH {S}, m AS (SELECT *, count({P}) OVER f AS n, quantile_cont({P}, 0.5) OVER f AS med FROM s WINDOW f AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT session_id, i, round(CASE WHEN n >= 2 AND abs(value - med) > 0.2 * med THEN med ELSE value END, 6) AS corrected, coalesce(n >= 2 AND abs(value - med) > 0.2 * med, false) AS ectopic FROM m")
def ectopic_correct(spark, sf_dir):
    return W.ectopic(T.samples(spark, sf_dir), "value", 10, 400, 0.2).select("session_id", "i", r("corrected", "corrected"), "ectopic")


@query(f"WITH {S} SELECT session_id, i, round(CASE WHEN count(value) OVER f >= 3 THEN avg(value) OVER f END, 5) AS m, round(max(value) OVER u, 6) AS top FROM s WINDOW f AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), u AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def rolling_and_running(spark, sf_dir):
    return T.samples(spark, sf_dir).select("session_id", "i", r(W.rolling_mean("value", 5, 4, 3), "m", 5), r(W.running_max("value"), "top"))


@query(f"WITH {S} SELECT session_id, i, round(coalesce(lead(value, 26) {O}, last_value(value) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 6) AS ahead FROM s")
def lead_shift_pad(spark, sf_dir):
    return T.samples(spark, sf_dir).select("session_id", "i", r(W.shift_ahead("value", 26), "ahead"))


@query(f"WITH {S}, k AS (SELECT *, row_number() {O} AS k FROM s WHERE code = 1) SELECT session_id, i FROM k WHERE k <= 5")
def first_k_baseline(spark, sf_dir):
    return T.samples(spark, sf_dir).where("code = 1").withColumn("k", F.row_number().over(W.order())).where("k <= 5").select("session_id", "i")


HEART = f"{S}, v AS (SELECT *, i // 20 AS win, value AS ibi FROM s WHERE value BETWEEN 1 AND 500), d AS (SELECT *, ibi - lag(ibi) OVER (PARTITION BY session_id, win ORDER BY i) AS d FROM v)"


@query(f"WITH {HEART} SELECT session_id, win, count(ibi) AS n_beats, round(avg(ibi), 6) AS mean_rr, round(median(ibi), 6) AS median_rr, round(min(ibi), 6) AS min_rr, round(max(ibi), 6) AS max_rr, round(60000 / nullif(avg(ibi), 0), 6) AS mean_hr, round(stddev_samp(ibi), 6) AS sdnn, round(sqrt(avg(d * d)), 6) AS rmssd, round(stddev_samp(d), 6) AS sdsd, round(100.0::DOUBLE * count(*) FILTER (abs(d) > 50) / (count(d) + 1), 6) AS pnn50 FROM d GROUP BY ALL HAVING count(ibi) >= 2")
def hrv_time(spark, sf_dir):
    rows = W.tumbling(T.samples(spark, sf_dir), 20).where(F.col("value").between(1, 500)).withColumn("ibi", F.col("value"))
    rows = rows.withColumn("d", F.col("ibi") - F.lag("ibi").over(Window.partitionBy("session_id", "window").orderBy("i")))
    return rows.groupBy("session_id", F.col("window").alias("win")).agg(*X.rounded(X.heart())).where("n_beats >= 2")


@query(f"""WITH {A}, m AS (SELECT *, sqrt(x*x + y*y + z*z) AS mag FROM a), j AS (SELECT *, 2 * sqrt(power(x - coalesce(lag(x) {O}, x), 2) + power(y - coalesce(lag(y) {O}, y), 2) + power(z - coalesce(lag(z) {O}, z), 2)) AS jerk, i // 50 AS win FROM m)
SELECT session_id, win, round(stddev_pop(x), 5) AS x_std, round(stddev_pop(y), 5) AS y_std, round(stddev_pop(z), 5) AS z_std, round(avg(mag), 5) AS mag_mean, round(stddev_pop(mag), 5) AS mag_std, round(max(mag), 5) AS mag_max, round(avg(abs(x) + abs(y) + abs(z)), 5) AS sma, round(avg(mag * mag), 5) AS energy,
round(avg(jerk), 5) AS jerk_mean, round(stddev_pop(jerk), 5) AS jerk_std, round(quantile_cont(jerk, 0.95), 5) AS jerk_p95, quantile_cont(jerk, 0.95) > 75 AS corrupted FROM j GROUP BY ALL HAVING count(*) = 50""")
def acc_features(spark, sf_dir):
    rows = W.tumbling(T.axes(spark, sf_dir), 50).withColumn("mag", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).withColumn("jerk", W.jerk(2))
    g = rows.groupBy("session_id", F.col("window").alias("win")).agg(F.count("*").alias("n"), *X.rounded(X.motion(), 5), (F.percentile("jerk", F.lit(0.95)) > 75).alias("corrupted"))
    return g.where("n = 50").drop("n")


@query(f"WITH {S}, p AS (SELECT session_id, i AS at, value FROM s WHERE value > 100), w AS (SELECT DISTINCT session_id, i // 10 AS win FROM s) SELECT w.session_id, w.win, count(p.at) AS peaks, round(coalesce(avg(value), 0), 6) AS amp_mean, round(coalesce(sum(value), 0), 6) AS amp_sum FROM w LEFT JOIN p ON p.session_id = w.session_id AND p.at // 10 = w.win GROUP BY ALL")
def event_agg_defaults(spark, sf_dir):
    s = T.samples(spark, sf_dir)
    w = W.tumbling(s, 10).select("session_id", F.col("window").alias("win")).distinct()
    p = W.tumbling(s.where("value > 100"), 10).select("session_id", F.col("window").alias("win"), F.col("i").alias("at"), "value")
    zero = F.lit(0.0)
    return w.join(p, ["session_id", "win"], "left").groupBy("session_id", "win").agg(F.count("at").alias("peaks"), r(F.coalesce(F.avg("value"), zero), "amp_mean"), r(F.coalesce(F.sum("value"), zero), "amp_sum"))


@query(f"WITH {S}, l AS (SELECT session_id, i AS j, code AS lab FROM s), n AS (SELECT session_id, max(j) AS last FROM l GROUP BY 1) SELECT s.session_id, s.i, l.lab FROM s JOIN n USING (session_id) JOIN l ON l.session_id = s.session_id AND l.j = least(ceil(s.i * 7 / 4.0), n.last)")
def asof_label_align(spark, sf_dir):
    s = T.samples(spark, sf_dir)
    return X.align_labels(s.select("session_id", "i"), s.select("session_id", F.col("i").alias("j"), F.col("code").alias("lab")), 4, 7).select("session_id", "i", "lab")


@query(f"WITH {S} SELECT a.session_id, a.i, b.code AS lab FROM s a JOIN s b ON a.session_id = b.session_id AND b.i = a.i * 2")
def decimate_align(spark, sf_dir):
    s = T.samples(spark, sf_dir)
    other = s.select("session_id", F.col("i").alias("at"), F.col("code").alias("lab"))
    return s.select("session_id", "i", (F.col("i") * 2).alias("at")).join(other, ["session_id", "at"]).select("session_id", "i", "lab")


@query(f"WITH {S}, m AS (SELECT session_id, t AS t0, row_number() OVER (PARTITION BY session_id ORDER BY t) AS phase, coalesce(lead(t) OVER (PARTITION BY session_id ORDER BY t), 'inf'::DOUBLE) AS t1 FROM s WHERE code = 0) SELECT s.session_id, m.phase, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM s JOIN m ON m.session_id = s.session_id AND t >= t0 AND t < t1 GROUP BY ALL")
def phase_features(spark, sf_dir):
    s = T.samples(spark, sf_dir)
    marks = X.phases(s.where("code = 0").select("session_id", F.col("t").alias("t0")))
    return X.in_phases(s, marks).groupBy("session_id", "phase").agg(F.count("*").alias("n"), r(F.avg("value"), "mean"), r(F.stddev_pop("value"), "std"))


@query(f"WITH {S}, f AS (SELECT *, value > 120 AS bad FROM s), g AS (SELECT *, max(CASE WHEN NOT bad THEN i END) OVER b AS i0, min(CASE WHEN NOT bad THEN i END) OVER a AS i1 FROM f WINDOW b AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT g.session_id, g.i, round(CASE WHEN i0 = i1 THEN p.value WHEN i0 IS NULL THEN q.value WHEN i1 IS NULL THEN p.value ELSE p.value + (q.value - p.value) * (g.i - i0) / (i1 - i0) END, 5) AS filled FROM g LEFT JOIN s p ON p.session_id = g.session_id AND p.i = i0 LEFT JOIN s q ON q.session_id = g.session_id AND q.i = i1")
def outlier_interpolate(spark, sf_dir):
    return W.interpolate(T.samples(spark, sf_dir), "value", F.col("value") > 120).select("session_id", "i", r("filled", "filled", 5))


@query(f"WITH {S}, b AS (SELECT session_id, avg(value) AS m, stddev_samp(value) AS d FROM s WHERE code = 1 GROUP BY 1) SELECT session_id, i, round(CASE WHEN m IS NULL THEN NULL WHEN coalesce(d, 0) = 0 THEN 0 ELSE (value - m) / d END, 5) AS z, round(CASE WHEN coalesce(m, 0) = 0 THEN 0 ELSE 100 * (value - m) / m END, 5) AS pct FROM s LEFT JOIN b USING (session_id)")
def norm_z_pct(spark, sf_dir):
    rows = X.baseline(T.samples(spark, sf_dir), ["value"])
    return rows.select("session_id", "i", r(X.z_score("value"), "z", 5), r(X.percent_change("value"), "pct", 5))


@query(f"WITH {S}, b AS (SELECT session_id, median(value) AS m FROM s WHERE code = 1 GROUP BY 1), d AS (SELECT session_id, median(abs(value - m)) AS d FROM s JOIN b USING (session_id) WHERE code = 1 GROUP BY 1) SELECT session_id, i, round(CASE WHEN d = 0 THEN 0 ELSE (value - m) / (1.4826 * d) END, 5) AS rz FROM s LEFT JOIN b USING (session_id) LEFT JOIN d USING (session_id)")
def norm_robust(spark, sf_dir):
    return X.robust_z(T.samples(spark, sf_dir), "value").select("session_id", "i", r("value_robust", "rz", 5))


@query(f"WITH {S}, h AS (SELECT *, CASE WHEN code <> 3 THEN value END AS v FROM s) SELECT session_id, i, round(coalesce(v, median(v) OVER (PARTITION BY session_id), 0), 6) AS v FROM h")
def median_fill(spark, sf_dir):
    rows = T.samples(spark, sf_dir).withColumn("v", F.when(F.col("code") != 3, F.col("value")))
    return rows.select("session_id", "i", r(X.median_fill("v"), "v"))


@query(f"WITH {S} SELECT session_id, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (value < 20) / greatest(1, count(*)), 6) AS off_pct, round(100.0::DOUBLE * count(*) FILTER (value > 120) / greatest(1, count(*)), 6) AS high_pct, round(median(value), 6) AS med FROM s GROUP BY 1")
def artifact_rates(spark, sf_dir):
    share = lambda e: 100.0 * F.count_if(F.expr(e)) / F.greatest(F.lit(1), F.count("*"))
    return T.samples(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n"), r(share("value < 20"), "off_pct"), r(share("value > 120"), "high_pct"), r(F.median("value"), "med"))


@query(f"WITH {S} SELECT session_id, count(*) FILTER (code = 0) AS c0, count(*) FILTER (code = 1) AS c1, count(*) FILTER (code = 2) AS c2, count(*) FILTER (code = 3) AS c3, count(*) FILTER (code = 4) AS c4, count(*) FILTER (code = 1) = 0 AS no_baseline FROM s GROUP BY 1")
def class_counts_pivot(spark, sf_dir):
    wide = T.samples(spark, sf_dir).groupBy("session_id").pivot("code", [0, 1, 2, 3, 4]).count().na.fill(0)
    return wide.select("session_id", *[F.col(str(k)).alias(f"c{k}") for k in range(5)]).withColumn("no_baseline", F.col("c1") == 0)


@query(f"WITH {S}, g AS (SELECT session_id, avg(value) FILTER (code = 2) AS ma, avg(value) FILTER (code <> 2) AS mb, stddev_samp(value) FILTER (code = 2) AS sa, stddev_samp(value) FILTER (code <> 2) AS sb, count(*) FILTER (code = 2) AS na, count(*) FILTER (code <> 2) AS nb FROM s GROUP BY 1) SELECT session_id, round(ma - mb, 5) AS diff, round(coalesce((ma - mb) / nullif(sqrt(((na - 1) * sa * sa + (nb - 1) * sb * sb) / nullif(na + nb - 2, 0)), 0), 0), 5) AS d FROM g WHERE na > 0")
def effect_size(spark, sf_dir):
    return X.effect_size(T.samples(spark, sf_dir), "value").select("session_id", r("diff", "diff", 5), r("d", "d", 5))


@query(f"WITH {A}, m AS (SELECT *, sqrt(x*x + y*y + z*z) AS mag FROM a) SELECT session_id, (i % 3)::INT AS cond, count(*) AS n, round(avg(mag), 4) AS mean, round(median(mag), 4) AS median, round(stddev_pop(mag), 4) AS std, round(quantile_cont(mag, 0.95), 4) AS p95, round(quantile_cont(mag, 0.99), 4) AS p99, round(max(mag), 4) AS max FROM m GROUP BY ALL")
def condition_summary(spark, sf_dir):
    m = T.axes(spark, sf_dir).withColumn("mag", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    return m.groupBy("session_id", (F.col("i") % 3).cast("int").alias("cond")).agg(F.count("*").alias("n"), r(F.avg("mag"), "mean", 4), r(F.median("mag"), "median", 4), r(F.stddev_pop("mag"), "std", 4), r(F.percentile("mag", F.lit(0.95)), "p95", 4), r(F.percentile("mag", F.lit(0.99)), "p99", 4), r(F.max("mag"), "max", 4))


PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM e" for k, a in enumerate(NAMES) for b in NAMES[k + 1 :])


@query(f"WITH {E} SELECT * FROM ({PAIRS}) WHERE abs(r) > 0.05")
def correlated_pairs(spark, sf_dir):
    return X.correlations(T.features(spark, sf_dir), NAMES).select("a", "b", r("r", "r")).where("abs(r) > 0.05")


LONG = " UNION ALL ".join(f"SELECT '{a}' AS feature, target, {a} AS v FROM e" for a in NAMES)


@query(f"WITH {E}, l AS ({LONG}), b AS (SELECT feature, target, count(v) AS n, sum(v) AS s, sum(v*v) AS q FROM l GROUP BY ALL), g AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s*s/n) AS c FROM b GROUP BY 1) SELECT feature, round(((c - s*s/n) / (k - 1)) / ((q - c) / (n - k)), 5) AS f, rank() OVER (ORDER BY round(((c - s*s/n) / (k - 1)) / ((q - c) / (n - k)), 5) DESC) AS place FROM g")
def anova_rank(spark, sf_dir):
    scores = X.anova(T.features(spark, sf_dir), NAMES).select("feature", r("f", "f", 5))
    return scores.withColumn("place", F.rank().over(Window.orderBy(F.desc("f"))).cast("long"))


LONG_ALL = " UNION ALL ".join(f"SELECT row_id, {k} AS k, '{a}' AS feature, target, {a} AS v FROM e" for k, a in enumerate(ALL))


SCORING = {"rr": ("mean", "<", "b - 5", 20), "rmssd": ("std", "<", "0.7 * b", 10), "scr": ("slope", ">", "b + 1.5", 20), "phasic": ("range", ">", "1.5 * b", 20), "activity": ("max", ">", "1.3 * b", 15), "temp": ("min", "<", "b - 0.3", 15)}
POINTS = " + ".join(f"CASE WHEN {f} {op} {limit.replace('b', 'b_' + name)} THEN {points} ELSE 0 END" for name, (f, op, limit, points) in SCORING.items())


@query(f"{WINDOW_SQL}, held AS (SELECT DISTINCT session_id FROM s ORDER BY session_id DESC LIMIT 2), t AS (SELECT {', '.join(f'avg({f}) AS b_{name}' for name, (f, *_) in SCORING.items())} FROM f WHERE label <> 2 AND session_id NOT IN (SELECT session_id FROM held)), p AS (SELECT f.session_id, f.win, {POINTS} AS points, label FROM f, t WHERE session_id IN (SELECT session_id FROM held)) SELECT session_id, win, points::INT AS points, (points >= 35)::INT AS p, (label = 2)::INT AS y FROM p")
def weighted_scoring(spark, sf_dir):
    """The points of the two last sessions' windows against the mean of the other sessions' windows that are no target."""
    rows = _windows(spark, sf_dir).withColumn("y", (F.col("label") == 2).cast("int"))
    held = [r[0] for r in rows.select("session_id").distinct().orderBy(F.desc("session_id")).limit(2).collect()]
    rules = [X.Rule(f, op, limit, points) for f, op, limit, points in SCORING.values()]
    base = X.scoring_baseline(rows.where(~F.col("session_id").isin(held)), rules)
    return X.weighted_scores(rows.where(F.col("session_id").isin(held)), base, rules, 35).select("session_id", "win", "points", "p", "y")


@query(f"{WINDOW_SQL}, z AS (SELECT f.*, CASE WHEN bm IS NULL THEN NULL WHEN coalesce(bs, 0) = 0 THEN 0 ELSE (mean - bm) / bs END AS mean_z FROM f LEFT JOIN b USING (session_id)) SELECT session_id, count(*) FILTER (label = 1) AS baseline, count(*) FILTER (label = 2) AS target, count(*) FILTER (label = 3) AS amusement, count(*) FILTER (label = 4) AS meditation, count(*) FILTER (label IN (1, 3, 4)) AS other, count(*) AS total, count(*) FILTER (label = 1) = 0 AS no_baseline, count(*) FILTER (mean_z IS NULL) AS all_null FROM z GROUP BY 1")
def baseline_check(spark, sf_dir):
    """Windows of each session by class, whether it has a baseline, and how many of its windows lack all normalised values."""
    rows = X.baseline(_windows(spark, sf_dir), ["mean"], "label").withColumn("mean_z", X.z_score("mean"))
    return X.class_counts(rows, "label", {1: "baseline", 2: "target", 3: "amusement", 4: "meditation"}, target=2, normalised=["mean_z"])


@query(f"WITH {E_ALL}, l AS ({LONG_ALL}), p AS (SELECT x.feature AS a, y.feature AS b, round(corr(x.v, y.v), 6) AS r FROM l x JOIN l y ON x.row_id = y.row_id AND x.k < y.k GROUP BY ALL) SELECT * FROM p WHERE abs(r) > 0.05")
def correlated_pairs_all(spark, sf_dir):
    return X.correlations(T.features(spark, sf_dir, len(ALL)), ALL).select("a", "b", r("r", "r")).where("abs(r) > 0.05")


@query(f"WITH {E_ALL}, l AS ({LONG_ALL}), b AS (SELECT feature, target, count(v) AS n, sum(v) AS s, sum(v*v) AS q FROM l GROUP BY ALL), g AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s*s/n) AS c FROM b GROUP BY 1) SELECT feature, round(((c - s*s/n) / (k - 1)) / ((q - c) / (n - k)), 5) AS f, rank() OVER (ORDER BY round(((c - s*s/n) / (k - 1)) / ((q - c) / (n - k)), 5) DESC) AS place FROM g")
def anova_rank_all(spark, sf_dir):
    scores = X.anova(T.features(spark, sf_dir, len(ALL)), ALL).select("feature", r("f", "f", 5))
    return scores.withColumn("place", F.rank().over(Window.orderBy(F.desc("f"))).cast("long"))


SCORE = "1 / (1 + exp(-(f0 + 2 * f1 - f2)))"
FOLDS = f"WITH {E}, p AS (SELECT fold, target AS y, round({SCORE}, 9) AS score FROM e)"


def _scored(spark, sf_dir):
    e = T.features(spark, sf_dir)
    return e.select("fold", F.col("target").alias("y"), F.round(1 / (1 + F.exp(-(F.col("f0") + 2 * F.col("f1") - F.col("f2")))), 9).alias("score"))


METRICS = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn"
SHARES = "tp, fp, fn, tn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy"


def _shares(g: DataFrame, *by: str) -> DataFrame:
    return g.select(*by, "tp", "fp", "fn", "tn", *[r(c, c) for c in ("precision", "recall", "f1", "accuracy")])


@query(f"{FOLDS}, q AS (SELECT fold, y, (score >= 0.5)::INT AS p FROM p), g AS (SELECT fold, {METRICS} FROM q GROUP BY 1) SELECT fold, {SHARES} FROM g")
def metrics_by_fold(spark, sf_dir):
    return _shares(X.metrics(_scored(spark, sf_dir).withColumn("p", (F.col("score") >= 0.5).cast("int")), ["fold"]), "fold")


GRID = [round(0.05 * k, 2) for k in range(1, 20)]


@query(f"{FOLDS}, q AS (SELECT threshold, y, (score >= threshold)::INT AS p FROM p, (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in GRID)}]) AS threshold)), g AS (SELECT threshold, {METRICS} FROM q GROUP BY 1) SELECT threshold, {SHARES} FROM g")
def threshold_sweep(spark, sf_dir):
    return _shares(X.threshold_sweep(_scored(spark, sf_dir), GRID), "threshold")


@query(f"{FOLDS}, k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS rk FROM p), g AS (SELECT fold, sum(rk) FILTER (y = 1) AS s, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn FROM k GROUP BY 1) SELECT fold, round((s - np * (np + 1) / 2.0)::DOUBLE / nullif(np * nn, 0), 6) AS auc FROM g")
def auc_rank(spark, sf_dir):
    return X.auc(_scored(spark, sf_dir), ["fold"]).select("fold", r("auc", "auc"))


@query(f"{WINDOW_SQL} SELECT session_id, win, (mean < 75 AND std > 20)::INT AS threshold_rule, ((CASE WHEN mean < 75 THEN 20 ELSE 0 END) + (CASE WHEN std > 20 THEN 20 ELSE 0 END) + (CASE WHEN slope > 0 THEN 15 ELSE 0 END) >= 35)::INT AS score_rule FROM f")
def rule_classifiers(spark, sf_dir):
    w = _windows(spark, sf_dir)
    score = X.rule_score([(F.col("mean") < 75, 20), (F.col("std") > 20, 20), (F.col("slope") > 0, 15)], 35)
    return w.select("session_id", "win", X.rule_threshold("mean", "std", 75.0, 20.0).alias("threshold_rule"), score.alias("score_rule"))


@query(f"WITH {E_ALL}, l AS ({' UNION ALL '.join(f"SELECT fold, '{f}' AS feature, avg({f}) AS m FROM e GROUP BY 1" for f in ALL)}), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(m, 9) DESC, feature) AS rn FROM l) SELECT feature, count(*) AS picked, round(count(*)::DOUBLE / 14, 6) AS stability FROM k WHERE rn <= 15 GROUP BY 1")
def topk_stability(spark, sf_dir):
    """Share of folds in which a feature is among the fifteen of greatest mean."""
    g = T.features(spark, sf_dir, len(ALL)).groupBy("fold").agg(*[F.avg(f).alias(f) for f in ALL]).unpivot("fold", ALL, "feature", "m")
    top = g.withColumn("rn", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc(F.round("m", 9)), "feature"))).where("rn <= 15")
    return top.groupBy("feature").agg(F.count("*").alias("picked")).withColumn("stability", F.round(F.col("picked") / 14, 6))


@query("SELECT coalesce(a.n_nationkey, b.n_nationkey) AS nation, a.customers, b.suppliers, rank() OVER (ORDER BY coalesce(customers, 0) DESC) AS place FROM (SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY 1) b ON a.n_nationkey = b.n_nationkey")
def outer_rank_merge(spark, sf_dir):
    a = T.scan(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = T.scan(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full").withColumn("place", F.rank().over(Window.orderBy(F.desc(F.coalesce("customers", F.lit(0))))).cast("long"))


@query(f"WITH {S}, a AS (SELECT DISTINCT session_id FROM s WHERE code = 1 AND value > 150), b AS (SELECT DISTINCT session_id FROM s WHERE code = 2 AND value > 150) SELECT session_id, session_id IN (SELECT session_id FROM b) AS both_classes FROM a UNION ALL SELECT session_id, NULL FROM (SELECT session_id FROM b EXCEPT SELECT session_id FROM a)")
def set_ops(spark, sf_dir):
    s = T.samples(spark, sf_dir).where("value > 150")
    a, b = (s.where(f"code = {k}").select("session_id").distinct() for k in (1, 2))
    both = a.intersect(b).withColumn("both_classes", F.lit(True)).union(a.subtract(b).withColumn("both_classes", F.lit(False)))
    return both.union(b.join(a, "session_id", "left_anti").withColumn("both_classes", F.lit(None).cast("boolean")))


@query("SELECT event_id, (props->>'k')::INT AS k FROM events")
def json_props(spark, sf_dir):
    return T.scan(spark, sf_dir, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query("WITH q AS (SELECT user_id AS session_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events), d AS (SELECT session_id, epoch_us(ts) / 1e6 AS t FROM q WHERE k = 1) SELECT session_id, count(*) AS n, round((count(*) - 1) / nullif(max(t) - min(t), 0), 9) AS fs FROM d GROUP BY 1")
def dedupe_timestamps(spark, sf_dir):
    w = Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    d = T.scan(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("user_id").alias("session_id"), T.seconds("ts").alias("t"))
    return d.groupBy("session_id").agg(F.count("*").alias("n"), r(F.try_divide(F.count("*") - 1, F.max("t") - F.min("t")), "fs", 9))


@query(f"""WITH RECURSIVE {S}, c AS (SELECT tan(pi() * 0.5 / 4) AS k), h AS (
 SELECT session_id, i, value AS x, value AS y FROM s WHERE i = 0
 UNION ALL SELECT s.session_id, s.i, s.value, (k * (s.value + h.x) - (k - 1) * h.y) / (1 + k) FROM h JOIN s ON s.session_id = h.session_id AND s.i = h.i + 1, c)
SELECT session_id, i, round(y, 5) AS filtered FROM h""")
def iir_lowpass(spark, sf_dir):
    return G.filtered(T.samples(spark, sf_dir), *K.lowpass(0.5, 4, 1)).select("session_id", "i", r("filtered", "filtered", 5))


@query()
def bandpass_beats(spark, sf_dir):
    return G.beat_rows(T.samples(spark, sf_dir), 4.0, 0.1, 1.5)


@query()
def skin_responses(spark, sf_dir):
    return G.response_rows(T.samples(spark, sf_dir), 4.0)


@query()
def welch_bands(spark, sf_dir):
    rows = T.axes(spark, sf_dir).select("session_id", "i", (600 + 10 * F.col("x")).alias("ibi"))
    return G.band_power(rows)


@query()
def zero_phase_lowpass(spark, sf_dir):
    return G.filtered(T.samples(spark, sf_dir), *K.lowpass(0.5, 4, 2), zero_phase=True)


@query()
def loso_eval(spark, sf_dir):
    """Held-out scores of a model per fold, and each fold's metrics."""
    scored = linear.held_out(T.features(spark, sf_dir, len(ALL)), ALL).withColumn("p", (F.col("score") >= 0.5).cast("int"))
    return X.metrics(scored, ["fold"])


def _judged(scored: DataFrame) -> DataFrame:
    return X.metrics(scored.withColumn("p", (F.col("score") >= 0.5).cast("int")), ["fold"])


@query()
def loso_forest(spark, sf_dir):
    return _judged(M.held_out(T.features(spark, sf_dir, len(ALL)), ALL, "forest"))


@query()
def loso_svm(spark, sf_dir):
    return _judged(M.held_out(T.features(spark, sf_dir, len(ALL)), ALL, "svm"))


@query()
def loso_ensemble(spark, sf_dir):
    return _judged(M.held_out(T.features(spark, sf_dir, len(ALL)), ALL, "ensemble"))


@query()
def mi_stability(spark, sf_dir):
    """Features by the share of folds that rank them among the three most informative."""
    return M.stability(M.fold_information(T.features(spark, sf_dir, len(ALL)), ALL), 3)


@query(f"WITH {E} SELECT fold AS \"group\", count(*) AS n, sum(target)::BIGINT AS targets, round(sum(target)::DOUBLE / count(*), 6) AS share FROM e GROUP BY 1")
def manifest_counts(spark, sf_dir):
    return M.manifest(T.features(spark, sf_dir), "fold", "target").withColumn("share", F.round("share", 6))


from tidewatch.plans import builder, relational, reports, stored, trees  # noqa: E402, F401, I001  these register their queries
