"""Queries of joins, projections, filters, sorts, limits, scalars and normalisation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import features as X
from tidewatch.operators import reports as P
from tidewatch.operators import shaping as H
from tidewatch.operators import windows as W
from tidewatch.plans.registry import ALL, E, E_ALL, O, A, S, query, r
from tidewatch.sources import tables as T

WIN = f"{S}, w AS (SELECT *, i // 10 AS win FROM s)"
BASE = f"{S}, b AS (SELECT session_id, avg(value) AS m, stddev_samp(value) AS d, stddev_pop(value) AS dp, median(value) AS md FROM s WHERE code = 1 GROUP BY 1)"


def _wins(spark, sf_dir, width=10):
    return W.tumbling(T.samples(spark, sf_dir), width).withColumnRenamed("window", "win")


@query("SELECT n_nationkey, n_name, c.customers, s.suppliers, s.balance FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c USING (n_nationkey) LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1) s USING (n_nationkey)")
def chained_left_joins(spark, sf_dir):
    customers = T.scan(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    suppliers = T.scan(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"), r(F.sum("s_acctbal"), "balance", 2))
    return H.chained_left(T.scan(spark, sf_dir, "nation").select("n_nationkey", "n_name"), [customers, suppliers], ["n_nationkey"])


@query(f"WITH {WIN}, a AS (SELECT session_id, win, round(avg(value), 6) AS mean FROM w GROUP BY ALL), b AS (SELECT session_id, win, count(DISTINCT code) AS codes FROM w GROUP BY ALL) SELECT a.session_id, a.win, mean, codes FROM a JOIN b ON a.session_id = b.session_id AND a.win = b.win")
def column_concat(spark, sf_dir):
    g = _wins(spark, sf_dir).groupBy("session_id", "win")
    return H.side_by_side([g.agg(r(F.avg("value"), "mean")), g.agg(F.count_distinct("code").alias("codes"))], ["session_id", "win"])


@query(f"WITH {S}, n AS (SELECT session_id, count(*) AS low FROM s WHERE value < 20 GROUP BY 1) SELECT session_id, count(*) AS n, max(low) AS low FROM s LEFT JOIN n USING (session_id) GROUP BY 1")
def series_map_join(spark, sf_dir):
    s = T.samples(spark, sf_dir)
    low = s.where("value < 20").groupBy("session_id").agg(F.count("*").alias("low"))
    return s.groupBy("session_id").agg(F.count("*").alias("n")).join(low, "session_id", "left")


@query(f"""WITH {S}, g AS (SELECT session_id, t FROM s WHERE code = 1), v AS (SELECT session_id, t, value FROM s WHERE code = 2),
 p AS (SELECT g.session_id, g.t, v.t AS t0, v.value AS v0 FROM g ASOF LEFT JOIN v ON g.session_id = v.session_id AND g.t >= v.t), q AS (SELECT p.*, v.t AS t1, v.value AS v1 FROM p ASOF LEFT JOIN v ON p.session_id = v.session_id AND p.t <= v.t)
 SELECT session_id, t, round(CASE WHEN t0 = t1 THEN v0 WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 4) AS value FROM q""")
def cross_axis_interpolation(spark, sf_dir):
    s = T.samples(spark, sf_dir)
    return H.interpolated_onto(s.where("code = 1"), s.where("code = 2")).withColumn("value", F.round("value", 4))


@query(f"WITH {S}, p AS (SELECT session_id, i // 10 AS win, value FROM s WHERE value BETWEEN 60 AND 200), w AS (SELECT DISTINCT session_id, i // 10 AS win FROM s) SELECT w.session_id, w.win, count(value) AS n, round(coalesce(avg(value), 0), 6) AS mean, round(coalesce(max(value), 0), 6) AS max, round(coalesce(stddev_pop(value), 0), 6) AS std, round(coalesce(sum(value), 0), 6) AS sum FROM w LEFT JOIN p ON p.session_id = w.session_id AND p.win = w.win GROUP BY ALL")
def amplitude_bounds(spark, sf_dir):
    w = _wins(spark, sf_dir)
    p = w.where(F.col("value").between(60, 200)).select("session_id", "win", "value")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = w.select("session_id", "win").distinct().join(p, ["session_id", "win"], "left").groupBy("session_id", "win")
    return g.agg(F.count("value").alias("n"), r(zero(F.avg("value")), "mean"), r(zero(F.max("value")), "max"), r(zero(F.stddev_pop("value")), "std"), r(zero(F.sum("value")), "sum"))


@query(f"WITH {S}, w AS (SELECT session_id, k * 5 + 20 AS e, value FROM s, unnest(range(greatest(0, ceil((i - 19) / 5.0)::BIGINT), i // 5 + 1)) u(k)) SELECT session_id, e AS window_end, round(avg(value), 6) AS mean FROM w WHERE e % 10 = 0 GROUP BY ALL HAVING count(*) = 20")
def stride_derivation(spark, sf_dir):
    g = W.end_anchored(T.samples(spark, sf_dir), 10, 20, 5).groupBy("session_id", F.col("end").alias("window_end")).agg(F.count("*").alias("n"), r(F.avg("value"), "mean"))
    return g.where("n = 20 and window_end % 10 = 0").drop("n")


@query(f"WITH {S}, l AS (SELECT DISTINCT session_id FROM s ORDER BY session_id DESC LIMIT 2) SELECT CASE WHEN session_id IN (SELECT session_id FROM l) THEN 'test' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT session_id) AS sessions, round(avg(value), 6) AS mean FROM s GROUP BY 1")
def fixed_hold_out(spark, sf_dir):
    s = T.samples(spark, sf_dir)
    held = [x[0] for x in s.select("session_id").distinct().orderBy(F.desc("session_id")).limit(2).collect()]  # two
    return H.split_sessions(s, held).groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), r(F.avg("value"), "mean"))


@query(f"WITH {S}, v AS (SELECT *, CASE WHEN code <> 3 THEN value END AS v FROM s), m AS (SELECT avg(v) AS m FROM v) SELECT session_id, i, round(coalesce(v, m), 6) AS by_mean, round(coalesce(v, 0), 6) AS by_zero FROM v, m")
def global_fill(spark, sf_dir):
    v = T.samples(spark, sf_dir).select("session_id", "i", F.when(F.col("code") != 3, F.col("value")).alias("by_mean")).withColumn("by_zero", F.col("by_mean"))
    return H.filled(H.filled(v, ["by_mean"]), ["by_zero"], 0.0).select("session_id", "i", r("by_mean", "by_mean"), r("by_zero", "by_zero"))


@query(f"WITH {S}, v AS (SELECT session_id, i, 1 / nullif(CASE WHEN code = 3 THEN 0 ELSE value END, 0) AS y FROM s), g AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN i END) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i0, min(CASE WHEN y IS NOT NULL THEN i END) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM v) SELECT g.session_id, g.i, round(CASE WHEN i0 = i1 OR i1 IS NULL THEN p.y WHEN i0 IS NULL THEN q.y ELSE p.y + (q.y - p.y) * (g.i - i0) / (i1 - i0) END, 6) AS y FROM g LEFT JOIN v p ON p.session_id = g.session_id AND p.i = i0 LEFT JOIN v q ON q.session_id = g.session_id AND q.i = i1")
def inverse_interpolated(spark, sf_dir):
    v = T.samples(spark, sf_dir).withColumn("y", H.inverse(F.when(F.col("code") == 3, F.lit(0.0)).otherwise(F.col("value"))))
    return W.interpolate(v, "y", F.col("y").isNull()).select("session_id", "i", r("filled", "y"))


@query(f"WITH {BASE} SELECT session_id, i, round(value, 6) AS raw_value, round(CASE WHEN m IS NULL OR coalesce(dp, 0) = 0 THEN 0 ELSE (value - m) / dp END, 5) AS z_value FROM s LEFT JOIN b USING (session_id) WHERE code <> 0")
def prefixed_buckets(spark, sf_dir):
    rows = X.baseline(T.samples(spark, sf_dir).where("code != 0"), ["value"], sample=False).withColumn("value", F.round("value", 15))
    return H.bucketed(rows, ["session_id", "i"], ["value"], {"value": r(F.coalesce(X.z_score("value"), F.lit(0.0)), digits=5)}).withColumn("raw_value", F.round("raw_value", 6))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def column_selection(spark, sf_dir):
    """A duplicate column, columns to drop, and an order of columns."""
    rows = T.scan(spark, sf_dir, "orders").withColumn("again", F.col("o_custkey"))
    wanted = ["o_orderkey", "o_custkey", "o_totalprice"]
    return rows.drop("again").select(*wanted)


@query(f"WITH {BASE}, q AS (SELECT session_id, 'full' AS length, code, i, value FROM s), c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) AS k FROM s WHERE code = 1), z AS (SELECT n, session_id, avg(value) AS m, stddev_samp(value) AS d FROM c, (SELECT unnest([3, 5, 8]) AS n) WHERE k <= n GROUP BY ALL) SELECT n, count(*) AS rows, round(avg(abs(CASE WHEN coalesce(z.d, 0) = 0 THEN 0 ELSE (value - z.m) / z.d END)), 5) AS mean_abs_z FROM s JOIN z USING (session_id) GROUP BY n")
def calibration_sweep(spark, sf_dir):
    """How the length of the calibration changes the scores: its first n samples for each n of a grid."""
    s = T.samples(spark, sf_dir)
    calm = s.where("code = 1").withColumn("k", F.row_number().over(W.order())).withColumn("n", F.explode(F.array(*map(F.lit, [3, 5, 8])))).where("k <= n")
    base = calm.groupBy("n", "session_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("d"))
    z = F.when(F.coalesce("d", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("value") - F.col("m"), F.col("d")))
    return s.join(base, "session_id").groupBy("n").agg(F.count("*").alias("rows"), r(F.avg(F.abs(z)), "mean_abs_z", 5))


@query(f"""WITH {WIN}, g AS (SELECT session_id, win, min(code) AS label, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS max FROM w GROUP BY ALL HAVING count(*) = 10), b AS (SELECT session_id, {', '.join(f'avg({f}) AS {f}_m, stddev_samp({f}) AS {f}_d' for f in ('mean', 'std', 'max'))} FROM g WHERE label = 0 GROUP BY 1)
SELECT session_id, win, {', '.join(f'round({f}, 5) AS {f}, round(CASE WHEN coalesce({f}_m, 0) = 0 THEN 0 ELSE 100 * ({f} - {f}_m) / {f}_m END, 4) AS {f}_percent_change, round(CASE WHEN {f}_m IS NULL THEN NULL WHEN coalesce({f}_d, 0) = 0 THEN 0 ELSE ({f} - {f}_m) / {f}_d END, 4) AS {f}_z_score' for f in ('mean', 'std', 'max'))} FROM g LEFT JOIN b USING (session_id)""")
def appended_normalised(spark, sf_dir):
    """Each feature, and beside it its change and its score against the calibration windows: three columns for one."""
    names = ["mean", "std", "max"]
    g = _wins(spark, sf_dir).groupBy("session_id", "win").agg(F.count("*").alias("n"), F.min("code").alias("label"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max")).where("n = 10")
    rows = X.baseline(g, names, "label", calm=0)
    return rows.select("session_id", "win", *[c for f in names for c in (r(f, f, 5), r(X.percent_change(f), f"{f}_percent_change", 4), r(X.z_score(f), f"{f}_z_score", 4))])


@query(f"WITH {WIN}, g AS (SELECT session_id, win, min(code) AS label, avg(value) AS mean, max(value) AS max FROM w GROUP BY ALL HAVING count(*) = 10), b AS (SELECT session_id, avg(max) AS m, stddev_samp(max) AS d FROM g WHERE label = 0 GROUP BY 1) SELECT session_id, win, round(mean, 6) AS raw_mean, round(CASE WHEN m IS NULL THEN NULL WHEN coalesce(d, 0) = 0 THEN 0 ELSE (max - m) / d END, 5) AS z_max FROM g LEFT JOIN b USING (session_id)")
def mixed_bucket(spark, sf_dir):
    """Some features raw, the others normalised; together they are all features, once each."""
    raw, z = ["mean"], ["max"]
    g = _wins(spark, sf_dir).groupBy("session_id", "win").agg(F.count("*").alias("n"), F.min("code").alias("label"), F.avg("value").alias("mean"), F.max("value").alias("max")).where("n = 10")
    assert not set(raw) & set(z) and set(raw) | set(z) == {"mean", "max"}
    out = H.bucketed(X.baseline(g, z, "label", calm=0), ["session_id", "win"], raw, {f: X.z_score(f) for f in z})
    return out.select("session_id", "win", r("raw_mean", "raw_mean"), r("z_max", "z_max", 5))


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS balance, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 10")
def head_sorted(spark, sf_dir):
    rows = T.scan(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal"))
    return H.first_rows(rows, [F.desc("c_acctbal"), F.col("c_custkey")], 10).select("c_custkey", "c_name", r("c_acctbal", "balance", 2), F.col("place").cast("long").alias("place"))


@query(f"WITH {S}, n AS (SELECT DISTINCT 'S' || session_id AS name, session_id FROM s) SELECT name, row_number() OVER (ORDER BY name) AS as_text, row_number() OVER (ORDER BY session_id) AS natural FROM n")
def session_orders(spark, sf_dir):
    """Session names in text order, where S10 comes before S2, and in natural order."""
    n = T.samples(spark, sf_dir).select(F.concat(F.lit("S"), F.col("session_id")).alias("name")).distinct()
    return H.ranked(H.ranked(n, [F.col("name")], "as_text"), H.natural("name"), "natural")



@query(f"WITH {S}, m AS (SELECT session_id, max(value) AS top FROM s GROUP BY 1) SELECT session_id, min(i) AS i, round(max(value), 6) AS value FROM s JOIN m USING (session_id) WHERE value = top GROUP BY 1")
def arg_max_row(spark, sf_dir):
    """The row of each session with the largest value, the first on ties."""
    g = T.samples(spark, sf_dir).groupBy("session_id").agg(F.max_by(F.struct("i", "value"), F.struct("value", -F.col("i"))).alias("m"))
    return g.select("session_id", "m.i", r("m.value", "value"))


@query(f"WITH {S}, g AS (SELECT session_id, count(*) FILTER (code = 2) AS targets, round(avg(value), 6) AS mean, round(min(value), 6) AS least FROM s GROUP BY 1) SELECT session_id, targets, mean, least FROM g ORDER BY (targets >= 5) DESC, mean DESC, least DESC, session_id LIMIT 1")
def preferred_row(spark, sf_dir):
    """The best row by several keys: first those that pass, then by mean, then by the least value."""
    g = T.samples(spark, sf_dir).groupBy("session_id").agg(F.count_if(F.col("code") == 2).alias("targets"), r(F.avg("value"), "mean"), r(F.min("value"), "least"))
    return H.first_rows(g, [F.desc(F.col("targets") >= 5), F.desc("mean"), F.desc("least"), F.col("session_id")], 1).drop("place")


@query("SELECT p_partkey, p_name || '_z_score' AS suffixed, starts_with(p_name, p_name[1:3]) AS starts, replace(p_name, ' ', '_') AS replaced, printf('%.2f%%', p_retailprice) AS shown, upper(p_brand) AS brand, len(p_name)::INT AS length FROM part")
def string_functions(spark, sf_dir):
    n = F.col("p_name")
    return T.scan(spark, sf_dir, "part").select(
        "p_partkey", F.concat(n, F.lit("_z_score")).alias("suffixed"), n.startswith(F.substring(n, 1, 3)).alias("starts"), F.replace(n, F.lit(" "), F.lit("_")).alias("replaced"),
        F.format_string("%.2f%%", "p_retailprice").alias("shown"), F.upper("p_brand").alias("brand"), F.length(n).alias("length"),
    )


@query(f"WITH {S} SELECT session_id, i, CASE code WHEN 0 THEN 'transient' WHEN 1 THEN 'baseline' WHEN 2 THEN 'stress' WHEN 3 THEN 'amusement' ELSE 'unknown' END AS name, coalesce(CASE code WHEN 2 THEN 1 WHEN 1 THEN 0 END, 0) AS legacy FROM s")
def map_lookup(spark, sf_dir):
    names = {0: "transient", 1: "baseline", 2: "stress", 3: "amusement"}
    both = F.map_concat(F.create_map(F.lit(1), F.lit(0)), F.create_map(F.lit(2), F.lit(1)))
    return T.samples(spark, sf_dir).select("session_id", "i", H.map_codes(F.col("code"), names, "unknown").alias("name"), F.coalesce(F.try_element_at(both, F.col("code")), F.lit(0)).alias("legacy"))


@query(f"WITH {S} SELECT session_id, i, round_even(value / 2, 0) AS half_even, (i // 7)::BIGINT AS part, i % 7 AS rest, least(greatest(value, 20), 200) AS clipped, round(exp(least(value, 200) / 100), 6) AS e, round(ln(value + 1), 6) AS l, isfinite(value) AS finite FROM s")
def math_functions(spark, sf_dir):
    v = F.col("value")
    clipped = F.least(F.greatest(v, F.lit(20.0)), F.lit(200.0))
    return T.samples(spark, sf_dir).select("session_id", "i", F.bround(v / 2, 0).alias("half_even"), F.expr("i div 7").alias("part"), (F.col("i") % 7).alias("rest"), clipped.alias("clipped"), r(F.exp(F.least(v, F.lit(200.0)) / 100), "e"), r(F.log(v + 1), "l"), (~F.isnan(v) & (F.abs(v) != float("inf"))).alias("finite"))


@query("SELECT vec_id, len(embedding[3:7])::INT AS cut, len(list_filter(embedding, lambda x: x > 0))::INT AS positive, len(list_distinct(list_transform(embedding, lambda x: round(x::DOUBLE * 10)::INT)))::INT AS distinct_tenths, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, len(list_concat(embedding, [0.0, 0.0]))::INT AS padded FROM embeddings")
def array_functions(spark, sf_dir):
    e = F.col("embedding")
    return T.scan(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(F.slice(e, 3, 5)).alias("cut"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"), F.size(F.array_distinct(F.transform(e, lambda x: F.round(x.cast("double") * 10).cast("int")))).alias("distinct_tenths"),
        r(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double")), "total", 4), F.size(F.concat(e, F.array_repeat(F.lit(0.0).cast("float"), 2))).alias("padded"),
    )


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, round(epoch(o_orderdate) / 60, 3) AS minutes, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, (date_diff('day', DATE '1995-01-01', o_orderdate::DATE))::INT AS days FROM orders")
def time_functions(spark, sf_dir):
    d = F.col("o_orderdate").cast("timestamp_ntz")
    s = T.seconds("o_orderdate")
    return T.scan(spark, sf_dir, "orders").select("o_orderkey", s.cast("long").alias("seconds"), F.round(s / 60, 3).alias("minutes"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"))


@query(f"WITH {S}, n AS (SELECT session_id, count(*) AS n FROM s GROUP BY 1), w AS (SELECT s.*, k AS win FROM s JOIN n USING (session_id), unnest(range(greatest(0, ceil((i - 19) / 10.0)::BIGINT), least(i // 10 + 1, (n - 20) // 10))) u(k)) SELECT session_id, win, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM w GROUP BY ALL")
def rule_windows(spark, sf_dir):
    """Overlapping windows as the rule-based study counts them: (n - width) // step of them, one fewer than fit."""
    s = T.samples(spark, sf_dir)
    n = s.groupBy("session_id").agg(F.expr("(count(*) - 20) div 10").alias("most"))
    g = W.sliding(s, 20, 10).join(n, "session_id").where("window < most").groupBy("session_id", F.col("window").alias("win"))
    return g.agg(F.count("*").alias("n"), r(F.avg("value"), "mean"), r(F.stddev_pop("value"), "std"))


@query(f"WITH {S}, n AS (SELECT session_id, count(*) AS n FROM s GROUP BY 1), e AS (SELECT session_id, k AS win, k * 10 + 10 AS stop, greatest(0, k * 10 + 10 - 30) AS begin FROM n, unnest(range(0, (n - 10) // 10 + 1)) u(k)) SELECT e.session_id, e.win, count(*) AS n, round(avg(value), 6) AS mean FROM e JOIN s ON s.session_id = e.session_id AND i >= begin AND i < stop GROUP BY ALL")
def lookback_clipped(spark, sf_dir):
    """Features of a lookback longer than the window that it ends with, cut at the session's start."""
    s = T.samples(spark, sf_dir)
    full = s.groupBy("session_id").agg((F.floor((F.count("*") - 10) / 10)).alias("last"))
    g = W.lookback(s, 10, 10, 30).join(full, "session_id").where("window <= last").groupBy("session_id", F.col("window").alias("win"))
    return g.agg(F.count("*").alias("n"), r(F.avg("value"), "mean"))


@query(f"WITH {S} SELECT session_id, i, round(avg(value) OVER (PARTITION BY session_id ORDER BY (t * 1000)::BIGINT RANGE BETWEEN 43200000 PRECEDING AND 43200000 FOLLOWING), 5) AS mean, round(coalesce(lead(value, 26) {O}, 0), 6) AS zero_padded FROM s")
def rolling_time_frame(spark, sf_dir):
    """Means over a centred day, and a shift whose tail is zero."""
    s = T.samples(spark, sf_dir)
    return s.select("session_id", "i", r(P.running(s, "value", 86400), "mean", 5), r(F.coalesce(F.lead("value", 26).over(W.order()), F.lit(0.0)), "zero_padded"))


@query(f"""WITH {S}, m AS (SELECT session_id, i::DOUBLE AS t FROM s WHERE code = 0 AND value > 60), k AS (SELECT session_id, list_sort(list(t)) AS m FROM m GROUP BY 1), z AS (SELECT DISTINCT session_id FROM s),
 p AS (SELECT z.session_id, u.p AS phase, CASE WHEN len(m) = 3 THEN CASE WHEN u.p = 1 THEN 0 ELSE m[u.p - 1] END ELSE [0.0, 10.0, 20.0][u.p]::DOUBLE END AS t0, CASE WHEN len(m) = 3 THEN m[u.p] ELSE [10.0, 20.0, 45.0][u.p]::DOUBLE END AS t1 FROM z LEFT JOIN k USING (session_id), (SELECT unnest([1, 2, 3]) AS p) u)
 SELECT session_id, phase, t0, t1, count(i) AS n FROM p LEFT JOIN s USING (session_id) WHERE i >= t0 AND i < t1 GROUP BY ALL""")
def marker_phases(spark, sf_dir):
    """Phases that end at a session's marks where there are exactly three; the usual times elsewhere. Samples find their phase by one ordered pass."""
    s = T.samples(spark, sf_dir)
    marks = s.where("code = 0 and value > 60").select("session_id", F.col("i").cast("double").alias("t"))
    phases = P.marked_phases(marks, s.select("session_id").distinct(), [(0, 10), (10, 20), (20, 45)])
    inside = X.in_phases(s.withColumn("t", F.col("i").cast("double")), phases)
    return inside.groupBy("session_id", "phase", "t0", "t1").agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT * FROM (SELECT 'f0' AS a, 'f1' AS b, CASE WHEN count(*) FILTER (f2 > 0) >= 3 THEN round(corr(f0, f1) FILTER (f2 > 0), 6) END AS r, fold FROM e GROUP BY fold)")
def guarded_pearson(spark, sf_dir):
    e = T.features(spark, sf_dir).withColumn("f1", F.when(F.col("f2") > 0, F.col("f1")))
    return e.groupBy("fold").agg(r(P.guarded_correlation("f0", "f1"), "r")).select(F.lit("f0").alias("a"), F.lit("f1").alias("b"), "r", "fold")


LONG_ALL = " UNION ALL ".join(f"SELECT row_id, {k} AS k, '{a}' AS feature, {a} AS v FROM e" for k, a in enumerate(ALL))


@query(f"WITH {E_ALL}, l AS ({LONG_ALL}), k AS (SELECT x.feature AS a, y.feature AS b, round(corr(x.v, y.v), 9) AS r FROM l x JOIN l y ON x.row_id = y.row_id AND x.k < y.k GROUP BY ALL HAVING abs(r) > 0.12), f AS (SELECT feature, round(avg(v), 9) AS f FROM l GROUP BY 1)," + """
 o AS (SELECT *, row_number() OVER (ORDER BY abs(r) DESC, a, b) AS k FROM k), p AS (SELECT o.*, fa.f AS fa, fb.f AS fb FROM o JOIN f fa ON fa.feature = a JOIN f fb ON fb.feature = b),
 z AS (WITH RECURSIVE step(k, gone) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT p.k, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, CASE WHEN fa >= fb THEN b ELSE a END) END FROM step JOIN p ON p.k = step.k + 1) SELECT gone FROM step ORDER BY k DESC LIMIT 1)
 SELECT unnest(gone) AS feature FROM z""")
def correlated_elimination(spark, sf_dir):
    """Features that go because a stronger one is correlated with them."""
    e = T.features(spark, sf_dir, len(ALL))
    pairs = X.correlations(e, ALL).withColumn("r", F.round("r", 9)).where("abs(r) > 0.12")
    score = e.agg(*[F.round(F.avg(f), 9).alias(f) for f in ALL]).unpivot([], ALL, "feature", "f")
    return spark.createDataFrame([(f,) for f in P.eliminated(pairs, score)], "feature string")
