"""Queries over metric points: ingest, grids, windows, scaling and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.operators import frames, smoothing
from skerry.sources.relations import METRIC_SQL, kind_of, metric_points, table

from .registry import query

NAMES = ["click", "error", "purchase", "signup", "view"]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_points(table(spark, sf_dir, "events"))


def r(column: str, places: int = 6):
    return F.round(column, places).alias(column)


SPINE_SQL = METRIC_SQL + """, sp AS (
  SELECT target_id, name, i AS seq, l - to_hours(59 - CAST(i AS INTEGER)) AS time
  FROM (SELECT target_id, name, max(time) AS l FROM mp GROUP BY 1, 2) x, range(60) t(i)
), fr AS (SELECT sp.target_id, sp.name, sp.time, CAST(sp.seq AS INTEGER) AS seq, mp.real_value FROM sp LEFT JOIN mp ON sp.target_id = mp.target_id AND sp.name = mp.name AND sp.time = mp.time)"""

FILLED_SQL = SPINE_SQL + """, nb AS (
  SELECT *, last_value(CASE WHEN real_value IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS x0, last_value(real_value IGNORE NULLS) OVER b AS y0,
    first_value(CASE WHEN real_value IS NOT NULL THEN seq END IGNORE NULLS) OVER a AS x1, first_value(real_value IGNORE NULLS) OVER a AS y1
  FROM fr WINDOW b AS (PARTITION BY target_id, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY target_id, name ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), fi AS (
  SELECT target_id, name, time, seq, real_value, CASE WHEN real_value IS NOT NULL THEN real_value
    WHEN y0 IS NOT NULL AND y1 IS NOT NULL THEN y0 + (y1 - y0) * (seq - x0) / (x1 - x0) ELSE coalesce(y0, y1) END AS filled FROM nb
)"""


@query(f"WITH {METRIC_SQL} SELECT time, inst_type, target_id, name, round(real_value, 6) AS real_value FROM mp")
def metric_long_ingest(spark, sf_dir):
    return points(spark, sf_dir).withColumn("real_value", F.round("real_value", 6))


@query("SELECT date_trunc('minute', ts) AS time, event_type AS name, count(*) AS n FROM events GROUP BY 1, 2")
def minute_count_resample(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("time"), F.col("event_type").alias("name")).agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT event_type AS name, user_id % 3 AS target, date_trunc('hour', ts) AS time FROM events),
l AS (SELECT name, target, max(time) AS last FROM e GROUP BY 1, 2),
c AS (SELECT e.name, e.target, e.time, count(*) AS n FROM e JOIN l ON e.name = l.name AND e.target = l.target AND e.time > l.last - INTERVAL 60 HOUR GROUP BY 1, 2, 3)
SELECT name, target, count(*) AS steps, count(*) FILTER (n > 1) AS repeated,
  CASE WHEN count(*) FILTER (n > 1) > 0 THEN 'E704' WHEN count(*) NOT IN (1, 60) THEN 'E704' ELSE 'OK' END AS error_code FROM c GROUP BY 1, 2
""")
def request_validation_status(spark, sf_dir):
    """A series may bring 60 steps or one, each of them once."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 3).alias("target"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"))
    counts = rows.groupBy("name", "target", "time").agg(F.count("*").alias("n"))
    last = counts.groupBy("name", "target").agg(F.max("time").alias("last"))
    recent = counts.join(last, ["name", "target"]).where("time > last - INTERVAL '60' HOUR")
    out = recent.groupBy("name", "target").agg(F.count("*").alias("steps"), F.count_if(F.col("n") > 1).alias("repeated"))
    return out.withColumn("error_code", F.when((F.col("repeated") > 0) | ~F.col("steps").isin(1, 60), "E704").otherwise("OK"))


@query(f"WITH {SPINE_SQL} SELECT target_id, name, time, seq, round(real_value, 6) AS real_value FROM fr")
def time_spine_left_join(spark, sf_dir):
    return frames.on_spine(points(spark, sf_dir)).withColumn("real_value", F.round("real_value", 6))


@query(f"""WITH {SPINE_SQL}, x AS (SELECT *, CASE WHEN name = 'view' THEN NULL ELSE real_value END AS v FROM fr)
SELECT target_id, name, time, round(v, 6) AS real_value FROM x WHERE (target_id, name) IN (SELECT (target_id, name) FROM x GROUP BY target_id, name HAVING count(v) > 0)""")
def drop_all_null_metric(spark, sf_dir):
    """One metric's values are hidden first, so that a series without any is there to be dropped."""
    hidden = frames.on_spine(points(spark, sf_dir)).withColumn("real_value", F.when(F.col("name") != "view", F.col("real_value")))
    return frames.drop_all_null(hidden).select("target_id", "name", "time", r("real_value"))


@query(f"""WITH {SPINE_SQL}, x AS (SELECT *, CASE WHEN name = 'view' AND target_id = 'was_0' THEN NULL ELSE real_value END AS v FROM fr),
b AS (SELECT DISTINCT target_id FROM (SELECT target_id, name FROM x GROUP BY 1, 2 HAVING count(v) = 0) y)
SELECT target_id, name, time, round(v, 6) AS real_value FROM x WHERE target_id NOT IN (SELECT target_id FROM b)""")
def drop_targets_any_null_metric(spark, sf_dir):
    """Targets of which one metric has no value at all go away; one target's metric is hidden first."""
    hidden = frames.on_spine(points(spark, sf_dir)).withColumn("real_value", F.when(~((F.col("name") == "view") & (F.col("target_id") == "was_0")), F.col("real_value")))
    return frames.drop_targets_any_null(hidden).select("target_id", "name", "time", r("real_value"))


SIGMAS = {"error": 2.0, "view": 1.5}


@query(f"""WITH {METRIC_SQL}, bw AS (SELECT *, count(real_value) OVER f AS n, avg(real_value) OVER f AS mu, stddev_pop(real_value) OVER f AS sd FROM mp WINDOW f AS (PARTITION BY target_id, name ORDER BY time ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, CASE name WHEN 'error' THEN 2.0::DOUBLE WHEN 'view' THEN 1.5 ELSE 3 END AS k FROM bw WHERE n = 24)
SELECT target_id, name, time, round(greatest(mu - k * sd, 0), 5) AS lower, round(mu + k * sd, 5) AS upper, (real_value > mu + k * sd OR real_value < greatest(mu - k * sd, 0)) AND real_value >= 0.1 AS anomaly FROM k""")
def sigma_band_by_metric(spark, sf_dir):
    """Bands whose width in deviations is a metric's own, three where none is configured."""
    k = F.coalesce(*(F.when(F.col("name") == n, v) for n, v in SIGMAS.items()), F.lit(3.0))
    return smoothing.band(points(spark, sf_dir), 24, k).select("target_id", "name", "time", r("lower", 5), r("upper", 5), "anomaly")


@query(f"""WITH {METRIC_SQL}, n AS (SELECT target_id FROM mp GROUP BY 1 HAVING count(*) >= 1200)
SELECT target_id, name, count(*) AS n FROM mp WHERE target_id IN (SELECT target_id FROM n) GROUP BY 1, 2""")
def min_length_targets(spark, sf_dir):
    return frames.long_enough(points(spark, sf_dir), 1200).groupBy("target_id", "name").agg(F.count("*").alias("n"))


@query(f"""WITH {SPINE_SQL} SELECT target_id, name, count(*) FILTER (real_value IS NULL) AS missing,
  count(*) FILTER (real_value IS NULL AND seq > 56) AS missing_recent, count(*) AS steps,
  CASE WHEN count(*) FILTER (real_value IS NULL AND seq > 56) >= 3 OR count(*) FILTER (real_value IS NULL) > 5 THEN 'E704' ELSE 'OK' END AS error_code FROM fr GROUP BY 1, 2""")
def gap_status_c1_c2(spark, sf_dir):
    return frames.gap_status(frames.on_spine(points(spark, sf_dir)))


@query(f"WITH {FILLED_SQL} SELECT target_id, name, time, seq, round(filled, 6) AS filled FROM fi")
def interpolate_linear_both(spark, sf_dir):
    return frames.interpolate(frames.on_spine(points(spark, sf_dir))).select("target_id", "name", "time", "seq", r("filled"))


@query(f"""WITH {SPINE_SQL}, m AS (SELECT target_id, name, time, seq, CASE WHEN seq >= 5 AND name <> 'view' THEN real_value END AS real_value FROM fr),
nb AS (SELECT *, last_value(CASE WHEN real_value IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS x0, last_value(real_value IGNORE NULLS) OVER b AS y0,
    first_value(CASE WHEN real_value IS NOT NULL THEN seq END IGNORE NULLS) OVER a AS x1, first_value(real_value IGNORE NULLS) OVER a AS y1
  FROM m WINDOW b AS (PARTITION BY target_id, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY target_id, name ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT target_id, name, time, seq, round(coalesce(CASE WHEN real_value IS NOT NULL THEN real_value
    WHEN y0 IS NOT NULL AND y1 IS NOT NULL THEN y0 + (y1 - y0) * (seq - x0) / (x1 - x0) ELSE coalesce(y0, y1) END, 0), 6) AS filled FROM nb""")
def interpolate_ffill_bfill_zero(spark, sf_dir):
    """Leading gaps take the next value; a series whose values are all hidden takes 0."""
    framed = frames.on_spine(points(spark, sf_dir)).withColumn("real_value", F.when((F.col("seq") >= 5) & (F.col("name") != "view"), F.col("real_value")))
    return frames.interpolate(framed, both=False).select("target_id", "name", "time", "seq", r("filled"))


@query(f"""WITH {METRIC_SQL} SELECT target_id, time, {', '.join(f"round(avg(real_value) FILTER (name = '{n}'), 6) AS {n}" for n in NAMES)} FROM mp
WHERE name IN ({', '.join(f"'{n}'" for n in NAMES)}) GROUP BY 1, 2""")
def pivot_metric_wide(spark, sf_dir):
    wide = frames.pivot(points(spark, sf_dir), NAMES)
    return wide.select("target_id", "time", *(r(n) for n in NAMES))


@query(f"""WITH {METRIC_SQL}, t AS (SELECT DISTINCT target_id, time FROM mp WHERE name IN ({', '.join(f"'{n}'" for n in NAMES)}))
SELECT t.target_id, t.time, n.name, round(mp.real_value, 6) AS real_value FROM t CROSS JOIN (VALUES {', '.join(f"('{n}')" for n in NAMES)}) n(name)
LEFT JOIN mp ON mp.target_id = t.target_id AND mp.time = t.time AND mp.name = n.name""")
def unpivot_metric_long(spark, sf_dir):
    return frames.unpivot(frames.pivot(points(spark, sf_dir), NAMES), NAMES).select("target_id", "time", "name", r("real_value"))


@query(f"""WITH {METRIC_SQL} SELECT DISTINCT inst_type || '_' || target_id AS composite, split_part(inst_type || '_' || target_id, '_', 1) AS inst_part,
  regexp_replace(inst_type || '_' || target_id, '^[^_]*_', '') AS target_part FROM mp""")
def composite_key_split(spark, sf_dir):
    key = F.concat_ws("_", "inst_type", "target_id")
    return points(spark, sf_dir).select(key.alias("composite"), F.substring_index(key, "_", 1).alias("inst_part"), F.regexp_replace(key, "^[^_]*_", "").alias("target_part")).distinct()


@query("""SELECT s_suppkey, s_name, CASE WHEN contains(s_name, 'T') THEN 'TIBERO' WHEN contains(s_name, 'P') THEN 'POSTGRES' WHEN contains(s_name, 'Y') THEN 'MYSQL' ELSE 'ORACLE' END AS db_kind
FROM (SELECT s_suppkey, replace(replace(s_name, 'Supplier', CASE s_suppkey % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'P' WHEN 2 THEN 'Y' ELSE 'db' END), ' ', '') AS s_name FROM supplier) x""")
def db_kind_from_target(spark, sf_dir):
    """Database kind by a letter in the target's name; the first rule that holds counts."""
    key = F.col("s_suppkey") % 4
    name = F.replace(F.replace("s_name", F.lit("Supplier"), F.when(key == 0, "T").when(key == 1, "P").when(key == 2, "Y").otherwise("db")), F.lit(" "), F.lit(""))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("s_name"))
    n = F.col("s_name")
    return rows.withColumn("db_kind", F.when(n.contains("T"), "TIBERO").when(n.contains("P"), "POSTGRES").when(n.contains("Y"), "MYSQL").otherwise("ORACLE"))


@query(f"""WITH {METRIC_SQL}, a AS (SELECT max(time) - INTERVAL 10 HOUR AS t0 FROM mp), u AS (SELECT * FROM mp UNION SELECT * FROM mp WHERE name <> 'view')
SELECT time, target_id, name, round(real_value, 6) AS real_value, (time > t0 - INTERVAL 60 HOUR AND time <= t0) AS served FROM u, a
WHERE time > t0 - INTERVAL 65 HOUR AND time <= t0 + INTERVAL 5 HOUR""")
def dedup_and_late_filter(spark, sf_dir):
    """Saved and newly arrived points overlap; late and early ones are kept or served by their distance."""
    all_points = points(spark, sf_dir)
    at = all_points.select((F.max("time") - F.expr("INTERVAL '10' HOUR")).cast("timestamp_ntz")).scalar()
    out = frames.late_filter(all_points, all_points.where("name <> 'view'"), at)
    return out.select("time", "target_id", "name", r("real_value"), "served")


@query(f"""WITH {METRIC_SQL} SELECT target_id, name, time, round(real_value, 6) AS real_value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY target_id, name ORDER BY time DESC) AS rank FROM mp) x WHERE rank <= 30""")
def tail_window_30(spark, sf_dir):
    return frames.tail(points(spark, sf_dir)).select("target_id", "name", "time", r("real_value"), "rank")


WINDOW_SQL = f"""WITH {METRIC_SQL}, w AS (SELECT target_id, name, time, array_agg(real_value) OVER (PARTITION BY target_id, name ORDER BY time ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS win,
  lead(real_value) OVER (PARTITION BY target_id, name ORDER BY time) AS nx FROM mp)"""


@query(WINDOW_SQL + " SELECT target_id, name, time, CAST(len(win) AS INTEGER) AS n, round(win[1], 6) AS first_value, round(win[30], 6) AS last_value, round(list_sum(win), 4) AS total FROM w WHERE len(win) = 30")
def sliding_window_arrays(spark, sf_dir):
    w = F.col("window")
    total = F.round(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), 4)
    return frames.sliding(points(spark, sf_dir)).select("target_id", "name", "time", F.size(w).alias("n"), F.round(w[0], 6).alias("first_value"), F.round(w[29], 6).alias("last_value"), total.alias("total"))


@query(WINDOW_SQL + " SELECT target_id, name, time, round(nx, 6) AS next_value FROM w WHERE len(win) = 30 AND nx IS NOT NULL")
def window_next_value(spark, sf_dir):
    return frames.sliding(points(spark, sf_dir)).where("next_value IS NOT NULL").select("target_id", "name", "time", r("next_value"))


@query(f"""WITH {METRIC_SQL}, p AS (SELECT target_id, name, row_number() OVER (PARTITION BY target_id, name ORDER BY time) AS k, count(*) OVER (PARTITION BY target_id, name) AS n FROM mp)
SELECT target_id, name, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS part, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def chronological_split_counts(spark, sf_dir):
    own = Window.partitionBy("target_id", "name")
    k, n = F.row_number().over(own.orderBy("time")), F.count("*").over(own)
    rows = points(spark, sf_dir).select("target_id", "name", k.alias("k"), n.alias("total"))
    train = F.floor(F.col("total") * 0.8)
    part = F.when(F.col("k") <= train, "train").when(F.col("k") <= train + F.floor(F.col("total") * 0.1), "validation").otherwise("test")
    return rows.groupBy("target_id", "name", part.alias("part")).agg(F.count("*").alias("n"))


FIT_SQL = METRIC_SQL + ", sc AS (SELECT target_id, name, avg(real_value) AS mean, CASE WHEN stddev_pop(real_value) = 0 THEN 1 ELSE stddev_pop(real_value) END AS std FROM mp GROUP BY 1, 2)"


@query(f"WITH {FIT_SQL} SELECT target_id, name, round(mean, 6) AS mean, round(std, 6) AS std FROM sc")
def standard_scaler_fit(spark, sf_dir):
    return smoothing.scaler_fit(points(spark, sf_dir)).select("target_id", "name", r("mean"), r("std"))


@query(f"WITH {FIT_SQL} SELECT target_id, name, time, round((real_value - mean) / std, 5) AS scaled, round(greatest((real_value - mean) / std * std + mean, 0), 8) AS back FROM mp JOIN sc USING (target_id, name)")
def standard_scale_inverse(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = smoothing.scale(p, smoothing.scaler_fit(p))
    return rows.select("target_id", "name", "time", r("scaled", 5), F.round(F.greatest(F.col("scaled") * F.col("std") + F.col("mean"), F.lit(0.0)), 8).alias("back"))


@query(f"WITH {METRIC_SQL} SELECT target_id, name, time, round((real_value - min(real_value) OVER w) / (max(real_value) OVER w - min(real_value) OVER w + 1e-7), 6) AS scaled FROM mp WINDOW w AS (PARTITION BY target_id, name)")
def minmax_scale(spark, sf_dir):
    return smoothing.min_max(points(spark, sf_dir)).select("target_id", "name", "time", r("scaled"))


@query(f"""WITH {FILLED_SQL} SELECT a.target_id, a.name, a.time, a.seq, round(sum(b.filled * power(0.5, a.seq - b.seq)) / sum(power(0.5, a.seq - b.seq)), 5) AS ewm
FROM fi a JOIN fi b ON a.target_id = b.target_id AND a.name = b.name AND b.seq <= a.seq WHERE a.filled IS NOT NULL GROUP BY 1, 2, 3, 4""")
def ewm_span3(spark, sf_dir):
    filled = frames.interpolate(frames.on_spine(points(spark, sf_dir)))
    return smoothing.ewm(filled.where("filled IS NOT NULL"), "filled").select("target_id", "name", "time", "seq", r("ewm", 5))


@query(f"""WITH {METRIC_SQL}, w AS (SELECT target_id, name, real_value, avg(real_value) OVER f AS ma, count(*) OVER f AS n FROM mp WINDOW f AS (PARTITION BY target_id, name ORDER BY time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT target_id, name, count(*) AS windows, count(*) FILTER (abs(ma - real_value) < 1e-9) AS equal_steps, count(*) FILTER (abs(ma - real_value) < 1e-9) >= 0.9 * count(*) AS flat FROM w WHERE n = 10 GROUP BY 1, 2""")
def moving_average_flatline(spark, sf_dir):
    return flatline(points(spark, sf_dir))


def flatline(p: DataFrame) -> DataFrame:
    """A series that equals its own ten-step mean at nine tenths of its full windows is a flat line."""
    frame = Window.partitionBy("target_id", "name").orderBy("time").rowsBetween(-9, 0)
    rows = p.select("target_id", "name", "real_value", F.avg("real_value").over(frame).alias("ma"), F.count("*").over(frame).alias("n")).where("n = 10")
    same = F.abs(F.col("ma") - F.col("real_value")) < 1e-9
    return rows.groupBy("target_id", "name").agg(F.count("*").alias("windows"), F.count_if(same).alias("equal_steps")).withColumn("flat", F.col("equal_steps") >= 0.9 * F.col("windows"))


@query(f"""WITH {METRIC_SQL} SELECT target_id, name, time, round(avg(real_value) OVER (PARTITION BY target_id, name ORDER BY time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 5) AS back_mean,
  round(real_value - avg(real_value) OVER (PARTITION BY target_id, name ORDER BY time ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 5) AS residual FROM mp""")
def drift_residual(spark, sf_dir):
    order = Window.partitionBy("target_id", "name").orderBy("time")
    back = F.round(F.avg("real_value").over(order.rowsBetween(-9, 0)), 5)
    return points(spark, sf_dir).select("target_id", "name", "time", back.alias("back_mean"), F.round(F.col("real_value") - F.avg("real_value").over(order.rowsBetween(-10, -1)), 5).alias("residual"))


@query(f"""WITH {FILLED_SQL}, s AS (SELECT *, avg(filled) OVER w AS m, sqrt(var_pop(filled) OVER w + 1e-5) AS d FROM fi WINDOW w AS (PARTITION BY target_id, name))
SELECT target_id, name, time, round((filled - m) / d, 5) AS normed, round((filled - m) / d * d + m, 6) AS restored FROM s""")
def rev_instance_norm(spark, sf_dir):
    """Each window is normalised by its own mean and deviation, and restored by them."""
    own = Window.partitionBy("target_id", "name")
    rows = frames.interpolate(frames.on_spine(points(spark, sf_dir))).withColumns({"m": F.avg("filled").over(own), "d": F.sqrt(F.var_pop("filled").over(own) + 1e-5)})
    normed = (F.col("filled") - F.col("m")) / F.col("d")
    return rows.select("target_id", "name", "time", F.round(normed, 5).alias("normed"), F.round(normed * F.col("d") + F.col("m"), 6).alias("restored"))


@query(f"""WITH {METRIC_SQL}, t AS (SELECT target_id, name, time, real_value FROM (SELECT *, row_number() OVER (PARTITION BY target_id, name ORDER BY time DESC) AS k FROM mp) x WHERE k <= 5),
m AS (SELECT target_id, name, time, i, real_value * (1 + 0.01 * ((i * 7919) % 101 - 50) / 50) AS v FROM t, range(50) r(i)),
s AS (SELECT target_id, name, time, avg(v) AS mu, stddev_pop(v) AS sd FROM m GROUP BY 1, 2, 3)
SELECT target_id, name, time, round(mu, 4) AS mean, round(sd, 4) AS std, round(greatest(mu - 3 * sd, 0), 4) AS lower, round(mu + 3 * sd, 4) AS upper FROM s""")
def mc_band_mean_std(spark, sf_dir):
    """Band from 50 replicas of each forecast; the replicas' noise follows from their number."""
    latest = frames.tail(points(spark, sf_dir), 5)
    replicas = latest.select("target_id", "name", "time", "real_value", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i"))
    v = F.col("real_value") * (1 + 0.01 * ((F.col("i") * 7919) % 101 - 50) / 50)
    s = replicas.groupBy("target_id", "name", "time").agg(F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd"))
    low, high = F.greatest(F.col("mu") - 3 * F.col("sd"), F.lit(0.0)), F.col("mu") + 3 * F.col("sd")
    return s.select("target_id", "name", "time", F.round("mu", 4).alias("mean"), F.round("sd", 4).alias("std"), F.round(low, 4).alias("lower"), F.round(high, 4).alias("upper"))


BAND_SQL = METRIC_SQL + """, bw AS (SELECT *, count(real_value) OVER f AS n, avg(real_value) OVER f AS mu, stddev_pop(real_value) OVER f AS sd FROM mp
  WINDOW f AS (PARTITION BY target_id, name ORDER BY time ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
bd AS (SELECT *, greatest(mu - 2 * sd, 0) AS lower, mu + 2 * sd AS upper FROM bw WHERE n = 24)"""


@query(f"""WITH {BAND_SQL} SELECT target_id, name, time, round(real_value, 5) AS real_value, round(lower, 5) AS lower, round(upper, 5) AS upper,
  (real_value > upper OR real_value < lower) AND real_value >= 0.1 AS anomaly FROM bd""")
def sigma_band_anomaly(spark, sf_dir):
    return smoothing.band(points(spark, sf_dir), 24, 2.0).select("target_id", "name", "time", r("real_value", 5), r("lower", 5), r("upper", 5), "anomaly")


@query(f"""WITH {BAND_SQL} SELECT target_id, name, time, round(CASE WHEN real_value > upper THEN real_value - upper WHEN real_value < lower THEN lower - real_value ELSE 0 END, 5) AS deviation,
  round(CASE WHEN sd <> 0 THEN (real_value - mu) / sd END, 5) AS z_score FROM bd WHERE (real_value > upper OR real_value < lower) AND real_value >= 0.1""")
def band_zscore_deviation(spark, sf_dir):
    return smoothing.band(points(spark, sf_dir), 24, 2.0).where("anomaly").select("target_id", "name", "time", r("deviation", 5), r("z_score", 5))


BASE_SQL = METRIC_SQL + ", bl AS (SELECT target_id, name, hour(time) AS hour_of_day, CASE WHEN isodow(time) >= 6 THEN 1 ELSE 0 END AS day_kind, avg(real_value) AS mean, stddev_pop(real_value) AS std, count(*) AS n FROM mp GROUP BY 1, 2, 3, 4)"


def baseline(p: DataFrame) -> DataFrame:
    """Mean and deviation for each hour of the day on workdays (0) and weekends (1)."""
    kind = F.when(F.weekday("time") >= 5, 1).otherwise(0)
    return p.groupBy("target_id", "name", F.hour("time").alias("hour_of_day"), kind.alias("day_kind")).agg(F.avg("real_value").alias("mean"), F.stddev_pop("real_value").alias("std"), F.count("*").alias("n"))


@query(f"WITH {BASE_SQL} SELECT target_id, name, CAST(hour_of_day AS INTEGER) AS hour_of_day, day_kind, round(mean, 5) AS mean, round(std, 5) AS std, n FROM bl")
def dynamic_baseline_table(spark, sf_dir):
    return baseline(points(spark, sf_dir)).select("target_id", "name", "hour_of_day", "day_kind", r("mean", 5), r("std", 5), "n")


@query(f"""WITH {BASE_SQL} SELECT p.target_id, p.name, p.time, round(b.mean, 5) AS predict_value, round(greatest(b.mean - 3 * b.std, 0), 5) AS predict_lower, round(b.mean + 3 * b.std, 5) AS predict_upper
FROM mp p LEFT JOIN bl b ON p.target_id = b.target_id AND p.name = b.name AND hour(p.time) = b.hour_of_day AND (CASE WHEN isodow(p.time) >= 6 THEN 1 ELSE 0 END) = b.day_kind""")
def dynamic_baseline_lookup(spark, sf_dir):
    p = points(spark, sf_dir)
    keyed = p.withColumns({"hour_of_day": F.hour("time"), "day_kind": F.when(F.weekday("time") >= 5, 1).otherwise(0)})
    rows = keyed.join(baseline(p), ["target_id", "name", "hour_of_day", "day_kind"], "left")
    return rows.select("target_id", "name", "time", F.round("mean", 5).alias("predict_value"), F.round(F.greatest(F.col("mean") - 3 * F.col("std"), F.lit(0.0)), 5).alias("predict_lower"), F.round(F.col("mean") + 3 * F.col("std"), 5).alias("predict_upper"))


@query("""WITH d AS (SELECT o_custkey, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS INTEGER) AS days FROM orders GROUP BY 1)
SELECT o_custkey, days, CASE WHEN days < 2 THEN -1 WHEN days < 7 THEN 0 WHEN days < 14 THEN 1 WHEN days < 56 THEN 2 ELSE 3 END AS mode FROM d""")
def training_mode_by_days(spark, sf_dir):
    """Training mode by the days that data covers: none, daily, working day, weekday or business day."""
    days = F.datediff(F.max("o_orderdate"), F.min("o_orderdate"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(days.alias("days"))
    d = F.col("days")
    return rows.withColumn("mode", F.when(d < 2, -1).when(d < 7, 0).when(d < 14, 1).when(d < 56, 2).otherwise(3))


@query(f"""WITH {METRIC_SQL}, ev AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, CASE user_id % 3 WHEN 0 THEN 'was' WHEN 1 THEN 'db' ELSE 'os' END || '_' || CAST(user_id % 3 AS VARCHAR) AS target_id FROM events),
ba AS (SELECT target_id, event_type AS name, isodow(ts) - 1 AS weekday, strftime(ts, '%H:%M') AS minute, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM ev WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2, 3, 4),
sv AS (SELECT target_id, event_type AS name, date_trunc('minute', ts) AS time, count(*) AS seen FROM ev WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2, 3)
SELECT sv.target_id, sv.name, sv.time, sv.seen, ba.n, round(ba.cents / (100.0::DOUBLE * ba.n), 4) AS baseline FROM sv LEFT JOIN ba ON sv.target_id = ba.target_id AND sv.name = ba.name AND isodow(sv.time) - 1 = ba.weekday AND strftime(sv.time, '%H:%M') = ba.minute""")
def baseline_by_minute_and_weekday(spark, sf_dir):
    """Served minutes with the baseline of their weekday and minute of the day, null where there is none."""
    rows = table(spark, sf_dir, "events")
    own = F.concat_ws("_", kind_of(F.col("user_id")), (F.col("user_id") % 3).cast("string")).alias("target_id")
    rows = rows.select(own, F.col("event_type").alias("name"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("time"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    keyed = rows.withColumns({"weekday": F.weekday("time"), "minute": F.date_format("time", "HH:mm")})
    split = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    known = keyed.where(F.col("time") < split).groupBy("target_id", "name", "weekday", "minute").agg(F.count("*").alias("n"), (F.sum("cents") / (100.0 * F.count("*"))).alias("baseline"))
    served = keyed.where(F.col("time") >= split).groupBy("target_id", "name", "time", "weekday", "minute").agg(F.count("*").alias("seen"))
    found = served.join(known, ["target_id", "name", "weekday", "minute"], "left")
    return found.select("target_id", "name", "time", "seen", "n", F.round("baseline", 4).alias("baseline"))
