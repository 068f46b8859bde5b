"""Queries around serving: features, attention, headers, periods and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from skerry.operators import serving
from skerry.sources import store
from skerry.sources.relations import LOG_SQL, METRIC_SQL, log_lines, table
from skerry.sources.written import folder

from .detection import KEYS, SCORED_SQL, scored
from .logs import BY, log_window_line_avg_score
from .metrics import points
from .registry import ORACLE, query


@query("SELECT event_id, CASE WHEN value >= 245 THEN round(sqrt(value - 245), 6) END AS root FROM events")
def nan_to_null(spark, sf_dir):
    root = serving.nan_to_null(F.sqrt(F.col("value") - 245))
    return table(spark, sf_dir, "events").select("event_id", F.round(root, 6).alias("root"))


@query("SELECT event_id, floor(value * 10) / 10.0::DOUBLE AS cut, floor(-value * 10) / 10.0::DOUBLE AS cut_below FROM events")
def floor_decimals(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", serving.floor_to(F.col("value"), 1).alias("cut"), serving.floor_to(-F.col("value"), 1).alias("cut_below"))


@query("SELECT event_id, base64(encode(props)) AS encoded, props AS decoded FROM events")
def base64_round_trip(spark, sf_dir):
    encoded = F.base64(F.encode("props", "UTF-8"))
    return table(spark, sf_dir, "events").select("event_id", encoded.alias("encoded"), F.decode(F.unbase64(encoded), "UTF-8").alias("decoded"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, isodow(ts) AS w, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT * FROM (VALUES ('daily', '0000000'), ('workingday', '0000055'), ('weekday', '0123456'), ('bizday', '0123456')) v(mode, buckets))
SELECT m.mode, CAST(substring(m.buckets, CAST(d.w AS INTEGER), 1) AS INTEGER) AS bucket, CAST(sum(d.n) AS BIGINT) AS n FROM d, m GROUP BY 1, 2""")
def weekday_bucket_counts(spark, sf_dir):
    """Events of each bucket of weekdays, by training mode."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    buckets = F.array(*(F.struct(F.lit(m).alias("mode"), serving.weekday_bucket(F.col("day"), m).alias("bucket")) for m in serving.WEEKDAY_BUCKETS))
    return days.select(F.explode(buckets).alias("b"), "n").groupBy("b.mode", "b.bucket").agg(F.sum("n").alias("n"))


@query(f"""WITH {METRIC_SQL}, al AS (SELECT target_id, time, name, real_value FROM mp UNION ALL SELECT target_id, time, name || '_upper', real_value + 1 FROM mp UNION ALL SELECT target_id, time, 'lower_' || name, real_value - 1 FROM mp UNION ALL SELECT target_id, time, 'socket_count', 1.0 FROM mp WHERE name = 'view')
SELECT target_id, name, count(*) AS n FROM al WHERE name <> 'socket_count' AND NOT contains(name, 'upper') AND NOT contains(name, 'lower') GROUP BY 1, 2""")
def metric_feature_filter(spark, sf_dir):
    """Metrics that a model may take, out of points, bounds of forecasts and a removed metric."""
    p = points(spark, sf_dir).select("target_id", "time", "name", "real_value")
    named = [p, p.withColumns({"name": F.concat("name", F.lit("_upper")), "real_value": F.col("real_value") + 1}), p.withColumns({"name": F.concat(F.lit("lower_"), "name"), "real_value": F.col("real_value") - 1}), p.where("name = 'view'").withColumns({"name": F.lit("socket_count"), "real_value": F.lit(1.0)})]
    return serving.features(reduce(lambda a, b: a.unionByName(b), named)).groupBy(*KEYS).agg(F.count("*").alias("n"))


@query(f"""WITH {SCORED_SQL}, av AS (SELECT target_id, time, avg(score) < 50 AS bad, array_agg(name ORDER BY name) AS names, array_agg(loss ORDER BY name) AS ls FROM sd GROUP BY 1, 2),
ro AS (SELECT *, unnest(range(1, len(names) + 1)) AS i, list_sum(ls) AS total FROM av),
am AS (SELECT target_id, time, names[i] AS name, bad, names, [CASE WHEN j = i THEN ls[j] / total ELSE ls[j] / (total - ls[i]) END FOR j IN range(1, len(names) + 1)] AS att FROM ro WHERE total > ls[i])
SELECT target_id, time, name, array_to_string([printf('%.4f', x) FOR x IN att], ',') AS attention, CASE WHEN bad THEN array_to_string([names[j] || ':' || printf('%.4f', round(att[j], 4)) FOR j IN range(1, len(names) + 1)], ',') END AS attention_map FROM am""")
def attention_matrix(spark, sf_dir):
    """Rows of each target's attention matrix with the own term on the diagonal, and maps by metric where there is an anomaly.

    No trained network is at hand, so attention to another metric is its share of the others' loss, and the own one the share of all.
    """
    by = Window.partitionBy("target_id", "time")
    pairs = F.sort_array(F.collect_list(F.struct("name", "loss")).over(by))
    rows = scored(spark, sf_dir).withColumns({"pairs": pairs, "bad": F.avg("score").over(by) < 50})
    rows = rows.withColumn("total", F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x["loss"])).where("total > loss")
    others = F.transform(F.filter("pairs", lambda x: x["name"] != F.col("name")), lambda x: x["loss"] / (F.col("total") - F.col("loss")))
    place = F.size(F.filter("pairs", lambda x: x["name"] < F.col("name")))
    rows = rows.withColumn("att", serving.with_own(others, F.col("loss") / F.col("total"), place))
    found = serving.attention_map(F.transform("pairs", lambda x: x["name"]), F.col("att"), F.col("bad"))
    shown = F.transform(F.map_entries(found), lambda e: F.concat(e["key"], F.lit(":"), F.format_string("%.4f", e["value"])))
    return rows.select(*KEYS, "time", F.array_join(F.transform("att", lambda x: F.format_string("%.4f", x)), ",").alias("attention"), F.array_join(shown, ",").alias("attention_map"))


HEADER_SQL = "WITH li AS ({lines}), c AS (SELECT target_id, count(*) AS t, count(*) FILTER (line_score > 0.5) AS a FROM li GROUP BY 1) SELECT target_id, CASE WHEN a > 0 THEN t END AS total_count, CASE WHEN a > 0 THEN a END AS anomaly_count, CASE WHEN a > 0 THEN a > 20 END AS anomaly FROM c"


@query(HEADER_SQL.format(lines=ORACLE["log_window_line_avg_score"]))
def log_serving_header(spark, sf_dir):
    """Headers of all scored lines: a document is a minute, and the first one is the serving minute."""
    first = table(spark, sf_dir, "documents").agg(F.min("doc_id")).first()[0]
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    rows = log_window_line_avg_score(spark, sf_dir).withColumn("time", start + F.make_dt_interval(mins=F.col("doc_id").cast("int")))
    return serving.header(rows, start + F.make_dt_interval(mins=F.lit(first).cast("int")), 0.5, 20).select(*BY, "header.total_count", "header.anomaly_count", "header.anomaly")


@query("""SELECT event_type AS name, count(*) AS n, strftime(least(min(CAST(ts AS DATE)), DATE '2024-01-10'), '%Y%m%d') AS mined_from, strftime(greatest(max(CAST(ts AS DATE)), DATE '2024-01-20'), '%Y%m%d') AS mined_to
FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-10' OR CAST(ts AS DATE) > DATE '2024-01-20' GROUP BY 1""")
def mining_period_update(spark, sf_dir):
    """Rows of days that are not mined yet, and the period after they are."""
    first, last = F.to_date(F.lit("2024-01-10")), F.to_date(F.lit("2024-01-20"))
    rows = serving.unmined(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.to_date("ts").alias("day")), "day", first, last)
    out = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("day").alias("lo"), F.max("day").alias("hi"))
    return out.select("name", "n", F.date_format(F.least("lo", first), "yyyyMMdd").alias("mined_from"), F.date_format(F.greatest("hi", last), "yyyyMMdd").alias("mined_to"))


@query("SELECT event_id, event_type FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 500")
def training_sample(spark, sf_dir):
    """Rows drawn without replacement, as a training run takes them."""
    return serving.draw(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], 500, 7)


@query(f"WITH {LOG_SQL} SELECT target_id, doc_id, pos, msg, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS _time FROM ll WHERE msg <> ''")
def log_line_reshape(spark, sf_dir):
    """Lines that are not empty, as sequences take them (a document is a minute)."""
    time = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    return log_lines(table(spark, sf_dir, "documents")).where("msg <> ''").withColumn("_time", time)


@query(f"""WITH {METRIC_SQL}, st AS (SELECT target_id, name, count(*) AS n, round(max(real_value), 6) AS top FROM mp GROUP BY 1, 2)
SELECT * FROM st UNION ALL SELECT DISTINCT target_id, 'none', NULL, NULL FROM st""")
def key_value_lookup(spark, sf_dir):
    """Statistics written as values by key and read back for all keys asked, of which one for each target has no value."""
    stats = points(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n"), F.round(F.max("real_value"), 6).alias("top"))
    path = folder(spark, "values")
    store.put(stats, path, KEYS)
    asked = stats.select(*KEYS)
    asked = asked.unionByName(asked.select("target_id", F.lit("none").alias("name")).distinct())
    return store.get(asked, path, KEYS, "n long, top double")
