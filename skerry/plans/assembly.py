"""Queries that put requests in and results out, and those around models and training sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skerry.functions import text
from skerry.operators import frames, models, serving, smoothing
from skerry.sources import envelopes, relations, sinks
from skerry.sources.relations import METRIC_SQL
from skerry.sources.written import folder, written

from .logs import KEY_SQL, RARE_SQL, SHAPED_SQL, rarity, shaped
from .metrics import BAND_SQL, points, r
from .registry import query

KEYS = ["target_id", "name"]


@query(f"WITH {METRIC_SQL} SELECT target_id, inst_type, name, time, round(real_value, 6) AS real_value, CAST(NULL AS VARCHAR) AS error_code FROM mp")
def request_envelope_parse(spark, sf_dir):
    """Points as requests in JSON (a header and an untyped body) and read back from them."""
    return relations.parse_envelopes(requests(points(spark, sf_dir))).select("target_id", "inst_type", "name", "time", r("real_value"), "error_code")


def requests(p):
    """Requests in JSON, each with a day of one target's points."""
    p = p.withColumn("day", F.to_date("time"))  # a request holds a day of one target
    cell = F.create_map(F.lit("time"), F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.col("name"), F.format_string("%.17g", "real_value"))
    bodies = p.groupBy("target_id", "inst_type", "day").agg(F.collect_list(cell).alias("body"))
    header = F.struct(F.lit("1").alias("sys_id"), "target_id", "inst_type")
    return bodies.select(F.to_json(F.struct(F.lit("module").alias("id1"), F.lit("2024-01-30 00:00:00").alias("standard_datetime"), header.alias("header"), "body")).alias("value"), "day")


@query(f"WITH {METRIC_SQL} SELECT target_id, inst_type, name, time, round(real_value, 6) AS real_value, CAST(NULL AS VARCHAR) AS error_code FROM mp")
def request_envelope_stream(spark, sf_dir):
    """The same requests in a folder for each day, read as a stream by the data source."""
    spark.dataSource.register(envelopes.Envelopes)
    root, out = folder(spark, "requests"), folder(spark, "requests-read")
    requests(points(spark, sf_dir)).write.partitionBy("day").text(root)
    stream = spark.readStream.format("envelopes").load(root)
    stream.writeStream.format("parquet").option("checkpointLocation", folder(spark, "requests-state")).trigger(availableNow=True).start(out).awaitTermination()
    rows = spark.read.schema(envelopes.SCHEMA).parquet(out)
    return rows.select("target_id", "inst_type", "name", "time", r("real_value"), "error_code")


@query(f"""WITH {BAND_SQL}, an AS (SELECT target_id, name, time, CASE WHEN real_value > upper THEN 'upper' ELSE 'lower' END AS side FROM bd WHERE (real_value > upper OR real_value < lower) AND real_value >= 0.1)
SELECT b.target_id, b.name, b.time, round(b.mu, 6) AS predict_value, round(b.lower, 6) AS predict_lower, round(b.upper, 6) AS predict_upper, coalesce(an.side, '') AS anomaly_side
FROM bd b LEFT JOIN an ON b.target_id = an.target_id AND b.name = an.name AND b.time = an.time""")
def baseline_result_assembly(spark, sf_dir):
    """Every prediction with its anomaly's columns, empty where there is none."""
    rows = smoothing.band(points(spark, sf_dir), 24, 2.0)
    side = F.when(F.col("real_value") > F.col("upper"), "upper").otherwise("lower")
    found = rows.where("anomaly").select(*KEYS, "time", side.alias("side"))
    out = rows.select(*KEYS, "time", F.round("mean_before", 6).alias("predict_value"), F.round("lower", 6).alias("predict_lower"), F.round("upper", 6).alias("predict_upper")).join(found, [*KEYS, "time"], "left")
    return out.select(*KEYS, "time", "predict_value", "predict_lower", "predict_upper", F.coalesce("side", F.lit("")).alias("anomaly_side"))


@query(f"""WITH {BAND_SQL}, an AS (SELECT *, real_value - CASE WHEN real_value > upper THEN upper ELSE lower END AS deviation FROM bd WHERE (real_value > upper OR real_value < lower) AND real_value >= 0.1)
SELECT b.target_id, b.name, b.time, round(b.real_value, 6) AS real_value, round(b.mu, 6) AS dbsln_value, round(b.lower, 6) AS dbsln_lower, round(b.upper, 6) AS dbsln_upper,
  an.target_id IS NOT NULL AS is_anomaly, CASE WHEN an.target_id IS NOT NULL THEN round(b.mu, 6) END AS avg, CASE WHEN an.target_id IS NOT NULL THEN round((b.upper - b.mu) / 2, 6) END AS std,
  round(an.deviation, 6) AS deviation, CASE WHEN an.target_id IS NOT NULL THEN round((b.real_value - b.mu) / nullif((b.upper - b.mu) / 2, 0), 4) END AS zscore
FROM bd b LEFT JOIN an ON b.target_id = an.target_id AND b.name = an.name AND b.time = an.time""")
def baseline_result_columns(spark, sf_dir):
    """Each point with its band, and where it is outside the columns of its anomaly; the band is two deviations wide on either side."""
    rows = smoothing.band(points(spark, sf_dir), 24, 2.0)
    std = (F.col("upper") - F.col("mean_before")) / 2
    away = F.col("real_value") - F.when(F.col("real_value") > F.col("upper"), F.col("upper")).otherwise(F.col("lower"))
    only = lambda c: F.when(F.col("anomaly"), c)
    return rows.select(*KEYS, "time", r("real_value"), F.round("mean_before", 6).alias("dbsln_value"), F.round("lower", 6).alias("dbsln_lower"), F.round("upper", 6).alias("dbsln_upper"), F.col("anomaly").alias("is_anomaly"),
        only(F.round("mean_before", 6)).alias("avg"), only(F.round(std, 6)).alias("std"), only(F.round(away, 6)).alias("deviation"), only(F.round(F.try_divide(F.col("real_value") - F.col("mean_before"), std), 4)).alias("zscore"))


@query(f"""WITH {BAND_SQL}, fl AS (SELECT target_id, name, time, ((real_value > upper OR real_value < lower) AND real_value >= 0.1)::INTEGER AS f FROM bd),
w AS (SELECT *, avg(f) OVER x AS ratio, count(f) OVER x AS n FROM fl WINDOW x AS (PARTITION BY target_id, name ORDER BY time ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT target_id, name, count(*) AS windows, count(*) FILTER (ratio < 0.06) AS kept FROM w WHERE n = 60 GROUP BY 1, 2""")
def window_anomaly_ratio_filter(spark, sf_dir):
    """Windows whose 60 steps before them are calm enough to train on."""
    rows = smoothing.band(points(spark, sf_dir), 24, 2.0).withColumn("f", F.col("anomaly").cast("int"))
    frame = Window.partitionBy(*KEYS).orderBy("time").rowsBetween(-60, -1)
    w = rows.withColumns({"ratio": F.avg("f").over(frame), "n": F.count("f").over(frame)}).where("n = 60")
    return w.groupBy(*KEYS).agg(F.count("*").alias("windows"), F.count_if(F.col("ratio") < 0.06).alias("kept"))


@query(f"WITH {METRIC_SQL}, n AS (SELECT DISTINCT target_id, name FROM mp) SELECT a.target_id, a.name AS src, b.name AS dst FROM n a JOIN n b ON a.target_id = b.target_id AND a.name <> b.name")
def fully_connected_edges(spark, sf_dir):
    """Edges between all metrics of a target: an equi-join of a few names for each target."""
    n = points(spark, sf_dir).select(*KEYS).distinct()
    return n.select("target_id", F.col("name").alias("src")).join(n.select("target_id", F.col("name").alias("dst")), "target_id").where("src <> dst")


@query(f"""WITH {SHAPED_SQL}, tm AS (SELECT tpl, row_number() OVER (ORDER BY n DESC, tpl) AS id FROM (SELECT tpl, count(*) AS n FROM sh GROUP BY 1) x QUALIFY id <= 10)
SELECT sh.target_id, coalesce(tm.id, 11) AS template_id, count(*) AS lines, string_agg(DISTINCT array_to_string([CASE WHEN i = coalesce(tm.id, 11) THEN '1' ELSE '0' END FOR i IN range(1, 12)], ''), ',') AS one_hot
FROM sh LEFT JOIN tm ON sh.tpl = tm.tpl GROUP BY 1, 2""")
def template_match_one_hot(spark, sf_dir):
    """Lines matched with the ten most frequent templates, others with one more, as one-hot vectors; lines are read and masked once."""
    counts = written(shaped(spark, sf_dir).groupBy("target_id", "tpl").agg(F.count("*").alias("n")), "counts")
    top = counts.groupBy("tpl").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "tpl").limit(10)
    ids = top.withColumn("id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc(), "tpl"))).select("tpl", "id")  # ten rows
    rows = counts.join(F.broadcast(ids), "tpl", "left").groupBy("target_id", F.coalesce("id", F.lit(11)).cast("long").alias("template_id")).agg(F.sum("n").alias("lines"))
    return rows.withColumn("one_hot", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: (i == F.col("template_id")).cast("int").cast("string")), ""))


@query(f"""WITH {RARE_SQL}, k AS (SELECT target_id, CASE WHEN {KEY_SQL} <> '' AND sparse THEN 1 WHEN sparse THEN 2 WHEN {KEY_SQL} <> '' THEN 3 ELSE 0 END AS d FROM sp)
SELECT 'sparse' AS kind, target_id, count(*) AS n FROM k WHERE d IN (1, 2) GROUP BY 2 UNION ALL SELECT 'keyword', target_id, count(*) FROM k WHERE d IN (1, 3) GROUP BY 2""")
def log_detection_tables(spark, sf_dir):
    """Summaries of the tables into which detections are split."""
    rows = rarity(spark, sf_dir)
    rows = rows.withColumn("detection_type", text.detection_type(F.col("keyword").isNotNull(), F.col("sparse")))
    tables = sinks.detection_tables(rows.select("target_id", "detection_type"))
    return tables["sparse_summary"].select(F.lit("sparse").alias("kind"), "target_id", "n").unionByName(tables["keyword_summary"].select(F.lit("keyword").alias("kind"), "target_id", "n"))


@query(f"""WITH {METRIC_SQL}, w AS (SELECT target_id, name, array_agg(real_value ORDER BY time) AS v FROM (SELECT *, row_number() OVER (PARTITION BY target_id, name ORDER BY time DESC) AS k FROM mp) x WHERE k <= 60 GROUP BY 1, 2),
s AS (SELECT CAST(i AS INTEGER) AS step FROM range(1, 31) t(i))
SELECT target_id, name, 'persistence' AS model, step, round(v[len(v)], 6) AS predict_value FROM w, s
UNION ALL SELECT target_id, name, 'moving_average', step, round(list_avg(v[-10:]), 6) FROM w, s
UNION ALL SELECT target_id, name, 'linear', step, round(v[len(v)] + (v[len(v)] - v[1]) / (len(v) - 1) * step, 6) FROM w, s
UNION ALL SELECT target_id, name, 'seasonal', step, round(v[len(v) - 24 + 1 + (step - 1) % 24], 6) FROM w, s""")
def forecast_model_registry(spark, sf_dir):
    """Every registered model's forecast from the last 60 values of each series."""
    past = frames.tail(points(spark, sf_dir), 60).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("time", "real_value"))).alias("p"))
    past = past.select(*KEYS, F.transform("p", lambda x: x["real_value"]).alias("v"))
    one = lambda n: F.struct(F.lit(n).alias("model"), models.score(n, F.col("v")).alias("values"))
    rows = past.select(*KEYS, F.explode(F.array(*(one(n) for n in ("persistence", "moving_average", "linear", "seasonal")))).alias("m"))
    steps = rows.select(*KEYS, "m.model", F.posexplode("m.values").alias("pos", "value"))
    return steps.select(*KEYS, "model", (F.col("pos") + 1).alias("step"), F.round("value", 6).alias("predict_value"))


@query(f"""WITH {METRIC_SQL}, h AS (SELECT *, md5(concat_ws(':', '7', target_id, name, strftime(time, '%Y%m%d%H%M%S'))) AS d FROM mp),
u AS (SELECT *, (CAST('0x' || substring(d, 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS a, (CAST('0x' || substring(d, 9, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS b, (CAST('0x' || substring(d, 17, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS c FROM h)
SELECT target_id, name, time, CASE WHEN c < 0.2 THEN 'validation' ELSE 'train' END AS part, round(real_value, 6) AS real_value, round(real_value * (1 + 0.002 * sqrt(-2 * ln(a)) * cos(2 * pi() * b)), 6) AS augmented FROM u""")
def training_augmentation(spark, sf_dir):
    """A seeded split (a fifth for validation) and values times 1 + 0.002 normal noise, both fixed by each row's keys."""
    keys = (*KEYS, F.date_format("time", "yyyyMMddHHmmss"))
    part = F.when(serving.uniform(7, *keys, part=2) < 0.2, "validation").otherwise("train")
    noisy = F.col("real_value") * (1 + 0.002 * serving.normal(7, *keys))
    rows = points(spark, sf_dir).withColumns({"part": part, "augmented": noisy})
    return rows.select(*KEYS, "time", "part", r("real_value"), r("augmented"))
