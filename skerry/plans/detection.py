"""Queries for scoring, forecasting, events, thresholds and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from skerry.operators import frames, kernels, scoring, smoothing, thresholds
from skerry.operators.ordering import joined
from skerry.sources.relations import METRIC_SQL
from skerry.sources.written import written

from .metrics import BASE_SQL, FILLED_SQL, baseline, points, r
from .registry import query

KEYS = ["target_id", "name"]

#: loss of each point: distance from the mean of the 24 before it
LOSS_SQL = METRIC_SQL + """, lw AS (SELECT *, count(real_value) OVER f AS n, avg(real_value) OVER f AS mu FROM mp WINDOW f AS (PARTITION BY target_id, name ORDER BY time ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
lo AS (SELECT target_id, name, inst_type, time, real_value, mu AS model_value, round(abs(real_value - mu), 8) AS loss FROM lw WHERE n = 24)"""

TABLE_SQL = LOSS_SQL + """, td AS (SELECT DISTINCT target_id, name, loss FROM lo WHERE time < TIMESTAMP '2024-01-20'),
tb AS (SELECT *, 100 - 100 * percent_rank() OVER (PARTITION BY target_id, name ORDER BY loss) AS score FROM td),
nw AS (SELECT * FROM lo WHERE time >= TIMESTAMP '2024-01-20')"""

SCORED_SQL = TABLE_SQL + ", sd AS (SELECT nw.target_id, nw.name, nw.inst_type, nw.time, nw.real_value, nw.model_value, nw.loss, tb.score FROM nw ASOF LEFT JOIN tb ON nw.target_id = tb.target_id AND nw.name = tb.name AND nw.loss >= tb.loss)"

ANOM_SQL = SCORED_SQL + """, ts AS (SELECT target_id, inst_type, time, avg(score) AS raw, sum(loss) AS total FROM sd GROUP BY 1, 2, 3),
gr AS (SELECT *, CASE WHEN raw > 5 THEN round_even(raw, 1) ELSE 5 END AS normality_score FROM ts)"""


def losses(spark, sf_dir):
    return losses_of(points(spark, sf_dir))


def losses_of(p):
    rows = smoothing.trailing(p, 24).where("n_before = 24")
    return rows.select(*KEYS, "inst_type", "time", "real_value", F.col("mean_before").alias("model_value"), F.round(F.abs(F.col("real_value") - F.col("mean_before")), 8).alias("loss"))


SPLIT = "2024-01-20 00:00:00"


def known_scores(rows):
    """The score table of the losses before a day."""
    return scoring.score_table(rows.where(F.col("time") < F.to_timestamp_ntz(F.lit(SPLIT))), KEYS)


def scored(spark, sf_dir, result: str = "score"):
    """Losses before a day make the score table; later ones are looked up in it."""
    rows = losses(spark, sf_dir)
    table = known_scores(rows).withColumnRenamed("score", result)
    return scoring.asof_backward(rows.where(F.col("time") >= F.to_timestamp_ntz(F.lit(SPLIT))), table, KEYS, "loss", "loss", result)


@query(f"WITH {SCORED_SQL} SELECT target_id, name, time, round(loss, 7) AS loss, round(score, 4) AS score, CASE WHEN score IS NULL THEN 'E900' END AS error_code FROM sd")
def asof_score_lookup(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.select(*KEYS, "time", r("loss", 7), r("score", 4), F.when(F.col("score").isNull(), "E900").alias("error_code"))


@query(f"""WITH {SCORED_SQL}, cd AS (SELECT target_id, name, loss, (100 - score) / 100 AS cdf FROM tb),
mt AS (SELECT target_id, time, avg(score) < 50 AS is_anomaly FROM sd GROUP BY 1, 2)
SELECT n.target_id, n.name, n.time, round(n.loss, 7) AS loss, round(c.cdf, 5) AS cdf, coalesce(mt.is_anomaly, false) AS is_anomaly,
  CASE WHEN c.cdf IS NULL THEN 5 ELSE greatest(round_even((CASE WHEN mt.is_anomaly THEN 50 ELSE 100 END) - c.cdf / 2 * 100, 1), 5) END AS score
FROM nw n ASOF LEFT JOIN cd c ON n.target_id = c.target_id AND n.name = c.name AND n.loss < c.loss JOIN mt ON n.target_id = mt.target_id AND n.time = mt.time""")
def asof_forward_cdf(spark, sf_dir):
    """Each metric's score from the next larger known loss: from 50 down where its target's mean score is below 50, else from 100."""
    rows = scored(spark, sf_dir, "table_score")
    bad = F.coalesce(F.avg("table_score").over(Window.partitionBy("target_id", "time")) < 50, F.lit(False))
    cdf = known_scores(losses(spark, sf_dir)).select(*KEYS, "loss", ((100 - F.col("score")) / 100).alias("cdf"))
    found = scoring.asof_forward(rows.withColumn("is_anomaly", bad), cdf, KEYS, "loss", "loss", "cdf")
    return found.select(*KEYS, "time", r("loss", 7), r("cdf", 5), "is_anomaly", scoring.forward_score(F.col("cdf"), F.col("is_anomaly")).alias("score"))


@query(f"WITH {ANOM_SQL} SELECT target_id, time, normality_score, CASE WHEN normality_score <= 30 THEN 2 WHEN normality_score <= 50 THEN 1 ELSE 0 END AS target_grade, normality_score < 50 AS is_anomaly FROM gr")
def anomaly_score_grade(spark, sf_dir):
    raw = scored(spark, sf_dir).groupBy("target_id", "time").agg(F.avg("score").alias("raw"))
    rows = raw.select("target_id", "time", scoring.floored(F.col("raw")).alias("normality_score"))
    return rows.withColumns({"target_grade": scoring.grade(F.col("normality_score")), "is_anomaly": F.col("normality_score") < 50})


@query(f"""WITH {SCORED_SQL} SELECT target_id, time, name, round(100 * loss / nullif(sum(loss) OVER (PARTITION BY target_id, time), 0), 4) AS anomaly_contribution,
  CAST(row_number() OVER (PARTITION BY target_id, time ORDER BY loss DESC, name) AS INTEGER) AS rank FROM sd""")
def anomaly_contribution_rank(spark, sf_dir):
    order = Window.partitionBy("target_id", "time").orderBy(F.col("loss").desc(), "name")
    return scored(spark, sf_dir).select("target_id", "time", "name", F.round(scoring.share("loss", ["target_id", "time"]), 4).alias("anomaly_contribution"), F.row_number().over(order).alias("rank"))


@query(f"""WITH {ANOM_SQL} SELECT gr.time, gr.target_id, gr.inst_type, gr.normality_score, gr.normality_score < 50 AS is_anomaly,
  CASE WHEN gr.normality_score <= 30 THEN 2 WHEN gr.normality_score <= 50 THEN 1 ELSE 0 END AS target_grade,
  sd.name AS metric_name, round(sd.real_value, 8) AS real_value, round(sd.model_value, 8) AS model_value, round(100 * sd.loss / nullif(gr.total, 0), 4) AS anomaly_contribution
FROM gr JOIN sd ON gr.target_id = sd.target_id AND gr.time = sd.time""")
def instance_anomaly_p1(spark, sf_dir):
    """Instance anomalies: a moving average predicts, losses become scores, targets get grades and contributions."""
    rows = scored(spark, sf_dir)
    own = Window.partitionBy("target_id", "time")
    score = F.avg("score").over(own)
    rows = rows.withColumns({"normality_score": scoring.floored(score), "anomaly_contribution": F.round(scoring.share("loss", ["target_id", "time"]), 4)})
    n = F.col("normality_score")
    return rows.select("time", "target_id", "inst_type", "normality_score", (n < 50).alias("is_anomaly"), scoring.grade(n).alias("target_grade"), F.col("name").alias("metric_name"), r("real_value", 8), r("model_value", 8), "anomaly_contribution")


LAST_SQL = METRIC_SQL + ", la AS (SELECT target_id, name, max(time) AS t0, arg_max(real_value, time) AS v FROM mp GROUP BY 1, 2), st AS (SELECT CAST(i AS INTEGER) AS step FROM range(1, 31) t(i))"


def horizon(p, steps: int = 30):
    """The last point of each series with the times of the next ``steps`` steps."""
    last = p.groupBy(*KEYS).agg(F.max("time").alias("t0"), F.max_by("real_value", "time").alias("v"))
    ahead = last.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return ahead.withColumn("predict_time", F.expr("t0 + make_dt_interval(0, step)"))


@query(f"WITH {LAST_SQL} SELECT target_id, name, t0 AS serving_time, t0 + to_hours(step) AS predict_time, step, round(v, 4) AS predict_value FROM la, st")
def forecast_persistence_30(spark, sf_dir):
    """The last value holds."""
    return horizon(points(spark, sf_dir)).select(*KEYS, F.col("t0").alias("serving_time"), "predict_time", "step", F.round("v", 4).alias("predict_value"))


SEASON_SQL = BASE_SQL + """, la AS (SELECT target_id, name, max(time) AS t0 FROM mp GROUP BY 1, 2),
ah AS (SELECT target_id, name, t0, CAST(i AS INTEGER) AS step, t0 + to_hours(CAST(i AS INTEGER)) AS predict_time FROM la, range(1, 31) t(i)),
se AS (SELECT ah.*, bl.mean AS v FROM ah LEFT JOIN bl ON ah.target_id = bl.target_id AND ah.name = bl.name AND hour(ah.predict_time) = bl.hour_of_day AND (CASE WHEN isodow(ah.predict_time) >= 6 THEN 1 ELSE 0 END) = bl.day_kind)"""


def seasonal(p):
    """The baseline of the predicted time's hour and kind of day."""
    ahead = horizon(p).drop("v").withColumns({"hour_of_day": F.hour("predict_time"), "day_kind": F.when(F.weekday("predict_time") >= 5, 1).otherwise(0)})
    return ahead.join(baseline(p).drop("std", "n"), [*KEYS, "hour_of_day", "day_kind"], "left").withColumnRenamed("mean", "v")


@query(f"WITH {SEASON_SQL} SELECT target_id, name, predict_time, step, round(v, 8) AS predict_value FROM se")
def forecast_seasonal_30(spark, sf_dir):
    return seasonal(points(spark, sf_dir)).select(*KEYS, "predict_time", "step", F.round("v", 8).alias("predict_value"))


@query(f"""WITH {LAST_SQL}, tr AS (SELECT target_id, name, (last_v - first_v) / 9 AS slope FROM (SELECT target_id, name, arg_max(real_value, time) AS last_v, arg_min(real_value, time) AS first_v FROM
  (SELECT *, row_number() OVER (PARTITION BY target_id, name ORDER BY time DESC) AS k FROM mp) x WHERE k <= 10 GROUP BY 1, 2) y)
SELECT la.target_id, la.name, CAST(step AS INTEGER) AS diff_minute, t0 + to_hours(step) AS predict_time, round(greatest(v + slope * step, 0), 4) AS predict_value FROM la JOIN tr ON la.target_id = tr.target_id AND la.name = tr.name, st""")
def forecast_result_explode(spark, sf_dir):
    """A linear forecast as an array for each series, exploded to a row for each step."""
    p = points(spark, sf_dir)
    ends = frames.tail(p, 10).groupBy(*KEYS).agg(F.max("time").alias("t0"), F.max_by("real_value", "time").alias("v"), F.min_by("real_value", "time").alias("u"))
    slope = (F.col("v") - F.col("u")) / 9
    arrays = ends.select(*KEYS, "t0", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.greatest(F.col("v") + slope * i, F.lit(0.0))).alias("values"))
    rows = arrays.select(*KEYS, "t0", F.posexplode("values").alias("pos", "value"))
    return rows.select(*KEYS, (F.col("pos") + 1).alias("diff_minute"), F.expr("t0 + make_dt_interval(0, pos + 1)").alias("predict_time"), F.round("value", 4).alias("predict_value"))


@query(f"WITH {SEASON_SQL} SELECT target_id, name, string_agg(strftime(predict_time, '%Y-%m-%d %H:%M:%S') || '=' || CAST(CAST(floor(v) AS BIGINT) AS VARCHAR), ',' ORDER BY step) AS data, count(v) AS steps FROM se WHERE v IS NOT NULL GROUP BY 1, 2")
def forecast_nested_result(spark, sf_dir):
    """A sorted list of (time, value) for each series, joined to one text."""
    rows = seasonal(points(spark, sf_dir)).where("v IS NOT NULL")
    nested = rows.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("step", "predict_time", F.floor("v").alias("value")))).alias("data"))
    line = F.transform("data", lambda d: F.concat(F.date_format(d["predict_time"], "yyyy-MM-dd HH:mm:ss"), F.lit("="), d["value"].cast("string")))
    return nested.select(*KEYS, F.array_join(line, ",").alias("data"), F.size("data").cast("long").alias("steps"))


@query(f"""WITH {FILLED_SQL}, ew AS (SELECT a.target_id, a.name, a.seq, sum(b.filled * power(0.5, a.seq - b.seq)) / sum(power(0.5, a.seq - b.seq)) AS v FROM fi a JOIN fi b ON a.target_id = b.target_id AND a.name = b.name AND b.seq <= a.seq WHERE a.filled IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT *, ln(v / lag(v) OVER (PARTITION BY target_id, name ORDER BY seq)) AS g FROM ew WHERE v > 0),
t AS (SELECT g.target_id, g.name, f.i, sum(g.g * (60 + f.i) / (60 + f.i - g.seq)) / sum((60 + f.i) / (60.0::DOUBLE + f.i - g.seq)) AS growth FROM g, (SELECT CAST(i AS DOUBLE) AS i FROM range(30) r(i)) f WHERE g.g IS NOT NULL GROUP BY 1, 2, 3),
la AS (SELECT target_id, name, arg_max(v, seq) AS v FROM g GROUP BY 1, 2)
SELECT t.target_id, t.name, CAST(t.i AS INTEGER) AS step, round(la.v * exp(t.i * growth), 3) AS predict_value FROM t JOIN la ON t.target_id = la.target_id AND t.name = la.name""")
def trend_extrapolation_30(spark, sf_dir):
    return trend(smoothing.ewm(frames.interpolate(frames.on_spine(points(spark, sf_dir))).where("filled IS NOT NULL"), "filled")).select(*KEYS, "step", F.round("value", 3).alias("predict_value"))


def trend(rows, steps: int = 30, window: int = 60):
    """Geometric trend of smoothed values ``ewm`` by ``seq``: the last one times the weighted mean growth to the power of the step.

    Step f weighs the growth into place w by (window + f) / (window + f - w), so that later ones weigh more. Values must be positive.
    """
    order = Window.partitionBy(*KEYS).orderBy("seq")
    known = rows.where("ewm > 0")
    g = known.withColumn("g", F.log(F.col("ewm") / F.lag("ewm").over(order))).where("g IS NOT NULL")
    each = g.select(*KEYS, "seq", "g", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    w = (F.col("step") + window) / (F.col("step") + window - F.col("seq"))
    growth = each.groupBy(*KEYS, "step").agg((F.sum(F.col("g") * w) / F.sum(w)).alias("growth"))
    last = known.groupBy(*KEYS).agg(F.max_by("ewm", "seq").alias("last"))
    return growth.join(last, KEYS).select(*KEYS, "step", (F.col("last") * F.exp(F.col("step") * F.col("growth"))).alias("value"))


@query(f"""WITH {FILLED_SQL}, fu AS (SELECT target_id, name, CAST(60 + i AS INTEGER) AS seq, last_v AS filled FROM (SELECT target_id, name, arg_max(filled, seq) AS last_v FROM fi GROUP BY 1, 2) x, range(30) t(i)),
al AS (SELECT target_id, name, seq, filled FROM fi UNION ALL SELECT target_id, name, seq, filled FROM fu)
SELECT target_id, name, CAST(seq - 30 AS INTEGER) AS seq, round(filled, 8) AS value FROM al WHERE seq >= 30""")
def past_future_stitch(spark, sf_dir):
    """60 past steps and 30 forecast ones, of which the last 60 go on."""
    past = frames.interpolate(frames.on_spine(points(spark, sf_dir))).select(*KEYS, "seq", "filled")
    last = past.groupBy(*KEYS).agg(F.max_by("filled", "seq").alias("filled"))
    future = last.select(*KEYS, F.explode(F.sequence(F.lit(60), F.lit(89))).alias("seq"), "filled")
    return past.unionByName(future).where("seq >= 30").select(*KEYS, (F.col("seq") - 30).alias("seq"), F.round("filled", 8).alias("value"))


@query(f"""WITH {BASE_SQL} SELECT p.target_id, p.name, round(100 * avg(CASE WHEN p.real_value = 0 AND b.mean = 0 THEN 0 ELSE abs(p.real_value - b.mean) / (abs(p.real_value) + abs(b.mean)) END), 4) AS smape
FROM mp p JOIN bl b ON p.target_id = b.target_id AND p.name = b.name AND hour(p.time) = b.hour_of_day AND (CASE WHEN isodow(p.time) >= 6 THEN 1 ELSE 0 END) = b.day_kind GROUP BY 1, 2""")
def smape_by_metric(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = p.withColumns({"hour_of_day": F.hour("time"), "day_kind": F.when(F.weekday("time") >= 5, 1).otherwise(0)}).join(baseline(p), [*KEYS, "hour_of_day", "day_kind"])
    a, b = F.col("real_value"), F.col("mean")
    term = F.when((a == 0) & (b == 0), 0.0).otherwise(F.abs(a - b) / (F.abs(a) + F.abs(b)))
    return rows.groupBy(*KEYS).agg(F.round(100 * F.avg(term), 4).alias("smape"))


#: events of the test data: an event watches some metrics of an instance type; ETC watches all
EVENT_FEATURES = [("SLOW", "was", "view"), ("SLOW", "was", "error"), ("LOCK", "db", "error"), ("LOCK", "db", "purchase"), ("LOAD", "os", "click"), ("LOAD", "os", "view"), ("LOAD", "os", "signup")]
FEATURE_SQL = "ef AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in EVENT_FEATURES) + ") v(event_code, inst_type, name))"


def event_features(spark):
    return spark.createDataFrame(EVENT_FEATURES, "event_code string, inst_type string, name string")


@query(f"WITH {METRIC_SQL}, {FEATURE_SQL} SELECT e.event_code, m.target_id, m.name, count(*) AS n FROM mp m JOIN ef e ON m.inst_type = e.inst_type AND m.name = e.name GROUP BY 1, 2, 3")
def event_feature_membership(spark, sf_dir):
    return points(spark, sf_dir).join(F.broadcast(event_features(spark)), ["inst_type", "name"]).groupBy("event_code", "target_id", "name").agg(F.count("*").alias("n"))


ONE_SIDED_SQL = LOSS_SQL + f""", {FEATURE_SQL},
os AS (SELECT inst_type, target_id, name, time, CASE WHEN real_value > model_value THEN loss ELSE 1e-7 END AS score FROM lo),
ev AS (SELECT e.event_code, o.target_id, o.name, o.time, o.score FROM os o JOIN ef e ON o.inst_type = e.inst_type AND o.name = e.name UNION ALL SELECT 'ETC', target_id, name, time, score FROM os),
es AS (SELECT event_code, target_id, time, avg(score) AS score FROM ev GROUP BY 1, 2, 3),
ga AS (SELECT *, first_value(score) OVER (PARTITION BY event_code, target_id ORDER BY time) AS first_score FROM es),
an AS (SELECT *, score > 60 AND first_score >= 60 AS anomaly, score > 60 AS above FROM ga)"""


def one_sided(rows):
    """Scores of losses: the loss where the value is above the model's, else nearly nothing."""
    return rows.withColumn("score", F.when(F.col("real_value") > F.col("model_value"), F.col("loss")).otherwise(1e-7))


def event_rows(scores, *more):
    """Scores of metrics by the events that watch them; ETC watches all."""
    columns = ["target_id", "name", *more, "score"]
    own = scores.join(F.broadcast(event_features(scores.sparkSession)), ["inst_type", "name"]).select("event_code", *columns)
    return own.unionByName(scores.select(F.lit("ETC").alias("event_code"), *columns))


def event_scores(rows, threshold: float = 60.0):
    """Mean score of each event; an event whose first step is below the threshold stays off."""
    s = rows.groupBy("event_code", "target_id", "time").agg(F.avg("score").alias("score"))
    first = s.groupBy("event_code", "target_id").agg(F.min_by("score", "time").alias("first_score"))
    s = s.join(first, ["event_code", "target_id"])
    return s.withColumns({"above": F.col("score") > threshold, "anomaly": (F.col("score") > threshold) & (F.col("first_score") >= threshold)})


def serving_scores(spark, sf_dir):
    return event_scores(event_rows(one_sided(losses(spark, sf_dir)), "time"))


@query(f"WITH {ONE_SIDED_SQL} SELECT event_code, target_id, time, round(score, 8) AS score FROM es")
def event_score_avg(spark, sf_dir):
    return serving_scores(spark, sf_dir).select("event_code", "target_id", "time", r("score", 8))


@query(f"WITH {ONE_SIDED_SQL} SELECT event_code, target_id, count(*) AS steps, count(*) FILTER (above) AS above, count(*) FILTER (anomaly) AS anomalies FROM an GROUP BY 1, 2")
def event_first_minute_gate(spark, sf_dir):
    return serving_scores(spark, sf_dir).groupBy("event_code", "target_id").agg(F.count("*").alias("steps"), F.count_if("above").alias("above"), F.count_if("anomaly").alias("anomalies"))


PROB_SQL = ONE_SIDED_SQL + """, gd AS (SELECT CAST(i AS INTEGER) AS i, i * 10.0::DOUBLE / 999 AS at FROM range(1000) t(i)),
ed AS (SELECT event_code, i, gd.at, avg(exp(-0.5 * power((gd.at - score / 50) / 0.5, 2))) AS density FROM es, gd GROUP BY 1, 2, 3),
ec AS (SELECT event_code, i, CASE WHEN ed.at > 1.2 THEN 0.95 * sum(CASE WHEN ed.at > 1.2 THEN density ELSE 0 END) OVER (PARTITION BY event_code ORDER BY i) / nullif(sum(CASE WHEN ed.at > 1.2 THEN density ELSE 0 END) OVER (PARTITION BY event_code), 0) ELSE 0 END AS cdf FROM ed),
pb AS (SELECT an.*, round(ec.cdf, 2) AS event_prob FROM an JOIN ec ON an.event_code = ec.event_code AND ec.i = least(ceil(an.score / 50 * 100), 999))"""


def event_probabilities(scores, threshold: float = 1.2):
    """``event_prob`` of each event score: the step ceil(100 x), 999 at most, of its event's distribution above the threshold.

    An event's distribution is an array of 1000 steps; x is the score by fifty, so that the grid from 0 to 10 holds all scores.
    """
    x = F.col("score") / 50
    d = density(scores.select("event_code", x.alias("v")), "event_code")
    cdf = above(d, "event_code", threshold).groupBy("event_code").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "cdf"))), lambda s: s["cdf"]).alias("steps"))
    at = F.least(F.ceil(x * 100), F.lit(999)).cast("int")
    return scores.join(cdf, "event_code").withColumn("event_prob", F.round(F.get("steps", at), 2)).drop("steps")


@query(f"WITH {PROB_SQL} SELECT event_code, target_id, time, event_prob FROM pb")
def event_cdf_probability(spark, sf_dir):
    return event_probabilities(serving_scores(spark, sf_dir)).select("event_code", "target_id", "time", "event_prob")


MASK_SQL = f""", hit AS (SELECT DISTINCT a.target_id, e.name FROM an a JOIN ef e ON a.event_code = e.event_code WHERE a.anomaly),
em AS (SELECT target_id, name, avg(score) AS mean_score FROM os GROUP BY 1, 2),
mk AS (SELECT em.target_id, em.name, mean_score FROM em WHERE mean_score > 5 AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.target_id = em.target_id AND hit.name = em.name))"""
ETC_SQL = ONE_SIDED_SQL + MASK_SQL


def etc_mask(scores, events, threshold: float = 5.0):
    """Metrics of no predicted event whose mean score is above the threshold."""
    features = event_features(scores.sparkSession).where("event_code <> 'ETC'")
    hit = events.where("anomaly").join(F.broadcast(features), "event_code").select("target_id", "name").distinct()
    means = scores.groupBy("target_id", "name").agg(F.avg("score").alias("mean_score"))
    return means.where(F.col("mean_score") > threshold).join(hit, ["target_id", "name"], "left_anti")


@query(f"WITH {ETC_SQL} SELECT target_id, name, round(mean_score, 4) AS mean_score FROM mk")
def event_etc_mask(spark, sf_dir):
    scores = one_sided(losses(spark, sf_dir))
    return etc_mask(scores, event_scores(event_rows(scores, "time"))).select("target_id", "name", r("mean_score", 4))


TOP_SQL = ONE_SIDED_SQL + ", rk AS (SELECT *, row_number() OVER (PARTITION BY event_code, target_id, time ORDER BY score DESC, name) AS rank FROM ev), tp AS (SELECT *, 100 * score / nullif(sum(score) OVER (PARTITION BY event_code, target_id, time), 0) AS contribution FROM rk WHERE rank <= 5)"


@query(f"WITH {TOP_SQL} SELECT event_code, target_id, time, name, CAST(rank AS INTEGER) AS rank, round(contribution, 3) AS contribution FROM tp")
def event_top5_contribution(spark, sf_dir):
    """The five largest contributors of each event and step with their share."""
    return scoring.top_share(event_rows(one_sided(losses(spark, sf_dir)), "time"), ["event_code", "target_id", "time"], "score", "name", 5).select("event_code", "target_id", "time", "name", "rank", r("contribution", 3))


P4_SQL = PROB_SQL + MASK_SQL + """, wa AS (SELECT ev.* FROM ev WHERE event_code <> 'ETC' OR EXISTS (SELECT 1 FROM mk WHERE mk.target_id = ev.target_id AND mk.name = ev.name)),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_code, target_id, time ORDER BY score DESC, name) AS rank FROM wa),
tp AS (SELECT *, 100 * score / nullif(sum(score) OVER (PARTITION BY event_code, target_id, time), 0) AS contribution FROM rk WHERE rank <= 5),
ex AS (SELECT event_code, target_id, time, string_agg(name || ':' || CAST(CAST(floor(round(contribution, 6)) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS explain FROM tp GROUP BY 1, 2, 3),
on_ AS (SELECT pb.*, pb.anomaly AND (event_code <> 'ETC' OR EXISTS (SELECT 1 FROM mk WHERE mk.target_id = pb.target_id)) AS predicted FROM pb)"""


@query(f"""WITH {P4_SQL} SELECT a.event_code, a.target_id, a.time AS predict_time, a.predicted AS anomaly, CASE WHEN a.predicted THEN a.event_prob ELSE 0 END AS event_prob, ex.explain
FROM on_ a LEFT JOIN ex ON a.event_code = ex.event_code AND a.target_id = ex.target_id AND a.time = ex.time""")
def event_forecast_p4(spark, sf_dir):
    """Event forecast: gate, probability and explanation of each event and step.

    ETC is predicted and explained only by metrics of its mask: those of no predicted event that stand out
    themselves. Events are read once: their losses are a written table.
    """
    scores = written(one_sided(losses(spark, sf_dir)), "losses")
    rows = event_rows(scores, "time")
    events = written(event_scores(rows), "events")
    mask = written(etc_mask(scores, events).select("target_id", "name"), "mask")
    explain = explained(rows, mask, "time", lambda share: F.floor(F.round(share, 6)).cast("string"))
    found = event_probabilities(events).join(explain, ["event_code", "target_id", "time"], "left")
    return predicted(found, mask).select("event_code", "target_id", F.col("time").alias("predict_time"), "anomaly", "event_prob", "explain")


def explained(rows, mask, step: str, shown):
    """The five largest contributors of each event and step as one text; ETC's only of its mask."""
    other, keys = F.col("event_code") == "ETC", ["event_code", "target_id", step]
    watched = rows.where(~other).unionByName(rows.where(other).join(mask, ["target_id", "name"], "left_semi").select(*rows.columns))
    top = scoring.top_share(watched, keys, "score", "name", 5)
    note = F.concat("name", F.lit(":"), shown(F.col("contribution")))
    notes = top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", note.alias("note")))).alias("x"))
    return notes.select(*keys, F.array_join(F.transform("x", lambda s: s["note"]), ",").alias("explain"))


def predicted(found, mask):
    """``anomaly`` and ``event_prob`` where ETC needs a metric of its target's mask."""
    targets = mask.select("target_id").distinct().withColumn("masked", F.lit(True))
    rows, other = found.join(targets, "target_id", "left"), F.col("event_code") == "ETC"
    rows = rows.withColumn("anomaly", F.col("anomaly") & (~other | F.coalesce("masked", F.lit(False))))
    return rows.withColumn("event_prob", F.when(F.col("anomaly"), F.col("event_prob")).otherwise(0.0)).drop("masked")


KDE_SQL = METRIC_SQL + """, x AS (SELECT name, real_value / 50 AS v FROM mp), g AS (SELECT CAST(i AS INTEGER) AS i, i * 10.0::DOUBLE / 999 AS at FROM range(1000) t(i)),
kd AS (SELECT name, i, g.at, avg(exp(-0.5 * power((g.at - v) / 0.5, 2))) / (0.5 * sqrt(2 * pi())) AS density FROM x, g GROUP BY 1, 2, 3)"""


def density(x, by: str, grid: int = 1000, bandwidth: float = 0.5):
    """Gaussian kernel density of each key's ``v`` on a grid from 0 to 10 (null and NaN values left out)."""
    sums = kernels.grid_sums(x.select(F.col(by).alias("key"), F.col("v").cast("double").alias("v")), 10.0, grid, bandwidth)
    value = F.col("sum") / F.col("n") / (bandwidth * math.sqrt(2 * math.pi))
    return sums.select(F.col("key").alias(by), "i", (F.col("i") * 10.0 / (grid - 1)).alias("at"), value.alias("density"))


def above(densities, by: str, threshold: float):
    """``cdf``: share of the density above a threshold (a number or column) up to each grid place, at most 0.95; 0 up to the threshold."""
    d, own = F.when(F.col("at") > threshold, F.col("density")).otherwise(0.0), Window.partitionBy(by)
    rows = densities.withColumn("d", d)
    cdf = F.try_divide(0.95 * F.sum("d").over(own.orderBy("i")), F.sum("d").over(own))
    return rows.withColumn("cdf", F.when(F.col("at") > threshold, cdf).otherwise(0.0)).drop("d")


def kde(spark, sf_dir):
    return density(points(spark, sf_dir).select("name", (F.col("real_value") / 50).alias("v")), "name")


@query(f"WITH {KDE_SQL} SELECT name, i, round(kd.at, 5) AS grid_at, round(density, 6) AS density FROM kd")
def kde_density_grid(spark, sf_dir):
    return kde(spark, sf_dir).select("name", "i", F.round("at", 5).alias("grid_at"), r("density"))


@query(f"""WITH {KDE_SQL}, cu AS (SELECT name, i, CASE WHEN kd.at > 2 THEN 0.95 * sum(CASE WHEN kd.at > 2 THEN density ELSE 0 END) OVER (PARTITION BY name ORDER BY i) / nullif(sum(CASE WHEN kd.at > 2 THEN density ELSE 0 END) OVER (PARTITION BY name), 0) ELSE 0 END AS cdf FROM kd)
SELECT name, i, round(cdf, 6) AS cdf FROM cu""")
def cdf_above_threshold(spark, sf_dir):
    return above(kde(spark, sf_dir), "name", 2.0).select("name", "i", F.round("cdf", 6).alias("cdf"))


@query(f"""WITH {KDE_SQL}, cu AS (SELECT name, i, CASE WHEN kd.at > 2 THEN 0.95 * sum(CASE WHEN kd.at > 2 THEN density ELSE 0 END) OVER (PARTITION BY name ORDER BY i) / nullif(sum(CASE WHEN kd.at > 2 THEN density ELSE 0 END) OVER (PARTITION BY name), 0) ELSE 0 END AS cdf FROM kd)
SELECT name, round((1000 - count(*) FILTER (cdf > 0.5)) * 0.01::DOUBLE, 2) AS threshold FROM cu GROUP BY 1""")
def event_threshold_half(spark, sf_dir):
    """The place of the grid at which the distribution above a threshold passes one half."""
    rows = above(kde(spark, sf_dir), "name", 2.0).groupBy("name").agg(F.count_if(F.col("cdf") > 0.5).alias("n"))
    return rows.select("name", F.round((1000 - F.col("n")) * 0.01, 2).alias("threshold"))


#: training scores of events: smoothed means of both sides' losses, in fifties, by the order of time
TRAIN_SQL = LOSS_SQL + f""", {FEATURE_SQL},
te AS (SELECT e.event_code, o.target_id, o.time, avg(o.loss / 50) AS v FROM lo o JOIN ef e ON o.inst_type = e.inst_type AND o.name = e.name GROUP BY 1, 2, 3
  UNION ALL SELECT 'ETC', target_id, time, avg(loss / 50) FROM lo GROUP BY 2, 3),
ti AS (SELECT *, row_number() OVER (PARTITION BY event_code, target_id ORDER BY time) AS i FROM te),
ts AS (SELECT a.event_code, a.target_id, a.i, round(sum(b.v * power(0.5, a.i - b.i)) / sum(power(0.5, a.i - b.i)), 9) AS score FROM ti a JOIN ti b ON a.event_code = b.event_code AND a.target_id = b.target_id AND b.i BETWEEN a.i - 60 AND a.i GROUP BY 1, 2, 3),
tk AS (SELECT *, row_number() OVER (PARTITION BY event_code, target_id ORDER BY score) AS k, count(*) OVER (PARTITION BY event_code, target_id) AS n FROM ts),
tt AS (SELECT event_code, target_id, score AS t, n FROM tk WHERE k = floor(n * 0.98) + 1),
tz AS (SELECT tt.event_code, tt.target_id, t, tt.n, count(*) FILTER (score > t) AS peaks, coalesce(avg(score - t) FILTER (score > t), 0) AS me FROM tk JOIN tt ON tk.event_code = tt.event_code AND tk.target_id = tt.target_id GROUP BY 1, 2, 3, 4),
zz AS (SELECT event_code, target_id, CASE WHEN peaks > 0 THEN t - me * ln(0.005 * n / peaks) ELSE t END AS z FROM tz),
zl AS (SELECT z.event_code, z.target_id, greatest(z.z, o.z) AS z FROM zz z JOIN zz o ON o.event_code = 'ETC' AND o.target_id = z.target_id),
kg AS (SELECT CAST(i AS INTEGER) AS i, i * 10.0::DOUBLE / 999 AS at FROM range(1000) t(i)),
kd AS (SELECT event_code, target_id, kg.i, kg.at, avg(exp(-0.5 * power((kg.at - score) / 0.5, 2))) AS d FROM ts, kg GROUP BY 1, 2, 3, 4),
kc AS (SELECT kd.event_code, kd.target_id, kd.i, CASE WHEN kd.at > z THEN 0.95 * sum(CASE WHEN kd.at > z THEN d ELSE 0 END) OVER (PARTITION BY kd.event_code, kd.target_id ORDER BY kd.i) / nullif(sum(CASE WHEN kd.at > z THEN d ELSE 0 END) OVER (PARTITION BY kd.event_code, kd.target_id), 0) ELSE 0 END AS cdf
  FROM kd JOIN zl ON kd.event_code = zl.event_code AND kd.target_id = zl.target_id),
lv AS (SELECT event_code, target_id, round((1000 - count(*) FILTER (cdf > 0.5)) * 0.01::DOUBLE, 2) AS level FROM kc GROUP BY 1, 2)"""


def training_scores(rows):
    """Smoothed mean losses of each event and target, in order: what an event's levels are fitted to."""
    scores = event_rows(rows.withColumn("score", F.col("loss") / 50), "time").groupBy("event_code", "target_id", "time").agg(F.avg("score").alias("v"))
    smooth = smoothing.ewm(scores, "v", 3, "time", ["event_code", "target_id"])
    return smooth.select("event_code", "target_id", F.round("ewm", 9).alias("score"))


def event_levels(scores, tail):
    """(event_code, target_id, level, steps): where each event's distribution above its threshold passes one half, and that distribution's 1000 steps.

    ``tail`` gives each key's threshold ``z`` from (key, score); an event's threshold is not below that of ETC at its target.
    """
    keys = ["event_code", "target_id"]
    ids = written(scores.select(*keys).distinct().withColumn("key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})), "keys")
    rows = written(joined(scores, ids, keys).select("key", "score"), "training")
    z = joined(tail(rows).select("key", "z"), ids, ["key"])
    etc = z.where("event_code = 'ETC'").select("target_id", F.col("z").alias("least"))
    z = joined(z, etc, ["target_id"], "left").select("key", F.greatest("z", "least").alias("z"))
    cdf = above(joined(density(rows.withColumnRenamed("score", "v"), "key"), z, ["key"]), "key", F.col("z"))
    steps = F.transform(F.sort_array(F.collect_list(F.struct("i", "cdf"))), lambda s: s["cdf"])
    level = F.round((1000 - F.count_if(F.col("cdf") > 0.5)) * 0.01, 2)
    return joined(cdf.groupBy("key").agg(level.alias("level"), steps.alias("steps")), ids, ["key"]).drop("key")


def exponential_tail(rows, level: float = 0.98, q: float = 0.005):
    """Thresholds of exponential tails in closed form; with no peaks, the initial threshold."""
    s = thresholds.initial_threshold(rows, ["key"], level)
    z = thresholds.gpd_quantile(F.col("threshold"), F.lit(0.0), F.col("mean_excess"), F.col("n"), F.col("peaks"), q)
    return s.select("key", F.when(F.col("peaks") > 0, z).otherwise(F.col("threshold")).alias("z"))


@query(f"WITH {TRAIN_SQL} SELECT lv.event_code, lv.target_id, lv.level, round(z, 5) AS threshold FROM lv JOIN zl ON lv.event_code = zl.event_code AND lv.target_id = zl.target_id")
def event_levels_exponential(spark, sf_dir):
    """Each event's level and threshold, the larger of its own and ETC's, with exponential tails."""
    rows = training_scores(losses(spark, sf_dir))
    levels = event_levels(rows, exponential_tail)
    own = exponential_tail(rows.withColumn("key", F.to_json(F.struct("event_code", "target_id"))).select("key", "score"))
    own = own.select(F.from_json("key", "event_code string, target_id string").alias("k"), "z").select("k.*", "z")
    etc = own.where("event_code = 'ETC'").select("target_id", F.col("z").alias("least"))
    found = levels.join(own, ["event_code", "target_id"]).join(etc, "target_id")
    return found.select("event_code", "target_id", "level", F.round(F.greatest("z", "least"), 5).alias("threshold"))


@query()
def event_levels_fitted(spark, sf_dir):
    """Each event's level with fitted tails (numeric, so no SQL)."""
    return event_levels(training_scores(losses(spark, sf_dir)), lambda rows: thresholds.pot(rows, "key", 0.98)).select("event_code", "target_id", "level")


STITCH_SQL = TRAIN_SQL.replace(METRIC_SQL, FILLED_SQL, 1) + """, sc AS (SELECT target_id, name, avg(real_value) AS mean, CASE WHEN stddev_pop(real_value) = 0 THEN 1 ELSE stddev_pop(real_value) END AS std FROM mp GROUP BY 1, 2),
al AS (SELECT target_id, name, seq, filled AS v FROM fi UNION ALL SELECT target_id, name, CAST(seq + 24 * k AS INTEGER), filled FROM fi, range(1, 3) t(k) WHERE seq >= 36 AND seq + 24 * k < 90),
bk AS (SELECT al.target_id, al.name, al.seq - 30 AS seq, round_even(round(greatest((al.v - mean) / std * std + mean, 0), 6) * 100, 0) / 100 AS x FROM al JOIN sc ON al.target_id = sc.target_id AND al.name = sc.name WHERE al.seq >= 30),
rm AS (SELECT *, avg(x) OVER (PARTITION BY target_id, name ORDER BY seq ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m FROM bk),
ra AS (SELECT target_id, name, seq, CASE WHEN x > round(m, 8) THEN round(x - m, 8) / 50 ELSE 1e-7 END AS v FROM rm),
re AS (SELECT a.target_id, a.name, a.seq - 30 AS step, round(sum(b.v * power(0.5, a.seq - b.seq)) / sum(power(0.5, a.seq - b.seq)), 9) AS score FROM ra a JOIN ra b ON a.target_id = b.target_id AND a.name = b.name AND b.seq <= a.seq WHERE a.seq >= 30 GROUP BY 1, 2, 3),
hv AS (SELECT e.event_code, r.target_id, r.name, r.step, r.score FROM re r JOIN ef e ON split_part(r.target_id, '_', 1) = e.inst_type AND r.name = e.name UNION ALL SELECT 'ETC', target_id, name, step, score FROM re),
hs AS (SELECT event_code, target_id, step, round(avg(score), 9) AS score FROM hv GROUP BY 1, 2, 3),
ha AS (SELECT hs.*, lv.level, hs.score > level AND first_value(hs.score) OVER (PARTITION BY hs.event_code, hs.target_id ORDER BY step) >= level AS anomaly FROM hs JOIN lv ON hs.event_code = lv.event_code AND hs.target_id = lv.target_id),
hp AS (SELECT ha.*, round(kc.cdf, 2) AS event_prob FROM ha JOIN kc ON ha.event_code = kc.event_code AND ha.target_id = kc.target_id AND kc.i = least(ceil(ha.score * 100), 999)),
hh AS (SELECT DISTINCT a.target_id, e.name FROM ha a JOIN ef e ON a.event_code = e.event_code WHERE a.anomaly),
hm AS (SELECT r.target_id, r.name FROM re r JOIN lv ON lv.event_code = 'ETC' AND lv.target_id = r.target_id WHERE NOT EXISTS (SELECT 1 FROM hh WHERE hh.target_id = r.target_id AND hh.name = r.name) GROUP BY r.target_id, r.name, lv.level HAVING avg(r.score) > lv.level),
hw AS (SELECT hv.* FROM hv WHERE event_code <> 'ETC' OR EXISTS (SELECT 1 FROM hm WHERE hm.target_id = hv.target_id AND hm.name = hv.name)),
hr AS (SELECT *, row_number() OVER (PARTITION BY event_code, target_id, step ORDER BY score DESC, name) AS rank FROM hw),
hc AS (SELECT *, score / nullif(sum(score) OVER (PARTITION BY event_code, target_id, step), 0) AS c FROM hr WHERE rank <= 5),
hx AS (SELECT event_code, target_id, step, string_agg(name || ':' || printf('%.2f', round(c, 6)), ',' ORDER BY rank) AS explain FROM hc GROUP BY 1, 2, 3),
hf AS (SELECT hp.*, anomaly AND (event_code <> 'ETC' OR EXISTS (SELECT 1 FROM hm WHERE hm.target_id = hp.target_id)) AS predicted FROM hp)"""


def horizon_scores(p):
    """One-sided smoothed scores of the 30 steps ahead: past and forecast are scaled, stitched, the last 60 put back in their unit, scored against what came before, and smoothed.

    No trained network is at hand, so the forecast is the last 24 steps once more.
    """
    past = frames.interpolate(frames.on_spine(p)).select(*KEYS, "seq", F.col("filled").alias("v"))
    ahead = past.where("seq >= 36").withColumn("seq", F.explode(F.array(F.col("seq") + 24, F.col("seq") + 48))).where("seq < 90")
    scaled = past.unionByName(ahead).join(smoothing.scaler_fit(p), KEYS).withColumn("scaled", (F.col("v") - F.col("mean")) / F.col("std"))
    back = F.rint(F.round(F.greatest(F.col("scaled") * F.col("std") + F.col("mean"), F.lit(0.0)), 6) * 100) / 100
    rows = scaled.where("seq >= 30").select(*KEYS, (F.col("seq") - 30).alias("seq"), back.alias("x"))
    before = F.avg("x").over(Window.partitionBy(*KEYS).orderBy("seq").rowsBetween(-24, -1))
    rows = rows.withColumn("m", before).withColumn("v", F.when(F.col("x") > F.round("m", 8), F.round(F.col("x") - F.col("m"), 8) / 50).otherwise(1e-7))
    smooth = smoothing.ewm(rows, "v").where("seq >= 30")
    return smooth.select(*KEYS, F.split_part("target_id", F.lit("_"), F.lit(1)).alias("inst_type"), (F.col("seq") - 30).alias("step"), F.round("ewm", 9).alias("score"))


@query(f"""WITH {STITCH_SQL} SELECT a.event_code, a.target_id, a.step, a.score, a.level, a.predicted AS anomaly, CASE WHEN a.predicted THEN a.event_prob ELSE 0 END AS event_prob, hx.explain
FROM hf a LEFT JOIN hx ON a.event_code = hx.event_code AND a.target_id = hx.target_id AND a.step = hx.step""")
def event_horizon_30(spark, sf_dir):
    """Events over the 30 steps ahead, against levels fitted to the past: gate by the first step, probability, and contributors."""
    p = written(points(spark, sf_dir), "points")
    levels = written(event_levels(training_scores(losses_of(p)), exponential_tail), "levels")
    scores = written(horizon_scores(p), "horizon")
    rows = event_rows(scores, "step")
    keys = ["event_code", "target_id"]
    s = rows.groupBy(*keys, "step").agg(F.round(F.avg("score"), 9).alias("score")).join(levels, keys)
    first = F.first("score").over(Window.partitionBy(*keys).orderBy("step"))
    events = s.withColumn("anomaly", (F.col("score") > F.col("level")) & (first >= F.col("level")))
    events = written(events.withColumn("event_prob", F.round(F.get("steps", F.least(F.ceil(F.col("score") * 100), F.lit(999)).cast("int")), 2)).drop("steps"), "events")
    least = levels.where("event_code = 'ETC'").select("target_id", "level")
    mask = written(etc_mask(scores, events, -1.0).join(least, "target_id").where("mean_score > level").select("target_id", "name"), "mask")
    explain = explained(rows, mask, "step", lambda share: F.format_string("%.2f", F.round(share / 100, 6)))
    found = predicted(events.join(explain, [*keys, "step"], "left"), mask)
    return found.select(*keys, "step", "score", "level", "anomaly", "event_prob", "explain")


POT_SQL = LOSS_SQL + """, so AS (SELECT target_id, loss AS score, row_number() OVER (PARTITION BY target_id ORDER BY loss) AS k, count(*) OVER (PARTITION BY target_id) AS n FROM lo),
th AS (SELECT target_id, score AS threshold, n FROM so WHERE k = floor(n * 0.95) + 1),
pk AS (SELECT th.target_id, th.threshold, th.n, count(*) FILTER (score > threshold) AS peaks, coalesce(avg(score - threshold) FILTER (score > threshold), 0) AS mean_excess FROM so JOIN th ON so.target_id = th.target_id GROUP BY 1, 2, 3)"""


def target_losses(spark, sf_dir):
    return losses(spark, sf_dir).select("target_id", "time", F.col("loss").alias("score"))


@query(f"WITH {POT_SQL} SELECT target_id, round(threshold, 5) AS threshold, n, peaks, round(mean_excess, 5) AS mean_excess FROM pk")
def pot_init_threshold_peaks(spark, sf_dir):
    return thresholds.initial_threshold(target_losses(spark, sf_dir), ["target_id"], 0.95).select("target_id", r("threshold", 5), "n", "peaks", r("mean_excess", 5))


@query(f"WITH {POT_SQL} SELECT target_id, round(threshold - mean_excess * ln(0.005 * n / peaks), 4) AS exponential, round(threshold + mean_excess / 0.1 * (power(0.005 * n / peaks, -0.1) - 1), 4) AS pareto FROM pk WHERE peaks > 0")
def pot_gpd_quantile(spark, sf_dir):
    """The tail's quantile for given shapes: an exponential tail and one of shape 0.1."""
    s = thresholds.initial_threshold(target_losses(spark, sf_dir), ["target_id"], 0.95).where("peaks > 0")
    level = lambda g: F.round(thresholds.gpd_quantile(F.col("threshold"), F.lit(g), F.col("mean_excess"), F.col("n"), F.col("peaks"), 0.005), 4)
    return s.select("target_id", level(0.0).alias("exponential"), level(0.1).alias("pareto"))


@query()
def pot_threshold_fit(spark, sf_dir):
    """Peaks-over-threshold with a fitted tail (numeric, so no SQL)."""
    return thresholds.pot(target_losses(spark, sf_dir), "target_id", 0.95)


@query()
def pot_both_tails(spark, sf_dir):
    return thresholds.both_tails(points(spark, sf_dir).select("target_id", "time", F.col("real_value").alias("score")), "target_id", 0.95)


@query()
def pot_drift_streaming(spark, sf_dir):
    """Drift residuals judged one after another, the tail refitted as peaks come in."""
    rows = thresholds.drifting(target_losses(spark, sf_dir).groupBy("target_id", "time").agg(F.avg("score").alias("score")), "target_id")

    def run(key, rows):
        return thresholds.streaming_pot(rows).assign(target_id=key[0])[["target_id", "time", "score", "level", "alarm"]]

    return rows.groupBy("target_id").applyInPandas(run, "target_id string, time timestamp_ntz, score double, level double, alarm boolean")


@query(f"""WITH {LOSS_SQL}, q AS (SELECT target_id, name, quantile_cont(loss, 0.5) AS med, quantile_cont(loss, 0.75) - quantile_cont(loss, 0.25) AS iqr FROM lo GROUP BY 1, 2)
SELECT lo.target_id, lo.name, time, round((loss - med) / (1 + iqr), 5) AS scaled FROM lo JOIN q ON lo.target_id = q.target_id AND lo.name = q.name""")
def iqr_scaled_score(spark, sf_dir):
    rows = losses(spark, sf_dir)
    q = rows.groupBy(*KEYS).agg(F.percentile("loss", 0.5).alias("med"), (F.percentile("loss", 0.75) - F.percentile("loss", 0.25)).alias("iqr"))
    return rows.join(q, KEYS).select(*KEYS, "time", F.round((F.col("loss") - F.col("med")) / (1 + F.col("iqr")), 5).alias("scaled"))


EPS_SQL = LOSS_SQL + """, k AS (SELECT target_id, loss, time, name, row_number() OVER (PARTITION BY target_id ORDER BY time, name) AS i FROM lo),
mo AS (SELECT target_id, avg(loss) AS mu, stddev_pop(loss) AS sd, max(loss) AS top, count(*) AS n FROM lo GROUP BY 1), z AS (SELECT 2.5 + 0.5 * j AS z FROM range(19) t(j)),
f AS (SELECT k.target_id, z.z, k.i, k.loss, mo.mu + mo.sd * z.z AS eps, k.loss >= mo.mu + mo.sd * z.z AS hit, mo.mu, mo.sd, mo.n FROM k JOIN mo ON k.target_id = mo.target_id, z),
d AS (SELECT *, max(CAST(hit AS INTEGER)) OVER (PARTITION BY target_id, z ORDER BY i ROWS BETWEEN 49 PRECEDING AND 49 FOLLOWING) AS near FROM f),
a AS (SELECT target_id, z, eps, mu, sd, n, count(*) FILTER (hit) AS hits, sum(near) AS wide, avg(loss) FILTER (NOT hit) AS mu2, stddev_pop(loss) FILTER (NOT hit) AS sd2 FROM d GROUP BY 1, 2, 3, 4, 5, 6),
s AS (SELECT *, ((mu - mu2) / mu + (sd - sd2) / sd) / nullif(wide, 0) AS score FROM a WHERE hits > 0 AND wide < 0.5 * n)
SELECT mo.target_id, round(coalesce((SELECT eps FROM s WHERE s.target_id = mo.target_id ORDER BY round(score, 9) DESC, z DESC LIMIT 1), mo.top), 4) AS epsilon FROM mo"""


@query("WITH " + EPS_SQL)
def epsilon_threshold(spark, sf_dir):
    """The number of deviations that makes the rest calmest for the fewest widened hits; the largest of equals."""
    rows = losses(spark, sf_dir)
    order = Window.partitionBy("target_id").orderBy("time", "name")
    k = rows.select("target_id", "loss", F.row_number().over(order).alias("i"))
    mo = rows.groupBy("target_id").agg(F.avg("loss").alias("mu"), F.stddev_pop("loss").alias("sd"), F.max("loss").alias("top"), F.count("*").alias("n"))
    f = k.join(mo, "target_id").withColumn("z", F.explode(F.transform(F.sequence(F.lit(0), F.lit(18)), lambda j: 2.5 + 0.5 * j)))
    f = f.withColumn("eps", F.col("mu") + F.col("sd") * F.col("z")).withColumn("hit", (F.col("loss") >= F.col("eps")).cast("int"))
    d = thresholds.dilate(f, "hit", ["target_id", "z"], "i")
    calm = F.when(F.col("hit") == 0, F.col("loss"))
    a = d.groupBy("target_id", "z", "eps", "mu", "sd", "n").agg(F.sum("hit").alias("hits"), F.sum("hit_near").alias("wide"), F.avg(calm).alias("mu2"), F.stddev_pop(calm).alias("sd2"))
    s = a.where("hits > 0 AND wide < 0.5 * n").withColumn("score", ((F.col("mu") - F.col("mu2")) / F.col("mu") + (F.col("sd") - F.col("sd2")) / F.col("sd")) / F.col("wide"))
    best = s.groupBy("target_id").agg(F.max_by("eps", F.struct(F.round("score", 9), "z")).alias("eps"))
    return mo.join(best, "target_id", "left").select("target_id", F.round(F.coalesce("eps", "top"), 4).alias("epsilon"))


DET_SQL = LOSS_SQL + """, dt AS (SELECT target_id, time, max(loss) AS loss, bool_or(name = 'error' AND loss > 100) OR bool_or(loss > 160) AS label FROM lo GROUP BY 1, 2),
pr AS (SELECT *, loss > 150 AS predict FROM dt), ch AS (SELECT *, CASE WHEN label <> lag(label) OVER w THEN 1 ELSE 0 END AS c FROM pr WINDOW w AS (PARTITION BY target_id ORDER BY time)),
ru AS (SELECT *, sum(c) OVER (PARTITION BY target_id ORDER BY time) AS run FROM ch),
aj AS (SELECT *, CASE WHEN label THEN bool_or(predict) OVER (PARTITION BY target_id, run) ELSE predict END AS adjusted FROM ru)"""


def detections(spark, sf_dir):
    loss = F.col("loss")
    rows = losses(spark, sf_dir).groupBy("target_id", "time").agg(F.max("loss").alias("loss"), (F.bool_or((F.col("name") == "error") & (loss > 100)) | F.bool_or(loss > 160)).alias("label"))
    return rows.withColumn("predict", F.col("loss") > 150)


def f1_sql(rows: str, predict: str, by: str) -> str:
    return f"""SELECT {by}, tp, tn, fp, fn, round(p, 5) AS precision, round(c, 5) AS recall, round(2 * p * c / (p + c + 1e-5), 5) AS f1 FROM (SELECT *, tp / (tp + fp + 1e-5) AS p, tp / (tp + fn + 1e-5) AS c FROM
(SELECT {by}, count(*) FILTER ({predict} AND label) AS tp, count(*) FILTER (NOT {predict} AND NOT label) AS tn, count(*) FILTER ({predict} AND NOT label) AS fp, count(*) FILTER (NOT {predict} AND label) AS fn FROM {rows} GROUP BY {by}) x) y"""


@query("WITH " + DET_SQL + " " + f1_sql("aj", "adjusted", "target_id"))
def point_adjust_f1(spark, sf_dir):
    c = thresholds.confusion(thresholds.point_adjust(detections(spark, sf_dir), ["target_id"], "time"), ["target_id"], "adjusted")
    return c.select("target_id", "tp", "tn", "fp", "fn", r("precision", 5), r("recall", 5), r("f1", 5))


@query("WITH " + DET_SQL + ", gx AS (SELECT dt.target_id, dt.label, g.cut, dt.loss > g.cut AS hit FROM dt, (SELECT 50 + 10 * i AS cut FROM range(16) t(i)) g), sc AS (" + f1_sql("gx", "hit", "target_id, cut") + ") SELECT target_id, CAST(cut AS BIGINT) AS cut, f1 FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY f1 DESC, cut) AS k FROM sc) x WHERE k = 1")
def best_f1_threshold(spark, sf_dir):
    """The threshold of a grid with the best F1, the smallest of equals."""
    rows = detections(spark, sf_dir).withColumn("cut", F.explode(F.sequence(F.lit(50), F.lit(200), F.lit(10)))).withColumn("hit", F.col("loss") > F.col("cut"))
    c = thresholds.confusion(rows, ["target_id", "cut"], "hit").withColumn("f1", F.round("f1", 5))
    best = c.withColumn("k", F.row_number().over(Window.partitionBy("target_id").orderBy(F.col("f1").desc(), "cut"))).where("k = 1")
    return best.select("target_id", F.col("cut").cast("long").alias("cut"), "f1")


@query("WITH " + DET_SQL + """, lr AS (SELECT target_id, run, max(loss) AS top, count(*) AS len FROM ru WHERE label GROUP BY 1, 2), cu AS (SELECT DISTINCT target_id, loss AS cut FROM ru),
hi AS (SELECT cu.target_id, cu.cut, coalesce(sum(lr.len) FILTER (lr.top >= cu.cut), 0) AS tp, coalesce(sum(lr.len), 0) AS labels FROM cu LEFT JOIN lr ON cu.target_id = lr.target_id GROUP BY 1, 2),
fa AS (SELECT cu.target_id, cu.cut, count(ru.loss) AS fp FROM cu LEFT JOIN ru ON cu.target_id = ru.target_id AND NOT ru.label AND ru.loss >= cu.cut GROUP BY 1, 2),
pc AS (SELECT hi.*, fa.fp, labels - tp AS fn, tp / (tp + fp + 1e-5) AS p, tp / (labels + 1e-5) AS c FROM hi JOIN fa ON hi.target_id = fa.target_id AND hi.cut = fa.cut),
f AS (SELECT *, 2 * p * c / (p + c + 1e-5) AS f1 FROM pc)
SELECT target_id, round(cut, 6) AS cut, CAST(tp AS BIGINT) AS tp, fp, CAST(fn AS BIGINT) AS fn, round(p, 5) AS precision, round(c, 5) AS recall, round(f1, 5) AS f1
FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(f1, 9) DESC, cut) AS k FROM f) x WHERE k = 1""")
def best_f1_all_cuts(spark, sf_dir):
    """The best of all cuts by point-adjusted F1, found in one sweep."""
    best = thresholds.best_cut(detections(spark, sf_dir), ["target_id"], "time", "loss")
    return best.select("target_id", r("cut"), "tp", "fp", "fn", r("precision", 5), r("recall", 5), r("f1", 5))


@query("WITH " + DET_SQL + ", nu AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY time) AS k FROM pr), sg AS (SELECT *, k - row_number() OVER (PARTITION BY target_id ORDER BY time) AS g FROM nu WHERE label) SELECT target_id, min(time) AS first, max(time) AS last, count(*) AS length FROM sg GROUP BY target_id, g")
def anomaly_segments(spark, sf_dir):
    return thresholds.segments(detections(spark, sf_dir), "label", ["target_id"], "time")


@query("WITH " + FILLED_SQL + " SELECT target_id, inst, name, n FROM (SELECT f.target_id, split_part(f.target_id, '_', 1) AS inst, f.name, count(f.filled) AS n FROM fi f WHERE f.target_id NOT IN (SELECT DISTINCT target_id FROM mp WHERE inst_type = 'db') GROUP BY 1, 2, 3) x")
def targets_not_fitted_anti_join(spark, sf_dir):
    """Series of targets without a fitted scaler (only db targets have one here)."""
    p = points(spark, sf_dir)
    fitted = p.where("inst_type = 'db'").select("target_id").distinct()
    framed = frames.interpolate(frames.on_spine(p)).join(fitted, "target_id", "left_anti")
    return framed.groupBy("target_id", F.split_part("target_id", F.lit("_"), F.lit(1)).alias("inst"), "name").agg(F.count("filled").alias("n"))


@query(f"WITH {LOSS_SQL} SELECT target_id, name, round(sqrt(avg(loss * loss)), 6) AS rms, count(*) AS n FROM lo GROUP BY 1, 2")
def loss_rms(spark, sf_dir):
    """Root mean square of each series' losses."""
    return losses(spark, sf_dir).groupBy(*KEYS).agg(F.round(F.sqrt(F.avg(F.col("loss") * F.col("loss"))), 6).alias("rms"), F.count("*").alias("n"))


#: alarm levels that were configured; other targets take the defaults
LEVELS, DEFAULT_LEVEL = [("was_0", 20.0, 40.0), ("db_1", 15.0, None)], (25.0, 50.0)


@query(f"""WITH {ANOM_SQL}, lv AS (SELECT * FROM (VALUES ('was_0', 20.0::DOUBLE, 40.0::DOUBLE), ('db_1', 15.0, NULL)) v(target_id, critical, warning)),
j AS (SELECT gr.target_id, gr.time, gr.normality_score, coalesce(lv.critical, 25) AS critical, coalesce(lv.warning, 50) AS warning FROM gr LEFT JOIN lv ON gr.target_id = lv.target_id)
SELECT target_id, time, critical, warning, CASE WHEN normality_score <= critical THEN 'critical' WHEN normality_score <= warning THEN 'warning' ELSE 'normal' END AS level FROM j""")
def alarm_level_lookup(spark, sf_dir):
    """Each score's alarm level by its target's configuration, or by the defaults where a level is not configured."""
    raw = scored(spark, sf_dir).groupBy("target_id", "time").agg(F.avg("score").alias("raw"))
    levels = spark.createDataFrame(LEVELS, "target_id string, critical double, warning double")
    rows = raw.withColumn("n", scoring.floored(F.col("raw"))).join(levels, "target_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(("critical", "warning"), DEFAULT_LEVEL)})
    level = F.when(F.col("n") <= F.col("critical"), "critical").when(F.col("n") <= F.col("warning"), "warning").otherwise("normal")
    return rows.select("target_id", "time", "critical", "warning", level.alias("level"))


#: alarm levels of a system's alarm types as ranges of a count of anomalous steps; the default row takes all others (fixed values)
ALARM_LEVELS, ALARM_DEFAULT = [("1", "was", "1,2", "3,4", "5,9"), ("1", "db", "2,4", "5,7", "8,9")], ("1,3", "4,5", "6,7")


@query(f"""WITH {ANOM_SQL}, al AS (SELECT * FROM (VALUES ('1', 'was', '1,2', '3,4', '5,9'), ('1', 'db', '2,4', '5,7', '8,9')) v(sys_id, alarm_type, attention_level, warning_level, critical_level)),
dy AS (SELECT '1' AS sys_id, inst_type, target_id, CAST(time AS DATE) AS day, count(*) FILTER (normality_score < 50) AS n FROM gr GROUP BY 2, 3, 4),
jn AS (SELECT dy.*, coalesce(attention_level, '1,3') AS attention_level, coalesce(warning_level, '4,5') AS warning_level, coalesce(critical_level, '6,7') AS critical_level FROM dy LEFT JOIN al ON dy.sys_id = al.sys_id AND dy.inst_type = al.alarm_type)
SELECT sys_id, inst_type, target_id, day, n, attention_level, warning_level, critical_level,
  CASE WHEN n >= CAST(split_part(critical_level, ',', 1) AS INTEGER) THEN 'critical' WHEN n >= CAST(split_part(warning_level, ',', 1) AS INTEGER) THEN 'warning' WHEN n >= CAST(split_part(attention_level, ',', 1) AS INTEGER) THEN 'attention' END AS level FROM jn""")
def alarm_levels_by_system(spark, sf_dir):
    """Each target's day by the number of its anomalous steps: three levels by system and alarm type, or those of the default row."""
    raw = scored(spark, sf_dir).groupBy("inst_type", "target_id", "time").agg(F.avg("score").alias("raw"))
    bad = F.count_if(scoring.floored(F.col("raw")) < 50).alias("n")
    days = raw.groupBy(F.lit("1").alias("sys_id"), "inst_type", "target_id", F.to_date("time").alias("day")).agg(bad)
    names = ["attention_level", "warning_level", "critical_level"]
    levels = spark.createDataFrame(ALARM_LEVELS, "sys_id string, inst_type string, " + ", ".join(f"{n} string" for n in names))
    rows = days.join(levels, ["sys_id", "inst_type"], "left").withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zip(names, ALARM_DEFAULT)})
    first = lambda c: F.split_part(F.col(c), F.lit(","), F.lit(1)).cast("int")
    level = F.when(F.col("n") >= first("critical_level"), "critical").when(F.col("n") >= first("warning_level"), "warning").when(F.col("n") >= first("attention_level"), "attention")
    return rows.select("sys_id", "inst_type", "target_id", "day", "n", *names, level.alias("level"))
