"""Hand-made cases with known results."""

import datetime
import json
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skerry.functions import text
from skerry.operators import frames, graphs, kernels, miner, models, ordering, scoring, serving, smoothing, thresholds
from skerry.plans import assembly, logs
from skerry.plans import serving as served
from skerry.plans.detection import trend
from skerry.plans.logs import alarm_messages
from skerry.plans.metrics import flatline
from skerry.plans.registry import ORACLE
from skerry.sources import envelopes, relations, sinks, store, tables
from skerry.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)


def series(spark, values, target="t", name="m"):
    rows = [(target, name, i, T0 + datetime.timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "target_id string, name string, seq int, time timestamp_ntz, real_value double")


def test_interpolate(spark):
    got = frames.interpolate(series(spark, [None, 1, None, None, 4, None])).orderBy("seq").collect()
    assert [r.filled for r in got] == [1, 1, 2, 3, 4, 4]


def test_interpolate_nothing_known(spark):
    got = frames.interpolate(series(spark, [None, None])).collect()
    assert {r.filled for r in got} == {None}
    assert {r.filled for r in frames.interpolate(series(spark, [None, None]), both=False).collect()} == {0.0}


def test_ewm(spark):
    got = smoothing.ewm(series(spark, [1, 5, 2, 8]), "real_value").orderBy("seq").collect()
    want = pd.Series([1.0, 5, 2, 8]).ewm(span=3).mean()
    assert [r.ewm for r in got] == pytest.approx(want.tolist())


@pytest.mark.parametrize(("missing", "code"), [(range(5), "OK"), (range(57, 60), "E704"), (range(6), "E704")])
def test_gaps(spark, missing, code):
    rows = series(spark, [None if i in missing else 1.0 for i in range(60)])
    assert frames.gap_status(rows).first().error_code == code


def test_asof(spark):
    lookup = spark.createDataFrame([("t", 0.1, 100.0), ("t", 0.5, 60.0), ("t", 0.9, 20.0)], "target_id string, loss double, score double")
    rows = spark.createDataFrame([("t", 0.05), ("t", 0.5), ("t", 2.0), ("u", 1.0)], "target_id string, x double")
    got = {(r.target_id, r.x): r.score for r in scoring.asof_backward(rows, lookup, ["target_id"], "x", "loss", "score").collect()}
    assert got == {("t", 0.05): None, ("t", 0.5): 60.0, ("t", 2.0): 20.0, ("u", 1.0): None}
    ahead = {r.x: r.score for r in scoring.asof_forward(rows, lookup, ["target_id"], "x", "loss", "score").collect() if r.target_id == "t"}
    assert ahead == {0.05: 100.0, 0.5: 20.0, 2.0: None}


def test_grades(spark):
    got = spark.createDataFrame([(30.0,), (50.0,), (50.1,)], "s double").select(scoring.grade(F.col("s")).alias("g")).collect()
    assert [r.g for r in got] == [2, 1, 0]


def test_detection_type(spark):
    rows = spark.createDataFrame([(True, True), (False, True), (True, False), (False, False)], "k boolean, s boolean")
    assert [r.t for r in rows.select(text.detection_type(F.col("k"), F.col("s")).alias("t")).collect()] == [1, 2, 3, 0]


def test_words_only_is_unicode(spark):
    rows = spark.createDataFrame([("오류: 값=12, é!",), (None,)], "m string")
    assert [r.w for r in rows.select(text.words_only(F.col("m")).alias("w")).collect()] == ["오류  값   é ", None]


def test_masks(spark):
    rows = spark.createDataFrame([("from 10.0.0.1 took -5 of 7 at 0xFF x7",)], "m string")
    assert rows.select(text.masked(F.col("m")).alias("w")).first().w == "from <:IP:> took <:NUM:> of <:NUM:> at <:HEX:> x7"


def test_band_handles_constant(spark):
    rows = smoothing.band(series(spark, [5.0] * 30 + [9.0]), 24).orderBy("time").collect()
    assert rows[-1].anomaly and rows[-1].z_score is None and not rows[0].anomaly


def test_late_filter(spark):
    at = F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00"))
    offsets = [-65, -64, -60, -59, 0, 5, 6]
    rows = spark.createDataFrame([("t", "m", datetime.datetime(2024, 1, 5) + datetime.timedelta(hours=o), 1.0) for o in offsets], "target_id string, name string, time timestamp_ntz, real_value double")
    got = frames.late_filter(rows, rows, at).collect()
    served = {(r.time - datetime.datetime(2024, 1, 5)).total_seconds() / 3600: r.served for r in got}
    assert served == {-64: False, -60: False, -59: True, 0: True, 5: False}


def test_tail_fit_recovers_shape():
    r = np.random.default_rng(3)
    for gamma in (0.3, -0.3):
        x = 2.0 / gamma * ((1 - r.random(4000)) ** -gamma - 1)
        got, sigma, _ = thresholds.fit_tail(np.sort(x))
        assert got == pytest.approx(gamma, abs=0.08) and sigma == pytest.approx(2.0, rel=0.1)


def test_streaming_pot_alarms():
    r = np.random.default_rng(1)
    x = r.exponential(1, 600)
    x[500] = 100
    got = thresholds.streaming_pot(pd.DataFrame({"time": range(600), "score": x}))
    assert got["alarm"].iloc[500] and got["alarm"].sum() < 12


def test_point_adjust(spark):
    rows = spark.createDataFrame([("t", i, bool(y), bool(p)) for i, (y, p) in enumerate(zip([0, 1, 1, 0, 1, 0], [0, 0, 1, 0, 0, 1]))], "k string, i int, label boolean, predict boolean")
    got = thresholds.point_adjust(rows, ["k"], "i").orderBy("i").collect()
    assert [r.adjusted for r in got] == [False, True, True, False, False, True]


def test_segments(spark):
    rows = spark.createDataFrame([("t", i, f) for i, f in enumerate([True, True, False, True])], "k string, i int, f boolean")
    assert sorted((r.first, r.last, r.length) for r in thresholds.segments(rows, "f", ["k"], "i").collect()) == [(0, 1, 2), (3, 3, 1)]


def test_miner(spark):
    texts = ["open file a", "open file b", "bye", "open file c", "9 lives now", "7 lives left", ""]
    lines = spark.createDataFrame([(t, i, 0, x) for t in ("t", "u") for i, x in enumerate(texts)], "target_id string, doc_id long, pos long, msg string")
    got = {r.doc_id: r for r in miner.online_templates(lines, 0.4).where("target_id = 't'").collect()}
    assert [got[i].change for i in range(7)] == ["created", "changed", "created", "none", "created", "changed", "created"]
    assert [got[i].template_id for i in range(7)] == [1, 1, 3, 1, 5, 5, 7] and got[3].cluster_size == 3
    assert got[3].rate == 0.75 and not got[3].sparse and got[5].sparse and got[6].rate == pytest.approx(1 / 7)
    assert not miner.online_templates(lines.limit(0)).collect()


def test_miner_with_many_templates_and_other_white_space(spark, monkeypatch):
    """A leaf of many templates gives what comparing one by one gives; only blanks that make leaves cut words."""
    r = np.random.default_rng(11)
    texts = [" ".join(["go", *r.choice([*"abcdefgh", "<*>"], 6)]) for _ in range(600)]
    once = miner.Leaf(0.6)
    found = [once.add(x) for x in texts]
    assert once.table is not None
    monkeypatch.setattr(miner, "_FEW", 10**6)
    plain = miner.Leaf(0.6)
    assert found == [plain.add(x) for x in texts] and once.sizes == plain.sizes and len(plain.sizes) > 20
    lines = spark.createDataFrame([("t", i, 0, x) for i, x in enumerate(["a b\u00a0c", "a  b", "a\tb "])], "target_id string, doc_id long, pos long, msg string")
    assert {x.doc_id: x.template_id for x in miner.online_templates(lines).collect()} == {0: 1, 1: 1, 2: 1}
    assert {x.doc_id: x.cluster_size for x in miner.online_templates(lines.withColumn("total", F.col("doc_id") + 1)).collect()} == {0: 1, 1: 2, 2: 3}


def test_alarm_messages_are_bounded(spark):
    rows = spark.createDataFrame([("t", i, 0, "error", 0.5) for i in range(250)] + [("u", 1, 0, "fail", 0.25)], "target_id string, doc_id long, pos long, keyword string, rate double")
    got = {(r.target_id, r.part): json.loads(r.message) for r in alarm_messages(rows).collect()}
    assert {k: len(v["sparseLog"]) for k, v in got.items()} == {("t", 0): 100, ("t", 1): 100, ("t", 2): 50, ("u", 0): 1}
    assert [x["doc_id"] for k in range(3) for x in got["t", k]["sparseLog"]] == list(range(250))
    assert got["u", 0] == {"inst_type": "log", "sparseLog": [{"doc_id": 1, "pos": 0, "keyword": "fail", "probability": 25.0}]}


def in_order(spark, rows, by, order):
    """Lines (key, order, text) numbered, with template ids."""
    df = spark.createDataFrame(rows, "k string, i int, tpl string").withColumn("t", F.xxhash64("tpl"))
    return ordering.numbered(df, by, order)


def test_graph(spark):
    lines = in_order(spark, [("t", i, x) for i, x in enumerate("abab")], ["k"], ["i"])
    edges = graphs.transitions(lines, ["k"], "tpl")
    assert {(r.src, r.dst): r.weight for r in edges.collect()} == {("a", "b"): 2, ("b", "a"): 1}
    p = graphs.row_normalized(edges, ["k"])
    assert {(r.src, r.dst): round(r.p, 4) for r in p.collect()} == {("a", "a"): 0.3333, ("a", "b"): 0.6667, ("b", "b"): 0.5, ("b", "a"): 0.5}


def plain_operators(w, alpha=0.1):
    """The operators of one window, by the eigenvector of the whole transition matrix."""
    nodes = list(dict.fromkeys(w))
    n = len(nodes)
    m = np.eye(n)
    for a, b in zip(w, w[1:]):
        m[nodes.index(a), nodes.index(b)] += 1
    p = m / m.sum(1, keepdims=True)
    big = np.zeros((n + 1, n + 1))
    big[:n, :n], big[n, :n], big[:n, n] = (1 - alpha) * p, 1 / n, alpha
    values, vectors = np.linalg.eig(big.T)
    pi = vectors[:, values.real.argmax()].real[:n]
    pi = pi / pi.sum()
    half = np.diag(np.sqrt(pi)) @ p @ np.diag(1 / np.sqrt(pi))
    scaled = lambda x: x / np.sqrt(x.sum(1)[:, None] * x.sum(1)[None, :])
    first = scaled((half + half.T) / 2)
    q = first + np.eye(n)
    q = q / q.sum(1, keepdims=True)
    into, out = q.T @ q, q @ q.T
    return nodes, pi, first, scaled(np.where((into != 0) & (out != 0), (into + out) / 2, 0))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_masked_once_and_counts_written(spark):
    one_hot = assembly.template_match_one_hot(spark, "/root/testdata/sf0.001")
    assert "regexp_replace" not in plan_of(one_hot)


def test_header_counts_all_scored_lines(spark):
    sf = "/root/testdata/sf0.001"
    scored = {r.target_id: r["count"] for r in logs.log_window_line_avg_score(spark, sf).groupBy("target_id").count().collect()}
    found = [r for r in served.log_serving_header(spark, sf).collect() if r.total_count is not None]
    assert found and all(r.total_count == scored[r.target_id] for r in found)


def test_texts_of_templates_without_a_sort(spark):
    found = logs.texts_of(spark.range(9).select((F.col("id") % 3).alias("t"), F.concat(F.lit("x"), F.col("id") % 3).alias("tpl")))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 3


def test_totals_of_a_target_without_a_window(spark):
    assert "Window" not in plan_of(logs.log_template_batch(spark, "/root/testdata/sf0.001"))


def test_lines_that_no_mask_matches_are_told_by_one_look(spark):
    parts = ["abcdef", "abcd", "ab", ":", " ", "1", "ABCD", "AB", "z", "-", "executed cmd ", '"x"', "\n"]
    draw = np.random.default_rng(5)
    made = ["".join(draw.choice(parts, draw.integers(1, 9))) for _ in range(3000)]
    found = spark.createDataFrame([(m,) for m in [*made, None]], "m string").select("m", text.masked(F.col("m")).alias("a"))
    chain = text.replace_chain(F.col("m"), [(p, f"<:{n}:>") for p, n in text.FAST_MASKS])
    assert "RLIKE" in plan_of(found) and found.where(~F.col("a").eqNullSafe(chain)).count() == 0
    assert 0 < found.where("a <> m").count() < found.where(F.col("m").rlike(text.MASKABLE)).count() < 3000


def test_keywords_without_a_lambda(spark):
    found = spark.createDataFrame([("Fatal ERROR",), ("token",), ("none",), ("",), (None,)], "m string").select(text.keywords_in(F.col("m"), logs.KEYWORDS).alias("k"))
    assert [r.k for r in found.collect()] == ["error,fatal", "token", None, None, None] and "lambda" not in plan_of(found)


def ordered_rows(spark, known=()):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    folders = {f for f in os.listdir(root) if f.startswith("ordered-")}
    return folders, [spark.read.parquet(f"{root}/{f}").count() for f in folders - set(known)]


def test_documents_are_put_in_order_and_not_lines(spark, tmp_path):
    """Also with documents of one id, without an id, without a source or without text."""
    rows = [("a", 3, "x\ny\n"), ("a", 1, "x"), ("a", 3, "z"), (None, 3, "x\ny"), (None, 2, ""), ("a", None, "q\nr"), ("b", 1, None)]
    spark.createDataFrame(rows, "source string, doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = logs.in_order(spark, str(tmp_path), logs.identified(spark, str(tmp_path)).withColumn("x", F.col("msg")), "x").collect()
    for target in ("a", None):
        own = sorted((r for r in got if r.target_id == target), key=lambda r: r.n)
        lines = [(d is not None, d or 0, p, x) for s, d, t in rows if s == target for p, x in enumerate(t.split("\n"))]
        assert [r.n for r in own] == list(range(1, len(lines) + 1)) and sorted((r.doc_id is not None, r.doc_id or 0, r.pos, r.x) for r in own) == sorted(lines)
        assert [(r.doc_id is not None, r.doc_id or 0, r.pos) for r in own] == [x[:3] for x in sorted(lines)]
    sf, (known, _) = "/root/testdata/sf0.001", ordered_rows(spark)
    assert logs.in_order(spark, sf, logs.identified(spark, sf)).count() == 1829
    assert ordered_rows(spark, known)[1] == [200]


def test_places_of_hot_and_of_rare_keys(spark):
    r = np.random.default_rng(7)
    keys = [(str(k) if k else None) for k in np.minimum(r.geometric(0.3, 600) - 1, 40).tolist()]
    df = spark.createDataFrame([(k, n + 1) for n, k in enumerate(keys)], "k string, n long")
    got = {x.n: x.place for x in ordering.places(df, ["k"], "place", size=23).collect()}
    assert got == {n + 1: keys[: n + 1].count(k) for n, k in enumerate(keys)}


def test_edges_of_a_target_without_a_name_are_normalized(spark):
    edges = spark.createDataFrame([(None, "a", "b", 1), ("t", "a", "b", 3)], "k string, src string, dst string, weight long")
    got = {(r.k, r.src, r.dst): r.p for r in graphs.row_normalized(edges, ["k"]).collect()}
    assert got == {(None, "a", "a"): 0.5, (None, "a", "b"): 0.5, (None, "b", "b"): 1.0, ("t", "a", "a"): 0.25, ("t", "a", "b"): 0.75, ("t", "b", "b"): 1.0}


def test_masks_as_spark_runs_them(spark):
    parts = ["abcdef", "abcdefabcdef", "0123456789abcdef01", "ab", "abc", ":", " ", "  ", "1", "123", "1234", ".", "0x", "0x1f", "ABCD", "ABCDE", "z", "-", "+", "é", "_", "\n", "\r", 'executed cmd "', '"']
    draw = np.random.default_rng(3)
    made = ["".join(draw.choice(draw.choice(parts, 4), draw.integers(1, 16))) for _ in range(4000)]
    made += ["ab:cd:ef:ab:cd:zz", "ab:cd:ef:ab:cdz ab:cd:ef:ab", "1.2.3.4.5 a1.2.3.4 1.2.3.4", "abcdefabcdef abcdef abcdefz", "abcdef abcdef abcdef  x", "ABCD ABCD ABCD ABCD ABCDE", "a-5 -5 +5 --5", "0x1g 0x1f"]
    rows = spark.createDataFrame([(m,) for m in made], "m string")
    for (plain, name), (fast, same) in zip(text.MASKS, text.FAST_MASKS, strict=True):
        both = rows.select("m", F.regexp_replace("m", plain, "<>").alias("a"), F.regexp_replace("m", fast, "<>").alias("b"))
        assert name == same and both.where("a <> m").count() > 0 and both.where("a <> b").count() == 0


def test_windows_of_a_block_that_begins_none(spark):
    rows = [(k, i, "abc"[i % 3]) for k, n in (("whole", 8192 + 5), ("short", 4)) for i in range(n)]
    windows = graphs.line_windows(in_order(spark, rows, ["k"], ["i"]), ["k"], ["i"])
    assert [(r.k, r["count"]) for r in graphs.window_graphs(windows).groupBy("k").count().collect()] == [("whole", 8192 + 5 - 29)]
    assert [(r.k, r["count"]) for r in graphs.window_operators(windows, 2).groupBy("k").count().collect()] == [("whole", 8192 + 5 - 29)]


def test_window_operators(spark):
    rows = [(k, i, x) for k, t in (("t", "abacabadbaccab"), (None, "xyxyxzzzzz")) for i, x in enumerate(t)]
    windows = graphs.line_windows(in_order(spark, rows, ["k"], ["i"]), ["k"], ["i"], width=5)
    assert windows.count() == 10 + 6
    first, second = ({(x.k, x.i): x for x in graphs.window_operators(windows, n).collect()} for n in (1, 2))
    counts = {(x.k, x.i): (x.nodes, x.edges) for x in graphs.window_graphs(windows).collect()}
    texts = {k: t for k, t in (("t", "abacabadbaccab"), (None, "xyxyxzzzzz"))}
    hashes = {r.tpl: r.t for r in spark.createDataFrame([(c,) for c in "abcdxyz"], "tpl string").withColumn("t", F.xxhash64("tpl")).collect()}
    assert set(first) == set(second) == {(k, i) for k, t in texts.items() for i in range(len(t) - 4)}
    for k, i in first:
        w = texts[k][i : i + 5]
        nodes, pi, one, two = plain_operators(w)
        for got, want in ((first[k, i], one), (second[k, i], two)):
            assert got.nodes == [hashes[x] for x in nodes] and got.pi == pytest.approx(pi)
            dense = np.zeros_like(want)
            for e in got.operator:
                dense[e.src, e.dst] = e.weight
            assert dense == pytest.approx(want)
        assert counts[k, i] == (len(nodes), len(set(zip(w, w[1:]))))


def test_shapes_are_solved_once():
    w = np.array([[5, 7, 5, 9], [1, 2, 1, 3], [4, 4, 4, 4]])
    assert graphs.first_sights(w).tolist() == [[0, 1, 0, 3], [0, 1, 0, 3], [0, 0, 0, 0]]
    assert graphs.edge_counts(graphs.first_sights(w)).tolist() == [3, 3, 1]


def test_line_scores_average_covering_windows(spark):
    t, want = "aaaaaabcdbcaaaaaaa", {}
    lines = in_order(spark, [("t", i, x) for i, x in enumerate(t)], ["k"], ["i"])
    got = {r.i: r.line_score for r in graphs.line_scores(lines, ["k"], ["i"], graphs.own_shares, width=4).collect()}
    for at in range(len(t) - 3):
        w = t[at : at + 4]
        if len(set(zip(w, w[1:]))) > 1:
            for i, x in enumerate(w):
                want.setdefault(at + i, []).append(w.count(x) / 4)
    assert got == pytest.approx({i: sum(v) / len(v) for i, v in want.items()}) and 13 in got
    assert not graphs.line_scores(lines.where("n < 4"), ["k"], ["i"], graphs.own_shares, width=4).collect()


def test_line_scores_over_block_borders(spark):
    r = np.random.default_rng(4)
    t = r.integers(0, 4, 20_000)
    lines = ordering.numbered(spark.createDataFrame([("t", i, int(x)) for i, x in enumerate(t)], "k string, i int, t long"), ["k"], ["i"])
    got = {r.i: r.line_score for r in graphs.line_scores(lines, ["k"], ["i"], graphs.own_shares).where("i BETWEEN 8100 AND 8300 OR i > 19950").collect()}
    for i in (8100, 8191, 8192, 8220, 19960, 19999):
        starts = [s for s in range(i - 29, i + 1) if 0 <= s <= len(t) - 30]
        assert got[i] == pytest.approx(np.mean([(t[s : s + 30] == t[i]).mean() for s in starts]))


def test_numbered(spark):
    r = np.random.default_rng(1)
    rows = [(k, int(d), p) for k in ("a", None, "b") for d in r.permutation(40) for p in range(3)]
    df = spark.createDataFrame(rows, "k string, d long, p int")
    got = {(x.k, x.d, x.p): (x.n, x.all) for x in ordering.numbered(df, ["k"], ["d", "p"], total="all").collect()}
    assert got == {(k, d, p): (3 * d + p + 1, 120) for k, d, p in rows}
    dealt = ordering.blocks(ordering.numbered(df, ["k"], ["d", "p"]), 4, size=50, behind=3).collect()
    assert sum(x._own for x in dealt) == len(rows) and len(dealt) == len(rows) + 3 * 2 * (4 + 3)
    assert not ordering.numbered(df.limit(0), ["k"], ["d", "p"], ties=True).collect()


@pytest.mark.parametrize("ids", ["hashed", "one document", "one row"])
def test_ranges_are_bounded_in_rows(spark, ids):
    """Sparse ids, one document with all lines, or one row again and again: no range holds much more than its share."""
    d, p = {"hashed": (F.xxhash64("id"), F.lit(0)), "one document": (F.lit(7), F.col("id")), "one row": (F.lit(7), F.lit(0))}[ids]
    df = spark.range(20_000).select(F.lit("hot").alias("k"), d.cast("long").alias("d"), p.cast("long").alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.numbered(df, ["k"], ["d", "p"], ties=True)
        held = [spark.read.parquet(f).count() for f in got.inputFiles() if "/ordered-" in f]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(held) == 20_000 and max(held) < 10_000
    rows = got.orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 20_001)) and [(r.d, r.p) for r in rows] == sorted((r.d, r.p) for r in rows)


def test_running_and_carried(spark):
    r = np.random.default_rng(2)
    x = [None if v > 0.3 else float(v) for v in r.random(500)]
    df = spark.createDataFrame([(k, i + 1, v) for k in ("a", None) for i, v in enumerate(x)], "k string, n long, v double")
    both = ordering.carried(ordering.running(df, ["k"], "v", "total", size=37), ["k"], "v", "last", size=37).collect()
    s = pd.Series(x, dtype=float)
    for k in ("a", None):
        got = sorted((y for y in both if y.k == k), key=lambda y: y.n)
        assert [y.total if y.total is not None else 0.0 for y in got] == pytest.approx(s.fillna(0).cumsum().tolist())
        assert [y.last for y in got] == [None if math.isnan(v) else v for v in s.ffill()]


def test_asof_with_a_hot_key(spark):
    """A key with nine tenths of the rows, many of them equal, against a merge of sorted tables."""
    r = np.random.default_rng(5)
    rows = pd.DataFrame({"k": ["hot"] * 9000 + ["other"] * 1000, "x": np.round(r.random(10_000), 3), "i": range(10_000)})
    table = pd.DataFrame({"k": ["hot"] * 300 + ["other"] * 50, "loss": np.round(r.random(350), 3)}).drop_duplicates()
    table["score"] = np.arange(len(table), dtype=float)
    left, right = spark.createDataFrame(rows), spark.createDataFrame(table)
    back = {y.i: y.score for y in scoring.asof_backward(left, right, ["k"], "x", "loss", "score").collect()}
    ahead = {y.i: y.score for y in scoring.asof_forward(left, right, ["k"], "x", "loss", "score").collect()}
    rows, table = rows.sort_values("x"), table.sort_values("loss")
    for got, how in ((back, {}), (ahead, {"direction": "forward", "allow_exact_matches": False})):
        want = pd.merge_asof(rows, table, left_on="x", right_on="loss", by="k", **how)
        assert got == {i: None if math.isnan(v) else v for i, v in zip(want["i"], want["score"])}


@pytest.mark.parametrize("level", [0.0, 0.5, 0.95, 0.999, 1 - 1e-9])
def test_value_at_a_place(spark, level):
    r = np.random.default_rng(6)
    x = {"a": r.normal(size=5001), "b": np.round(r.random(4000), 1), "c": np.array([3.0]), None: np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, values in x.items() for v in values] + [("a", None)]
    got = {y.k: (y.threshold, y.n) for y in thresholds.value_at(spark.createDataFrame(rows, "k string, score double").repartition(5), ["k"], level).collect()}
    assert got == {k: (float(np.sort(v)[int(np.floor(len(v) * level))]), len(v)) for k, v in x.items()}


def test_tails_by_partial_sums(spark):
    """Fits whose sums are added over many tasks equal the ones over all excesses at once."""
    r = np.random.default_rng(7)
    x = {i: np.abs(2.0 / g * ((1 - r.random(n)) ** -g - 1)) for i, (g, n) in enumerate([(0.3, 3000), (-0.3, 3000), (0.05, 500), (0.8, 40), (-0.8, 60), (0.2, 2)])}
    x[9] = np.array([1.5])
    rows = spark.createDataFrame([(i, float(v)) for i, values in x.items() for v in values], "id long, y double").repartition(7)
    got = {y.id: y for y in thresholds.fit_tails(rows).collect()}
    for i, y in x.items():
        gamma, sigma, _ = thresholds.fit_tail(np.sort(y))
        level = lambda g, s: s * math.log(10) if abs(g) < 1e-8 else s / g * (0.1**-g - 1)
        assert got[i].n == len(y) and level(got[i].gamma, got[i].sigma) == pytest.approx(level(gamma, sigma), rel=1e-6)


def test_best_cut_equals_trying_every_cut(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for k in ("a", None, "none"):
        y = np.repeat(r.random(60) < (0.3 if k != "none" else 0), r.integers(1, 6, 60))
        x = np.round(r.random(len(y)) + 0.3 * y, 2)
        rows += [(k, i, float(a), bool(b)) for i, (a, b) in enumerate(zip(x, y))]
        runs = np.cumsum(np.diff(y, prepend=y[:1]) != 0)
        tried = []
        for cut in np.unique(x):
            p = x >= cut
            for run in np.unique(runs[y]):
                if p[runs == run].any():
                    p[runs == run] = True
            tp, fp, fn = (p & y).sum(), (p & ~y).sum(), (~p & y).sum()
            a, b = tp / (tp + fp + 1e-5), tp / (tp + fn + 1e-5)
            tried.append((round(2 * a * b / (a + b + 1e-5), 9), -cut, tp, fp, fn))
        want[k] = max(tried)
    got = thresholds.best_cut(spark.createDataFrame(rows, "k string, i int, x double, label boolean"), ["k"], "i", "x").collect()
    assert {g.k: (round(g.f1, 9), -g.cut, g.tp, g.fp, g.fn) for g in got} == want


def test_grid_sums(spark):
    r = np.random.default_rng(9)
    rows = [(k, float(v)) for k in ("a", None) for v in r.random(300) * 9] + [("a", None), ("b", float("nan"))]
    got = kernels.grid_sums(spark.createDataFrame(rows, "key string, v double").repartition(6), 10.0, 50, 0.5, fan=3).collect()
    at = np.linspace(0, 10, 50)
    for k in ("a", None):
        v = np.array([x for key, x in rows if key == k and x is not None])
        own = sorted((g.i, g.n, g.sum) for g in got if g.key == k)
        assert [g[2] for g in own] == pytest.approx(np.exp(-0.5 * ((at[:, None] - v) / 0.5) ** 2).sum(axis=1).tolist()) and {g[1] for g in own} == {300}
    assert {g.key for g in got} == {"a", None}


def test_forward_scores(spark):
    rows = spark.createDataFrame([(0.555, False), (0.555, True), (None, False), (0.98, True)], "c double, a boolean")
    assert [r.s for r in rows.select(scoring.forward_score(F.col("c"), F.col("a")).alias("s")).collect()] == [72.2, 22.2, 5.0, 5.0]


def test_values_by_key_do_not_collide(spark, tmp_path):
    rows = spark.createDataFrame([("a:b", "c", 1), ("a", "b:c", 2), (None, "x", 3), ("x", None, 4), ("null", "x", 5)], "k string, l string, v int")
    store.put(rows, str(tmp_path / "values"), ["k", "l"])
    asked = rows.select("k", "l").union(spark.createDataFrame([("a:b:c", None)], "k string, l string"))
    got = {(r.k, r.l): r.v for r in store.get(asked, str(tmp_path / "values"), ["k", "l"], "v int").collect()}
    assert got == {("a:b", "c"): 1, ("a", "b:c"): 2, (None, "x"): 3, ("x", None): 4, ("null", "x"): 5, ("a:b:c", None): None}


def test_templates_are_whole_lines(spark):
    got = [r.t for r in spark.createDataFrame([("one two three ERROR disk full",), ("uno dos tres ok fine 12",), ('executed cmd "ls -l" in 5',), ("1 2 3 4",), ("aa:bb:cc:dd:ee",), ("",), (None,)], "m string").select(text.masked(F.col("m")).alias("t")).collect()]
    assert got == ["one two three ERROR disk full", "uno dos tres ok fine <:NUM:>", "executed cmd <:CMD:> in <:NUM:>", "<:NUM:> <:NUM:> <:NUM:> <:NUM:>", "<:ID:>", "", None]


def test_masks_of_lines_of_any_length(spark):
    """Java takes a call for each round of a repeated group that is not possessive, and such lines filled the stack; the driver's own calls, as a task's would end the JVM."""
    pattern = spark._jvm.java.util.regex.Pattern
    odd = {"ABCD " * 50000: "<:SEQ:>", "1234 " * 50000 + "x": "<:SEQ:> x", "1234 " * 50000 + "12345": "<:SEQ:> <:NUM:>", ":".join(["ab"] * 50000): "<:ID:>", ":".join(["ab"] * 50000) + "z": "<:ID:>:abz", "abcdef " * 50000: "<:SEQ:>"}
    for line, want in odd.items():
        for p, n in text.FAST_MASKS:
            line = pattern.compile(p).matcher(line).replaceAll(f"<:{n}:>")
        assert line == want


def test_masks_of_runs_at_borders(spark):
    fours, ids = text.MASKS[3][0], text.MASKS[0][0]
    draw = np.random.default_rng(11)
    for plain, (fast, _), parts in ((fours, text.FAST_MASKS[3], ["ABCD", "1234", "ABCDEF01", "ABC", "z"]), (ids, text.FAST_MASKS[0], ["ab", "cd1", "12", "abcdef", "a", "abg"])):
        gaps = [" " if plain == fours else ":"] * 6 + ["", "  ", "-", "\n"]
        made = ["".join(draw.choice(parts) + draw.choice(gaps) for _ in range(draw.integers(1, 14))) for _ in range(2000)]
        both = spark.createDataFrame([(m,) for m in made], "m string").select("m", F.regexp_replace("m", plain, "<>").alias("a"), F.regexp_replace("m", fast, "<>").alias("b"))
        assert both.where("a <> m").count() > 100 and both.where("a <> b").count() == 0


def documents(spark, tmp_path, rows):
    """A folder with (doc_id, text) as the documents of one target."""
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'t' AS source", "length(text) AS n_chars")
    table.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_window_operators_of_whole_lines(spark, tmp_path):
    """Lines that differ behind their first 300 characters are different nodes."""
    sf = documents(spark, tmp_path, [(i, "x" * 400 + "ab"[i % 2]) for i in range(31)])
    got = logs.directed_laplacian_pagerank(spark, sf).collect()
    assert len(got) == 2 and all(len(set(r.nodes)) == 2 and len(r.pi) == 2 for r in got)


def test_alarm_messages_of_whole_lines(spark, tmp_path):
    """A keyword may stand behind a line's first 300 characters, and lines that differ there have different templates."""
    sf = documents(spark, tmp_path, [(1, "y" * 350 + " fatal one"), (2, "y" * 350 + " error two")])
    items = [x for r in logs.log_alarm_message_json(spark, sf).collect() for x in json.loads(r.message)["sparseLog"]]
    assert [(x["doc_id"], x["keyword"], x["probability"]) for x in items] == [(1, "fatal", 100.0), (2, "error", 50.0)]


def test_templates_of_whole_lines_are_counted(spark, tmp_path):
    sf = documents(spark, tmp_path, [(i, "z" * 400 + " end " * (i % 2) + f"{i}") for i in range(6)])
    got = {(r.template, r.occurrences, r.ratio) for r in logs.log_template_batch(spark, sf).collect()}
    # digits right behind a letter are no number
    assert got == {("z" * 400 + " end <:NUM:>", 3, 0.5), *(("z" * 400 + f"{i}", 1, round(1 / 6, 8)) for i in (0, 2, 4))}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    assert {(r[1], r[2], r[3]) for r in con.sql(ORACLE["log_template_batch"]).fetchall()} == got


def test_flatline(spark):
    rows = series(spark, [5.0] * 30).unionByName(series(spark, list(range(30)), name="up"))
    assert {r.name: (r.equal_steps, r.flat) for r in flatline(rows).collect()} == {"m": (21, True), "up": (0, False)}


def test_trend(spark):
    x = np.random.default_rng(2).uniform(1, 9, 60)
    rows = smoothing.ewm(series(spark, x.tolist()), "real_value")
    a = pd.Series(x).ewm(span=3).mean().to_numpy()
    got = {r.step: r.value for r in trend(rows).collect()}
    for f in range(30):
        w = np.array([(60 + f) / (60 + f - k) for k in range(60)])[1:]
        assert got[f] == pytest.approx(a[-1] * np.prod((a[1:] / a[:-1]) ** w) ** (f / w.sum()))


def test_envelopes(spark):
    raw = spark.createDataFrame([('{"id1":"x","standard_datetime":"2024-01-01 00:00:00","header":{"sys_id":"1","target_id":"2","inst_type":"was"},"body":[{"time":"2024-01-01 00:00:00","cpu":"1.5","mem":"bad"}]}',), ("not json",)], "value string")
    got = relations.parse_envelopes(raw).collect()
    assert {(r.name, r.real_value) for r in got if r.id1} == {("cpu", 1.5), ("mem", None)}
    assert [r.error_code for r in got if not r.id1] == ["E703"]


def test_empty(spark):
    empty = series(spark, [1]).limit(0)
    assert not frames.interpolate(frames.on_spine(empty)).collect()
    assert not smoothing.band(empty).collect()
    assert not thresholds.pot(empty.select("target_id", "time", F.col("real_value").alias("score")), "target_id").collect()


def test_upsert(spark):
    schema = "k string, at int, v string"
    now = spark.createDataFrame([("a", 1, "old"), ("b", 5, "keep")], schema)
    change = spark.createDataFrame([("a", 1, "new"), ("b", 4, "late"), ("c", 1, "add")], schema)
    assert sorted(tuple(r) for r in sinks.upsert(now, change, ["k"], "at").collect()) == [("a", 1, "new"), ("b", 5, "keep"), ("c", 1, "add")]


def test_alarm_messages(spark):
    rows = spark.createDataFrame([("t", 2), ("t", 1)], "target_id string, n int").select("target_id", F.struct("n").alias("item"))
    got = sinks.alarm_messages(rows, rows.limit(0), rows.limit(0)).collect()
    assert [(r.key, r.value) for r in got] == [("t", '{"inst_type":"log","target_id":"t","data":{"sparseLog":[{"n":1},{"n":2}]}}')]


def test_models(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    got = {n: row.select(models.score(n, F.col("v"), 3).alias("x")).first().x for n in ("persistence", "moving_average", "linear")}
    assert got == {"persistence": [3, 3, 3], "moving_average": [2, 2, 2], "linear": [4, 5, 6]}
    with pytest.raises(KeyError, match="E714"):
        models.score("missing", F.col("v"))


def test_own_attention_stands_on_the_diagonal(spark):
    rows = spark.createDataFrame([(0, True), (1, False), (2, True)], "i int, bad boolean")
    row = serving.with_own(F.array(F.lit(0.1), F.lit(0.2)), F.lit(0.9), F.col("i"))
    names = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    got = rows.select("i", row.alias("att"), serving.attention_map(names, row, F.col("bad")).alias("m")).orderBy("i").collect()
    assert [g.att for g in got] == [[0.9, 0.1, 0.2], [0.1, 0.9, 0.2], [0.1, 0.2, 0.9]]
    assert got[0].m == {"a": 0.9, "b": 0.1, "c": 0.2} and got[1].m is None


def test_header_counts_lines_from_the_serving_minute_on(spark):
    rows = spark.createDataFrame(
        [("a", 1, 0.9), ("a", 2, 0.9), ("a", 3, 0.1), ("b", 1, 0.9), ("b", 2, 0.1), ("c", None, 0.9), ("a", 4, None)], "target_id string, m int, line_score double"
    ).withColumn("time", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("m")))
    got = {r.target_id: r.header for r in serving.header(rows, F.to_timestamp_ntz(F.lit("2024-01-01 00:02:00")), 0.5, 0).collect()}
    assert (got["a"].total_count, got["a"].anomaly_count, got["a"].anomaly) == (3, 1, True)
    assert got["b"] is None and got["c"] is None


def test_small_serving_functions(spark):
    rows = spark.createDataFrame([("view",), ("view_upper",), ("x_lower",), ("socket_count",), (None,)], "name string")
    assert [r.name for r in serving.features(rows).collect()] == ["view"]
    one = spark.range(1).select(serving.floor_to(F.lit(-1.29), 1), serving.floor_to(F.lit(1.29), 1), serving.nan_to_null(F.lit(float("nan"))), serving.nan_to_null(F.lit(2.0)), serving.weekday_bucket(F.lit("2024-01-07").cast("date"), "workingday"))
    assert tuple(one.first()) == (-1.3, 1.2, None, 2.0, 5)
    drawn = [sorted(r.id for r in serving.draw(spark.range(100).repartition(n), ["id"], 10, 3).collect()) for n in (1, 5)]
    assert len(drawn[0]) == 10 and drawn[0] == drawn[1]
    assert serving.draw(spark.range(3), ["id"], 10, 3).count() == 3 and serving.draw(spark.range(0), ["id"], 10, 3).count() == 0


def test_bucketed_upserts_replay(spark, tmp_path):
    """A batch that runs again changes nothing, and buckets that it doesn't touch aren't rewritten."""
    schema = "k string, at int, v string"
    table = tables.Bucketed(str(tmp_path / "t"), ["k"], "at", buckets=4)
    first = spark.createDataFrame([(f"k{i}", 1, "old") for i in range(20)], schema)
    second = spark.createDataFrame([("k3", 2, "new"), ("k3", 1, "late"), ("x", 1, "add")], schema)
    table.merge(first, 0)
    table.merge(second, 1)
    want = sorted(tuple(r) for r in table.read(spark, first.schema).collect())
    assert want == sorted([(f"k{i}", 1, "old") for i in range(20) if i != 3] + [("k3", 2, "new"), ("x", 1, "add")])
    assert set(table.manifest.read(spark, 1).values()) == {0, 1}
    table.merge(second, 1)
    table.merge(second.limit(0), 2)
    assert sorted(tuple(r) for r in table.read(spark, first.schema).collect()) == want
    assert not tables.Bucketed(str(tmp_path / "none"), ["k"], "at").read(spark, first.schema).collect()


def test_sinks_take_a_batch_together(spark, tmp_path):
    """A failure between two sinks leaves nothing to read; the batch run again is there once in both."""
    broken = []

    def second(batch):
        if broken:
            raise RuntimeError("between the sinks")
        return batch.groupBy().count()

    both = tables.Together(str(tmp_path / "s"), {"rows": lambda b: b, "counts": second})
    both.write(spark.range(3), 0)
    broken.append(True)
    with pytest.raises(RuntimeError, match="between"):
        both.write(spark.range(5), 1)
    read = lambda: (both.read(spark, "rows", "id long").count(), sorted(r["count"] for r in both.read(spark, "counts", "count long").collect()))
    assert read() == (3, [3])
    broken.clear()
    both.write(spark.range(5), 1)
    both.write(spark.range(5), 1)
    assert read() == (8, [3, 5])


def test_rolling_buffer_over_restarts(spark):
    rows = spark.createDataFrame([("t", "m", T0 + datetime.timedelta(hours=i), float(i)) for i in range(9)], "target_id string, name string, time timestamp_ntz, real_value double")
    got = jobs.rolled(jobs.Feed(rows, "time", again="2 HOURS"), 4).collect()
    hour = lambda r: (r.time.replace(tzinfo=None) - T0).seconds // 3600
    assert sorted((hour(r), r.n, r.mean) for r in got if r.error_code is None) == [(i, min(i + 1, 4), sum(range(max(0, i - 3), i + 1)) / min(i + 1, 4)) for i in range(9)]
    assert sorted((hour(r), r.batch) for r in got if r.error_code) == [(1, 1), (2, 1), (4, 2), (5, 2)]


def test_envelopes_as_a_source(spark, tmp_path):
    """Minutes of requests in a folder: a stream that stops after each gives the batch's rows, malformed ones as error rows."""
    spark.dataSource.register(envelopes.Envelopes)
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    stream = None
    for minute in range(3):
        at = f"2024-01-01 00:0{minute}:00"
        metric = {"id1": "x", "standard_datetime": at, "header": {"sys_id": "1", "target_id": "t", "inst_type": "was"}, "body": [{"time": at, "cpu": str(minute), "mem": "bad"}]}
        log = {"id1": "y", "standard_datetime": at, "header": {"sys_id": "1", "target_id": "l", "inst_type": "log"}, "body": [{"time": at, "path": "/a", "line": 4, "log": "one \u00e9"}]}
        (root / f"minute={minute:03}").mkdir(parents=True)
        (root / f"minute={minute:03}" / "part.json").write_text("\n".join([json.dumps(metric), json.dumps(log), "not json", '{"id1": "z", "body": 5}', ""]), encoding="utf-8")
        stream = spark.readStream.format("envelopes").load(root.as_uri())
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        assert spark.read.parquet(out).count() == 5 * (minute + 1)
    batch = spark.read.format("envelopes").load(root.as_uri())
    rows = sorted(map(tuple, batch.collect()), key=str)
    assert rows == sorted(map(tuple, spark.read.parquet(out).collect()), key=str)
    found = {(r.name, r.real_value, r.message, r.line, r.error_code) for r in batch.where("minute = 'minute=002'").collect()}
    assert found == {("cpu", 2.0, None, None, None), ("mem", None, None, None, "E703"), ("/a", None, "one é", 4, None), (None, None, None, None, "E703")}
    assert not spark.read.format("envelopes").load((tmp_path / "none").as_uri()).collect()
