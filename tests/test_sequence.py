import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import reference
from tidemark.config import Config
from tidemark.operators import frames, incidents, intervals, matching, windows

C = Config()


def verdicts(spark, rows):
    """rows: (video, t0, class, confidence) windows of one unit."""
    data = [(v, i, float(t), float(t) + 1.0, c, float(p), f"d{i}") for i, (v, t, c, p) in enumerate(rows)]
    return spark.createDataFrame(data, "video_id long, event_id long, t0 double, t1 double, class string, confidence double, description string")


def curve(spark, points, video=1):
    return spark.createDataFrame([(video, [(float(t), float(h)) for t, h in points])], "video_id long, curve array<struct<t:double,health:double>>")


def duration(spark, d, video=1):
    return spark.createDataFrame([(video, float(d))], "video_id long, duration double")


def test_weak_windows_make_no_incident(spark):
    assert incidents.incidents(verdicts(spark, [(1, t, "fire", 0.4) for t in range(5)]), C).count() == 0


def test_single_window_is_as_long_as_the_window_and_buffer(spark):
    r = incidents.incidents(verdicts(spark, [(1, 5, "traffic_accident", 0.9)]), C).first()
    assert r["end"] - r["start"] == pytest.approx(1 + 2 * C.extent_buffer) and r["source"] == "windows"


def test_long_depression_is_one_incident(spark):
    v = verdicts(spark, [(1, t, "traffic_congestion", 0.8) for t in range(10, 571, 20)])
    r = incidents.incidents(v, C, curve(spark, [(t, -0.5) for t in range(0, 599)]), duration(spark, 602)).collect()
    assert len(r) == 1 and r[0]["end"] - r[0]["start"] > 500


@pytest.mark.parametrize("calm", [True, False])
def test_curve_does_not_split(spark, calm):
    v = verdicts(spark, [(1, t, "traffic_congestion", 0.8) for t in (10, 30, 50, 250, 270, 290)])
    c = [(t, 0.5 if calm and 120 <= t <= 220 else -0.5) for t in range(0, 300)]
    assert incidents.incidents(v, C, curve(spark, c)).count() == 1


def test_classes_share_a_cluster_and_a_normal_window_splits(spark):
    both = incidents.clusters(verdicts(spark, [(1, 507.5, "smoke", 0.95), (1, 523.5, "fighting_or_violence", 0.9)]))
    assert {r["cluster"] for r in both.collect()} == {1}
    apart = incidents.clusters(verdicts(spark, [(1, 20, "traffic_congestion", 0.9), (1, 100, "normal", 0.9), (1, 200, "traffic_congestion", 0.9)]))
    assert [r["cluster"] for r in apart.orderBy("t0").collect()] == [1, 2]


def test_main_class_tags_and_adjudication(spark):
    v = verdicts(spark, [(1, 507.5, "smoke", 0.95), (1, 523.5, "fighting_or_violence", 0.9)])
    c = curve(spark, [(t, -0.5 if 500 <= t <= 530 else 0.5) for t in range(480, 560)])
    r = incidents.incidents(v, C, c).first()
    assert r["class_name"] == "smoke" and [t["class_name"] for t in r["sub_tags"]] == ["fighting_or_violence"]
    said = spark.createDataFrame([(1, 1, "traffic_accident", 0.7, None)], "video_id long, cluster long, primary string, primary_confidence double, primary_reason string")
    r = incidents.incidents(v, C, c, None, said).first()
    assert r["class_name"] == "traffic_accident" and {t["class_name"] for t in r["sub_tags"]} == {"smoke", "fighting_or_violence"}
    assert r["reason"] == "adjudicated" and r["peak"] == 0.95


def test_extent_follows_the_curve_and_stays_in_the_video(spark):
    v = verdicts(spark, [(1, 510, "traffic_accident", 0.9)])
    r = incidents.incidents(v, C, curve(spark, [(t, -0.5 if 490 <= t <= 535 else 0.5) for t in range(480, 560)])).first()
    assert r["source"] == "measured" and r["start"] <= 495 and r["end"] >= 530
    short = incidents.incidents(verdicts(spark, [(1, 32, "traffic_accident", 0.9)]), C, curve(spark, [(t / 2, -0.5 if 30 <= t / 2 <= 35 else 0.5) for t in range(0, 120)])).first()
    assert short["end"] - short["start"] < 12
    end = incidents.incidents(verdicts(spark, [(1, 99, "traffic_accident", 0.9)]), C, None, duration(spark, 100)).first()
    assert 0 <= end["start"] and end["end"] <= 100


def test_extent_equals_the_walk(spark):
    r = random.Random(3)
    cases = []
    for video in range(300):
        t = sorted(r.sample(range(0, 80), r.randint(1, 20)))
        c = [(float(x), r.choice([-0.5, -0.1, 0.2])) for x in t]
        s = r.uniform(-2, 80)
        cases.append((video, c, s, s + r.uniform(0, 20), r.choice([40.0, 60.0, 100.0])))
    for threshold in (-0.4, 0.4):
        spans = spark.createDataFrame([(v, 1, s, e, False, d) for v, _, s, e, d in cases], "video_id long, cluster long, s double, e double, probed boolean, duration double")
        curves = spark.createDataFrame([(v, c) for v, c, *_ in cases], "video_id long, curve array<struct<t:double,health:double>>")
        got = {x["video_id"]: (x["s"], x["e"], x["source"]) for x in incidents.extent(spans, curves, threshold, C, True).collect()}
        for v, c, s, e, d in cases:
            assert got[v] == pytest.approx(reference.extent(s, e, c, threshold, C.loose_factor, C.extent_buffer, d))


def test_clusters_equal_the_sequential_rule(spark):
    r = random.Random(5)
    rows, want = [], {}
    for video in range(120):
        ws = []
        for _ in range(r.randint(1, 12)):
            t0 = r.randint(0, 12)
            ws.append((t0, t0 + r.randint(0, 3), r.random() < 0.6))
        ws.sort(key=lambda w: w[0])
        base = len(rows)
        rows += [(video, base + i, float(a), float(b), "fire" if hit else "normal", 0.9, "") for i, (a, b, hit) in enumerate(ws)]
        want[video] = reference.cluster(ws)
    v = spark.createDataFrame(rows, "video_id long, event_id long, t0 double, t1 double, class string, confidence double, description string")
    got = {}
    for x in incidents.clusters(v).orderBy("video_id", "t0", "event_id").collect():
        got.setdefault(x["video_id"], []).append(x["cluster"])
    assert got == {k: w for k, w in want.items() if w}


def test_gate_forms_equal_the_loop(spark):
    r = random.Random(7)
    rows, want = [], {}
    for video in range(40):
        t, own = 0.0, []
        for _ in range(r.randint(1, 30)):
            t += r.choice([0.5, 1.0, 3.0])
            own.append((t, r.choice([0.0, 2.0, 4.2, 9.0])))
        want |= {(video, i): w for i, w in enumerate(reference.gate(own, C.gate_signal, C.gate_keepalive))}
        rows += [(video, i, t, m) for i, (t, m) in enumerate(own)]
    f = spark.createDataFrame(rows, "video_id long, event_id long, t double, motion double")
    for form in (frames.gate, frames.gate_grouped):
        assert {(x["video_id"], x["event_id"]): x["why"] for x in form(f, C).collect()} == want


def _frames(spark, rows):
    return spark.createDataFrame([(v, i, float(t), float(h)) for i, (v, t, h) in enumerate(rows)], "video_id long, event_id long, t double, health double")


def test_sessions_join_at_the_gap_and_split_beyond(spark):
    f = _frames(spark, [(1, 0, -1), (1, 1.0, -1), (1, 2.0 + 1e-6, -1), (1, 9, 1)])
    w = windows.summarise(windows.escalations(f, 0.0, 1.0), "escalated").orderBy("win").collect()
    assert [(x["t0"], x["n_frames"]) for x in w] == [(0.0, 2), (2.0 + 1e-6, 1)]


def test_scan_floor_cases(spark):
    calm = _frames(spark, [(1, t, 1) for t in range(0, 100)] + [(2, t, t / 100) for t in range(0, 50)] + [(3, 15.0, -1.0)] + [(3, t, 1) for t in range(0, 100)])
    d = spark.createDataFrame([(1, 100.0), (2, 60.0), (3, 100.0)], "video_id long, duration double")
    w = windows.scan_floor(calm, d, 0.0, C).collect()
    by = {v: sorted((x["source"], x["win"]) for x in w if x["video_id"] == v) for v in (1, 2, 3)}
    assert by[1] == [("scan", i) for i in range(5)]
    assert by[2] == [("last-resort", 0)]  # exactly the least duration: no floor
    assert by[3] == [("escalated", 1)] + [("scan", i) for i in range(1, 5)]


def test_pick_takes_all_or_even_positions(spark):
    f = _frames(spark, [(1, t, -1) for t in range(6)]).withColumn("win", F.lit(1))
    assert [x["t"] for x in windows.pick(f, 4).orderBy("t").collect()] == [0.0, 2.0, 3.0, 5.0]
    assert windows.pick(f, 9).count() == 6


def test_matching(spark):
    r = random.Random(11)
    t, p, want = [], [], set()
    for video in range(60):
        own_t = sorted((r.randint(0, 20), r.randint(1, 8)) for _ in range(r.randint(1, 5)))
        own_p = sorted((r.randint(0, 20), r.randint(1, 8)) for _ in range(r.randint(1, 5)))
        a = [(video * 100 + i, float(s), float(s + n)) for i, (s, n) in enumerate(own_t)]
        b = [(video * 100 + i, float(s), float(s + n)) for i, (s, n) in enumerate(own_p)]
        want |= set(reference.greedy(a, b))
        t += [(video, i, "fire", s, e) for i, s, e in a]
        p += [(video, i, "fire", s, e) for i, s, e in b]
    truth = spark.createDataFrame(t, "video_id long, truth_id long, class string, s double, e double")
    pred = spark.createDataFrame(p, "video_id long, pred_id long, class string, s double, e double")
    assert {(x["truth_id"], x["pred_id"]) for x in matching.match_greedy(truth, pred).collect()} == want


def _spans(r, n, wide):
    out = []
    for i in range(n):
        s = r.choice([r.uniform(0, 60), float(r.randint(0, 60))])
        out.append((r.randint(1, 3), i, s, s + r.choice([0.0, 1.0, r.uniform(0, wide)])))
    return out


@pytest.mark.parametrize("width", [0.7, 8.0, 500.0])
def test_bucket_joins_equal_all_pairs(spark, width):
    r = random.Random(2)
    a, b = _spans(r, 60, 20), _spans(r, 60, 5)
    left = spark.createDataFrame(a, "video_id long, x long, s double, e double")
    right = spark.createDataFrame(b, "video_id long, y long, ps double, pe double")
    got = intervals.overlapping(left, right, ["video_id"], ("s", "e"), ("ps", "pe"), width)
    assert sorted((g["x"], g["y"]) for g in got.collect()) == sorted((x, y) for v, x, s, e in a for w, y, ps, pe in b if v == w and ps < e and pe > s)
    points = left.select("video_id", "x", F.col("s").alias("t"))
    got = intervals.points_in(points, right, "ps", "pe", width)
    assert sorted((g["x"], g["y"]) for g in got.collect()) == sorted((x, y) for v, x, t, _ in a for w, y, ps, pe in b if v == w and ps <= t <= pe)


def test_nearest_takes_both_sides_and_breaks_ties(spark):
    r = random.Random(4)
    points = [(v, float(r.randint(0, 12)), i) for i, v in enumerate(r.choices([1, 2, 3], k=60))]
    centres = [(v, float(c)) for v in (1, 2, 3, 4) for c in range(-1, 15)]
    p, c = spark.createDataFrame(points, "video_id long, t double, event_id long"), spark.createDataFrame(centres, "video_id long, centre double")
    got = {}
    for g in intervals.nearest(p, c, 4, []).collect():
        got.setdefault((g["video_id"], g["centre"]), set()).add(g["event_id"])
    for v, centre in centres:
        best = sorted((abs(t - centre), t, i) for w, t, i in points if w == v)[:4]
        assert got.get((v, centre), set()) == {i for _, _, i in best}


def test_percentiles_equal_sorting(spark):
    r = random.Random(6)
    rows = [(k, r.choice([r.uniform(-5, 5), 1.0, 1e6 * (k == 2)])) for k in (1, 2, 3) for _ in range(200)] + [(4, 2.5), (5, None)]
    got = {g["k"]: g for g in frames.percentiles(spark.createDataFrame(rows, "k long, v double"), "v", {"a": 0.0, "b": 0.12, "c": 0.5, "d": 1.0}, ("k",), cells=16).collect()}
    for k in (1, 2, 3, 4):
        v = sorted(x for j, x in rows if j == k)
        for name, p in (("a", 0.0), ("b", 0.12), ("c", 0.5), ("d", 1.0)):
            at = p * (len(v) - 1)
            lo = v[int(at)]
            hi = v[min(int(at) + 1, len(v) - 1)]
            assert got[k][name] == pytest.approx(lo + (hi - lo) * (at - int(at)))
    assert 5 not in got


def test_override_by_a_second_call(spark):
    rows = [(1, "normal", 0.0, "", "fire", 0.95, "smoke", 0.7, "seen"), (2, "normal", 0.1, "first", "fire", 0.95, None, None, None), (3, "normal", 0.1, "", "fire", 0.92, "normal", 0.3, ""), (4, "smoke", 0.4, "s", "fire", 0.99, "fire", 0.9, "x"), (5, "normal", 0.1, "s", None, 0.99, None, None, None)]
    v = spark.createDataFrame(rows, "id long, class string, confidence double, description string, probe_top string, probe_anomaly double, second_class string, second_confidence double, second_description string")
    got = {g["id"]: (g["class"], g["confidence"], g["description"], g["probe_override"]) for g in incidents.override(v, 0.9).collect()}
    assert got == {1: ("smoke", 0.7, "seen", True), 2: ("fire", 0.95, "first", True), 3: ("fire", 0.92, "Probe: fire", True), 4: ("smoke", 0.4, "s", False), 5: ("normal", 0.1, "s", False)}


@pytest.mark.parametrize("kind", ["outlier", "constant", "few", "nan", "steps", "plain"])
def test_percentiles_are_exact_wherever_values_lie(spark, kind):
    import random

    import numpy as np

    r = random.Random(9)
    values = {
        "outlier": [r.random() for _ in range(4000)] + [1e15, -1e15],
        "constant": [3.5] * 3000,
        "few": [2.0, 1.0],
        "nan": [r.gauss(0, 1) for _ in range(500)],
        "steps": [float(r.choice([1, 1, 1, 2, 7])) for _ in range(3000)],
        "plain": [r.lognormvariate(0, 3) for _ in range(5000)],
    }[kind]
    shares = {"a": 0.12, "b": 0.01, "c": 0.5, "d": 0.99, "e": 0.0, "f": 1.0}
    want = {name: float(np.percentile(values, 100 * s)) for name, s in shares.items()}
    rows = spark.createDataFrame([("k", v) for v in values] + [("k", None), ("none", None), ("one", 4.0)], "key string, x double").repartition(3)
    got = {row["key"]: row.asDict() for row in frames.percentiles(rows, "x", shares, ("key",)).collect()}
    assert set(got) == {"k", "one"} and set(got["one"].values()) == {"one", 4.0}
    assert all(got["k"][name] == pytest.approx(want[name], rel=1e-12, abs=1e-12) for name in shares)
    single = frames.percentiles(rows.where("key = 'k'"), "x", shares).first()
    assert all(single[name] == pytest.approx(want[name], rel=1e-12, abs=1e-12) for name in shares)


def test_percentiles_order_few_of_the_values(spark):
    """One value of 10^15 among many leaves the cells narrow: what is ordered is a small part."""
    rows = spark.range(200_000).select((F.when(F.col("id") == 7, 1e15).otherwise(F.xxhash64("id") / 2.0**63)).alias("x"))
    df = frames.percentiles(rows, "x", {"m": 0.5, "p": 0.12})
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and df.first()["m"] == rows.agg(F.percentile("x", 0.5)).first()[0]
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "x double")
    assert frames.percentiles(nan, "x", {"m": 0.5, "low": 0.0}).first().asDict() == {"m": 2.0, "low": 1.0}
    assert frames.percentiles(nan.limit(0), "x", {"m": 0.5}).collect() == []


def test_calibration_takes_the_first_normal_videos(spark):
    truth = spark.createDataFrame([(5, "normal", "p"), (3, "normal", "p"), (3, "normal", "q"), (1, "fire", "p"), (2, "normal", None), (9, "normal", "p")], "video_id long, class_name string, path string")
    chosen = frames.normal_videos(truth, 2)
    assert sorted(r["video_id"] for r in chosen.collect()) == [3, 5]
    rows = spark.createDataFrame([(3, 1.0), (5, 3.0), (9, 100.0), (1, -5.0)], "video_id long, health double")
    c = frames.calibrate(rows, 0.5, chosen).first()
    assert (c["threshold"], c["mean"]) == (2.0, 2.0)
    assert frames.calibrate(rows, 0.5, frames.normal_videos(truth.limit(0))).collect() == []


@pytest.mark.parametrize("rounds", [8, 0, 1])
def test_matching_by_rounds_and_by_reading_are_the_sequential_rule(spark, rounds):
    r = random.Random(11)
    truth, pred, want = [], [], set()
    for video in range(12):
        n, span = r.randint(1, 40), r.choice([5, 40, 400])
        t = sorted((round(r.uniform(0, span), 1), i) for i in range(n))
        t = [(1000 * video + i, s, s + r.choice([2.0, 3.0, 5.0])) for s, i in t]
        p = [(1000 * video + i, s + r.choice([0, 0.2, -0.4, 1.0]), e + r.choice([0, 0.2, 1.0])) for i, (_, s, e) in enumerate(t) for _ in range(r.randint(0, 2))]
        p = [(1000 * video + j, s, e) for j, (_, s, e) in enumerate(sorted(p, key=lambda x: x[1]))]
        t.sort(key=lambda x: (x[1], x[0]))
        want |= {(video, a, b) for a, b in reference.greedy(t, p)}
        truth += [(video, i, "fire", s, e) for i, s, e in t]
        pred += [(video, i, "fire", s, e) for i, s, e in p]
    a = spark.createDataFrame(truth, "video_id long, truth_id long, class string, s double, e double").repartition(3)
    b = spark.createDataFrame(pred, "video_id long, pred_id long, class string, s double, e double").repartition(3)
    got = matching.match_greedy(a, b, rounds=rounds)
    assert {(g["video_id"], g["truth_id"], g["pred_id"]) for g in got.collect()} == want and got.count() == len(want) > 60


def test_a_long_chain_of_displaced_truths_ends(spark):
    """Each truth likes best the prediction that the one before it will take: rounds would be as many as truths."""
    n = 3000
    truth = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("truth_id"), F.lit("fire").alias("class"), F.col("id").cast("double").alias("s"), (F.col("id") + 10.0).alias("e"))
    pred = truth.select("video_id", F.col("truth_id").alias("pred_id"), "class", (F.col("s") + 0.6).alias("s"), (F.col("e") + 0.6).alias("e"))
    got = {r["truth_id"]: r["pred_id"] for r in matching.match_greedy(truth, pred).collect()}
    want = dict(reference.greedy([(i, float(i), i + 10.0) for i in range(150)], [(i, i + 0.6, i + 10.6) for i in range(150)]))
    assert len(got) == n and all(got[i] == want[i] for i in range(100))


@pytest.mark.parametrize("form", ["gate", "gate_grouped"])
def test_quiet_stretches_of_a_million_frames(spark, form):
    import time

    n = 1_000_000
    frames_ = spark.range(n).select((F.col("id") % 2).alias("video_id"), F.col("id").alias("event_id"), (F.col("id") * 0.25).alias("t"), F.lit(0.0).alias("motion"))
    began = time.time()
    got = {(r["video_id"], r["why"]): r["count"] for r in getattr(frames, form)(frames_, Config(gate_signal=1.0, gate_keepalive=4.0)).groupBy("video_id", "why").count().collect()}
    assert time.time() - began < 60
    passes = (n // 2 - 1) // 8  # every eighth frame of a video is four seconds after the last that passed
    assert got == {(v, k): m for v in (0, 1) for k, m in (("first", 1), ("keepalive", passes), ("skipped", n // 2 - 1 - passes))}


@pytest.mark.parametrize("form", ["gate", "gate_grouped"])
def test_gate_across_batches_and_pieces(spark, form):
    r = random.Random(5)
    rows, want = [], {}
    for video in range(4):
        t, mine = 0.0, []
        for _ in range(900):
            t += r.choice([0.1, 0.3, 0.7, 1.0, 4.0]) if r.random() < 0.2 else 0.1
            mine.append((t, 5.0 if r.random() < 0.01 else 0.0))
        rows += [(video, len(rows) + i, a, m) for i, (a, m) in enumerate(mine)]
        want[video] = reference.gate(mine, 4.2, 1.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = getattr(frames, form)(spark.createDataFrame(rows, "video_id long, event_id long, t double, motion double"), Config(gate_keepalive=1.0)).orderBy("event_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {v: [g["why"] for g in got if g["video_id"] == v] for v in range(4)} == want


def test_large_groups_stay_spread_in_percentiles(spark, monkeypatch):
    """Before, a join by key put a whole group in one task."""
    monkeypatch.setattr(frames, "LARGE", 100)
    r = np.random.default_rng(3)
    values = {"a": r.normal(size=5000).round(2), "b": r.normal(size=101), "c": r.normal(size=100), "d": np.array([1.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k string, x double").repartition(8)
    out = frames.percentiles(df, "x", {"p50": 0.5, "p95": 0.95}, ("k",))
    got = {row["k"]: (row["p50"], row["p95"]) for row in out.collect()}
    assert got.keys() == values.keys()
    assert all(np.allclose(got[k], np.percentile(v, [50, 95]), rtol=1e-12) for k, v in values.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 4


def test_measured_incidents_deal_videos_by_rows(spark, data, monkeypatch):
    """Before, the number of tasks did not follow the rows of the tables."""
    from tidemark import bindings as B
    from tidemark import plans

    monkeypatch.setattr(plans, "ROWS", 100)
    f = B.frames(spark, data)
    plan = plans.measured_incidents(f, B.verdicts(spark, data), C)._jdf.queryExecution().executedPlan().toString()
    assert f", {max(spark.sparkContext.defaultParallelism, f.count() // 100 + 1)}), REPARTITION_BY_NUM" in plan
