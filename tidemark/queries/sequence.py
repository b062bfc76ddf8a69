"""Gate, windows, clusters, extents, incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import bindings as B
from tidemark import plans
from tidemark.config import BOUND, Config
from tidemark.operators import frames as fr
from tidemark.operators import incidents as inc
from tidemark.operators import windows as win

#: Health below this is flagged in the bound stream.
FLAG = 0.0


def r6(c):
    return F.round(c, 6)


def gate(spark, d):
    """The stateful gate over each user's events, as a fold."""
    out = fr.gate(fr.motion(B.frames(spark, d)), BOUND)
    return out.select("video_id", "event_id", r6("t").alias("t"), r6("motion").alias("motion"), "why")


def gate_reasons(spark, d):
    """How many frames passed for which reason."""
    return fr.gate(fr.motion(B.frames(spark, d)), BOUND).groupBy("why").agg(F.count("*").alias("n"))


def gate_grouped(spark, d):
    """P1 in its form for stretches of any length."""
    out = fr.gate_grouped(fr.motion(B.frames(spark, d)), BOUND)
    return out.select("video_id", "event_id", r6("t").alias("t"), r6("motion").alias("motion"), "why")


def stride_sample(spark, d):
    """Every stride-th frame for a source at 25 and a target of 2 frames a second."""
    f = B.frames(spark, d).withColumn("source_rate", F.when(F.col("video_id") % 3 == 0, F.lit(None)).when(F.col("video_id") % 3 == 1, 0.0).otherwise(10.0).cast("double"))
    return fr.sample(f, 2.0).select("video_id", "event_id")


def sampled_source(spark, d):
    """Each user's events written as a container of frames at 10 a second, and every fifth frame read back, with the duration of its video."""
    from tidemark import sources
    from tidemark.sources import frame_source

    with sources.scratch(spark, "frames") as folder:
        frame_source.write_containers(B.frames(spark, d).select("video_id", "t", "event_id", F.col("signal").alias("value")), folder)
        with sources.setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
            f = frame_source.read_frames(spark, folder).where("sampled").join(frame_source.video_durations(spark, folder), "video_id")
            return f.select(F.col("video_id").cast("long").alias("video_id"), "frame", "t", F.element_at("payload", 1).alias("value"), "duration").checkpoint()


def escalations(spark, d):
    """Gap sessions of flagged frames."""
    w = win.summarise(win.escalations(B.frames(spark, d), FLAG, BOUND.gap), "escalated")
    return w.select("video_id", "win", r6("t0").alias("t0"), r6("t1").alias("t1"), "n_frames", r6("health").alias("health"))


def scan_floor(spark, d):
    """Escalated windows, scans of uncovered slots, last resorts."""
    f = B.frames(spark, d)
    w = win.scan_floor(f, plans.durations(f), FLAG, BOUND)
    return w.select("video_id", "source", "win", r6("t0").alias("t0"), r6("t1").alias("t1"), "n_frames", r6("health").alias("health"))


def pick_frames(spark, d):
    """Two even positions of each escalated window."""
    return win.pick(win.escalations(B.frames(spark, d), FLAG, BOUND.gap), 3).select("video_id", "win", "event_id")


def widen_window(spark, d):
    """Frames around each error event."""
    f = B.frames(spark, d)
    centres = B.truth(spark, d).select("video_id", F.col("truth_id").alias("centre_id"), F.col("s").alias("centre"))
    return win.widen(f, centres, BOUND.probe_span, BOUND.probe_frames).select("video_id", "centre_id", "event_id")


def calibration(spark, d):
    """Exact percentiles of health."""
    c = fr.calibrate(B.frames(spark, d), BOUND.health_percentile)
    return c.select(*(r6(x).alias(x) for x in c.columns))


def calibration_normal(spark, d):
    """The same over the first twelve users with a normal event of more than 100 as their normal videos."""
    truth = B.verdicts(spark, d).select("video_id", F.col("class").alias("class_name"), F.when(F.col("health") < -1, F.col("description")).alias("path"))
    c = fr.calibrate(B.frames(spark, d), BOUND.health_percentile, fr.normal_videos(truth))
    return c.select(*(r6(x).alias(x) for x in c.columns))


def video_thresholds(spark, d):
    """A10: each video's own percentile."""
    return fr.thresholds(B.frames(spark, d), BOUND.health_percentile).select("video_id", r6("threshold").alias("threshold"))


def escalation_rate(spark, d):
    """Share of frames in escalated windows; rounded as its twin rounds, half up (`sink_rounding` has the operator's own rounding)."""
    f = B.frames(spark, d)
    rate = fr.escalation_rate(win.summarise(win.escalations(f, FLAG, BOUND.gap), "escalated"), f, None)
    return rate.select("video_id", F.round("rate", 4).alias("rate"))


def window_sources(spark, d):
    """Windows by source."""
    f = B.frames(spark, d)
    return win.scan_floor(f, plans.durations(f), FLAG, BOUND).groupBy("source").agg(F.count("*").alias("windows"), F.sum("n_frames").alias("frames"))


def clusters(spark, d):
    """Clusters split only by a normal window between two hits."""
    return inc.clusters(B.verdicts(spark, d)).select("video_id", "event_id", F.col("class").alias("class_name"), "cluster")


def incidents(spark, d):
    """D5 without a curve: incidents of all videos, flattened."""
    i = inc.incidents(B.verdicts(spark, d), BOUND)
    return i.select(
        "video_id", "cluster", "class_name", r6("start").alias("start_t"), r6("end").alias("end_t"), r6("confidence").alias("confidence"), r6("peak").alias("peak"), "n_windows", "source", "reason", "description", F.size("sub_tags").alias("n_tags")
    )


def adjudicated_incidents(spark, d):
    """Incidents whose primary class a slot decides where there are several; it names the last by letters, and fails on every fifth number of windows."""
    from tidemark.operators import slots

    def slot(items):
        if any(sum(i["n"]) % 5 == 0 for i in items):
            raise RuntimeError("no answer")
        return [f'I say {{"primary": "{max(i["class"])}", "confidence": 0.75, "reason": "{len(i["class"])} seen"}}' for i in items]

    v = B.verdicts(spark, d)
    i = inc.incidents(v, BOUND, adjudicated=slots.adjudicate(v, slot))
    return i.select("video_id", "cluster", "class_name", r6("start").alias("start_t"), r6("end").alias("end_t"), r6("confidence").alias("confidence"), r6("peak").alias("peak"), "n_windows", "reason", F.size("sub_tags").alias("n_tags"))


def picked_overrides(spark, d):
    """The probe's overrides, each with a second call that picks among its likeliest classes, or has no opinion."""
    from tidemark.operators import slots

    def slot(items):
        return [None if i["event_id"] % 3 == 0 else f'{{"class": "{sorted(i["options"])[0]}", "confidence": 0.8, "description": "picked"}}' for i in items]

    e = F.col("event_id")
    options = F.when(e % 4 == 0, F.array(F.lit("normal"))).when(e % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("smoke"), F.lit("road_spill_or_debris")))
    v = B.verdicts(spark, d).withColumns({"probe_top": F.when(e % 5 != 0, "fire"), "probe_anomaly": (e % 100) / 100.0, "options": options})
    return inc.override(slots.pick(v, slot, 0.5), 0.5).select("event_id", F.col("class").alias("class_name"), r6("confidence").alias("confidence"), "description", "probe_override")


def incidents_measured(spark, d):
    """Extents along the health curve, clamped to the video."""
    i = plans.measured_incidents(B.frames(spark, d), B.verdicts(spark, d), BOUND)
    return i.select("video_id", "cluster", "class_name", r6("start").alias("start_t"), r6("end").alias("end_t"), "source", "n_windows")


def incident_tags(spark, d):
    """Other classes of each incident by peak confidence."""
    i = inc.incidents(B.verdicts(spark, d), BOUND).select("video_id", "cluster", F.posexplode("sub_tags").alias("pos", "s"))
    return i.select("video_id", "cluster", "pos", "s.class_name", r6("s.peak_confidence").alias("peak_confidence"), "s.n_windows", r6("s.first_seen_sec").alias("first_seen"), "s.description")


def min_duration_filter(spark, d):
    """Intervals at least as long as their class asks."""
    from tidemark.functions import least_duration

    t = B.predicted(spark, d)
    return t.where(F.col("e") - F.col("s") + 1e-6 >= least_duration(F.col("class"))).select("video_id", "pred_id", F.col("class").alias("class_name"))


def probe_override(spark, d):
    """Normal verdicts overridden by a confident probe."""
    v = B.verdicts(spark, d).withColumns({"probe_top": F.when(F.col("event_id") % 5 != 0, "fire"), "probe_anomaly": (F.col("event_id") % 100) / 100.0})
    return inc.override(v, 0.9).select("event_id", F.col("class").alias("class_name"), r6("confidence").alias("confidence"), "probe_override")


def timeline(spark, d):
    """Timeline of each video: measured incidents, their other classes, labelled bands."""
    rows = plans.timeline(plans.measured_incidents(B.frames(spark, d), B.verdicts(spark, d), BOUND), B.truth(spark, d))
    return rows.select("video_id", "kind", "class_name", r6("start").alias("start_t"), r6("length").alias("length"), "measured")


def recovered_between(spark, d):
    """Whether health recovered between an error event and the next one."""
    f = B.frames(spark, d)
    gaps = B.truth(spark, d, clip=False).withColumn("hi", F.expr("lead(s) over (partition by video_id order by s, truth_id)"))
    return inc.recovered_between(f, gaps.select("video_id", F.col("truth_id").alias("gap_id"), F.col("s").alias("lo"), F.coalesce("hi", "s").alias("hi")), BOUND.health_threshold, BOUND.loose_factor)


def gate_pipeline(spark, d):
    """The whole plan: gate, floor, clusters and incidents on the frames that passed."""
    f = B.frames(spark, d)
    passed = fr.gate(fr.motion(f), BOUND).where("why <> 'skipped'").select("event_id")
    kept = B.verdicts(spark, d).join(passed, "event_id", "left_semi")
    i = inc.incidents(kept, BOUND)
    return i.groupBy("class_name").agg(F.count("*").alias("incidents"), F.sum("n_windows").alias("windows"), r6(F.avg("peak")).alias("mean_peak"))


_GATE = """, ordered AS (
  SELECT *, coalesce(abs(signal - lag(signal) OVER (PARTITION BY video_id ORDER BY t, event_id)), 0.0) AS motion,
         row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS rn FROM frames
), gated AS (
  SELECT video_id, event_id, t, motion, rn, 'first' AS why, t AS last FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.video_id, o.event_id, o.t, o.motion, o.rn,
         CASE WHEN o.motion >= 60 THEN 'motion' WHEN o.t - g.last >= 24 THEN 'keepalive' ELSE 'skipped' END,
         CASE WHEN o.motion >= 60 OR o.t - g.last >= 24 THEN o.t ELSE g.last END
  FROM gated g JOIN ordered o ON o.video_id = g.video_id AND o.rn = g.rn + 1
)"""
_SESSION = """, flagged AS (
  SELECT *, coalesce(CAST(t - lag(t) OVER (PARTITION BY video_id ORDER BY t, event_id) > 12 AS INT), 0) AS new FROM frames WHERE health < 0
), members AS (
  SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) + 1 AS win FROM flagged
), escalated AS (
  SELECT video_id, 'escalated' AS source, CAST(win AS BIGINT) AS win, min(t) AS t0, max(t) AS t1, count(*) AS n_frames, avg(health) AS health FROM members GROUP BY video_id, win
)"""
_FLOOR = (
    _SESSION
    + """, dur AS (SELECT video_id, max(t) + 1 AS duration FROM frames GROUP BY 1
), slots AS (SELECT video_id, unnest(range(0, CAST(ceil(duration / 120) AS BIGINT))) AS slot FROM dur WHERE duration > 360
), free AS (SELECT * FROM slots s WHERE NOT EXISTS (SELECT 1 FROM escalated e WHERE e.video_id = s.video_id AND e.t0 < s.slot * 120 + 120 AND e.t1 >= s.slot * 120)
), near AS (SELECT s.video_id, s.slot, f.t, f.health, row_number() OVER (PARTITION BY s.video_id, s.slot ORDER BY abs(f.t - (s.slot * 120 + 60)), f.t, f.event_id) AS rn
  FROM free s JOIN frames f USING (video_id)
), scans AS (SELECT video_id, 'scan' AS source, slot AS win, min(t) AS t0, max(t) AS t1, count(*) AS n_frames, avg(health) AS health FROM near WHERE rn <= 4 GROUP BY video_id, slot
  HAVING abs(min(t) - (slot * 120 + 60)) <= 120
), found AS (SELECT * FROM escalated UNION ALL SELECT * FROM scans
), low AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY health, t, event_id) AS rn FROM frames WHERE video_id NOT IN (SELECT video_id FROM found)
), floor_windows AS (SELECT * FROM found UNION ALL SELECT video_id, 'last-resort', 0, min(t), max(t), count(*), avg(health) FROM low WHERE rn <= 4 GROUP BY video_id
)"""
)
_CLUSTERS = """, hits AS (
  SELECT *, lag(t1) OVER (PARTITION BY video_id ORDER BY t0, event_id) AS p FROM {v} WHERE class <> 'normal'
), splits AS (
  SELECT h.*, CASE WHEN EXISTS (SELECT 1 FROM {v} x WHERE x.class = 'normal' AND x.video_id = h.video_id AND x.t0 >= h.p AND x.t1 <= h.t0) THEN 1 ELSE 0 END AS split FROM hits h
), clustered AS (
  SELECT *, CAST(sum(split) OVER (PARTITION BY video_id ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS cluster FROM splits
), best AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, cluster ORDER BY confidence DESC, t0, event_id) AS bn FROM clustered WHERE confidence >= 0.55
), rolled AS (
  SELECT c.video_id, c.cluster, count(*) AS n_windows, avg(CASE WHEN confidence >= 0.55 THEN confidence END) AS confidence,
    min(CASE WHEN confidence >= 0.55 THEN t0 END) AS s0, max(CASE WHEN confidence >= 0.55 THEN t1 END) AS e0, count(DISTINCT class) AS classes
  FROM clustered c GROUP BY c.video_id, c.cluster
), tops AS (
  SELECT r.*, b.class AS class_name, b.confidence AS peak, b.description FROM rolled r JOIN best b ON b.video_id = r.video_id AND b.cluster = r.cluster AND b.bn = 1
)"""
_LEAST = "CASE class_name WHEN 'traffic_accident' THEN 1.0 WHEN 'traffic_congestion' THEN 2.5 WHEN 'fire' THEN 1.5 ELSE 2.0 END"

ORACLES = {
    "gate": f"WITH RECURSIVE {B.ctes('frames')}{_GATE} SELECT video_id, event_id, round(t, 6) AS t, round(motion, 6) AS motion, why FROM gated",
    "gate_grouped": f"WITH RECURSIVE {B.ctes('frames')}{_GATE} SELECT video_id, event_id, round(t, 6) AS t, round(motion, 6) AS motion, why FROM gated",
    "gate_reasons": f"WITH RECURSIVE {B.ctes('frames')}{_GATE} SELECT why, count(*) AS n FROM gated GROUP BY why",
    "stride_sample": f"""WITH {B.ctes('frames')}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS i FROM frames)
        SELECT video_id, event_id FROM n WHERE i % (CASE WHEN video_id % 3 = 2 THEN 5 ELSE 12 END) = 0""",
    "sampled_source": f"""WITH {B.ctes('frames')}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM frames)
        SELECT video_id, i AS frame, i / 10.0 AS t, signal AS value, n / 10.0 AS duration FROM n WHERE i % 5 = 0""",
    "escalations": f"WITH {B.ctes('frames')}{_SESSION} SELECT video_id, win, round(t0, 6) AS t0, round(t1, 6) AS t1, n_frames, round(health, 6) AS health FROM escalated",
    "scan_floor": f"WITH {B.ctes('frames')}{_FLOOR} SELECT video_id, source, win, round(t0, 6) AS t0, round(t1, 6) AS t1, n_frames, round(health, 6) AS health FROM floor_windows",
    "window_sources": f"WITH {B.ctes('frames')}{_FLOOR} SELECT source, count(*) AS windows, CAST(sum(n_frames) AS BIGINT) AS frames FROM floor_windows GROUP BY source",
    "pick_frames": f"""WITH {B.ctes('frames')}{_SESSION}, m AS (SELECT *, count(*) OVER (PARTITION BY video_id, win) AS n, row_number() OVER (PARTITION BY video_id, win ORDER BY t, event_id) - 1 AS i FROM members)
        SELECT video_id, CAST(win AS BIGINT) AS win, event_id FROM m WHERE n <= 3 OR i IN (0, CAST(round_even((n - 1) / 2.0, 0) AS BIGINT), n - 1)""",
    "widen_window": f"""WITH {B.ctes('frames', 'truth')}, near AS (SELECT f.video_id, t.truth_id AS centre_id, f.event_id,
          count(*) OVER (PARTITION BY t.truth_id) AS n, row_number() OVER (PARTITION BY t.truth_id ORDER BY f.t, f.event_id) - 1 AS i
          FROM frames f JOIN truth t ON t.video_id = f.video_id AND f.t BETWEEN t.s - 48 AND t.s + 48)
        SELECT video_id, centre_id, event_id FROM near WHERE n >= 2 AND (n <= 8 OR list_contains(list_transform(range(0, 8), lambda j: CAST(round_even(j * (n - 1) / 7.0, 0) AS BIGINT)), i))""",
    "calibration": f"""WITH {B.ctes('frames')} SELECT round(quantile_cont(health, 0.12), 6) AS threshold, round(avg(health), 6) AS mean, round(quantile_cont(health, 0.01), 6) AS p1,
        round(quantile_cont(health, 0.5), 6) AS p50, round(quantile_cont(health, 0.99), 6) AS p99 FROM frames""",
    "calibration_normal": f"""WITH {B.ctes('frames', 'verdicts')}, v AS (SELECT DISTINCT video_id FROM verdicts WHERE class = 'normal' AND health < -1 ORDER BY video_id LIMIT 12)
        SELECT round(quantile_cont(health, 0.12), 6) AS threshold, round(avg(health), 6) AS mean, round(quantile_cont(health, 0.01), 6) AS p1,
        round(quantile_cont(health, 0.5), 6) AS p50, round(quantile_cont(health, 0.99), 6) AS p99 FROM frames JOIN v USING (video_id)""",
    "video_thresholds": f"WITH {B.ctes('frames')} SELECT video_id, round(quantile_cont(health, 0.12), 6) AS threshold FROM frames GROUP BY video_id",
    "escalation_rate": f"""WITH {B.ctes('frames')} SELECT video_id, round(count(*) FILTER (WHERE health < 0) / count(*), 4) AS rate FROM frames GROUP BY video_id""",
    "clusters": f"WITH {B.ctes('verdicts')}{_CLUSTERS.format(v='verdicts')} SELECT video_id, event_id, class AS class_name, cluster FROM clustered",
    "incidents": f"""WITH {B.ctes('verdicts')}{_CLUSTERS.format(v='verdicts')}
        SELECT video_id, cluster, class_name, round(greatest(0.0, s0 - 2), 6) AS start_t, round(e0 + 2, 6) AS end_t, round(confidence, 6) AS confidence, round(peak, 6) AS peak, n_windows,
          'windows' AS source, 'highest confidence' AS reason, description, CAST(classes - 1 AS INT) AS n_tags
        FROM tops WHERE e0 + 2 - greatest(0.0, s0 - 2) + 1e-6 >= {_LEAST}""",
    "adjudicated_incidents": f"""WITH {B.ctes('verdicts')}{_CLUSTERS.format(v='verdicts')},
        asked AS (SELECT video_id, cluster, max(class) AS said FROM clustered GROUP BY 1, 2 HAVING count(DISTINCT class) > 1 AND count(*) % 5 <> 0),
        d AS (SELECT t.* EXCLUDE (class_name, peak), coalesce(a.said, t.class_name) AS class_name, CASE WHEN a.said IS NULL THEN peak ELSE greatest(peak, 0.75) END AS peak,
          CASE WHEN a.said IS NULL THEN 'highest confidence' ELSE classes || ' seen' END AS reason FROM tops t LEFT JOIN asked a USING (video_id, cluster))
        SELECT video_id, cluster, class_name, round(greatest(0.0, s0 - 2), 6) AS start_t, round(e0 + 2, 6) AS end_t, round(confidence, 6) AS confidence, round(peak, 6) AS peak, n_windows, reason, CAST(classes - 1 AS INT) AS n_tags
        FROM d WHERE e0 + 2 - greatest(0.0, s0 - 2) + 1e-6 >= {_LEAST}""",
    "picked_overrides": f"""WITH {B.ctes('verdicts')}, p AS (SELECT *, class = 'normal' AND event_id % 5 <> 0 AND (event_id % 100) / 100.0 >= 0.5 AS o FROM verdicts),
        q AS (SELECT *, o AND event_id % 3 <> 0 AND event_id % 4 >= 2 AS again FROM p)
        SELECT event_id, CASE WHEN again THEN 'road_spill_or_debris' WHEN o THEN 'fire' ELSE class END AS class_name,
          round(CASE WHEN o THEN round(greatest(0.5, CASE WHEN again THEN least(0.8, (event_id % 100) / 100.0) ELSE (event_id % 100) / 100.0 END), 3) ELSE confidence END, 6) AS confidence,
          CASE WHEN again THEN 'picked' ELSE description END AS description, o AS probe_override FROM q""",
    "incidents_measured": f"""WITH {B.ctes('verdicts', 'frames')}{_CLUSTERS.format(v='verdicts')}, curve AS (
          SELECT video_id, t, health, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n, max(t) OVER (PARTITION BY video_id) + 1 AS duration FROM frames
        ), ends AS (
          SELECT o.video_id, o.cluster, any_value(c.n) AS n, any_value(c.duration) AS duration, coalesce(min(CASE WHEN c.t >= o.s0 THEN c.i END), any_value(c.n) - 1) AS a0, coalesce(max(CASE WHEN c.t <= o.e0 THEN c.i END), 0) AS b0
          FROM tops o JOIN curve c USING (video_id) GROUP BY o.video_id, o.cluster
        ), walked AS (
          SELECT e.video_id, e.cluster, any_value(e.duration) AS duration, coalesce(max(CASE WHEN c.i < e.a0 AND NOT c.health < -0.4 * 0.4 THEN c.i END) + 1, 0) AS a,
            coalesce(min(CASE WHEN c.i > e.b0 AND NOT c.health < -0.4 * 0.4 THEN c.i END) - 1, any_value(e.n) - 1) AS b
          FROM ends e JOIN curve c USING (video_id) GROUP BY e.video_id, e.cluster
        ), spans AS (
          SELECT o.*, w.duration, greatest(0.0, least(o.s0, ca.t) - 2) AS s1, greatest(o.e0, cb.t) + 2 AS e1
          FROM tops o JOIN walked w USING (video_id, cluster) JOIN curve ca ON ca.video_id = w.video_id AND ca.i = w.a JOIN curve cb ON cb.video_id = w.video_id AND cb.i = w.b
        ), clamped AS (
          SELECT *, CASE WHEN e1 > duration THEN least(s1, greatest(0.0, duration - 1e-3)) ELSE s1 END AS s, least(e1, duration) AS e FROM spans
        )
        SELECT video_id, cluster, class_name, round(s, 6) AS start_t, round(e, 6) AS end_t, 'measured' AS source, n_windows FROM clamped WHERE e - s + 1e-6 >= {_LEAST}""",
    "incident_tags": f"""WITH {B.ctes('verdicts')}{_CLUSTERS.format(v='verdicts')}, kept AS (SELECT * FROM tops WHERE e0 + 2 - greatest(0.0, s0 - 2) + 1e-6 >= {_LEAST}
        ), firsts AS (SELECT *, row_number() OVER (PARTITION BY video_id, cluster ORDER BY t0, event_id) AS turn, row_number() OVER (PARTITION BY video_id, cluster, class ORDER BY t0, event_id) AS fn FROM clustered
        ), tags AS (SELECT f.video_id, f.cluster, f.class AS class_name, max(f.confidence) AS p, count(*) AS n, min(f.t0) AS first_seen, min(f.turn) AS turn, max(CASE WHEN f.fn = 1 THEN f.description END) AS description
          FROM firsts f JOIN kept k ON k.video_id = f.video_id AND k.cluster = f.cluster AND k.class_name <> f.class GROUP BY f.video_id, f.cluster, f.class)
        SELECT video_id, cluster, CAST(row_number() OVER (PARTITION BY video_id, cluster ORDER BY p DESC, turn) - 1 AS INT) AS pos, class_name, round(p, 6) AS peak_confidence, n AS n_windows, round(first_seen, 6) AS first_seen, description FROM tags""",
    "min_duration_filter": f"WITH {B.ctes('frames', 'truth', 'pred')} SELECT video_id, pred_id, class AS class_name FROM pred WHERE e - s + 1e-6 >= CASE class WHEN 'traffic_accident' THEN 1.0 ELSE 1.5 END",
    "probe_override": f"""WITH {B.ctes('verdicts')}, p AS (SELECT *, class = 'normal' AND event_id % 5 <> 0 AND (event_id % 100) / 100.0 >= 0.9 AS o FROM verdicts)
        SELECT event_id, CASE WHEN o THEN 'fire' ELSE class END AS class_name, round(CASE WHEN o THEN round(greatest(0.5, (event_id % 100) / 100.0), 3) ELSE confidence END, 6) AS confidence, o AS probe_override FROM p""",
    "recovered_between": f"""WITH {B.ctes('frames')}, g AS (SELECT f.video_id, f.event_id AS gap_id, f.t AS lo, coalesce(lead(f.t) OVER (PARTITION BY f.video_id ORDER BY f.t, f.event_id), f.t) AS hi
          FROM frames f JOIN events e ON e.event_id = f.event_id AND e.event_type = 'error')
        SELECT g.video_id, g.gap_id, coalesce(2 * count(*) FILTER (WHERE f.health >= -0.4 * 0.4) > nullif(count(f.t), 0), false) AS recovered
        FROM g LEFT JOIN frames f ON f.video_id = g.video_id AND f.t > g.lo AND f.t < g.hi GROUP BY g.video_id, g.gap_id""",
    "gate_pipeline": f"""WITH RECURSIVE {B.ctes('frames', 'verdicts')}{_GATE}, kept AS (SELECT v.* FROM verdicts v JOIN gated g ON g.event_id = v.event_id AND g.why <> 'skipped'){_CLUSTERS.format(v='kept')}
        SELECT class_name, count(*) AS incidents, CAST(sum(n_windows) AS BIGINT) AS windows, round(avg(peak), 6) AS mean_peak FROM tops WHERE e0 + 2 - greatest(0.0, s0 - 2) + 1e-6 >= {_LEAST} GROUP BY class_name""",
}

_EXACT = ORACLES["incidents_measured"].replace("round(s, 6) AS start_t, round(e, 6) AS end_t", "s AS start_t, e AS end_t")
ORACLES["timeline"] = f"""WITH im AS ({_EXACT}), {B.ctes('verdicts', 'frames', 'truth')}{_CLUSTERS.format(v='verdicts')},
    firsts AS (SELECT c.video_id, c.cluster, c.class, min(c.t0) AS t0 FROM clustered c GROUP BY 1, 2, 3)
    SELECT video_id, 'bar' AS kind, class_name, round(start_t, 6) AS start_t, round(end_t - start_t, 6) AS length, true AS measured FROM im
    UNION ALL SELECT f.video_id, 'marker', f.class, round(f.t0, 6), NULL, NULL FROM firsts f JOIN im ON im.video_id = f.video_id AND im.cluster = f.cluster AND im.class_name <> f.class
    UNION ALL SELECT video_id, 'band', class, round(s, 6), round(e - s, 6), NULL FROM truth"""

QUERIES = {name: globals()[name] for name in ORACLES}
