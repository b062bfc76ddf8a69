"""Matching, scoring, submission."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import bindings as B
from tidemark.functions import interval_iou, marks
from tidemark.operators import matching as ma
from tidemark.operators import metrics as me
from tidemark.operators import submission as su


def r6(c):
    return F.round(c, 6)


def _truth_rows(spark, d):
    """A ground-truth-like relation: video_id (a source), class_name, is_anomaly from labels joined to documents."""
    j = B.table(spark, d, "labels").join(B.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return j.select(F.col("doc_id"), F.col("source").alias("video_id"), F.when(F.col("toxic") == 1, F.concat(F.lit("toxic_"), F.col("lang"))).otherwise("normal").alias("class_name"), (F.col("toxic") == 1).alias("is_anomaly"))


def _video_truth(spark, d):
    e = B.table(spark, d, "events").select(F.col("user_id").alias("video_id"), B.class_of(F.col("event_type")).alias("class_name"), "value")
    return e.select("video_id", F.when(F.col("value") > 250, F.col("class_name")).otherwise("normal").alias("class_name")).withColumn("is_anomaly", F.col("class_name") != "normal")


def _video_predictions(spark, d):
    """For users with an event over 150: the class of the event of greatest value, anomalous if that exceeds 240."""
    e = B.table(spark, d, "events").where("value > 150")
    top = e.groupBy(F.col("user_id").alias("video_id")).agg(F.max(F.struct("value", "event_id", "event_type")).alias("m"))
    cls = B.class_of(F.col("m.event_type"))
    said = (F.col("m.value") > 240) & (cls != "normal")
    return top.select("video_id", said.alias("said_anomaly"), F.when(said, cls).otherwise("normal").alias("said_class"))


def overlap_pairs(spark, d):
    """Overlapping truth and prediction of one video and class."""
    p = ma.overlapping(B.truth(spark, d), B.predicted(spark, d))
    return p.select("video_id", "truth_id", "pred_id", r6("iou").alias("iou"))


def overlap_pairs_any_class(spark, d):
    """J7 over all classes."""
    p = ma.overlapping(B.truth(spark, d), B.predicted(spark, d), same_class=False)
    return p.select("video_id", "truth_id", "pred_id", r6("iou").alias("iou"))


def match_disjoint(spark, d):
    """D8 by window functions (truths of a class do not overlap here)."""
    return ma.match_disjoint(B.truth(spark, d), B.predicted(spark, d)).select("video_id", "truth_id", "pred_id", r6("iou").alias("iou"))


def match_greedy(spark, d):
    """D8 as the exact sequential rule, on the same disjoint truths."""
    return ma.match_greedy(B.truth(spark, d), B.predicted(spark, d)).select("video_id", "truth_id", "pred_id", r6("iou").alias("iou"))


def match_greedy_overlapping(spark, d):
    """D8 on truths that overlap, where only the sequential rule is right."""
    return ma.match_greedy(B.truth(spark, d, clip=False), B.predicted(spark, d, clip=False)).select("video_id", "truth_id", "pred_id", r6("iou").alias("iou"))


def timed_score(spark, d):
    """Found, near misses, wrong classes and false alarms of each video."""
    t, p = B.truth(spark, d), B.predicted(spark, d)
    return ma.per_video(t, p, ma.match_disjoint(t, p))


def loose_evaluation(spark, d):
    """Best overlap of each truth without one-to-one matching."""
    return ma.loose_evaluation(B.truth(spark, d), B.predicted(spark, d)).select("video_id", "truth_id", r6("best").alias("best"), "hit", "fragments")


def quiet_false_alarms(spark, d):
    """Normal videos with any predicted event."""
    levels = B.table(spark, d, "events").groupBy(F.col("user_id").alias("video_id")).agg((F.max("value") < 200).alias("is_normal"))
    levels = levels.withColumn("level", (F.col("video_id") % 3 + 1).cast("int"))
    return ma.quiet_false_alarms(levels, B.predicted(spark, d))


def truth_rollup(spark, d):
    """A1: anomaly flag and classes of each source, classes joined to text."""
    r = me.truth_rollup(_truth_rows(spark, d))
    return r.select("video_id", "is_anomaly", F.array_join("classes", ",").alias("classes"))


def truth_label(spark, d):
    """the label text of each source."""
    return me.truth_label(me.truth_rollup(_truth_rows(spark, d)))


def truth_labels(spark, d):
    """gt_label: a label for every document, also for those without truth."""
    t = B.table(spark, d, "labels").join(B.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    t = t.select(F.col("doc_id").alias("video_id"), F.when(F.col("toxic") == 1, F.concat(F.lit("toxic_"), F.col("lang"))).otherwise("normal").alias("class_name"), (F.col("toxic") == 1).alias("is_anomaly"))
    return me.truth_labels(B.table(spark, d, "documents").select(F.col("doc_id").alias("video_id")), me.truth_rollup(t))


def score_table(spark, d):
    """The scores of each level and their total; orders by status as levels."""
    o = B.table(spark, d, "orders")
    level = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    s = o.groupBy(level.alias("level")).agg(F.count_if(F.col("o_totalprice") > 300000).alias("found"), F.count("*").alias("total"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("fa"))
    t = me.score_table(s)
    return t.select("level", "found", "total", "fa", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("marks").alias("marks"))


def _runs(spark, d):
    """Each order's lines as a run; returned ones took no time."""
    return B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("video_id")).agg(F.sum("l_quantity").alias("duration"), F.sum(F.when(F.col("l_returnflag") != "A", F.col("l_quantity") * 3 + 1).otherwise(0)).alias("seconds"))


def realtime_factors(spark, d):
    """Real-time factor of each order's lines as runs, rounded as its twin rounds: the product's half away from zero (`sink_rounding` has the operator's own rounding)."""
    factor = me.realtime(_runs(spark, d), None)
    return factor.select("video_id", (F.floor(F.col("realtime_factor") * 100 + 0.5) / 100).alias("realtime_factor"))


def sink_rounding(spark, d):
    """What the sinks round, as the binary value has it: real-time factors to two places, and the same to one, three and four."""
    runs = _runs(spark, d)
    each = me.realtime(runs, 2).withColumnRenamed("realtime_factor", "places2")
    for places in (1, 3, 4):
        each = each.join(me.realtime(runs, places).withColumnRenamed("realtime_factor", f"places{places}"), "video_id")
    return each


def confusion(spark, d):
    """A2: counts, precision, recall, F1 and false-alarm rate over videos."""
    both = me.truth_rollup(_video_truth(spark, d)).join(_video_predictions(spark, d), "video_id")
    c = me.confusion(both.select(F.col("is_anomaly").alias("truth"), F.col("said_anomaly").alias("said")))
    return c.select("tp", "fp", "fn", "tn", *(r6(x).alias(x) for x in ("precision", "recall", "f1", "false_alarm_rate")))


def class_accuracy(spark, d):
    """Share of true positives whose class is among the truth's."""
    both = me.truth_rollup(_video_truth(spark, d)).join(_video_predictions(spark, d), "video_id").where("is_anomaly and said_anomaly")
    return both.agg(r6(F.avg(F.array_contains("classes", F.col("said_class")).cast("int"))).alias("class_accuracy"))


def per_class_detection(spark, d):
    """A4: of the videos with a class, how many were flagged, and how many with that class."""
    both = me.truth_rollup(_video_truth(spark, d)).join(_video_predictions(spark, d), "video_id")
    each = both.select(F.explode("classes").alias("class_name"), "said_anomaly", "said_class")
    return each.groupBy("class_name").agg(F.count("*").alias("videos"), F.count_if("said_anomaly").alias("detected"), F.count_if(F.col("said_class") == F.col("class_name")).alias("correct"))


def video_outcomes(spark, d):
    """A5: the outcome of each video; unanswered ones stay."""
    return me.video_outcomes(me.truth_rollup(_video_truth(spark, d)), _video_predictions(spark, d)).select("video_id", "outcome")


def video_score(spark, d):
    """A5: totals over the outcomes."""
    return me.video_score(me.video_outcomes(me.truth_rollup(_video_truth(spark, d)), _video_predictions(spark, d)))


def marks_by_level(spark, d):
    """Precision, recall and marks for levels and counts taken from nations."""
    s = B.table(spark, d, "nation").select((F.col("n_nationkey") % 3 + 1).cast("int").alias("level"), (F.col("n_nationkey") % 9).alias("found"), (F.col("n_nationkey") % 9 + 3).alias("total"), (F.col("n_nationkey") % 5).alias("fa"))
    out = me.level_scores(s.distinct())
    return out.select("level", "found", "total", "fa", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("marks").alias("marks"))


def _as_twin(statistics):
    """Times rounded as their twin rounds, half up (`sink_rounding` has the operator's own rounding)."""
    return statistics.select(*(F.round(c, 1).alias(c) if c.endswith("_ms") else c for c in statistics.columns))


def call_statistics(spark, d):
    """Runtime statistics of calls, one model for each return flag."""
    calls = B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model_name"), F.col("l_extendedprice").alias("elapsed_ms"))
    return _as_twin(me.call_statistics(calls, places=None))


def call_statistics_by_line(spark, d):
    """A11 by two keys."""
    calls = B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model_name"), F.col("l_linenumber").alias("video_id"), F.col("l_extendedprice").alias("elapsed_ms"))
    return _as_twin(me.call_statistics(calls, ("video_id", "model_name"), None))


def class_report(spark, d):
    """Per-class precision, recall and F1 of event classes against a rule on the value."""
    pairs = B.verdicts(spark, d).select(F.col("class").alias("label"), F.when(F.col("event_id") % 4 == 0, "normal").otherwise(F.col("class")).alias("pred"))
    return me.class_report(pairs).select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


def confusion_matrix(spark, d):
    """Counts of label against prediction."""
    pairs = B.verdicts(spark, d).select(F.col("class").alias("label"), F.when(F.col("event_id") % 4 == 0, "normal").when(F.col("event_id") % 7 == 0, "fire").otherwise(F.col("class")).alias("pred"))
    return me.confusion_matrix(pairs, ["fire", "normal", "smoke", "traffic_accident", "traffic_congestion"])


def video_class(spark, d):
    """The class of the strongest prediction of each video, the first on ties."""
    p = B.predicted(spark, d).select("video_id", F.col("class").alias("class_name"), F.round(F.col("e") - F.col("s"), 0).alias("peak"), F.col("s").alias("start"), F.col("pred_id").alias("cluster"))
    return su.video_class(p)


def _events(spark, d):
    p = B.predicted(spark, d)
    tags = F.when(F.col("pred_id") % 3 == 0, F.array(F.struct(F.lit("smoke").alias("class_name")))).otherwise(F.array().cast("array<struct<class_name:string>>"))
    return p.select("video_id", F.col("class").alias("class_name"), F.col("s").alias("start"), F.col("e").alias("end"), (F.col("e") - F.col("s")).alias("peak"), F.col("pred_id").alias("cluster"), F.concat(F.lit("prediction "), F.col("pred_id").cast("string")).alias("description"), tags.alias("sub_tags"))


def _manifest(spark, d):
    """Users with an event over 200."""
    u = B.table(spark, d, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.max(B.hours(F.col("ts"))).alias("duration"), F.max("value").alias("most")).where("most > 200")
    return u.select("video_id", (F.col("video_id") % 3 + 1).cast("int").alias("level"), "duration")


def submission_rows(spark, d):
    """Events as submitted, with explanations."""
    s = su.project(_events(spark, d), _manifest(spark, d))
    return s.select("video_id", "level", "class_name", r6("start_time_sec").alias("start_time_sec"), r6("end_time_sec").alias("end_time_sec"), r6("confidence").alias("confidence"), "explanation")


def submission_document(spark, d):
    """The whole submission written as one JSON document from ordered partitions, read back and taken apart; videos without answers are not there."""
    from tidemark import sources

    manifest = _manifest(spark, d)
    events = su.project(_events(spark, d), manifest).select("video_id", "start_time_sec", "end_time_sec", "class_name", "confidence", "explanation")
    answers = B.predicted(spark, d).where("e - s >= 6").groupBy("video_id").agg(F.count("*").alias("n"))
    meta = F.when(F.col("n") > 3, F.struct(F.col("n").alias("frames_processed"), F.lit(1).cast("long").alias("chunks_processed"), F.lit(0.5).alias("end_to_end_internal_time_ms")))
    with sources.scratch(spark, "submission") as folder:
        su.write(manifest, answers.select("video_id", meta.alias("runtime_metadata")), events, "run-1", "tidemark", f"{folder}/submission.json")
        kind = "schema_version string, submission_id string, model_name string, predictions array<struct<video_id: long, events: array<struct<start_time_sec: double, end_time_sec: double, class_name: string, confidence: double, explanation: string>>, runtime_metadata: struct<frames_processed: long>>>"
        whole = spark.read.text(f"{folder}/submission.json", wholetext=True).select(F.from_json("value", kind).alias("d"))
        each = whole.select("d.submission_id", "d.model_name", F.posexplode("d.predictions").alias("place", "p"))
        each = each.select("submission_id", "model_name", "place", "p.video_id", F.col("p.runtime_metadata.frames_processed").alias("frames_processed"), F.explode_outer("p.events").alias("e"))
        return each.select("submission_id", "model_name", "place", "video_id", "frames_processed", "e.class_name", r6("e.start_time_sec").alias("start_time_sec"), r6("e.confidence").alias("confidence"), "e.explanation").checkpoint()


def submission_problems(spark, d):
    """Every broken rule."""
    e = B.predicted(spark, d)
    answers = e.where("e - s >= 6").select("video_id", (F.col("class") != "fire").alias("has_metadata")).distinct()  # two classes make two answers
    timed = F.col("pred_id") % 6 != 0
    events = e.select("video_id", F.when(F.col("pred_id") % 10 == 0, "normal").otherwise(F.col("class")).alias("class_name"), F.when(timed, F.col("s")).alias("start_time_sec"), F.when(timed, F.when(F.col("pred_id") % 9 == 0, F.col("s") - 1).otherwise(F.col("e"))).alias("end_time_sec"))
    return su.problems(_manifest(spark, d), answers, events).groupBy("video_id", "problem").agg(F.count("*").alias("n"))


_MATCH = """, pairs AS (
  SELECT t.video_id, t.truth_id, p.pred_id, t.class, p.class AS pc, t.s, t.e, p.s AS ps, p.e AS pe,
    (least(t.e, p.e) - greatest(t.s, p.s)) / (greatest(t.e, p.e) - least(t.s, p.s)) AS iou
  FROM truth t JOIN pred p ON p.video_id = t.video_id AND p.s < t.e AND p.e > t.s
), b AS (SELECT *, row_number() OVER (PARTITION BY truth_id ORDER BY iou DESC, ps, pred_id) AS bn FROM pairs WHERE class = pc AND iou >= 0.5
), m AS (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY s, truth_id) AS fn FROM b WHERE bn = 1
), matched AS (SELECT video_id, truth_id, pred_id, iou FROM m WHERE fn = 1)"""
_BASE = B.ctes("frames", "truth", "pred")
_CLS = "CASE event_type WHEN 'error' THEN 'traffic_accident' WHEN 'click' THEN 'smoke' WHEN 'purchase' THEN 'fire' WHEN 'signup' THEN 'traffic_congestion' ELSE 'normal' END"
_VT = f"""vt AS (SELECT user_id AS video_id, CASE WHEN value > 250 THEN {_CLS} ELSE 'normal' END AS class_name FROM events),
roll AS (SELECT video_id, bool_or(class_name <> 'normal') AS is_anomaly, coalesce(list(DISTINCT class_name) FILTER (WHERE class_name <> 'normal'), []) AS classes FROM vt GROUP BY 1),
tp AS (SELECT user_id AS video_id, value, {_CLS} AS c, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS rn FROM events WHERE value > 150),
said AS (SELECT video_id, value > 240 AND c <> 'normal' AS said_anomaly, CASE WHEN value > 240 AND c <> 'normal' THEN c ELSE 'normal' END AS said_class FROM tp WHERE rn = 1)"""
_OUT = """outcomes AS (SELECT r.video_id, r.is_anomaly, CASE WHEN s.said_anomaly IS NULL THEN 'unanswered' WHEN r.is_anomaly AND s.said_anomaly THEN CASE WHEN list_contains(r.classes, s.said_class) THEN 'found' ELSE 'wrong-class' END
  WHEN r.is_anomaly THEN 'missed' WHEN s.said_anomaly THEN 'false-alarm' ELSE 'true-normal' END AS outcome FROM roll r LEFT JOIN said s USING (video_id))"""
_TR = "tr AS (SELECT d.source AS video_id, CASE WHEN l.toxic = 1 THEN 'toxic_' || d.lang ELSE 'normal' END AS class_name, l.toxic = 1 AS is_anomaly FROM labels l JOIN documents d USING (doc_id))"
_STATS = """count(*) AS call_count, round(sum(l_extendedprice), 1) AS total_time_ms, round(avg(l_extendedprice), 1) AS average_time_ms,
  round(quantile_cont(l_extendedprice, 0.5), 1) AS p50_time_ms, round(quantile_cont(l_extendedprice, 0.95), 1) AS p95_time_ms, round(max(l_extendedprice), 1) AS max_time_ms"""
_MANIFEST = "man AS (SELECT user_id AS video_id, CAST(user_id % 3 + 1 AS INT) AS level, max((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0) AS duration FROM events GROUP BY 1 HAVING max(value) > 200)"

ORACLES = {
    "overlap_pairs": f"WITH {_BASE}{_MATCH} SELECT video_id, truth_id, pred_id, round(iou, 6) AS iou FROM pairs WHERE class = pc AND iou > 0",
    "overlap_pairs_any_class": f"WITH {_BASE}{_MATCH} SELECT video_id, truth_id, pred_id, round(iou, 6) AS iou FROM pairs WHERE iou > 0",
    "match_disjoint": f"WITH {_BASE}{_MATCH} SELECT video_id, truth_id, pred_id, round(iou, 6) AS iou FROM matched",
    "match_greedy": f"WITH {_BASE}{_MATCH} SELECT video_id, truth_id, pred_id, round(iou, 6) AS iou FROM matched",
    "timed_score": f"""WITH {_BASE}{_MATCH}, t AS (SELECT t.video_id, count(*) AS truth, count(m.truth_id) AS found,
          count(*) FILTER (WHERE m.truth_id IS NULL AND t.truth_id IN (SELECT truth_id FROM pairs WHERE iou > 0)) AS near_miss FROM truth t LEFT JOIN matched m USING (truth_id) GROUP BY t.video_id
        ), w AS (SELECT pred_id, bool_and(class <> pc) AS wrong FROM pairs WHERE iou > 0 GROUP BY 1
        ), p AS (SELECT p.video_id, count(*) AS pred, count(*) FILTER (WHERE m.pred_id IS NULL AND coalesce(w.wrong, false)) AS wrong_class, count(*) FILTER (WHERE m.pred_id IS NULL AND NOT coalesce(w.wrong, false)) AS false_alarm
          FROM pred p LEFT JOIN matched m ON m.pred_id = p.pred_id LEFT JOIN w ON w.pred_id = p.pred_id GROUP BY p.video_id)
        SELECT video_id, truth, pred, found, near_miss, wrong_class, false_alarm, wrong_class + false_alarm AS unmatched FROM t JOIN p USING (video_id)""",
    "loose_evaluation": f"""WITH {_BASE}{_MATCH}, bb AS (SELECT truth_id, max(iou) AS best FROM pairs WHERE class = pc AND iou > 0 GROUP BY 1), nn AS (SELECT video_id, class, count(*) AS n FROM pred GROUP BY 1, 2)
        SELECT t.video_id, t.truth_id, round(coalesce(best, 0), 6) AS best, coalesce(best, 0) >= 0.5 AS hit, greatest(0, coalesce(n, 0) - 1) AS fragments
        FROM truth t LEFT JOIN bb USING (truth_id) LEFT JOIN nn ON nn.video_id = t.video_id AND nn.class = t.class""",
    "quiet_false_alarms": f"""WITH {_BASE}, lv AS (SELECT user_id AS video_id, max(value) < 200 AS is_normal FROM events GROUP BY 1)
        SELECT video_id, CAST(video_id % 3 + 1 AS INT) AS level FROM lv WHERE is_normal AND video_id IN (SELECT video_id FROM pred)""",
    "truth_rollup": f"""WITH {_TR} SELECT video_id, bool_or(is_anomaly) AS is_anomaly, coalesce(string_agg(DISTINCT CASE WHEN class_name <> 'normal' THEN class_name END, ',' ORDER BY CASE WHEN class_name <> 'normal' THEN class_name END), '') AS classes FROM tr GROUP BY 1""",
    "truth_label": f"""WITH {_TR} SELECT video_id, coalesce(string_agg(DISTINCT CASE WHEN class_name <> 'normal' THEN class_name END, ', ' ORDER BY CASE WHEN class_name <> 'normal' THEN class_name END), 'normal') AS label FROM tr GROUP BY 1""",
    "truth_labels": "SELECT doc_id AS video_id, CASE WHEN l.doc_id IS NULL THEN 'no ground truth' WHEN toxic = 1 THEN 'toxic_' || lang ELSE 'normal' END AS label FROM documents d LEFT JOIN labels l USING (doc_id)",
    "score_table": """WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS level, count(*) FILTER (WHERE o_totalprice > 300000) AS found, count(*) AS total, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS fa FROM orders GROUP BY 1),
        m AS (SELECT *, CASE level WHEN 1 THEN greatest(2.0, least(25.0, 3.46 + 1.005 * found + 1.047 * ln(1 + fa))) WHEN 2 THEN greatest(2.0, least(35.0, 19.37 + 2.135 * found - 0.778 * ln(1 + fa))) ELSE greatest(2.0, least(40.0, 9.09 + 4.994 * found - 1.569 * ln(1 + fa))) END AS marks FROM s),
        a AS (SELECT * FROM m UNION ALL SELECT NULL, CAST(sum(found) AS BIGINT), CAST(sum(total) AS BIGINT), CAST(sum(fa) AS BIGINT), sum(marks) FROM m)
        SELECT level, found, total, fa, round(found / greatest(found + fa, 1), 6) AS precision, round(found / greatest(total, 1), 6) AS recall, round(marks, 6) AS marks FROM a""",
    "realtime_factors": "SELECT l_orderkey AS video_id, CASE WHEN sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity * 3 + 1 ELSE 0 END) > 0 THEN round(sum(l_quantity) / sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity * 3 + 1 ELSE 0 END), 2) ELSE 0 END AS realtime_factor FROM lineitem GROUP BY 1",
    "match_greedy_overlapping": f"""WITH RECURSIVE {B.ctes('frames')}, truth AS (SELECT f.video_id, f.event_id AS truth_id, f.t AS s, f.t + f.signal / 10 AS e, row_number() OVER (PARTITION BY f.video_id ORDER BY f.t, f.event_id) AS k
          FROM frames f JOIN events ev ON ev.event_id = f.event_id AND ev.event_type = 'error'),
        pred AS (SELECT video_id, truth_id AS pred_id, s + (truth_id % 5 - 2) AS ps, e + (truth_id % 5 - 2) AS pe FROM truth WHERE truth_id % 7 <> 0),
        pairs AS (SELECT video_id, truth_id, pred_id, ps, (least(e, pe) - greatest(s, ps)) / (greatest(e, pe) - least(s, ps)) AS iou FROM truth JOIN pred USING (video_id) WHERE least(e, pe) > greatest(s, ps)),
        turns AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS truth_id, CAST(NULL AS BIGINT) AS pred_id, CAST(NULL AS DOUBLE) AS iou, CAST([] AS BIGINT[]) AS taken FROM truth
          UNION ALL SELECT video_id, k, truth_id, best.p, best.iou, CASE WHEN best.p IS NULL THEN taken ELSE list_append(taken, best.p) END FROM (
            SELECT r.video_id, t.k, t.truth_id, r.taken, (SELECT min({{'d': -q.iou, 'ps': q.ps, 'p': q.pred_id, 'iou': q.iou}}) FROM pairs q WHERE q.truth_id = t.truth_id AND q.iou >= 0.5 AND NOT list_contains(r.taken, q.pred_id)) AS best
            FROM turns r JOIN truth t ON t.video_id = r.video_id AND t.k = r.k + 1))
        SELECT video_id, truth_id, pred_id, round(iou, 6) AS iou FROM turns WHERE pred_id IS NOT NULL""",
    "sink_rounding": """WITH r AS (SELECT l_orderkey AS video_id, sum(l_quantity) AS a, sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity * 3 + 1 ELSE 0 END) AS b FROM lineitem GROUP BY 1),
        f AS (SELECT video_id, CASE WHEN b > 0 THEN a / b ELSE 0 END AS x FROM r)
        SELECT video_id, CAST(printf('%.1f', x) AS DOUBLE) AS places1, CAST(printf('%.2f', x) AS DOUBLE) AS places2, CAST(printf('%.3f', x) AS DOUBLE) AS places3, CAST(printf('%.4f', x) AS DOUBLE) AS places4 FROM f""",
    "confusion": f"""WITH {_VT}, c AS (SELECT count(*) FILTER (WHERE is_anomaly AND said_anomaly) AS tp, count(*) FILTER (WHERE NOT is_anomaly AND said_anomaly) AS fp,
          count(*) FILTER (WHERE is_anomaly AND NOT said_anomaly) AS fn, count(*) FILTER (WHERE NOT is_anomaly AND NOT said_anomaly) AS tn FROM roll JOIN said USING (video_id)),
        q AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM c)
        SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-9), 6) AS f1, round(fp / greatest(fp + tn, 1), 6) AS false_alarm_rate FROM q""",
    "class_accuracy": f"WITH {_VT} SELECT round(avg(CAST(list_contains(classes, said_class) AS INT)), 6) AS class_accuracy FROM roll JOIN said USING (video_id) WHERE is_anomaly AND said_anomaly",
    "per_class_detection": f"""WITH {_VT}, x AS (SELECT unnest(classes) AS class_name, said_anomaly, said_class FROM roll JOIN said USING (video_id))
        SELECT class_name, count(*) AS videos, count(*) FILTER (WHERE said_anomaly) AS detected, count(*) FILTER (WHERE said_class = class_name) AS correct FROM x GROUP BY 1""",
    "video_outcomes": f"WITH {_VT}, {_OUT} SELECT video_id, outcome FROM outcomes",
    "video_score": f"""WITH {_VT}, {_OUT} SELECT count(*) FILTER (WHERE outcome = 'found') AS found, count(*) FILTER (WHERE is_anomaly) AS total, count(*) FILTER (WHERE outcome IN ('wrong-class', 'false-alarm')) AS fa,
        count(*) FILTER (WHERE outcome = 'missed') AS missed, count(*) FILTER (WHERE outcome = 'true-normal') AS tn, count(*) FILTER (WHERE outcome = 'wrong-class') AS wrong_class FROM outcomes""",
    "marks_by_level": """WITH s AS (SELECT DISTINCT CAST(n_nationkey % 3 + 1 AS INT) AS level, n_nationkey % 9 AS found, n_nationkey % 9 + 3 AS total, n_nationkey % 5 AS fa FROM nation)
        SELECT level, found, total, fa, round(found / greatest(found + fa, 1), 6) AS precision, round(found / greatest(total, 1), 6) AS recall,
          round(CASE level WHEN 1 THEN greatest(2.0, least(25.0, 3.46 + 1.005 * found + 1.047 * ln(1 + fa))) WHEN 2 THEN greatest(2.0, least(35.0, 19.37 + 2.135 * found - 0.778 * ln(1 + fa))) ELSE greatest(2.0, least(40.0, 9.09 + 4.994 * found - 1.569 * ln(1 + fa))) END, 6) AS marks FROM s""",
    "call_statistics": f"SELECT l_returnflag AS model_name, {_STATS} FROM lineitem GROUP BY 1",
    "call_statistics_by_line": f"SELECT l_linenumber AS video_id, l_returnflag AS model_name, {_STATS} FROM lineitem GROUP BY 1, 2",
    "class_report": f"""WITH {B.ctes('verdicts')}, x AS (SELECT class AS label, CASE WHEN event_id % 4 = 0 THEN 'normal' ELSE class END AS pred FROM verdicts),
        h AS (SELECT label, count(*) AS support, count(*) FILTER (WHERE label = pred) AS tp FROM x GROUP BY 1), s AS (SELECT pred AS label, count(*) AS said FROM x GROUP BY 1),
        q AS (SELECT label, support, coalesce(tp, 0) / greatest(coalesce(said, 0), 1) AS p, coalesce(tp, 0) / greatest(coalesce(support, 0), 1) AS r FROM h FULL JOIN s USING (label))
        SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-9), 6) AS f1, support FROM q""",
    "confusion_matrix": f"""WITH {B.ctes('verdicts')}, x AS (SELECT class AS label, CASE WHEN event_id % 4 = 0 THEN 'normal' WHEN event_id % 7 = 0 THEN 'fire' ELSE class END AS pred FROM verdicts)
        SELECT label, count(*) FILTER (WHERE pred = 'fire') AS fire, count(*) FILTER (WHERE pred = 'normal') AS normal, count(*) FILTER (WHERE pred = 'smoke') AS smoke,
        count(*) FILTER (WHERE pred = 'traffic_accident') AS traffic_accident, count(*) FILTER (WHERE pred = 'traffic_congestion') AS traffic_congestion FROM x GROUP BY label""",
    "video_class": f"""WITH {_BASE}, x AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(e - s, 0) DESC, s, pred_id) AS rn FROM pred) SELECT video_id, class AS class_name FROM x WHERE rn = 1""",
    "submission_rows": f"""WITH {_BASE}, {_MANIFEST}, x AS (SELECT p.*, level, row_number() OVER (PARTITION BY p.video_id ORDER BY p.e - p.s DESC, p.s, pred_id) AS rn FROM pred p JOIN man USING (video_id))
        SELECT video_id, level, class AS class_name, CASE WHEN level > 1 THEN round(s, 6) END AS start_time_sec, CASE WHEN level > 1 THEN round(e, 6) END AS end_time_sec, round(e - s, 6) AS confidence,
          'prediction ' || pred_id || CASE WHEN pred_id % 3 = 0 THEN ' Also observed: smoke.' ELSE '' END AS explanation FROM x WHERE level > 1 OR rn = 1""",
    "submission_document": f"""WITH {_BASE}, {_MANIFEST}, x AS (SELECT p.*, level, row_number() OVER (PARTITION BY p.video_id ORDER BY p.e - p.s DESC, p.s, pred_id) AS rn FROM pred p JOIN man USING (video_id)),
        a AS (SELECT video_id, count(*) AS n FROM pred WHERE e - s >= 6 GROUP BY 1), v AS (SELECT video_id, n, row_number() OVER (ORDER BY video_id) - 1 AS place FROM a JOIN man USING (video_id))
        SELECT 'run-1' AS submission_id, 'tidemark' AS model_name, CAST(place AS INT) AS place, v.video_id, CASE WHEN n > 3 THEN n ELSE 0 END AS frames_processed, class AS class_name, CASE WHEN level > 1 THEN round(s, 6) END AS start_time_sec,
          round(e - s, 6) AS confidence, 'prediction ' || pred_id || CASE WHEN pred_id % 3 = 0 THEN ' Also observed: smoke.' ELSE '' END AS explanation FROM v JOIN x ON x.video_id = v.video_id AND (level > 1 OR rn = 1)""",
    "submission_problems": f"""WITH {_BASE}, {_MANIFEST}, ans AS (SELECT DISTINCT video_id, class <> 'fire' AS has_metadata FROM pred WHERE e - s >= 6),
        ev AS (SELECT video_id, CASE WHEN pred_id % 10 = 0 THEN 'normal' ELSE class END AS class_name, CASE WHEN pred_id % 6 <> 0 THEN s END AS st, CASE WHEN pred_id % 6 <> 0 THEN CASE WHEN pred_id % 9 = 0 THEN s - 1 ELSE e END END AS en FROM pred),
        j AS (SELECT ev.*, level, duration FROM ev JOIN man USING (video_id)),
        p AS (SELECT video_id, 'more than one answer' AS problem FROM ans GROUP BY 1 HAVING count(*) > 1
          UNION ALL SELECT video_id, 'not in manifest' FROM ans WHERE video_id NOT IN (SELECT video_id FROM man)
          UNION ALL SELECT video_id, 'no runtime metadata' FROM ans WHERE NOT has_metadata AND video_id IN (SELECT video_id FROM man)
          UNION ALL SELECT video_id, 'not an event class' FROM j WHERE class_name NOT IN ('traffic_accident', 'fire')
          UNION ALL SELECT video_id, 'level 1 with times' FROM j WHERE level = 1 AND (st IS NOT NULL OR en IS NOT NULL)
          UNION ALL SELECT video_id, 'times missing' FROM j WHERE level > 1 AND (st IS NULL OR en IS NULL)
          UNION ALL SELECT video_id, 'ends before it starts' FROM j WHERE level > 1 AND en <= st
          UNION ALL SELECT video_id, 'ends after the video' FROM j WHERE level > 1 AND en > st AND en > duration + 0.5
          UNION ALL SELECT video_id, 'never answered' FROM man WHERE video_id NOT IN (SELECT video_id FROM ans))
        SELECT video_id, problem, count(*) AS n FROM p GROUP BY 1, 2""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
