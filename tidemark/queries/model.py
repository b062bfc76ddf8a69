"""Similarity, pooling, the probe, and the live path."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import bindings as B
from tidemark import sources, streaming
from tidemark.config import BOUND
from tidemark.functions import parse_reply
from tidemark.operators import probe, similarity
from tidemark.queries.relational import _pool, reply_texts


def r6(c):
    return F.round(c, 6)


def _frames(spark, d):
    return B.table(spark, d, "embeddings").where("vec_id >= 93").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("emb"), "label")


def rule_health(spark, d):
    """Signed sum of the five most similar rules."""
    return similarity.health(_frames(spark, d), _pool(spark, d)).select("frame_id", r6("health").alias("health"))


def class_shortlist(spark, d):
    """O2, M4: five classes with the most similar owned vector."""
    owners = B.table(spark, d, "embeddings").where("vec_id < 93").select(F.concat(F.lit("class"), F.col("label").cast("string")).alias("class"), F.col("embedding").alias("emb"))
    s = similarity.shortlist(_frames(spark, d).withColumnRenamed("frame_id", "vector_id"), owners)
    return s.select("vector_id", F.col("class").alias("class_name"), r6("best").alias("best"), "rank")


def mean_vectors(spark, d):
    """Element-wise mean of the vectors of each label."""
    m = similarity.mean_vector(B.table(spark, d, "embeddings").select("label", F.col("embedding").alias("emb")), "label")
    return m.select("label", F.posexplode("mean").alias("pos", "x")).select("label", "pos", r6("x").alias("x"))


def probe_curve(spark, d):
    """A linear score along each label's vectors, two to a unit of time."""
    f = B.table(spark, d, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("event_id"), (F.col("vec_id") / 2).alias("t"), F.col("embedding").alias("emb"))
    w = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 5 - 2).cast("double")).alias("w"), F.lit(0.25).alias("b"))
    return probe.curve(f, w, 32.0, 8.0)


def probe_anomaly(spark, d):
    """1 - p(normal) and the most likely other class; 0 and none where the probe has no opinion (here: small values)."""
    e = B.table(spark, d, "events")
    total = F.col("value") + 60
    p = F.when(F.col("value") >= 5, F.array(F.lit(50.0) / total, F.col("value") / total, F.lit(10.0) / total))
    return e.select("event_id", r6(probe.anomaly(p)).alias("anomaly"), F.when(F.get(p, F.lit(1)) >= F.get(p, F.lit(2)), 1).when(p.isNotNull(), 2).alias("top"))


def capped_sample(spark, d):
    """At most 30 vectors of each label, those with the smallest hash."""
    return probe.capped_sample(B.table(spark, d, "embeddings"), "label", "vec_id", 30).select("label", "vec_id")


def training_rows(spark, d):
    """Clips of five vectors, labelled by their smallest class; those of documents of low quality are disputed; at most twelve of each class, pooled."""
    from tidemark.operators import training

    e = B.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("video_id"), F.col("vec_id").alias("event_id"), F.col("vec_id").cast("double").alias("t"), F.col("embedding").alias("emb"), "label")
    clips = e.groupBy("video_id").agg(F.concat(F.lit("class"), F.min("label").cast("string")).alias("class_name"), F.when(F.max("label") < 9, F.lit("clip")).alias("path"))
    disputed = B.table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("video_id"))
    rows = training.training_rows(clips, disputed, e.drop("label"), 12, 3)
    return rows.select("video_id", "class_name", "n_frames", F.posexplode("emb").alias("pos", "x")).select("video_id", "class_name", "n_frames", "pos", r6("x").alias("x"))


def resident_encoder(spark, d):
    """M8, M1: an encoder loaded once in each worker, from a file made of its content: a projection of every vector to eight places."""
    import numpy as np

    from tidemark.operators import slots

    weights = np.array([[(i * 7 + j * 3) % 5 - 2 for j in range(8)] for i in range(64)], "<f8")

    def load(content: bytes):
        matrix = np.frombuffer(content, "<f8").reshape(64, 8)
        return lambda vectors: pd.Series(list(np.stack(vectors.to_list()).astype(np.float64) @ matrix))

    encoder = slots.Resident(spark, weights.tobytes(), load, "encoder")
    e = probe.embed(B.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("payload")), encoder)
    return e.select("vec_id", F.posexplode(F.col("emb").cast("array<double>")).alias("pos", "x")).select("vec_id", "pos", F.round("x", 3).alias("x"))


def stratified_split(spark, d):
    """A 75 / 25 split of each label, by hash."""
    return probe.split(B.table(spark, d, "embeddings"), "label", "vec_id").select("label", "vec_id", "train")


def probe_predictions(spark, d):
    """A probe fitted to the training part, applied to every vector."""
    e = probe.split(B.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("emb")), "label", "vec_id")
    model = probe.fit(e.where("train"))
    p = probe.predict(model, e, ["vec_id", "label", "train"])
    return p.select("vec_id", "label", "train", F.round(probe.anomaly(F.col("p")), 4).alias("anomaly"), (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("pred"))


def verified_windows(spark, d):
    """A deterministic verifier in the model slot; its replies are parsed."""

    def verifier(rows: pd.DataFrame) -> pd.Series:
        return rows["reply"].where(rows["event_id"] % 10 != 9, None)

    e = reply_texts(B.table(spark, d, "events")).withColumnRenamed("reply", "said").withColumn("reply", F.col("said")).select("event_id", "reply")
    v = probe.verify(e.withColumnRenamed("reply", "r").select("event_id", F.col("r").alias("reply")).select("event_id", F.struct("event_id", "reply").alias("w")).select("event_id", "w.reply"), verifier, ["event_id", "reply"])
    p = parse_reply(F.col("reply"))
    return v.select("event_id", p["class"].alias("class_name"))


def encoded_frames(spark, d):
    """M1, M8: a deterministic encoder in the model slot (letter counts), as it is; `stage1_chain` normalises."""

    def encoder(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [float(s.count(c)) for c in "aeiou"])

    e = probe.embed(B.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("payload")), encoder)
    return e.select("p_partkey", F.posexplode(F.col("emb").cast("array<double>")).alias("pos", "x"))


def _rules5(spark):
    """Six rules over five letters: one for each letter and one for all."""
    axes = [(i, 1.0 if i < 2 else -1.0, [1.0 if j == i else 0.0 for j in range(5)]) for i in range(5)]
    return spark.createDataFrame([*axes, (5, 1.0, [0.2] * 5)], "rule_id int, w double, emb array<double>")


def stage1_chain(spark, d):
    """M1, M3: sample, embed, normalise and score as one plan (parts as frames, in order of their keys, sizes as videos)."""
    from tidemark.operators import verdicts

    def encoder(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [float(s.count(c)) for c in "aeiou"])

    f = B.table(spark, d, "part").select(F.col("p_size").cast("long").alias("video_id"), F.col("p_partkey").alias("event_id"), F.col("p_partkey").cast("double").alias("t"), F.col("p_name").alias("payload"), F.lit(6.0).alias("source_rate"))
    s = verdicts.stage1(f, _rules5(spark), 2.0, encoder)
    return s.select("video_id", "frame_id", r6("health").alias("health"), r6(F.aggregate("emb", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


def window_verdicts(spark, d):
    """Verdict records of escalated windows; a deterministic verifier, and the probe's override with a second call."""
    from tidemark.operators import incidents as inc
    from tidemark.operators import verdicts
    from tidemark.operators import windows as win

    def verifier(rows: pd.DataFrame) -> pd.Series:
        return rows["said"].where(rows["said"].str.len() % 10 != 9, None)

    r = verdicts.records(win.escalations(B.frames(spark, d), 0.0, BOUND.gap), BOUND, 1.0)
    said = reply_texts(B.table(spark, d, "events")).select(F.col("event_id").alias("first_event"), F.col("reply").alias("said"))
    v = verdicts.judged(probe.verify(r.join(said, "first_event"), verifier, ["said"]))
    i = F.col("first_event")
    p = (i % 100) / 100.0
    again = i % 3 == 0
    v = v.withColumns({"probe_top": F.when(i % 5 != 0, "fire"), "probe_anomaly": p, "second_class": F.when(again, "smoke"), "second_confidence": F.when(again, 0.95), "second_description": F.when(again, "second look")})
    o = inc.override(v, 0.5)
    return o.select("video_id", "win", r6("t0").alias("t0"), r6("t1").alias("t1"), "n_frames", "picked", r6("health").alias("health"), F.col("class").alias("class_name"), r6("confidence").alias("confidence"), "description", "probe_override")


def pooled_shortlist(spark, d):
    """M4, O3: five classes for each window of ten vectors, by its mean vector; where a probe has an opinion, its own ranking comes first."""
    e = B.table(spark, d, "embeddings")
    mean = similarity.mean_vector(e.where("vec_id >= 93").select(F.floor(F.col("vec_id") / 10).alias("vector_id"), F.col("embedding").alias("emb")), "vector_id").withColumnRenamed("mean", "emb")
    owners = e.where("vec_id < 93").select(F.concat(F.lit("class"), F.col("label").cast("string")).alias("class"), F.col("embedding").alias("emb"))
    ids = mean.select("vector_id").where("vector_id >= 30")
    learned = ids.select("vector_id", F.explode(F.array(*(F.struct(F.lit(n).alias("class"), F.lit(p).alias("p")) for n, p in (("normal", 0.5), ("class3", 0.3), ("class1", 0.2))))).alias("o")).select("vector_id", "o.*")
    s = similarity.shortlist(mean, owners, 5, learned)
    return s.select("vector_id", F.col("class").alias("class_name"), r6("best").alias("best"), "rank", "learned")


def _stream(spark, d):
    """The events as a stream of files, in one trigger."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file source lists a folder; of the tables' folder it takes the events only
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select(F.col("user_id").alias("video_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), B.hours(F.col("ts")).alias("t"), F.col("value").alias("signal"), (1 - F.col("value") / 50).alias("health"))


def _drain(spark, stream, name, mode="append"):
    """What the stream gives, written batch by batch to the shared folder and read again; of a complete result the last batch."""
    schema = stream.schema
    with sources.scratch(spark, name) as base:
        streaming.store(stream, f"{base}/rows", f"{base}/state", mode).awaitTermination()
        spark.createDataFrame([], schema).write.parquet(f"{base}/rows/batch=-1")  # also of a stream without rows
        rows = spark.read.schema(f"{schema.toDDL()}, batch int").parquet(f"{base}/rows")
        rows = (rows if mode == "append" else rows.where(F.col("batch") == rows.select(F.max("batch")).scalar())).drop("batch")
        return rows.checkpoint()  # the folder goes


def stream_alerts(spark, d):
    """Score messages and alerts from the stream."""
    a = streaming.alerts(streaming.scores(_stream(spark, d)))
    return _drain(spark, a, "alerts").select("video_id", r6("t").alias("t"), "anomaly", "stage")


def stream_totals(spark, d):
    """Running totals at the end of the stream."""
    s = _drain(spark, streaming.statistics(streaming.scores(_stream(spark, d))), "totals", "complete")
    return s.select("frames_seen", "frames_escalated", r6("escalation_rate").alias("escalation_rate"))


def stream_slots(spark, d):
    """Frames of each user and five-day slot."""
    s = _drain(spark, streaming.slots(_stream(spark, d), "120 hours"), "slots", "complete")
    return s.select("video_id", F.date_format("slot_start", "yyyy-MM-dd HH").alias("slot_start"), "n_frames", r6("health").alias("health"))


def stream_sessions(spark, d):
    """Gap sessions of the stream, with the same windows as the batch operator."""
    s = _drain(spark, streaming.sessions(_stream(spark, d), 0.0, "12 hours"), "sessions", "complete")
    return s.select("video_id", r6("t0").alias("t0"), r6("t1").alias("t1"), "n_frames")


def stream_centred(spark, d):
    """Mean health in windows of four days, a day apart, by their centres."""
    s = _drain(spark, streaming.centred(_stream(spark, d), "96 hours", "24 hours", 48 * 3600), "centred", "complete")
    return s.select("video_id", F.date_format("centre", "yyyy-MM-dd HH").alias("centre"), r6("health").alias("health"))


def stream_gate(spark, d):
    """The stateful gate on the stream."""
    with sources.setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        g = _drain(spark, streaming.gate(_stream(spark, d), BOUND), "gate")
    return g.select("video_id", "event_id", r6("t").alias("t"), r6("motion").alias("motion"), "why")


def moving_region(spark, d):
    """The largest moving region between neighbouring vectors of a label, read as frames of 8 x 8 cells."""
    from tidemark.operators import regions

    e = B.table(spark, d, "embeddings")
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    frames = e.select("vec_id", "embedding", before.alias("before")).where("before IS NOT NULL")
    frames = frames.select("vec_id", F.zip_with("embedding", "before", lambda a, b: F.abs(a.cast("double") - b.cast("double"))).alias("diff"))
    return regions.moving_regions(frames, 8, 8, threshold=0.28, reach=1, least=12).select("vec_id", "box.*")


def live_progress(spark, d):
    """Running figures of the stream as its micro-batches observe them, after the last one."""
    from tidemark.streaming import progress

    with sources.scratch(spark, "live") as base:
        scored = progress.observed(streaming.scores(_stream(spark, d)))
        progress.watched(spark, f"{base}/progress", lambda: streaming.store(scored, f"{base}/rows", f"{base}/state").awaitTermination())
        t = progress.totals(spark, f"{base}/progress").orderBy(F.desc("batch")).limit(1)
        return t.select("frames_seen", "frames_escalated", "escalation_rate", r6("footage").alias("footage"), "due").checkpoint()


def fan_out(spark, d):
    """Alerts as messages of a log, as they are committed, after two subscribers have had them and one has died."""
    from tidemark.streaming import fanout

    def dead(messages):
        raise ConnectionError

    with sources.scratch(spark, "fanout") as base:
        fanout.log(streaming.alerts(streaming.scores(_stream(spark, d))).drop("ts"), f"{base}/log", f"{base}/state", "alert").awaitTermination()
        took = fanout.FanOut(f"{base}/log").deliver({"first": lambda messages: None, "dead": dead, "last": lambda messages: None})
        m = fanout.messages(spark, f"{base}/log")
        data = F.from_json("message", "type string, data struct<video_id: long, t: double, anomaly: double, stage: string>")
        rows = m.select("batch", "place", data.alias("m")).select("m.type", "m.data.*")
        return rows.select("video_id", r6("t").alias("t"), "anomaly", "stage", "type", F.lit(took["first"]).cast("long").alias("first_took"), F.lit(took["dead"]).cast("long").alias("dead_took"), F.lit(took["last"]).cast("long").alias("last_took")).checkpoint()


_SIM = "list_sum(list_transform(list_zip(f.embedding::DOUBLE[], r.embedding::DOUBLE[]), lambda p: p[1] * p[2]))"

ORACLES = {
    "rule_health": f"""WITH s AS (SELECT f.vec_id AS frame_id, CASE WHEN r.vec_id < 30 THEN 1.0 ELSE -1.0 END AS w, {_SIM} AS sim, r.vec_id AS rule_id FROM embeddings f, embeddings r WHERE f.vec_id >= 93 AND r.vec_id < 93),
        n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY sim DESC, rule_id) AS k FROM s) SELECT frame_id, round(sum(w * sim), 6) AS health FROM n WHERE k <= 5 GROUP BY 1""",
    "class_shortlist": f"""WITH s AS (SELECT f.vec_id AS vector_id, 'class' || r.label AS class_name, max({_SIM}) AS best FROM embeddings f, embeddings r WHERE f.vec_id >= 93 AND r.vec_id < 93 GROUP BY 1, 2),
        n AS (SELECT *, CAST(row_number() OVER (PARTITION BY vector_id ORDER BY best DESC, class_name) AS INT) AS rank FROM s) SELECT vector_id, class_name, round(best, 6) AS best, rank FROM n WHERE rank <= 5""",
    "mean_vectors": "SELECT label, CAST(i AS INT) AS pos, round(avg(embedding[i + 1]::DOUBLE), 6) AS x FROM embeddings, range(0, 64) r(i) GROUP BY 1, 2",
    "probe_curve": """WITH f AS (SELECT label AS video_id, vec_id, vec_id / 2.0 AS t, embedding FROM embeddings), b AS (SELECT video_id, min(t) AS lo, max(t) AS hi FROM f GROUP BY 1),
        c AS (SELECT video_id, lo + 8 * unnest(range(0, CAST(floor((hi - lo) / 8) AS BIGINT) + 1)) AS c FROM b),
        near AS (SELECT c.video_id, c.c, f.embedding, count(*) OVER (PARTITION BY c.video_id, c.c) AS n, row_number() OVER (PARTITION BY c.video_id, c.c ORDER BY f.t, f.vec_id) - 1 AS k FROM c JOIN f ON f.video_id = c.video_id AND f.t BETWEEN c.c - 16 AND c.c + 16),
        eight AS (SELECT * FROM near WHERE n <= 8 OR list_contains(list_transform(range(0, 8), lambda j: CAST(round_even(j * (n - 1) / 7.0, 0) AS BIGINT)), k)),
        m AS (SELECT video_id, c, i, avg(embedding[i + 1]::DOUBLE) AS x FROM eight, range(0, 64) r(i) GROUP BY 1, 2, 3)
        SELECT video_id, round(c, 2) AS t, round(1 / (1 + exp(-(0.25 + sum(x * (i % 5 - 2))))), 4) AS score FROM m GROUP BY video_id, c""",
    "probe_anomaly": "SELECT event_id, CASE WHEN value >= 5 THEN round(1 - 50.0 / (value + 60), 6) ELSE 0 END AS anomaly, CASE WHEN value >= 10 THEN 1 WHEN value >= 5 THEN 2 END AS top FROM events",
    "capped_sample": "SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':0'), vec_id) <= 30",
    "training_rows": """WITH e AS (SELECT CAST(floor(vec_id / 5) AS BIGINT) AS video_id, vec_id, embedding, label FROM embeddings),
        c AS (SELECT video_id, 'class' || min(label) AS class_name FROM e WHERE video_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1 HAVING max(label) < 9),
        k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY md5(video_id || ':0'), video_id) <= 12),
        f AS (SELECT e.*, k.class_name, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY vec_id) - 1 AS i FROM e JOIN k USING (video_id)),
        p AS (SELECT * FROM f WHERE n <= 3 OR i IN (0, CAST(round_even((n - 1) / 2.0, 0) AS BIGINT), n - 1))
        SELECT video_id, class_name, least(any_value(n), 3) AS n_frames, CAST(j AS INT) AS pos, round(avg(embedding[j + 1]::DOUBLE), 6) AS x FROM p, range(0, 64) r(j) GROUP BY video_id, class_name, j""",
    "resident_encoder": "SELECT vec_id, CAST(j AS INT) AS pos, round(sum(embedding[i + 1]::DOUBLE * ((i * 7 + j * 3) % 5 - 2)), 3) AS x FROM embeddings, range(0, 64) a(i), range(0, 8) b(j) GROUP BY 1, 2",
    "stratified_split": "SELECT label, vec_id, percent_rank() OVER (PARTITION BY label ORDER BY md5(vec_id || ':0'), vec_id) < 0.75 AS train FROM embeddings",
    "verified_windows": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'traffic_accident' WHEN 1 THEN 'fire' WHEN 2 THEN 'traffic_congestion' ELSE 'normal' END AS class_name FROM events WHERE event_id % 10 <> 9",
    "encoded_frames": "SELECT p_partkey, CAST(i AS INT) AS pos, CAST(len(p_name) - len(replace(p_name, substr('aeiou', i + 1, 1), '')) AS DOUBLE) AS x FROM part, range(0, 5) r(i)",
    "stage1_chain": """WITH f AS (SELECT CAST(p_size AS BIGINT) AS video_id, p_partkey AS frame_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS n, p_name FROM part),
        c AS (SELECT video_id, frame_id, CAST(i AS INT) AS i, CAST(len(p_name) - len(replace(p_name, substr('aeiou', i + 1, 1), '')) AS DOUBLE) AS x FROM f, range(0, 5) r(i) WHERE n % 3 = 0),
        u AS (SELECT *, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY frame_id)), 0) AS y FROM c),
        s AS (SELECT frame_id, video_id, i AS rule_id, CASE WHEN i < 2 THEN 1.0 ELSE -1.0 END AS w, coalesce(y, 0) AS sim FROM u UNION ALL SELECT frame_id, video_id, 5, 1.0, coalesce(sum(0.2 * y), 0) FROM u GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY sim DESC, rule_id) AS k FROM s), h AS (SELECT video_id, frame_id, sum(w * sim) AS health FROM n WHERE k <= 5 GROUP BY 1, 2)
        SELECT h.video_id, h.frame_id, round(health, 6) AS health, round(q.norm, 6) AS norm FROM h JOIN (SELECT frame_id, coalesce(sum(y * y), 0) AS norm FROM u GROUP BY 1) q USING (frame_id)""",
    "pooled_shortlist": f"""WITH m AS (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS vector_id, i, avg(embedding[i + 1]::DOUBLE) AS x FROM embeddings, range(0, 64) r(i) WHERE vec_id >= 93 GROUP BY 1, 2),
        v AS (SELECT vector_id, list(x ORDER BY i) AS x FROM m GROUP BY 1),
        s AS (SELECT vector_id, 'class' || label AS class_name, max(list_sum(list_transform(list_zip(v.x, e.embedding::DOUBLE[]), lambda p: p[1] * p[2]))) AS best FROM v, embeddings e WHERE e.vec_id < 93 GROUP BY 1, 2),
        l(class_name, p) AS (VALUES ('class3', 0.3), ('class1', 0.2)), a AS (SELECT vector_id, class_name, best, false AS learned FROM s WHERE vector_id < 30 UNION ALL SELECT vector_id, class_name, p, true FROM v, l WHERE vector_id >= 30),
        n AS (SELECT *, CAST(row_number() OVER (PARTITION BY vector_id ORDER BY best DESC, class_name) AS INT) AS rank FROM a) SELECT vector_id, class_name, round(best, 6) AS best, rank, learned FROM n WHERE rank <= 5""",
    "window_verdicts": f"""WITH {B.ctes('frames')}, f AS (SELECT *, coalesce(CAST(t - lag(t) OVER (PARTITION BY video_id ORDER BY t, event_id) > 12 AS INT), 0) AS new FROM frames WHERE health < 0),
        m AS (SELECT *, CAST(sum(new) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS win FROM f),
        i AS (SELECT *, count(*) OVER (PARTITION BY video_id, win) AS n, row_number() OVER (PARTITION BY video_id, win ORDER BY t, event_id) - 1 AS k FROM m),
        w AS (SELECT video_id, win, min(t) AS t0, max(t) + 1 AS t1, any_value(n) AS n_frames, min(CASE WHEN k = 0 THEN event_id END) AS e,
          count(*) FILTER (WHERE n <= 4 OR list_contains(list_transform(range(0, 4), lambda j: CAST(round_even(j * (n - 1) / 3.0, 0) AS BIGINT)), k)) AS picked,
          avg(health) FILTER (WHERE n <= 4 OR list_contains(list_transform(range(0, 4), lambda j: CAST(round_even(j * (n - 1) / 3.0, 0) AS BIGINT)), k)) AS health FROM i GROUP BY 1, 2),
        s AS (SELECT w.*, value / (value + 50) AS conf, CASE e % 4 WHEN 0 THEN 'traffic_accident' WHEN 1 THEN 'fire' WHEN 2 THEN 'traffic_congestion' ELSE 'normal' END AS c,
          CASE e % 4 WHEN 0 THEN 'seen ' || e WHEN 1 THEN 'hot' WHEN 2 THEN 'There may be Traffic Congestion or smoke at ' || e ELSE 'nothing {{here}} ' || e END AS d,
          CASE e % 4 WHEN 0 THEN len('{{"class": "Traffic-Accident", "confidence": ' || CAST(round(value / (value + 50), 3) AS VARCHAR) || ', "description": "seen ' || e || '"}}')
            WHEN 1 THEN 77 + len(CAST(e AS VARCHAR)) WHEN 2 THEN 44 + len(CAST(e AS VARCHAR)) ELSE 15 + len(CAST(e AS VARCHAR)) END AS said FROM w JOIN events ON events.event_id = e),
        o AS (SELECT *, c = 'normal' AND e % 5 <> 0 AND (e % 100) / 100.0 >= 0.5 AS o FROM s WHERE said % 10 <> 9)
        SELECT video_id, win, round(t0, 6) AS t0, round(t1, 6) AS t1, n_frames, picked, round(health, 6) AS health, CASE WHEN o AND e % 3 = 0 THEN 'smoke' WHEN o THEN 'fire' ELSE c END AS class_name,
          round(CASE WHEN o THEN round(greatest(0.5, CASE WHEN e % 3 = 0 THEN least(0.95, (e % 100) / 100.0) ELSE (e % 100) / 100.0 END), 3) ELSE CASE e % 4 WHEN 0 THEN round(conf, 3) WHEN 1 THEN 1.0 WHEN 2 THEN 0.4 ELSE 0.0 END END, 6) AS confidence,
          CASE WHEN o AND e % 3 = 0 THEN 'second look' ELSE d END AS description, o AS probe_override FROM o""",
    "moving_region": """WITH RECURSIVE d AS (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings),
        hot AS (SELECT vec_id, i // 8 AS y, i % 8 AS x FROM d, range(0, 64) r(i) WHERE before IS NOT NULL AND abs(embedding[i + 1]::DOUBLE - before[i + 1]::DOUBLE) > 0.28),
        cell AS (SELECT DISTINCT vec_id, y + dy AS y, x + dx AS x FROM hot, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7),
        reach AS (SELECT vec_id, y * 8 + x AS root, y, x FROM cell UNION SELECT r.vec_id, r.root, c.y, c.x FROM reach r JOIN cell c ON c.vec_id = r.vec_id AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1),
        region AS (SELECT vec_id, y, x, min(root) AS id FROM reach GROUP BY 1, 2, 3),
        box AS (SELECT vec_id, id, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM region GROUP BY 1, 2),
        air AS (SELECT vec_id, id, -1 AS y, -1 AS x FROM box
          UNION SELECT a.vec_id, a.id, a.y + s.dy, a.x + s.dx FROM air a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dy, dx)
          WHERE a.y + s.dy BETWEEN -1 AND 8 AND a.x + s.dx BETWEEN -1 AND 8
            AND NOT EXISTS (SELECT 1 FROM region g WHERE g.vec_id = a.vec_id AND g.id = a.id AND g.y = a.y + s.dy AND g.x = a.x + s.dx)),
        filled AS (SELECT vec_id, id, y, x FROM box, range(0, 8) p(y), range(0, 8) q(x) WHERE NOT EXISTS (SELECT 1 FROM air a WHERE a.vec_id = box.vec_id AND a.id = box.id AND a.y = p.y AND a.x = q.x)),
        corner AS (SELECT vec_id, id, y - dy AS sy, x - dx AS sx, count(*) AS n FROM filled, range(0, 2) a(dy), range(0, 2) b(dx) GROUP BY 1, 2, 3, 4),
        area AS (SELECT vec_id, id, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0 END) AS area FROM corner GROUP BY 1, 2),
        best AS (SELECT * FROM box JOIN area USING (vec_id, id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, y0, x0, w, h) = 1)
        SELECT d.vec_id, CAST(x0 AS INT) AS x, CAST(y0 AS INT) AS y, CAST(w AS INT) AS w, CAST(h AS INT) AS h FROM d LEFT JOIN best b ON b.vec_id = d.vec_id AND b.w * b.h >= 12 WHERE before IS NOT NULL""",
    "stream_centred": """WITH w AS (SELECT user_id AS video_id, value, time_bucket(INTERVAL 24 HOURS, ts, TIMESTAMP '1970-01-01') - to_hours(24 * CAST(j AS INT)) AS s FROM events, range(0, 4) r(j))
        SELECT video_id, strftime(s + INTERVAL 48 HOURS, '%Y-%m-%d %H') AS centre, round(avg(1 - value / 50), 6) AS health FROM w GROUP BY 1, 2""",
    "stream_alerts": f"WITH {B.ctes('frames')} SELECT video_id, round(t, 6) AS t, round(1 - health, 3) AS anomaly, CASE WHEN round(1 - health, 3) > 0.8 THEN 'vlm' ELSE 'filter' END AS stage FROM frames WHERE round(1 - round(health, 15), 3) > 0.5",
    "fan_out": f"WITH {B.ctes('frames')} SELECT video_id, round(t, 6) AS t, round(1 - health, 3) AS anomaly, CASE WHEN round(1 - health, 3) > 0.8 THEN 'vlm' ELSE 'filter' END AS stage, 'alert' AS type, count(*) OVER () AS first_took, CAST(0 AS BIGINT) AS dead_took, count(*) OVER () AS last_took FROM frames WHERE round(1 - round(health, 15), 3) > 0.5",
    "live_progress": f"WITH {B.ctes('frames')}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE round(1 - health, 3) > 0.5) AS e, max(t) - min(t) AS f FROM frames) SELECT n AS frames_seen, e AS frames_escalated, CAST(printf('%.4f', e / n) AS DOUBLE) AS escalation_rate, round(f, 6) AS footage, n >= 10 AS due FROM s",
    "stream_totals": f"WITH {B.ctes('frames')} SELECT count(*) AS frames_seen, count(*) FILTER (WHERE round(1 - health, 3) > 0.5) AS frames_escalated, round(count(*) FILTER (WHERE round(1 - health, 3) > 0.5) / greatest(count(*), 1), 6) AS escalation_rate FROM frames",
    "stream_slots": "SELECT user_id AS video_id, strftime(time_bucket(INTERVAL 120 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H') AS slot_start, count(*) AS n_frames, round(avg(1 - value / 50), 6) AS health FROM events GROUP BY 1, 2",
    "stream_sessions": f"""WITH {B.ctes('frames')}, f AS (SELECT *, coalesce(CAST(t - lag(t) OVER (PARTITION BY video_id ORDER BY t, event_id) > 12 AS INT), 0) AS new FROM frames WHERE health < 0),
        m AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS win FROM f) SELECT video_id, round(min(t), 6) AS t0, round(max(t), 6) AS t1, count(*) AS n_frames FROM m GROUP BY video_id, win""",
}
from tidemark.queries.sequence import ORACLES as _SEQUENCE  # noqa: E402

ORACLES["stream_gate"] = _SEQUENCE["gate"]

QUERIES = {name: globals()[name] for name in [*ORACLES, "probe_predictions"]}
