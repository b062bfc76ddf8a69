"""Joins, set operations, windows, top-k, scalar functions, audits, on the driver's tables."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import bindings as B
from tidemark import functions as fn
from tidemark import plans, sources
from tidemark.operators import intervals


def r6(c):
    return F.round(c, 6)


def _pool(spark, d):
    return B.table(spark, d, "embeddings").where("vec_id < 93").select(F.col("vec_id").alias("rule_id"), F.when(F.col("vec_id") < 30, 1.0).otherwise(-1.0).alias("w"), F.col("embedding").alias("emb"))


def semi_join(spark, d):
    """Documents that have a label."""
    return B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


def anti_join(spark, d):
    """Documents without a label."""
    return B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


def lookup_join(spark, d):
    """Every document with its label if it has one, and the number of those that have none."""
    j = B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


def full_diff(spark, d):
    """Finished orders against orders of which a line came back; the level is a residue of the customer or the greatest supplier."""
    a = B.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("video_id"), (F.col("o_custkey") % 3).cast("int").alias("level"))
    b = B.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("video_id")).agg((F.max("l_suppkey") % 3).cast("int").alias("level"))
    return sources.compare_manifests(a, b)


def manifest_left(spark, d):
    """Users of the manifest with and without predictions of fire."""
    m = B.table(spark, d, "events").select(F.col("user_id").alias("video_id")).distinct()
    p = B.predicted(spark, d).where("class = 'fire'").groupBy("video_id").agg(F.count("*").alias("n"))
    return m.join(p, "video_id", "left").select("video_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


def prediction_truth_join(spark, d):
    """Inner join with renamed sides."""
    t = B.truth(spark, d).groupBy("video_id").agg(F.count("*").alias("n_true"))
    p = B.predicted(spark, d).groupBy("video_id").agg(F.count_if(F.col("class") == "fire").alias("n_pred"))
    return t.join(p, "video_id").select("video_id", "n_true", "n_pred")


def range_join(spark, d):
    """Frames inside each labelled interval, ends included."""
    f = B.frames(spark, d).select("video_id", F.col("event_id").alias("frame"), "t")
    return intervals.points_in(f, B.truth(spark, d), "s", "e", 8.0).groupBy("truth_id").agg(F.count("*").alias("frames"))


def first_containing(spark, d):
    """For each frame the first predicted interval that contains it."""
    f = B.frames(spark, d)
    j = intervals.points_in(f, B.predicted(spark, d), "s", "e", 8.0)
    n = F.row_number().over(Window.partitionBy("event_id").orderBy("s", "pred_id"))
    return j.withColumn("n", n).where("n = 1").select("event_id", "pred_id")


def id_intersection(spark, d):
    """Customers that are also suppliers' keys."""
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).intersect(B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


def bag_union(spark, d):
    """Parts of a table put together again, and counted."""
    e = B.table(spark, d, "events").select("user_id", "event_type")
    u = e.where("event_type = 'view'").unionByName(e.where("event_type <> 'view'")).unionByName(e.where("event_type = 'error'"))
    return u.groupBy("event_type").agg(F.count("*").alias("n"))


def keep_first(spark, d):
    """The first event of each user and type."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return B.table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "event_id")


def set_differences(spark, d):
    """Vocabulary against the classes of the events, both ways."""
    return sources.label_differences(spark, B.verdicts(spark, d).where("class <> 'fire'").select(F.col("class").alias("class_name")).unionByName(spark.createDataFrame([("odd",)], "class_name string")))


def ordered_union(spark, d):
    """Two label lists joined in order without repetition, at most six."""
    a = F.array(F.col("event_type"), F.lit("fire"), F.lit("smoke"), F.lit("view"))
    b = F.array(F.lit("smoke"), F.col("event_type"), F.lit("x1"), F.lit("x2"), F.lit("x3"), F.lit("x4"))
    return B.table(spark, d, "events").select("event_id", F.array_join(F.slice(F.array_distinct(F.concat(a, b)), 1, 6), ",").alias("hints"))


def class_counts(spark, d):
    """Events per class without a muted one."""
    return B.verdicts(spark, d).where(~F.col("class").isin("smoke")).groupBy(F.col("class").alias("class_name")).agg(F.count("*").alias("n"))


def strong_filter(spark, d):
    """Videos with a window of confidence 0.55 or more."""
    v = B.verdicts(spark, d)
    return v.groupBy("video_id").agg(F.count_if(F.col("confidence") >= 0.55).alias("strong"), F.count("*").alias("n")).where("strong > 0")


def last_points(spark, d):
    """The last 5 frames of each user, newest first."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("t"), F.desc("event_id")))
    return B.frames(spark, d).withColumn("n", n).where("n <= 5").select("video_id", "n", "event_id")


def head(spark, d):
    """A limit under a total order."""
    return B.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def ordered_events(spark, d):
    """Predicted events of each video in order, as one text."""
    p = B.predicted(spark, d).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("s", "pred_id"))).alias("x"))
    return p.select("video_id", F.array_join(F.transform("x", lambda e: e["pred_id"].cast("string")), ",").alias("events"))


def duration_by_level(spark, d):
    """Videos and total duration by level."""
    u = plans.durations(B.frames(spark, d)).withColumn("level", (F.col("video_id") % 3 + 1).cast("int"))
    return u.groupBy("level").agg(F.count("*").alias("videos"), r6(F.sum("duration")).alias("duration"))


def run_totals(spark, d):
    """Sums and shares over orders as runs."""
    o = B.table(spark, d, "orders")
    return o.agg(
        F.count("*").alias("runs"), F.round(F.sum("o_totalprice"), 2).alias("total"), r6(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) / F.greatest(F.sum("o_totalprice"), F.lit(1e-9))).alias("share_f"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )


def live_totals(spark, d):
    """Frames seen, escalated, and the rate, as the stream's statistics give them."""
    from tidemark import streaming

    s = streaming.statistics(B.frames(spark, d).select("video_id", F.lit(None).cast("timestamp").alias("ts"), "t", "health", (1 - F.col("health")).alias("anomaly")))
    return s.select("frames_seen", "frames_escalated", r6("escalation_rate").alias("escalation_rate"))


def audit(spark, d):
    """Files, bytes and classes of each root (documents by source and language)."""
    f = B.table(spark, d, "documents").select(F.col("source").alias("root"), F.col("lang").alias("class_name"), F.col("n_chars").alias("length"))
    return sources.audit(f)


def download_page_sniff(spark, d):
    """S3: which small pages begin like a file host's page (here the title is put in front)."""
    p = B.table(spark, d, "pages").withColumn("content", F.encode(F.concat(F.when(F.col("page_id") % 3 == 0, "<!DOCTYPE HTML><title>Google Drive</title>").otherwise(""), F.col("html")), "utf-8"))
    return p.where(sources.looks_like_download_page(F.col("content"), F.octet_length("content").cast("long"))).select("page_id")


def resume_list(spark, d):
    """Entries still to be extracted."""
    a = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("size"))
    b = B.table(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("size"))
    return sources.not_yet_extracted(a, b)


def cache_check(spark, d):
    """Rows, bad vectors and unknown labels of the vector table."""
    c = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("video_id"), F.when(F.col("label") == 0, "normal").when(F.col("label") == 9, "odd").otherwise("fire").alias("label"), F.col("embedding").alias("emb"))
    return sources.check_cache(c)


def duration_expr(spark, d):
    """Frames over rate with a fallback rate of 25."""
    return B.table(spark, d, "part").select("p_partkey", r6(F.col("p_size") * 100 / F.coalesce(F.nullif((F.col("p_size") % 5).cast("double"), F.lit(0.0)), F.lit(25.0))).alias("duration"))


def class_names(spark, d):
    """free spellings to labels."""
    t = F.col("event_id") % 8
    raw = (
        F.when(t == 0, "Traffic-Accident").when(t == 1, " traffic  accident ").when(t == 2, "FIRE").when(t == 3, "roadspillordebris").when(t == 4, "_smoke_").when(t == 5, "something else").when(t == 6, F.lit(None)).otherwise("wrong way-driving")
    )
    return B.table(spark, d, "events").select("event_id", fn.resolve_class(raw).alias("class_name"))


def reply_texts(df):
    """Model replies in four shapes, made from event columns."""
    t, v, i = F.col("event_id") % 4, F.col("value"), F.col("event_id").cast("string")
    conf = F.round(v / (v + 50), 3).cast("string")
    return df.withColumn(
        "reply",
        F.when(t == 0, F.concat(F.lit('{"class": "Traffic-Accident", "confidence": '), conf, F.lit(', "description": "seen '), i, F.lit('"}')))
        .when(t == 1, F.concat(F.lit('Sure:\n```json\n{"class": "fire", "confidence": 1.7, "description": "hot"}\n``` '), i))
        .when(t == 2, F.concat(F.lit("There may be Traffic Congestion or smoke at "), i))
        .otherwise(F.concat(F.lit("nothing {here} "), i)),
    )


def parsed_replies(spark, d):
    """replies as JSON, in fences, in prose, and junk."""
    p = fn.parse_reply(F.col("reply"))
    e = reply_texts(B.table(spark, d, "events")).withColumn("p", p)
    return e.select("event_id", F.col("p.class").alias("class_name"), F.round("p.confidence", 3).alias("confidence"), F.col("p.description").alias("description"))


def props_json(spark, d):
    """a number from a JSON column."""
    return B.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


def explanations(spark, d):
    """descriptions with the other classes seen, at most 500 characters."""
    others = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("road_spill_or_debris"), F.lit("fire"))).otherwise(F.array().cast("array<string>"))
    text = F.when(F.col("p_size") % 7 == 0, F.lit(None).cast("string")).when(F.col("p_size") % 5 == 0, F.repeat(F.col("p_name"), 60)).otherwise(F.col("p_name"))
    return B.table(spark, d, "part").select("p_partkey", fn.explanation(text, others).alias("explanation"))


def timeline_bars(spark, d):
    """predicted intervals as text rows."""
    p = B.predicted(spark, d)
    return p.select("pred_id", fn.bar(F.col("s"), F.col("e"), F.lit(720.0), "o").alias("bar"))


def crop_boxes(spark, d):
    """crops in full size around boxes in the small frame."""
    x, y = F.col("p_size") * 9, F.col("p_size") * 5
    c = fn.crop_box(x.cast("double"), y.cast("double"), (F.col("p_partkey") % 40 + 1).cast("double"), (F.col("p_partkey") % 30 + 1).cast("double"), (640, 360), (1920, 1080))
    return B.table(spark, d, "part").select("p_partkey", c.alias("c")).where("c is not null").select("p_partkey", "c.x0", "c.y0", "c.x1", "c.y1")


def prompt_circles(spark, d):
    """marker centre and radius."""
    c = fn.prompt_circle(F.col("p_size"), F.col("p_size") * 2, F.col("p_size") + 7, F.col("p_size") * 3)
    return B.table(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.cx", "c.cy", "c.r")


def clip_points(spark, d):
    """eight even times around labelled parts."""
    t = B.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("dur"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 4).alias("s"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 2).alias("e"))
    return t.select("p_partkey", F.posexplode(fn.clip_points(F.col("s"), F.col("e"), F.col("dur"))).alias("i", "t")).select("p_partkey", "i", r6("t").alias("t"))


def softmax(spark, d):
    """scaled softmax over three scores."""
    s = F.array(F.col("p_size") / 100, F.lit(0.2), (F.col("p_partkey") % 10) / 20)
    return B.table(spark, d, "part").select("p_partkey", F.posexplode(fn.softmax(s)).alias("i", "p")).select("p_partkey", "i", r6("p").alias("p"))


def normalised_dot(spark, d):
    """inner product of normalised vectors with the first vector."""
    e = B.table(spark, d, "embeddings")
    first = e.where("vec_id = 0").select(F.first("embedding")).scalar()
    return e.withColumn("z", first).select("vec_id", r6(fn.dot(fn.l2_normalise(F.col("embedding")), fn.l2_normalise(F.col("z")))).alias("sim"))


def file_stems(spark, d):
    """Stems of page paths."""
    return B.table(spark, d, "pages").select("page_id", fn.stem(F.regexp_replace("url", "[?#].*$", "")).alias("stem"))


def gallery_time(spark, d):
    """Gallery frame: middle of the strongest predicted fire, else the first labelled start of ten hours or more, else half the duration."""
    f = plans.durations(B.frames(spark, d))
    top = B.predicted(spark, d).where("class = 'fire'").withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc(F.col("e") - F.col("s")), "s", "pred_id"))).where("n = 1")
    first = B.truth(spark, d).where("e - s >= 10").groupBy("video_id").agg(F.min("s").alias("first"))
    j = f.join(top.select("video_id", ((F.col("s") + F.col("e")) / 2).alias("mid")), "video_id", "left").join(first, "video_id", "left")
    return j.select("video_id", r6(F.coalesce("mid", "first", F.col("duration") / 2)).alias("t"))


def truth_from_csv(spark, d):
    """Labelled intervals written as CSV with some repeated rows, read again as truth."""
    t = B.predicted(spark, d)
    rows = t.select(F.col("video_id").cast("string").alias("video_id"), F.lit("2").alias("level"), F.upper((F.col("class") != "normal").cast("string")).alias("is_anomaly"), F.col("class").alias("class_name"), F.round("s", 3).cast("string").alias("start_time_sec"), F.when(F.col("class") == "fire", "later").otherwise(F.round("e", 3).cast("string")).alias("end_time_sec"))
    with sources.scratch(spark, "truth") as at:
        rows.unionByName(rows.where("class_name = 'fire'")).write.csv(at, header=True)
        read = sources.read_truth(spark, [at]).select("video_id", "level", "is_anomaly", "class_name", r6("start_time_sec").alias("start_time_sec"), r6("end_time_sec").alias("end_time_sec"))
        return read.checkpoint()  # the folder goes


def manifest_round_trip(spark, d):
    """Users as one manifest document, written and read again."""
    u = plans.durations(B.frames(spark, d)).where("duration is not null")
    video = F.struct(F.col("video_id").cast("string").alias("video_id"), F.when(F.col("duration") > 700, 1).cast("int").alias("level"), F.when(F.col("duration") <= 700, 2).cast("int").alias("difficulty"), F.when(F.col("duration") > 710, 0.0).otherwise(F.col("duration")).alias("duration_sec"))
    with sources.scratch(spark, "manifest") as at:
        sources.write_document(u.agg(F.to_json(F.struct(F.lit("1").alias("schema_version"), F.collect_list(video).alias("videos"))).alias("document")), at)
        return sources.read_manifest(spark, at).select("video_id", "level", r6("duration_sec").alias("duration_sec")).checkpoint()


def predictions_as_json(spark, d):
    """Predictions as JSON lines with nulls kept, and vectors as a cache, both written and read again."""
    p = B.predicted(spark, d).select("video_id", "pred_id", F.when(F.col("class") == "fire", F.col("class")).alias("class_name"))
    with sources.scratch(spark, "json") as folder:
        at = sources.stamped(folder, "predictions", "run-1")
        sources.write_json(p, at)
        lines = spark.read.text(at).select(F.contains("value", F.lit('"class_name":null')).alias("kept"), F.from_json("value", p.schema).alias("r"))
        return lines.select("r.*", "kept").checkpoint()


def cache_round_trip(spark, d):
    """Vectors written as a cache, read again and checked."""
    with sources.scratch(spark, "cache") as at:
        sources.write_cache(B.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("video_id"), F.when(F.col("label") == 0, "normal").otherwise("fire").alias("label"), F.col("embedding").alias("emb")), at)
        return sources.check_cache(spark.read.parquet(at)).checkpoint()


def zip_ingest(spark, d):
    """Parts packed into ten archives, some with paths that lead outside, unpacked below a folder, twice, and read back."""
    from tidemark.sources import folders, zips

    p = B.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    with sources.scratch(spark, "zips") as base:
        name = F.concat(F.when(F.col("p_partkey") % 7 == 0, "../").otherwise("Pack/"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".txt"))
        _pack(p.select((F.col("p_partkey") % 10).alias("zip"), name.alias("name"), F.col("p_name").alias("content")), f"{base}/in")
        archives = [f"{base}/in/{i}.zip" for i in range(10)]
        first = zips.ingest(spark, archives, f"{base}/out", "Pack/").groupBy("outcome").count().collect()
        again = {r["outcome"]: r["count"] for r in zips.ingest(spark, archives, f"{base}/out", "Pack/").groupBy("outcome").count().collect()}
        first = {r["outcome"]: r["count"] for r in first}
        read = folders.contents(folders.below(spark, f"{base}/out"), f"{base}/out")
        part = lambda i: F.regexp_extract("rel", r"([0-9]+)/([0-9]+)\.txt$", i)
        counts = [F.lit(n).cast("long").alias(c) for n, c in ((first.get("written", 0), "written"), (first.get("outside", 0), "outside"), (again.get("present", 0), "present"))]
        return read.select(part(2).cast("long").alias("p_partkey"), part(1).cast("int").alias("folder"), F.col("content").cast("string").alias("content"), *counts).checkpoint()


def _pack(rows, folder):
    """rows (zip, name, content) as archives {zip}.zip in a folder, each streamed to its file by one task."""
    import zipfile

    import pyarrow as pa

    from tidemark.sources.folders import store_of

    def pack(batches):
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        open_, archive, out = None, None, None
        for batch in batches:
            for to, name, content in zip(*(batch.column(c).to_pylist() for c in ("zip", "name", "content")), strict=True):
                if to != open_:
                    if archive:
                        archive.close()
                        out.close()
                    open_, out = to, store.open_output_stream(f"{base}/{to}.zip")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(name, content)
        if archive:
            archive.close()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["zip"])

    dealt = rows.repartition(10, "zip").sortWithinPartitions("zip")
    dealt.mapInArrow(pack, "zip long").write.format("noop").mode("overwrite").save()


def seek_time(spark, d):
    """Seeking goes two units before an event, not below 0."""
    return B.predicted(spark, d).select("pred_id", r6(F.greatest(F.lit(0.0), F.col("s") - 2)).alias("seek"))


def timeline_rows(spark, d):
    """Timeline rows: predicted bars and labelled bands in one table."""
    p = B.predicted(spark, d).select("video_id", F.lit("predicted").alias("kind"), F.col("class").alias("class_name"), r6("s").alias("start_t"), r6(F.col("e") - F.col("s")).alias("length"))
    t = B.truth(spark, d).select("video_id", F.lit("truth").alias("kind"), F.col("class").alias("class_name"), r6("s").alias("start_t"), r6(F.col("e") - F.col("s")).alias("length"))
    return p.unionByName(t)


_SPELL = "CASE event_id % 8 WHEN 0 THEN 'traffic_accident' WHEN 1 THEN 'traffic_accident' WHEN 2 THEN 'fire' WHEN 3 THEN 'road_spill_or_debris' WHEN 4 THEN 'smoke' WHEN 5 THEN 'normal' WHEN 6 THEN 'normal' ELSE 'wrong_way_driving' END"
_TFP = B.ctes("frames", "truth", "pred")

ORACLES = {
    "semi_join": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "anti_join": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "lookup_join": "SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "full_diff": """WITH a AS (SELECT o_orderkey AS video_id, o_custkey % 3 AS level FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT l_orderkey AS video_id, max(l_suppkey) % 3 AS level FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
        SELECT coalesce(a.video_id, b.video_id) AS video_id, CASE WHEN b.video_id IS NULL THEN 'only in first' WHEN a.video_id IS NULL THEN 'only in second' ELSE 'level differs' END AS difference
        FROM a FULL JOIN b USING (video_id) WHERE a.video_id IS NULL OR b.video_id IS NULL OR a.level <> b.level""",
    "manifest_left": f"WITH {_TFP}, p AS (SELECT video_id, count(*) AS n FROM pred WHERE class = 'fire' GROUP BY 1) SELECT u.video_id, coalesce(n, 0) AS n, n IS NULL AS missing FROM (SELECT DISTINCT user_id AS video_id FROM events) u LEFT JOIN p USING (video_id)",
    "prediction_truth_join": f"WITH {_TFP} SELECT video_id, n_true, n_pred FROM (SELECT video_id, count(*) AS n_true FROM truth GROUP BY 1) JOIN (SELECT video_id, count(*) FILTER (WHERE class = 'fire') AS n_pred FROM pred GROUP BY 1) USING (video_id)",
    "range_join": f"WITH {_TFP} SELECT truth_id, count(*) AS frames FROM truth JOIN frames f ON f.video_id = truth.video_id AND f.t BETWEEN truth.s AND truth.e GROUP BY 1",
    "first_containing": f"WITH {_TFP}, x AS (SELECT f.event_id, p.pred_id, row_number() OVER (PARTITION BY f.event_id ORDER BY p.s, p.pred_id) AS n FROM frames f JOIN pred p ON p.video_id = f.video_id AND f.t BETWEEN p.s AND p.e) SELECT event_id, pred_id FROM x WHERE n = 1",
    "id_intersection": "SELECT c_custkey AS id FROM customer INTERSECT SELECT s_suppkey FROM supplier",
    "bag_union": "SELECT event_type, count(*) * CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS n FROM events GROUP BY 1",
    "keep_first": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
    "set_differences": """SELECT unnest(['stalled_or_broken_down_vehicle', 'vehicle_blocking_traffic', 'wrong_way_driving', 'road_spill_or_debris', 'waterlogging_or_flood', 'fire', 'fighting_or_violence', 'loitering_or_suspicious_presence']) AS class_name, 'missing' AS difference UNION ALL SELECT 'odd', 'extra'""",
    "ordered_union": "SELECT event_id, CASE WHEN event_type = 'view' THEN 'view,fire,smoke,x1,x2,x3' ELSE event_type || ',fire,smoke,view,x1,x2' END AS hints FROM events",
    "class_counts": f"WITH {B.ctes('verdicts')} SELECT class AS class_name, count(*) AS n FROM verdicts WHERE class <> 'smoke' GROUP BY 1",
    "strong_filter": f"WITH {B.ctes('verdicts')} SELECT video_id, count(*) FILTER (WHERE confidence >= 0.55) AS strong, count(*) AS n FROM verdicts GROUP BY 1 HAVING count(*) FILTER (WHERE confidence >= 0.55) > 0",
    "last_points": "SELECT video_id, n, event_id FROM (SELECT user_id AS video_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS n FROM events) WHERE n <= 5",
    "head": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "ordered_events": f"WITH {_TFP} SELECT video_id, string_agg(CAST(pred_id AS VARCHAR), ',' ORDER BY s, pred_id) AS events FROM pred GROUP BY 1",
    "duration_by_level": f"WITH {B.ctes('frames')}, u AS (SELECT video_id, max(t) + 1 AS duration FROM frames GROUP BY 1) SELECT CAST(video_id % 3 + 1 AS INT) AS level, count(*) AS videos, round(sum(duration), 6) AS duration FROM u GROUP BY 1",
    "run_totals": "SELECT count(*) AS runs, round(sum(o_totalprice), 2) AS total, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / greatest(sum(o_totalprice), 1e-9), 6) AS share_f, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders",
    "live_totals": f"WITH {B.ctes('frames')} SELECT count(*) AS frames_seen, count(*) FILTER (WHERE 1 - health > 0.5) AS frames_escalated, round(count(*) FILTER (WHERE 1 - health > 0.5) / greatest(count(*), 1), 6) AS escalation_rate FROM frames",
    "audit": "SELECT source AS root, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, count(DISTINCT lang) AS classes FROM documents GROUP BY 1",
    "download_page_sniff": "SELECT page_id FROM pages WHERE page_id % 3 = 0 AND strlen(html) + 43 < 2000000",
    "resume_list": "SELECT l_orderkey AS path, l_linenumber AS size FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity > 10 AND b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber)",
    "cache_check": "SELECT count(*) AS rows, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) = 0) AS bad_vectors, count(*) FILTER (WHERE label = 9) AS unknown_labels, count(*) >= 200 AND count(*) FILTER (WHERE label = 9) = 0 AS usable FROM embeddings",
    "duration_expr": "SELECT p_partkey, round(p_size * 100 / coalesce(nullif(CAST(p_size % 5 AS DOUBLE), 0), 25.0), 6) AS duration FROM part",
    "class_names": f"SELECT event_id, {_SPELL} AS class_name FROM events",
    "parsed_replies": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'traffic_accident' WHEN 1 THEN 'fire' WHEN 2 THEN 'traffic_congestion' ELSE 'normal' END AS class_name,
        CASE event_id % 4 WHEN 0 THEN round(value / (value + 50), 3) WHEN 1 THEN 1.0 WHEN 2 THEN 0.4 ELSE 0.0 END AS confidence,
        CASE event_id % 4 WHEN 0 THEN 'seen ' || event_id WHEN 1 THEN 'hot' WHEN 2 THEN 'There may be Traffic Congestion or smoke at ' || event_id ELSE 'nothing {here} ' || event_id END AS description FROM events""",
    "props_json": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "explanations": """SELECT p_partkey, nullif(substring(trim(concat_ws(' ', CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN repeat(p_name, 60) ELSE p_name END,
        CASE WHEN p_size % 3 = 0 THEN 'Also observed: road spill or debris, fire.' END)), 1, 500), '') AS explanation FROM part""",
    "timeline_bars": f"""WITH {_TFP}, c AS (SELECT pred_id, greatest(0, least(45, CAST(trunc(46 * s / 720) AS INT))) AS a, greatest(0, least(45, CAST(trunc(46 * e / 720) AS INT))) AS z FROM pred)
        SELECT pred_id, repeat('.', a) || repeat('o', greatest(a, z) - a + 1) || repeat('.', 45 - greatest(a, z)) AS bar FROM c""",
    "crop_boxes": """WITH b AS (SELECT p_partkey, (p_size * 9 + (p_partkey % 40 + 1) / 2.0) * 3.0 AS cx, (p_size * 5 + (p_partkey % 30 + 1) / 2.0) * 3.0 AS cy, greatest((p_partkey % 40 + 1) * 3.0 * 3.0, 320.0) / 2 AS hw, greatest((p_partkey % 30 + 1) * 3.0 * 3.0, 320.0) / 2 AS hh FROM part),
        c AS (SELECT p_partkey, CAST(trunc(greatest(0.0, cx - hw)) AS INT) AS x0, CAST(trunc(greatest(0.0, cy - hh)) AS INT) AS y0, CAST(trunc(least(1920.0, cx + hw)) AS INT) AS x1, CAST(trunc(least(1080.0, cy + hh)) AS INT) AS y1 FROM b)
        SELECT * FROM c WHERE x1 - x0 >= 32 AND y1 - y0 >= 32""",
    "prompt_circles": "SELECT p_partkey, CAST(p_size + floor((p_size + 7) / 2.0) AS INT) AS cx, CAST(p_size * 2 + floor(p_size * 3 / 2.0) AS INT) AS cy, greatest(18, CAST(trunc(0.6::DOUBLE * greatest(p_size + 7, p_size * 3)) AS INT)) AS r FROM part",
    "clip_points": """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS dur, CASE WHEN p_partkey % 2 = 0 THEN (p_size / 4.0 + p_size / 2.0) / 2 ELSE p_size / 2.0 END AS c, least(16.0, p_size) AS len FROM part),
        q AS (SELECT *, greatest(0.0, least(c - len / 2, dur - len)) AS lo FROM p), r AS (SELECT *, greatest(lo, least(dur, lo + len) - 0.001) AS hi FROM q)
        SELECT p_partkey, CAST(i AS INT) AS i, round(lo + (hi - lo) * i / 7, 6) AS t FROM r, range(0, 8) x(i) WHERE dur > 0""",
    "softmax": """WITH s AS (SELECT p_partkey, [p_size / 100.0, 0.2, (p_partkey % 10) / 20.0] AS s FROM part), e AS (SELECT p_partkey, list_transform(s, lambda x: exp((x - list_max(s)) * 100)) AS e FROM s)
        SELECT p_partkey, CAST(i AS INT) AS i, round(e[i + 1] / list_sum(e), 6) AS p FROM e, range(0, 3) x(i)""",
    "normalised_dot": "WITH z AS (SELECT embedding::DOUBLE[] AS z FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], z), 6) AS sim FROM embeddings, z",
    "file_stems": r"SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM pages",
    "gallery_time": f"""WITH {_TFP}, u AS (SELECT video_id, max(t) + 1 AS duration FROM frames GROUP BY 1), top AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY e - s DESC, s, pred_id) AS n FROM pred WHERE class = 'fire'),
        f AS (SELECT video_id, min(s) AS first FROM truth WHERE e - s >= 10 GROUP BY 1) SELECT u.video_id, round(coalesce((top.s + top.e) / 2, f.first, duration / 2), 6) AS t FROM u LEFT JOIN top ON top.video_id = u.video_id AND n = 1 LEFT JOIN f ON f.video_id = u.video_id""",
    "truth_from_csv": f"WITH {_TFP} SELECT DISTINCT CAST(video_id AS VARCHAR) AS video_id, 2 AS level, class <> 'normal' AS is_anomaly, class AS class_name, round(s, 3) AS start_time_sec, CASE WHEN class <> 'fire' THEN round(e, 3) END AS end_time_sec FROM pred",
    "manifest_round_trip": f"WITH {_TFP}, u AS (SELECT video_id, max(t) + 1 AS duration FROM frames GROUP BY 1) SELECT CAST(video_id AS VARCHAR) AS video_id, CASE WHEN duration > 700 THEN 1 ELSE 2 END AS level, CASE WHEN duration <= 710 THEN round(duration, 6) END AS duration_sec FROM u",
    "predictions_as_json": f"WITH {_TFP} SELECT video_id, pred_id, CASE WHEN class = 'fire' THEN class END AS class_name, class <> 'fire' AS kept FROM pred",
    "cache_round_trip": "SELECT count(*) AS rows, 0 AS bad_vectors, 0 AS unknown_labels, count(*) >= 200 AS usable FROM embeddings",
    "zip_ingest": """SELECT p_partkey, CAST(p_size AS INT) AS folder, p_name AS content, (SELECT count(*) FROM part WHERE p_partkey % 7 <> 0) AS written, (SELECT count(*) FROM part WHERE p_partkey % 7 = 0) AS outside,
        (SELECT count(*) FROM part WHERE p_partkey % 7 <> 0) AS present FROM part WHERE p_partkey % 7 <> 0""",
    "seek_time": f"WITH {_TFP} SELECT pred_id, round(greatest(0.0, s - 2), 6) AS seek FROM pred",
    "timeline_rows": f"""WITH {_TFP} SELECT video_id, 'predicted' AS kind, class AS class_name, round(s, 6) AS start_t, round(e - s, 6) AS length FROM pred UNION ALL SELECT video_id, 'truth', class, round(s, 6), round(e - s, 6) FROM truth""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
