import json

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import sources
from tidemark.operators import metrics, submission


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Traffic-Accident", "traffic_accident"), (" wrong  way driving ", "wrong_way_driving"), ("roadspillordebris", "road_spill_or_debris"), ("__FIRE__", "fire"), ("", "normal"), (None, "normal"), ("cat", "normal")],
)
def test_resolve_class(spark, raw, want):
    assert one(spark, fn.resolve_class(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    ("text", "name", "confidence"),
    [
        ('{"class": "smoke", "confidence": 0.7, "description": "x"}', "smoke", 0.7),
        ('```json\n{"class": "Traffic-Accident", "confidence": 1.7}\n```', "traffic_accident", 1.0),
        ('{"class": "fire"}', "fire", 0.0),
        ('{"a": 1} and {"b": 2} fire', "fire", 0.4),
        ('{"class": "smoke"}, {"b": 2} fire', "fire", 0.4),
        ("I see traffic congestion and smoke", "traffic_congestion", 0.4),
        ("junk", "normal", 0.0),
        ('{"class": "fire", "confidence": "high"}', "fire", 0.4),
    ],
)
def test_parse_reply(spark, text, name, confidence):
    r = one(spark, fn.parse_reply(F.lit(text)))
    assert (r["class"], r["confidence"]) == (name, confidence)


def test_interval_iou(spark):
    assert one(spark, fn.interval_iou(*map(F.lit, (0.0, 2.0, 1.0, 3.0)))) == pytest.approx(1 / 3)
    assert one(spark, fn.interval_iou(*map(F.lit, (0.0, 1.0, 5.0, 6.0)))) == 0
    assert one(spark, fn.interval_iou(*map(F.lit, (1.0, 1.0, 1.0, 1.0)))) == 0


@pytest.mark.parametrize("n", [19, 20, 501])
def test_explanation_lengths(spark, n):
    assert len(one(spark, fn.explanation(F.lit("x" * n), F.array().cast("array<string>")))) == min(n, 500)
    assert one(spark, fn.explanation(F.lit(None).cast("string"), F.array().cast("array<string>"))) is None


def test_scores_of_the_published_rows(spark):
    s = spark.createDataFrame([(1, 7, 17, 2), (2, 2, 12, 0), (3, 0, 6, 6)], "level int, found int, total int, fa int")
    got = [(round(r["precision"], 2), round(r["recall"], 2)) for r in metrics.level_scores(s).orderBy("level").collect()]
    assert got == [(0.78, 0.41), (1.0, 0.17), (0.0, 0.0)]
    assert metrics.level_scores(s).where("level = 3").first()["marks"] >= 2.0


def test_manifest_forms_and_truth(spark, tmp_path):
    videos = [{"video_id": "a", "level": 1, "duration_sec": 5.0}, {"video_id": "b", "difficulty": 2, "duration_sec": 0}]
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": "1", "videos": videos}, indent=1))
    (tmp_path / "l.json").write_text(json.dumps(videos))
    for name in ("m.json", "l.json"):
        got = {r["video_id"]: (r["level"], r["duration_sec"]) for r in sources.read_manifest(spark, str(tmp_path / name)).collect()}
        assert got == {"a": (1, 5.0), "b": (2, None)}
    (tmp_path / "t.csv").write_text("video_id,level,is_anomaly,class_name,start_time_sec,end_time_sec,description_summary\na,2,TRUE,fire,1.5,x,d\na,2,true,fire,1.5,x,later\nb,1,false,normal,,,\n")
    t = sources.read_truth(spark, [str(tmp_path / "t.csv")]).orderBy("video_id").collect()
    assert [(r["video_id"], r["is_anomaly"], r["start_time_sec"], r["end_time_sec"], r["description_summary"]) for r in t] == [("a", True, 1.5, None, "d"), ("b", False, None, None, None)]


def test_roots_and_index(spark, tmp_path):
    for p in ("x/one/train/fire", "x/videos/two/test", "x/three/test"):
        (tmp_path / p).mkdir(parents=True)
    (tmp_path / "x/one/train/fire/v1.mp4").write_bytes(b"12")
    (tmp_path / "x/three/test/v1.mp4").write_bytes(b"123")
    roots = sources.find_roots([str(tmp_path)])
    assert [r.rsplit("/", 1)[1] for r in roots] == ["one", "three"]
    assert [r.removeprefix("file:") for r in sources.find_roots([str(tmp_path)], spark=spark)] == roots
    assert sources.find_roots([str(tmp_path)], max_depth=1) == [] and len(sources.find_roots([str(tmp_path)], max_depth=2)) == 2
    assert [(r["video_id"], r["length"]) for r in sources.video_index(spark, roots).collect()] == [("v1", 2)]


def test_levels_of_files_and_readiness(spark):
    index = spark.createDataFrame([("a", "/x/L1/a.mp4", 1), ("b", "/x/L3/deep/b.mp4", 1), ("c", "/x/c.mp4", 1), ("d", "/x/L2/d.mp4", 1)], "video_id string, path string, length long")
    manifest = spark.createDataFrame([("a", 2, 5.0), ("e", 1, 1.0)], "video_id string, level int, duration_sec double")
    assert {r["video_id"]: (r["level"], r["duration_sec"]) for r in sources.eval_index(index, manifest).collect()} == {"a": (2, 5.0), "b": (3, None), "c": (None, None), "d": (2, None)}
    audited = sources.audit(index.select(F.lit("r").alias("root"), F.lit("fire").alias("class_name"), "length"))
    none = spark.createDataFrame([("x", "extra")], "class_name string, difference string")
    missing = spark.createDataFrame([("fire", "missing")], "class_name string, difference string")
    said = [sources.data_ok(*args).first()["ok"] for args in ((audited, none, 1), (audited, missing, 1), (audited, none, 0), (audited.limit(0), none, 1), (audited, missing, 0, True), (audited.limit(0), none, 1, True))]
    assert said == [True, False, False, False, True, False]


def test_submission_document(spark, tmp_path):
    manifest = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "video_id string, level int")
    meta = "struct<frames_processed:bigint,chunks_processed:bigint,end_to_end_internal_time_ms:double>"
    answers = spark.createDataFrame([("a", None), ("b", (3, 1, 2.5))], f"video_id string, runtime_metadata {meta}")
    events = spark.createDataFrame([("b", 1.0, 2.0, "fire", 0.9, None)], "video_id string, start_time_sec double, end_time_sec double, class_name string, confidence double, explanation string")
    doc = submission.build(manifest, answers, events, "s1", "m")
    got = json.loads(doc.first()["document"])
    assert [p["video_id"] for p in got["predictions"]] == ["a", "b"]
    assert got["predictions"][1]["events"][0]["explanation"] is None and got["predictions"][0]["runtime_metadata"]["frames_processed"] == 0
    sources.write_document(doc, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        sources.write_document(doc, str(tmp_path / "out"))


def test_rounding_is_that_of_the_binary_value(spark):
    import random
    import struct

    r = random.Random(8)
    values = [0.575, 0.565, 1.025, 2.675, 0.125, 0.375, 1.005, 0.285, -0.575, -0.125, 0.0, 1e15 + 0.5, 4503599627370497.5, 1e300, 0.5, 1.5, 2.5]
    values += [r.randrange(10**6) / 1000 + 0.0005 for _ in range(3000)] + [r.randrange(1, 3000) / r.choice([8, 16, 40, 200, 240]) for _ in range(3000)]
    values += [x for x in (struct.unpack("d", r.randbytes(8))[0] for _ in range(500)) if x == x and abs(x) < 1e290]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (0, 1, 2, 3, 4):
        got = [row[0] for row in df.select(fn.rounded("x", places)).collect()]
        assert got == [round(v, places) for v in values]
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("nan"),)], "x double").select(fn.rounded("x", 2)).collect()
    assert odd[0][0] is None and odd[1][0] == float("inf") and odd[2][0] != odd[2][0]


def test_a_document_from_parts_is_the_document(spark, tmp_path):
    manifest = spark.range(500).select(F.concat(F.lit("vidéo-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("video_id"), F.lit(2).alias("level"))
    i = F.substring("video_id", -4, 4).cast("int")
    meta = "struct<frames_processed:bigint,chunks_processed:bigint,end_to_end_internal_time_ms:double>"
    answers = manifest.where(i % 7 != 0).select("video_id", F.when(i % 2 == 0, F.struct(i.cast("long").alias("frames_processed"), F.lit(1).cast("long").alias("chunks_processed"), F.lit(2.5).alias("end_to_end_internal_time_ms"))).cast(meta).alias("runtime_metadata"))
    events = manifest.where(i % 3 == 0).select("video_id", F.lit(None).cast("double").alias("start_time_sec"), F.lit(2.0).alias("end_time_sec"), F.lit("fire").alias("class_name"), (i / 500).alias("confidence"), F.lit('quote " and é').alias("explanation"))
    path = str(tmp_path / "s.json")
    with sources.setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        parts = submission.write(manifest, answers.repartition(7), events, "s1", "mödel", path)
    with open(path, encoding="utf-8") as f:
        assert f.read() == submission.build(manifest, answers, events, "s1", "mödel").first()["document"]
    assert parts["rows"] == 428 and len(parts["parts"]) > 1 and sum(p["rows"] for p in parts["parts"]) == 428
    assert [p.name for p in tmp_path.iterdir()] == ["s.json"]
    with pytest.raises(FileExistsError):
        submission.write(manifest, answers, events, "s1", "m", path)
    submission.write(manifest.limit(0), answers, events, "s1", "m", str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text())["predictions"] == []


def test_truth_of_many_files_is_one_scan_for_their_heads(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.csv").write_text("video_id,class_name\na,fire\n" + f"v{i},smoke\n" if i % 2 else "class_name, video_id,level\nfire,a,3\n" + f"smoke,w{i},x\n")
    (tmp_path / "z.csv").write_text("")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("heads", "heads")
    df = sources.read_truth(spark, [str(tmp_path / f"{i}.csv") for i in (1, 0, 2, 3, 4, 5)] + [str(tmp_path / "z.csv")])
    assert len(jobs.getJobIdsForGroup("heads")) <= 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {(r["video_id"], r["class_name"], r["level"], r["source_csv"][-5:]) for r in df.collect()}
    assert got == {("a", "fire", None, "1.csv")} | {(f"v{i}", "smoke", None, f"{i}.csv") for i in (1, 3, 5)} | {(f"w{i}", "smoke", None, f"{i}.csv") for i in (0, 2, 4)}
    assert sources.read_truth(spark, [str(tmp_path / "z.csv")]).count() == 0
    assert sources.stamped("out", "predictions", "r7") == "out/predictions_r7.json"
