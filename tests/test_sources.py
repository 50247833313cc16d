import json

import pytest
from pyspark.sql import functions as F

from gallerist.sources import config, files, sinks
from gallerist.sources.synthetic import gallery as synthetic


def write(path, text):
    path.write_text(text if isinstance(text, str) else json.dumps(text), "utf-8")
    return str(path)


def test_manifest(spark, tmp_path):
    doc = {"split": "validation", "gallery": [{"image": "a.jpg", "label": "Ann"}, {"image": "b.jpg"}], "probes": [{"image": "a.jpg", "label": None, "subject_id": None}, {"image": "c.jpg", "label": "Ann", "condition": "mask"}]}
    rows = files.manifest(spark, write(tmp_path / "m.json", doc))
    assert rows.count() == 4
    assert sorted((r["at"], r["fault"]) for r in files.manifest_faults(rows).collect()) == [("a.jpg", "twice"), ("a.jpg", "twice"), ("a.jpg", "unknown without subject"), ("b.jpg", "gallery without label")]
    with pytest.raises(files.InvalidInput):
        files.require_none(files.manifest_faults(rows))


def test_pairs(spark, tmp_path):
    p = lambda a, b, g, s="x", t="y": {"left_image": a, "right_image": b, "left_subject_id": s, "right_subject_id": t, "genuine": g}
    rows = files.pair_manifest(spark, write(tmp_path / "p.json", {"split": "test", "pairs": [p("a", "b", False), p("b", "a", False), p("c", "c", True, "x", "x"), p("d", "e", True)]}))
    got = sorted((r["at"], r["fault"]) for r in files.pair_faults(rows).collect())
    assert got == [("0", "twice"), ("1", "twice"), ("2", "self pair"), ("3", "contradiction")]


def test_video(spark, tmp_path):
    face = {"track_id": 1, "box": [0, 0, 2, 2], "state": "known", "name": "Ann", "quality": {"accepted": True}, "single_frame": {"state": "known", "name": "Ann", "distance": 0.1}}
    lines = [{"type": "metadata", "schema": "v2", "video": "v", "every": 1}, {"type": "frame", "frame": 0, "timestamp": 0.0, "processing_ms": 1.0, "faces": [face, face]}, {"type": "frame", "frame": 1, "timestamp": 0.0, "processing_ms": 1.0, "faces": [{**face, "state": "odd"}]}]
    rows = files.video_export(spark, write(tmp_path / "v.jsonl", "\n".join(map(json.dumps, lines))))
    assert sorted((r["at"], r["fault"]) for r in files.video_faults(rows).collect()) == [("v", "summary"), ("v#0", "track twice"), ("v#1", "state"), ("v#1", "time")]
    truth = files.video_truth(spark, write(tmp_path / "t.json", {"split": "test", "frames": [{"frame": 0, "faces": []}, {"frame": 2, "faces": [{"subject": "s", "label": None, "box": [0, 0, 1, 1]}]}]}))
    assert truth.count() == 2
    assert sorted((r["frame"], r["fault"]) for r in files.coverage_faults(rows.filter("type = 'frame'"), truth).collect()) == [(1, "no truth"), (2, "no export")]


def test_capture(spark, tmp_path):
    head = "subject_id,role,split,condition,session_id,image,consent_confirmed,captured_at_utc"
    rows = files.capture_index(spark, write(tmp_path / "c.csv", f"{head}\ns1,gallery,validation,plain,k1,a.jpg,yes,2026\ns2,guest,test,,k1,b.jpg,no,2026\n"))
    assert sorted(r["fault"] for r in files.capture_faults(rows).collect()) == ["consent", "missing cell", "role"]
    with pytest.raises(files.InvalidInput):
        files.capture_index(spark, write(tmp_path / "d.csv", "x,y\n1,2\n"))


def test_text_formats(spark, tmp_path):
    rows = files.photo_metadata(spark, write(tmp_path / "p.txt", "7@N0@51_1.jpg 1\n7@N0@52_0.jpg 0\nbroken line\n"))
    assert sorted((r["identity"], r["photo"], r["flag"]) for r in rows.filter("file <> ''").collect()) == [("7@N0", "51", "1"), ("7@N0", "52", "0")]
    assert {r["fault"] for r in files.photo_faults(rows).collect()} == {"form", "identity", "photo"}
    good = write(tmp_path / "t.txt", "2\n0 1 s1 1 2 3 4 1 0.5\n1 0\n")
    assert [r["subject"] for r in files.track_annotations(spark, good).orderBy("frame").collect()] == ["s1", None]
    assert files.annotation_faults(spark, good).count() == 0
    assert files.annotation_inventory(files.track_annotations(spark, good)).first()["faces"] == 1
    bad = write(tmp_path / "u.txt", "5\n0 2 s1 1 2 3 4 1 0.5 s1 1 2 3 4 1 0.5\n2 1 s1 1 2\n")
    assert {r["fault"] for r in files.annotation_faults(spark, bad).collect()} == {"subject twice", "arity", "frame count", "not consecutive"}


def test_artifacts(spark, tmp_path):
    root = tmp_path / "r"
    with sinks.new_result_directory(root) as stage:
        (stage / "a.txt").write_text("a")
        (stage / "b.txt").write_text("b")
    with pytest.raises(FileExistsError), sinks.new_result_directory(root):
        pass
    with pytest.raises(RuntimeError), sinks.new_result_directory(tmp_path / "x"):
        raise RuntimeError
    assert not (tmp_path / "x").exists()
    want = files.file_digests(spark, str(root)).select("name", "sha256")
    assert files.artifact_faults(spark, str(root), want).count() == 0
    (root / "a.txt").write_text("z")
    (root / "c.txt").write_text("c")
    (root / "b.txt").unlink()
    assert sorted((r["name"], r["fault"]) for r in files.artifact_faults(spark, str(root), spark.createDataFrame([("a.txt", "0"), ("b.txt", "0")], "name string, sha256 string")).collect()) == [("a.txt", "changed"), ("b.txt", "missing"), ("c.txt", "not listed")]
    found = {r["base"]: r["found"] for r in files.located(spark, str(root), spark.createDataFrame([("a.txt",), ("q.txt",)], "file string")).collect()}
    assert found == {"a.txt": 1, "q.txt": 0}


def test_json_once_journal_and_log(spark, tmp_path):
    sinks.write_json_once(tmp_path / "a.json", {"x": 1})
    with pytest.raises(FileExistsError):
        sinks.write_json_once(tmp_path / "a.json", {"x": 2})
    with pytest.raises(ValueError):
        sinks.write_json_once(tmp_path / "b.json", float("nan"))
    with pytest.raises(ZeroDivisionError), sinks.Journal(tmp_path / "j") as j:
        j.mark("frozen")
        with pytest.raises(ValueError):
            j.mark("completed")
        1 / 0  # noqa: B018
    assert (tmp_path / "j" / "failed.json").exists()
    with pytest.raises(FileExistsError), sinks.Journal(tmp_path / "j"):
        pass
    df = spark.createDataFrame([("start", 1)], "event string, n int")
    sinks.log_events(df, str(tmp_path / "log"))
    sinks.log_events(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_csv(df, str(tmp_path / "csv"), ["n", "event"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["n", "event"]


def test_event_log_never_stops_the_caller(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    df = spark.createDataFrame([("start", 1)], "event string, n int")
    with pytest.warns(RuntimeWarning):
        assert sinks.log_events(df, str(tmp_path / "file" / "log")) is False
    assert sinks.log_events(df, str(tmp_path / "log")) is True


def test_journal_keeps_no_error_text(tmp_path):
    with pytest.raises(KeyError), sinks.Journal(tmp_path / "j"):
        raise KeyError("Ann Lee")
    assert "KeyError" in (tmp_path / "j" / "failed.json").read_text() and "Ann" not in (tmp_path / "j" / "failed.json").read_text()


def test_video_exports_round_trip(spark, data, tmp_path):
    exports, frames = (spark.read.parquet(f"{data}/video_{n}.parquet") for n in ("exports", "frames"))
    fine = frames.filter("timestamp >= 0 AND NOT isnan(timestamp) AND processing_ms >= 0")
    sinks.write_video_exports(exports, fine, str(tmp_path / "out"))
    rows = files.video_export(spark, str(tmp_path / "out" / "*"))
    kinds = {r["type"]: r["n"] for r in rows.groupBy("type").agg(F.count("*").alias("n")).collect()}
    videos = exports.select("video").distinct().count()
    assert kinds == {"metadata": videos, "summary": videos, "frame": fine.select("video", "frame").distinct().count()}
    assert rows.filter("type = 'summary'").agg(F.sum("analyzed_frames")).first()[0] == kinds["frame"]
    assert files.video_faults(rows).filter("fault IN ('metadata', 'summary', 'frame twice', 'state', 'box')").count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_video_exports(exports, fine, str(tmp_path / "out"))


def test_adding_rewrites_nothing(spark, tmp_path):
    g = sinks.Gallery(spark, str(tmp_path / "g"), "sig", 2)
    new = spark.createDataFrame([("Ann", [1.0, 0.0], None)], "name string, vector array<double>, quality string")
    g.add(new)
    before = g._folders(1)
    g.add(new)
    after = g._folders(2)
    assert all(after[n][: len(w)] == w for n, w in before.items()) and after["archives"] == before["archives"]
    assert g.read("samples").count() == 2 and g.read("samples", 1).count() == 1 and g.read("people").count() == 1


def test_gallery_store(spark, tmp_path):
    g = sinks.Gallery(spark, str(tmp_path / "g"), "sig", 2)
    new = spark.createDataFrame([(" Ann  Lee ", [1.0, 0.0], "{}"), ("ann lee", [0.0, 1.0], None), ("Weiß", [1.0, 1.0], None), ("WEISS", [1.0, 1.0], None)], "name string, vector array<double>, quality string")
    assert g.add(new) == 1 and g.revision == 1
    assert {r["name_key"]: r["n"] for r in g.scan().groupBy("name_key").agg(F.count("*").alias("n")).collect()} == {"ann lee": 2, "weiss": 2}
    with pytest.raises(ValueError):
        g.add(spark.createDataFrame([("Cy", [0.0, 0.0], None)], new.schema))
    assert g.revision == 1
    ann = g.read("people").filter("name_key = 'ann lee'").first()["id"]
    archive = g.archive(ann)
    assert g.scan().count() == 2 and g.read("people", 1).filter("active = 1").count() == 2
    g.add(spark.createDataFrame([("ANN LEE", [1.0, 0.5], None)], new.schema))
    with pytest.raises(ValueError):
        g.restore(archive)
    g.archive(g.read("people").filter("name_key = 'ann lee' AND active = 1").first()["id"])
    g.restore(archive)
    assert g.scan().count() == 4
    with pytest.raises(KeyError):
        g.restore(archive)
    with pytest.raises(ValueError):
        sinks.Gallery(spark, str(tmp_path / "g"), "other", 2)


def test_config(tmp_path):
    assert config.load_config(write(tmp_path / "c.json", {"recognition": {"margin": 0.1}})).recognition.margin == 0.1
    for bad in ({"x": 1}, {"recognition": {"margin": True}}, {"recognition": {"margin": 2}}, {"search": {"strategy": "odd"}}, {"recognition": {"vote_window": 3}}, {"recognition": {"vote_window": 3.5}}):
        with pytest.raises(ValueError):
            config.load_config(write(tmp_path / "c.json", bad))
    assert config.load_protocol(write(tmp_path / "p.json", {"budgets": [1, 2]})).budgets == (1, 2)
    with pytest.raises(ValueError):
        config.load_protocol(write(tmp_path / "p.json", {"primary": "first"}))


def test_synthetic(spark):
    rows = synthetic(spark, 10, (1, 2), 8, seed=1).collect()
    assert len(rows) == 15 and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-9 for r in rows)
    assert rows[3]["vector"] == synthetic(spark, 10, (1, 2), 8, seed=1).collect()[3]["vector"]
