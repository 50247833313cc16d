"""Readers of the file formats.

Readers give tables and never guess a schema; the rules of a format are
separate tables of violations (``*_faults``), empty for a valid input, so that
one pass over a large input finds all faults instead of the first.
``require_none`` turns faults into an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gallerist.sources import schemas


class InvalidInput(ValueError):
    """An input breaks the rules of its format."""


def require_none(faults: DataFrame) -> None:
    """Raise ``InvalidInput`` with examples if there are faults."""
    found = faults.limit(5).collect()
    if found:
        raise InvalidInput("; ".join(str(r.asDict()) for r in found))


def _fault(name: str, cond) -> F.Column:
    return F.when(cond, F.lit(name))


def _faults(df: DataFrame, key: str, checks: dict) -> DataFrame:
    found = F.array_compact(F.array(*[_fault(n, F.coalesce(c, F.lit(True))) for n, c in checks.items()]))
    return df.select(F.col(key).cast("string").alias("at"), F.explode(found).alias("fault"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation or research manifest (one JSON document per file) as entries
    ``(path, split, section, position, image, label, condition, ...)``."""
    doc = spark.read.schema(schemas.MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.input_file_name())
    g = doc.select("path", "split", F.lit("gallery").alias("section"), F.posexplode("gallery").alias("position", "e"))
    p = doc.select("path", "split", F.lit("probes").alias("section"), F.posexplode("probes").alias("position", "e"))
    cols = ["path", "split", "section", "position", "e.image", "e.label"]
    g = g.select(*cols, F.lit(None).cast("string").alias("condition"), "e.session_id", "e.subject_id")
    return g.unionByName(p.select(*cols, "e.condition", "e.session_id", "e.subject_id"))


def manifest_faults(entries: DataFrame) -> DataFrame:
    """Wrong split, missing picture, unlabelled gallery, nameless unknowns and
    pictures that occur twice."""
    twice = F.count("*").over(Window.partitionBy("path", "image")) > 1
    return _faults(entries.withColumn("twice", twice), "image", {
        "split": ~F.col("split").isin("validation", "test", "train"), "no image": F.col("image").isNull() | (F.trim("image") == ""),
        "gallery without label": (F.col("section") == "gallery") & F.col("label").isNull(), "unknown without subject": (F.col("section") == "probes") & F.col("label").isNull() & F.col("subject_id").isNull(), "twice": F.col("twice"),
    })


def pair_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Pair manifest as rows with the pair's position."""
    doc = spark.read.schema(schemas.PAIRS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select("split", F.posexplode("pairs").alias("pair_index", "p")).select("split", "pair_index", "p.*")


def pair_faults(pairs: DataFrame) -> DataFrame:
    """Self pairs, missing or contradictory truth, and pairs that occur twice
    in either order."""
    key = F.concat_ws("\x00", F.least("left_image", "right_image"), F.greatest("left_image", "right_image"))
    twice = F.count("*").over(Window.partitionBy("split", key)) > 1
    return _faults(pairs.withColumn("twice", twice), "pair_index", {
        "self pair": F.col("left_image") == F.col("right_image"), "no truth": F.col("genuine").isNull(),
        "contradiction": F.col("genuine") != (F.col("left_subject_id") == F.col("right_subject_id")), "twice": F.col("twice"),
    })


def video_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a video export (JSON lines, told apart by ``type``) with the
    video of the file on every row."""
    rows = spark.read.schema(schemas.VIDEO).option("mode", "FAILFAST").json(path).withColumn("path", F.input_file_name())
    name = rows.filter("type = 'metadata'").groupBy("path").agg(F.min("video").alias("_video"))
    return rows.join(F.broadcast(name), "path", "left").withColumn("video", F.coalesce("video", "_video")).drop("_video")


def video_faults(rows: DataFrame) -> DataFrame:
    """Order of frames and times, repeated tracks, unknown states, and the
    number of metadata and summary rows of each export."""
    frames = rows.filter("type = 'frame'")
    order = Window.partitionBy("video").orderBy("frame")
    states = ("known", "unknown", "confirming", "quality_rejected", "identity_conflict", "capacity")
    tracks = F.filter(F.transform("faces", lambda f: f["track_id"]), lambda t: t.isNotNull())
    late = F.col("timestamp") <= F.lag("timestamp").over(order)
    again = F.col("frame") == F.lag("frame").over(order)
    frames = frames.withColumn("late", F.coalesce(late, F.lit(False))).withColumn("again", F.coalesce(again, F.lit(False)))
    at = F.concat_ws("#", "video", "frame")
    found = _faults(frames.withColumn("at", at), "at", {
        "time": F.col("timestamp").isNull() | F.isnan("timestamp") | (F.col("timestamp") < 0) | F.col("late"), "frame twice": F.col("again"),
        "track twice": F.size(tracks) != F.size(F.array_distinct(tracks)), "state": F.exists("faces", lambda f: ~F.coalesce(f["state"].isin(*states), F.lit(False))),
        "box": F.exists("faces", lambda f: (F.size(f["box"]) != 4) | F.exists(f["box"], lambda v: v.isNull())),
    })
    ends = rows.groupBy("video").agg(F.count_if(F.col("type") == "metadata").alias("m"), F.count_if(F.col("type") == "summary").alias("s"))
    return found.unionByName(_faults(ends, "video", {"metadata": F.col("m") != 1, "summary": F.col("s") != 1}))


def video_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth boxes ``(split, frame, subject, label, box)``; a frame without
    faces gives one row without subject."""
    doc = spark.read.schema(schemas.TRUTH).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = doc.select("split", "session_id", F.explode("frames").alias("f")).select("split", "session_id", "f.frame", F.explode_outer("f.faces").alias("x"))
    return rows.select("split", "session_id", "frame", "x.subject", "x.label", "x.box")


def coverage_faults(frames: DataFrame, truth: DataFrame) -> DataFrame:
    """Frames that only one side has."""
    a, b = frames.select("frame").distinct(), truth.select("frame").distinct()
    return a.join(b, "frame", "left_anti").withColumn("fault", F.lit("no truth")).unionByName(b.join(a, "frame", "left_anti").withColumn("fault", F.lit("no export")))


def file_gallery(spark: SparkSession, path: str) -> DataFrame:
    """Templates of a JSON gallery, vectors inline."""
    doc = spark.read.schema(schemas.GALLERY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    people = doc.select("schema_version", "feature_signature", F.explode("people").alias("p"))
    rows = people.select("schema_version", "feature_signature", F.col("p.id").alias("person_id"), F.col("p.name").alias("name"), F.explode_outer("p.samples").alias("s"))
    return rows.select("schema_version", "feature_signature", "person_id", "name", F.col("s.id").alias("sample_id"), F.col("s.feature").alias("vector"), F.col("s.quality").alias("quality"), F.col("s.created_at").alias("created_at"))


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """Capture index (CSV with a fixed header)."""
    head = spark.read.text(path).limit(1).first()
    want = ",".join(c.split()[0] for c in schemas.CAPTURE.split(", "))
    if head is None or head["value"].lstrip("﻿").strip() != want:
        raise InvalidInput(f"header is not {want}")
    return spark.read.schema(schemas.CAPTURE).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def capture_faults(rows: DataFrame) -> DataFrame:
    """Ids, roles, consent and missing cells of a capture index."""
    empty = F.lit(False)
    for c in rows.columns:
        empty = empty | F.col(c).isNull() | (F.trim(c) == "")
    return _faults(rows, "image", {
        "missing cell": empty, "subject": ~F.col("subject_id").rlike("^[A-Za-z0-9_-]{1,64}$"), "role": ~F.col("role").isin("gallery", "known_probe", "unknown_probe"),
        "split": ~F.col("split").isin("train", "validation", "test"), "consent": F.col("consent_confirmed") != "yes", "gallery split": (F.col("role") == "gallery") & (F.col("split") == "test"),
    })


def photo_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Photo list: lines ``<file name> <0|1>``; the identity is what stands
    before the second ``@`` of the name, the photo between it and the last ``_``."""
    line = F.trim("value")
    rows = spark.read.text(path).filter(line != "").select(F.regexp_extract(line, r"^(\S+)\s+([01])$", 1).alias("file"), F.regexp_extract(line, r"^(\S+)\s+([01])$", 2).alias("flag"), F.col("value").alias("line"))
    stem = F.regexp_replace("file", r"\.[A-Za-z]+$", "")
    return rows.select("file", "flag", F.regexp_extract(stem, r"^([^@]+@[^@]+)@", 1).alias("identity"), F.regexp_extract(stem, r"^[^@]+@[^@]+@(.*)_[^_]*$", 1).alias("photo"), "line")


def photo_faults(rows: DataFrame) -> DataFrame:
    twice = F.count("*").over(Window.partitionBy("file")) > 1
    return _faults(rows.withColumn("twice", twice), "line", {"form": F.col("file") == "", "identity": F.col("identity") == "", "photo": F.col("photo") == "", "twice": F.col("twice")})


def track_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Track annotations: the first line is the number of frames, then one line
    ``index n (subject x y w h face confidence) * n`` for each."""
    rows = spark.read.text(path).withColumn("path", F.input_file_name()).select("path", F.split(F.trim("value"), r"\s+").alias("t")).filter(F.col("t")[0] != "")
    rows = rows.filter(F.size("t") > 1).select("path", F.col("t")[0].cast("int").alias("frame"), F.col("t")[1].cast("int").alias("n"), F.slice("t", 3, F.size("t")).alias("v"))
    item = F.explode_outer(F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.slice("v", (i * 7 + 1).cast("int"), F.lit(7)))))
    rows = rows.select("path", "frame", "n", F.size("v").alias("fields"), item.alias("d"))
    num = lambda i: F.element_at("d", i).cast("double")
    return rows.select("path", "frame", "n", "fields", F.element_at("d", 1).alias("subject"), F.array(num(2), num(3), num(4), num(5)).alias("box"), num(6).alias("face"), num(7).alias("confidence"))


def annotation_faults(spark: SparkSession, path: str) -> DataFrame:
    """Frame count, consecutive numbers, arity, and one subject once a frame."""
    rows = track_annotations(spark, path)
    heads = spark.read.text(path).withColumn("path", F.input_file_name()).filter(F.trim("value").rlike(r"^\d+$")).groupBy("path").agg(F.max(F.trim("value").cast("int")).alias("frames"))
    frames = rows.groupBy("path", "frame").agg(F.first("n").alias("n"), F.first("fields").alias("fields"), F.count("subject").alias("k"), F.countDistinct("subject").alias("u"))
    found = _faults(frames.withColumn("at", F.concat_ws("#", "path", "frame")), "at", {"arity": F.col("fields") != 7 * F.col("n"), "subject twice": F.col("k") != F.col("u")})
    ends = frames.groupBy("path").agg(F.count("*").alias("c"), F.max("frame").alias("top")).join(heads, "path", "left")
    return found.unionByName(_faults(ends, "path", {"frame count": F.col("frames") != F.col("c"), "not consecutive": F.col("top") != F.col("c") - 1}))


def annotation_inventory(rows: DataFrame) -> DataFrame:
    """Frames, faces, subjects and frames with several faces of each file."""
    frames = rows.groupBy("path", "frame").agg(F.count("subject").alias("k"))
    a = frames.groupBy("path").agg(F.count("*").alias("frames"), F.sum("k").alias("faces"), F.count_if(F.col("k") >= 2).alias("several"), F.max("k").alias("most"))
    return a.join(rows.groupBy("path").agg(F.countDistinct("subject").alias("subjects")), "path")


def located(spark: SparkSession, root: str, wanted: DataFrame, column: str = "file") -> DataFrame:
    """Paths below ``root`` of the wanted base names, with the number found."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.element_at(F.split("path", "/"), -1).alias("base"))
    return wanted.select(F.col(column).alias("base")).distinct().join(files, "base", "left").groupBy("base").agg(F.count("path").alias("found"), F.min("path").alias("path"))


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 and size of every file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def artifact_faults(spark: SparkSession, root: str, required: DataFrame) -> DataFrame:
    """Files of ``required(name, sha256)`` that are missing or changed, and
    files that it doesn't list."""
    have = file_digests(spark, root).select("name", F.col("sha256").alias("have"))
    both = required.select("name", F.col("sha256").alias("want")).join(have, "name", "full_outer")
    fault = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "not listed").when(F.col("have") != F.col("want"), "changed")
    return both.select("name", fault.alias("fault")).filter("fault IS NOT NULL")
