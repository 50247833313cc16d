"""Ordered operators over analysed video frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "__unknown__"
#: Frame numbers of a video that are counted together.
STRETCH = 65_536
#: Fixed values of voting: frames in the window, least frames, least share.
WINDOW, LEAST, SHARE = 7, 4, 0.6


def frames_once(frames: DataFrame) -> DataFrame:
    """Frames without redelivered rows, with their ordinal in the video.

    A video is cut into stretches of frame numbers, so that a video with a
    large part of all rows is spread over many tasks: ordinals are counted
    inside a stretch and moved by the number of frames in the stretches
    before.  Later windows are over tracks, not whole videos.
    """
    known = frames.filter("video IS NOT NULL AND frame IS NOT NULL").withColumn("_stretch", F.floor(F.col("frame") / STRETCH))
    sizes = known.select("video", "_stretch", "frame").distinct().groupBy("video", "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("video").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("video", "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    one = known.repartition("video", "_stretch").dropDuplicates(["video", "_stretch", "frame"])
    one = one.withColumn("_at", F.row_number().over(Window.partitionBy("video", "_stretch").orderBy("frame")))
    return one.join(sizes, ["video", "_stretch"]).withColumn("ordinal", F.col("_at") + F.col("_before")).drop("_stretch", "_at", "_before")


def faces(frames: DataFrame) -> DataFrame:
    """One row per face of ``frames_once``."""
    rows = frames.select("video", "frame", "ordinal", F.col("timestamp").alias("ts"), "processing_ms", F.posexplode("faces").alias("idx", "f"))
    return rows.select(
        "video", "frame", "ordinal", "ts", "processing_ms", (F.col("idx") + 1).alias("idx"), "f.track_id", "f.state", "f.name", "f.person_id", "f.distance", "f.box",
        F.col("f.quality.accepted").alias("accepted"), F.col("f.quality.focus_score").alias("focus"), F.col("f.single_frame.state").alias("single_state"),
        F.col("f.single_frame.name").alias("single_name"), F.col("f.single_frame.distance").alias("single_distance"),
    )


def track_runs(tracked: DataFrame) -> DataFrame:
    """Number the unbroken runs of every track.

    A run ends when an analysed frame of the video misses the track; of
    several faces of a track in a frame the first counts.  A rejected frame
    breaks the run too and belongs to no run of votes (``vote`` is false).
    """
    one = tracked.filter("track_id IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("video", "track_id", "ordinal").orderBy("idx"))).filter("r = 1").drop("r")
    order = Window.partitionBy("video", "track_id").orderBy("ordinal")
    vote = F.coalesce(F.col("accepted"), F.lit(False)) & F.col("single_state").isin("known", "unknown")
    one = one.withColumn("vote", F.coalesce(vote, F.lit(False)))
    before = F.lag(F.struct("ordinal", "vote")).over(order)
    broken = before.isNull() | (before["ordinal"] != F.col("ordinal") - 1) | (before["vote"] != F.col("vote"))
    return one.withColumn("run", F.sum(broken.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def votes(runs: DataFrame) -> DataFrame:
    """Rolling majority over the last ``WINDOW`` votes of a run.

    A result is stable if there are ``LEAST`` votes, the newest key has
    ``SHARE`` of them and was also the one before; the representative distance
    is the one nearest to the median of the winner's (earliest on a tie).
    """
    rows = runs.filter("vote").withColumn("key", F.when(F.col("single_state") == "known", F.coalesce("single_name", F.lit(UNKNOWN))).otherwise(UNKNOWN))
    order = Window.partitionBy("video", "track_id", "run").orderBy("ordinal")
    seen = F.collect_list(F.struct("key", F.col("single_distance").alias("d"))).over(order.rowsBetween(-(WINDOW - 1), Window.currentRow))
    rows = rows.withColumn("seen", seen).withColumn("last_key", F.lag("key").over(order))
    mine = F.filter("seen", lambda x: x["key"] == F.col("key"))
    rows = rows.withColumn("n", F.size("seen")).withColumn("votes", F.size(mine)).withColumn("ds", F.filter(F.transform(mine, lambda x: x["d"]), lambda d: d.isNotNull()))
    stable = (F.col("n") >= LEAST) & (F.col("votes") / F.col("n") >= SHARE) & (F.col("last_key") == F.col("key"))
    rows = rows.withColumn("stable", F.coalesce(stable, F.lit(False)))
    s = F.array_sort("ds")
    k = F.size("ds")
    middle = F.when(k > 0, (F.element_at(s, F.floor((k + 1) / 2).cast("int")) + F.element_at(s, F.floor(k / 2).cast("int") + 1)) / 2)
    rows = rows.withColumn("middle", middle)
    best = F.array_min(F.transform("ds", lambda d, i: F.struct(F.round(F.abs(d - F.col("middle")), 12).alias("off"), i.alias("i"), d.alias("d"))))["d"]
    return rows.select("video", "track_id", "run", "frame", "ordinal", "ts", "key", "n", "votes", "stable", F.when(F.col("stable"), best).alias("distance"))


def greedy_pairs(cost: list[tuple]) -> list[tuple]:
    """One-to-one assignment: edges (cost, i, j) in order, each end once."""
    left, right, out = set(), set(), []
    for c, i, j in sorted(cost):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((c, i, j))
    return out


def box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of all boxes of ``a`` with all of ``b`` (x, y, w, h)."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, :2] + a[:, None, 2:], b[None, :, :2] + b[None, :, 2:])
    both = np.prod(np.maximum(hi - lo, 0), axis=2)
    union = np.prod(a[:, 2:], axis=1)[:, None] + np.prod(b[:, 2:], axis=1)[None, :] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def match_truth(predicted: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Greedy one-to-one matching of truth and detected boxes per frame.

    ``truth(video, frame, subject, box)`` and ``predicted(video, frame, idx,
    box)``; edges with an IoU of at least ``least`` are taken by falling IoU,
    then truth order, then detection order.  Returns ``(video, frame, subject,
    idx, iou)`` with a null idx for a truth box without a detection.
    """
    edges = predicted.select("video", "frame", "idx", F.col("box").alias("p")).withColumn("side", F.lit(1))
    both = truth.groupBy("video", "frame").agg(F.sort_array(F.collect_list(F.struct("subject", F.col("box").cast("array<double>").alias("box")))).alias("t"))
    found = edges.groupBy("video", "frame").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("p").cast("array<double>").alias("box")))).alias("p"))

    def run(batches):
        for pdf in batches:
            out = []
            for video, frame, t, p in zip(pdf["video"], pdf["frame"], pdf["t"], pdf["p"]):
                p = [] if p is None else list(p)
                iou = box_iou(np.array([x["box"] for x in t], float).reshape(len(t), 4), np.array([x["box"] for x in p], float).reshape(len(p), 4))
                got = {i: (j, -c) for c, i, j in greedy_pairs([(-iou[i, j], i, j) for i, j in np.argwhere(iou >= least)])}
                for i, x in enumerate(t):
                    j = got.get(i)
                    out.append((video, frame, x["subject"], None if j is None else int(p[j[0]]["idx"]), None if j is None else float(j[1])))
            yield pd.DataFrame(out, columns=["video", "frame", "subject", "idx", "iou"]).astype({"idx": "Int32"})

    return both.join(found, ["video", "frame"], "left").mapInPandas(run, "video string, frame int, subject string, idx int, iou double")


def suppress(boxes: DataFrame, limit: float = 0.35) -> DataFrame:
    """Non-maximum suppression per frame: by falling area (then ``idx``), a box
    stays if its IoU with every box kept so far is below ``limit``."""
    grouped = boxes.groupBy("video", "frame").agg(F.collect_list(F.struct("idx", F.col("box").cast("array<double>").alias("box"))).alias("b"))

    def run(batches):
        for pdf in batches:
            out = []
            for video, frame, b in zip(pdf["video"], pdf["frame"], pdf["b"]):
                rows = sorted(((-x["box"][2] * x["box"][3], x["idx"], np.array([x["box"]], float)) for x in b), key=lambda r: r[:2])
                kept: list = []
                for _, idx, box in rows:
                    if all(box_iou(box, k)[0, 0] < limit for k in kept):
                        kept.append(box)
                        out.append((video, frame, int(idx)))
            yield pd.DataFrame(out, columns=["video", "frame", "idx"])

    return grouped.mapInPandas(run, "video string, frame int, idx int")


def episodes(rows: DataFrame, key: list[str]) -> DataFrame:
    """Gaps and islands: number the runs of consecutive ordinals of each key."""
    order = Window.partitionBy(*key).orderBy("ordinal")
    return rows.withColumn("island", F.col("ordinal") - F.row_number().over(order))


def load_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").otherwise("2+")
