"""Queries over the analysed frames of the video exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gallerist.functions import boxes as B
from gallerist.operators import video as V
from gallerist.plans.registry import query
from gallerist.storage import exact_quantiles, materialize

FRAMES = """
WITH fr AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY received_at) AS dup FROM video_frames) WHERE dup = 1)
"""
FACES = FRAMES + """,
x AS (SELECT video, frame, ordinal, "timestamp" AS ts, processing_ms, unnest(faces) AS f, generate_subscripts(faces, 1) AS idx FROM fr),
fc AS (SELECT video, frame, ordinal, ts, processing_ms, idx, f.track_id AS track_id, f.state AS state, f.name AS name, f.person_id AS person_id, f.distance AS distance, f.box AS box,
 f.quality.accepted AS accepted, f.quality.focus_score AS focus, f.single_frame.state AS single_state, f.single_frame.name AS single_name, f.single_frame.distance AS single_distance FROM x)
"""
RUNS = FACES + """,
o AS (SELECT *, coalesce(coalesce(accepted, false) AND single_state IN ('known', 'unknown'), false) AS vote FROM (SELECT *, row_number() OVER (PARTITION BY video, track_id, ordinal ORDER BY idx) AS r FROM fc WHERE track_id IS NOT NULL) WHERE r = 1),
b AS (SELECT *, CASE WHEN lag(ordinal) OVER w IS NULL OR lag(ordinal) OVER w <> ordinal - 1 OR lag(vote) OVER w <> vote THEN 1 ELSE 0 END AS brk FROM o WINDOW w AS (PARTITION BY video, track_id ORDER BY ordinal)),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY video, track_id ORDER BY ordinal) AS run FROM b)
"""


def frames(t):
    return V.frames_once(t("video_frames"))


def faces(t):
    return V.faces(frames(t))


@query("stable_votes", RUNS + """,
k AS (SELECT *, CASE WHEN single_state = 'known' THEN coalesce(single_name, '__unknown__') ELSE '__unknown__' END AS key FROM runs WHERE vote),
w AS (SELECT *, list({'k': key, 'd': single_distance}) OVER (PARTITION BY video, track_id, run ORDER BY ordinal ROWS 6 PRECEDING) AS seen, lag(key) OVER (PARTITION BY video, track_id, run ORDER BY ordinal) AS last_key FROM k),
c AS (SELECT *, len(seen) AS n, len(list_filter(seen, lambda e: e.k = key)) AS votes FROM w)
SELECT video, track_id, frame, key, n, votes, coalesce(n >= 4 AND votes / n >= 0.6 AND last_key = key, false) AS stable FROM c""")
def stable_votes(t):
    """Rolling vote of every track over its single-frame decisions."""
    return V.votes(V.track_runs(faces(t))).select("video", "track_id", "frame", "key", F.col("n").cast("bigint").alias("n"), F.col("votes").cast("bigint").alias("votes"), "stable")


@query("vote_outcomes", RUNS + """,
k AS (SELECT *, CASE WHEN single_state = 'known' THEN coalesce(single_name, '__unknown__') ELSE '__unknown__' END AS key FROM runs WHERE vote),
w AS (SELECT *, list({'k': key, 'd': single_distance}) OVER (PARTITION BY video, track_id, run ORDER BY ordinal ROWS 6 PRECEDING) AS seen, lag(key) OVER (PARTITION BY video, track_id, run ORDER BY ordinal) AS last_key FROM k),
c AS (SELECT *, list_filter(list_transform(list_filter(seen, lambda e: e.k = key), lambda e: e.d), lambda d: d IS NOT NULL) AS ds, coalesce(len(seen) >= 4 AND len(list_filter(seen, lambda e: e.k = key)) / len(seen) >= 0.6 AND last_key = key, false) AS stable FROM w),
m AS (SELECT *, list_aggregate(ds, 'median') AS middle FROM c), off AS (SELECT *, list_transform(ds, lambda d: round(abs(d - middle), 12)) AS off FROM m)
SELECT video, count(*) AS votes, count(*) FILTER (WHERE stable) AS stable, count(*) FILTER (WHERE stable AND key <> '__unknown__') AS stable_known, round(avg(CASE WHEN stable THEN ds[list_position(off, list_min(off))] END), 6) AS mean_distance FROM off GROUP BY 1""")
def vote_outcomes(t):
    """Per video: stable frames by outcome and the mean representative distance."""
    v = V.votes(V.track_runs(faces(t)))
    return v.groupBy("video").agg(F.count("*").alias("votes"), F.count_if("stable").alias("stable"), F.count_if(F.col("stable") & (F.col("key") != V.UNKNOWN)).alias("stable_known"), F.round(F.avg("distance"), 6).alias("mean_distance"))


@query("track_lengths", RUNS + "SELECT video, track_id, count(*) AS faces, count(DISTINCT run) AS runs, min(frame) AS first_frame, max(frame) AS last_frame FROM runs GROUP BY 1, 2")
def track_lengths(t):
    return V.track_runs(faces(t)).groupBy("video", "track_id").agg(F.count("*").alias("faces"), F.countDistinct("run").alias("runs"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query("state_counts", FACES + "SELECT state, single_state, count(*) AS faces FROM fc GROUP BY 1, 2")
def state_counts(t):
    return faces(t).groupBy("state", "single_state").agg(F.count("*").alias("faces"))


@query("state_map", FACES + ", s AS (SELECT video, state, count(*) AS n FROM fc GROUP BY 1, 2) SELECT video, string_agg(state || '=' || n, ',' ORDER BY state) AS states FROM s GROUP BY 1")
def state_map(t):
    """Counts of the states of each video as one sorted map."""
    s = faces(t).groupBy("video", "state").agg(F.count("*").alias("n"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("state", "n"))), lambda x: F.concat_ws("=", x["state"], x["n"]))
    return s.groupBy("video").agg(F.array_join(pairs, ",").alias("states"))


@query("output_changes", RUNS + """,
l AS (SELECT *, lag(state) OVER w AS ps, lag(name) OVER w AS pn, lag(ordinal) OVER w AS po, lag(track_id) OVER w AS pt FROM o WINDOW w AS (PARTITION BY video, track_id ORDER BY ordinal))
SELECT video, count(*) FILTER (WHERE po IS NOT NULL AND (ps IS DISTINCT FROM state OR pn IS DISTINCT FROM name)) AS output_changes,
 count(*) FILTER (WHERE ps IN ('known', 'unknown') AND state IN ('known', 'unknown') AND pn IS DISTINCT FROM name AND po = ordinal - 1) AS label_changes FROM l GROUP BY 1""")
def output_changes(t):
    """Changes of the shown output, and of the recognised name in an unbroken
    run, along every track."""
    order = Window.partitionBy("video", "track_id").orderBy("ordinal")
    prev = F.lag(F.struct("state", "name", "ordinal")).over(order)
    rows = V.track_runs(faces(t)).withColumn("p", prev)
    changed = F.col("p").isNotNull() & ~(F.col("p.state").eqNullSafe(F.col("state")) & F.col("p.name").eqNullSafe(F.col("name")))
    seen = F.col("p.state").isin("known", "unknown") & F.col("state").isin("known", "unknown") & ~F.col("p.name").eqNullSafe(F.col("name")) & (F.col("p.ordinal") == F.col("ordinal") - 1)
    return rows.groupBy("video").agg(F.count_if(changed).alias("output_changes"), F.count_if(F.coalesce(seen, F.lit(False))).alias("label_changes"))


@query("distinct_until_changed", RUNS + """,
l AS (SELECT *, lag(state) OVER w AS ps, lag(person_id) OVER w AS pp, row_number() OVER w AS rn FROM o WINDOW w AS (PARTITION BY video, track_id ORDER BY ordinal))
SELECT video, track_id, frame, state, person_id FROM l WHERE rn = 1 OR ps IS DISTINCT FROM state OR pp IS DISTINCT FROM person_id""")
def distinct_until_changed(t):
    """The first output of every track, and each one unlike the one before."""
    order = Window.partitionBy("video", "track_id").orderBy("ordinal")
    prev = F.lag(F.struct("state", "person_id")).over(order)
    rows = V.track_runs(faces(t)).withColumn("p", prev)
    new = F.col("p").isNull() | ~F.col("p.state").eqNullSafe(F.col("state")) | ~F.col("p.person_id").eqNullSafe(F.col("person_id"))
    return rows.filter(new).select("video", "track_id", "frame", "state", "person_id")


@query("person_episodes", FACES + """,
p AS (SELECT DISTINCT video, person_id, ordinal, ts FROM fc WHERE person_id IS NOT NULL),
g AS (SELECT video, person_id, ordinal, min(ts) AS ts FROM p GROUP BY 1, 2, 3),
i AS (SELECT *, ordinal - row_number() OVER (PARTITION BY video, person_id ORDER BY ordinal) AS island FROM g)
SELECT video, person_id, min(ordinal) AS first_ordinal, count(*) AS frames FROM i GROUP BY video, person_id, island""")
def person_episodes(t):
    """Unbroken appearances of a recognised person in a video."""
    rows = faces(t).filter("person_id IS NOT NULL").groupBy("video", "person_id", "ordinal").agg(F.min("ts").alias("ts"))
    e = V.episodes(rows, ["video", "person_id"])
    return e.groupBy("video", "person_id", "island").agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("frames")).drop("island")


@query("confirmation_delay", FACES + """,
g AS (SELECT video, track_id, ordinal, min(CASE WHEN isfinite(ts) AND ts >= 0 THEN ts END) AS ts, max((state = 'known')::INT) AS known FROM fc WHERE track_id IS NOT NULL GROUP BY 1, 2, 3),
i AS (SELECT *, ordinal - row_number() OVER (PARTITION BY video, track_id ORDER BY ordinal) AS island FROM g)
SELECT video, track_id, min(ordinal) AS first_ordinal, count(*) AS frames, sum(known)::BIGINT AS known_frames, round(min(CASE WHEN known = 1 THEN ts END) - min(ts), 6) AS delay FROM i GROUP BY video, track_id, island""")
def confirmation_delay(t):
    """Seconds from the start of an appearance to its first confirmed name."""
    ts = F.when((F.col("ts") >= 0) & ~F.isnan("ts") & (F.col("ts") < float("inf")), F.col("ts"))
    rows = faces(t).filter("track_id IS NOT NULL").groupBy("video", "track_id", "ordinal").agg(F.min(ts).alias("ts"), F.max((F.col("state") == "known").cast("int")).alias("known"))
    e = V.episodes(rows, ["video", "track_id"])
    return e.groupBy("video", "track_id", "island").agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("frames"), F.sum("known").alias("known_frames"), F.round(F.min(F.when(F.col("known") == 1, F.col("ts"))) - F.min("ts"), 6).alias("delay")).drop("island")


@query("scene_counts", FRAMES + "SELECT video, count(*) AS frames, count(*) FILTER (WHERE len(faces) >= 2) AS several_faces, max(coalesce(len(faces), 0)) AS most_faces FROM fr GROUP BY 1")
def scene_counts(t):
    n = F.coalesce(F.size("faces"), F.lit(0))
    return frames(t).groupBy("video").agg(F.count("*").alias("frames"), F.count_if(n >= 2).alias("several_faces"), F.max(n).cast("bigint").alias("most_faces"))


@query("timing_by_load", FRAMES + """,
m AS (SELECT CASE WHEN coalesce(len(faces), 0) = 0 THEN '0' WHEN len(faces) = 1 THEN '1' ELSE '2+' END AS load, processing_ms AS ms FROM fr WHERE processing_ms >= 0 AND NOT isnan(processing_ms)),
a AS (SELECT * FROM m UNION ALL SELECT 'all', ms FROM m)
SELECT load, count(*) AS frames, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(count(*) * 1000 / sum(ms), 3) AS fps FROM a GROUP BY 1""")
def timing_by_load(t):
    """Latency and throughput by the number of faces in a frame, and overall."""
    m = frames(t).filter("processing_ms >= 0 AND NOT isnan(processing_ms)").select(V.load_bucket(F.greatest(F.coalesce(F.size("faces"), F.lit(0)), F.lit(0))).alias("load"), F.col("processing_ms").alias("ms"))
    m = m.select(F.explode(F.array("load", F.lit("all"))).alias("load"), "ms")
    m = materialize(m, "timings")
    q = exact_quantiles(m, "ms", (0.5, 0.95), ["load"]).select("load", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p95"))
    return m.groupBy("load").agg(F.count("*").alias("frames"), F.round(F.count("*") * 1000 / F.sum("ms"), 3).alias("fps")).join(q, "load").select("load", "frames", "p50", "p95", "fps")


@query("frame_order_faults", FRAMES + """,
l AS (SELECT *, lag("timestamp") OVER (PARTITION BY video ORDER BY frame) AS pt FROM fr)
SELECT video, count(*) FILTER (WHERE "timestamp" IS NULL OR isnan("timestamp") OR "timestamp" < 0) AS no_time, count(*) FILTER (WHERE pt IS NOT NULL AND NOT isnan(pt) AND NOT isnan("timestamp") AND "timestamp" <= pt) AS backwards,
 count(*) FILTER (WHERE processing_ms IS NULL OR isnan(processing_ms) OR processing_ms < 0) AS no_timing FROM l GROUP BY 1""")
def frame_order_faults(t):
    """Frames without time, with a time not after the one before, or without
    timing: the checks of a video export as counts."""
    pt = F.lag("timestamp").over(Window.partitionBy("video").orderBy("frame"))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0)
    rows = frames(t).withColumn("pt", pt)
    back = F.col("pt").isNotNull() & ~F.isnan("pt") & ~F.isnan("timestamp") & (F.col("timestamp") <= F.col("pt"))
    return rows.groupBy("video").agg(F.count_if(bad("timestamp")).alias("no_time"), F.count_if(F.coalesce(back, F.lit(False))).alias("backwards"), F.count_if(bad("processing_ms")).alias("no_timing"))


@query("sampling_faults", FRAMES + ", e AS (SELECT video, min(every) AS every FROM video_exports GROUP BY 1) SELECT fr.video, count(*) AS frames, count(*) FILTER (WHERE fr.frame % e.every <> 0) AS off_grid FROM fr JOIN e ON e.video = fr.video GROUP BY 1")
def sampling_faults(t):
    """Frames that are not on the sampling grid of their export."""
    e = t("video_exports").groupBy("video").agg(F.min("every").alias("every"))
    return frames(t).join(e, "video").groupBy("video").agg(F.count("*").alias("frames"), F.count_if(F.col("frame") % F.col("every") != 0).alias("off_grid"))


@query("duplicate_tracks", FACES + "SELECT video, frame, track_id, count(*) AS faces FROM fc WHERE track_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_tracks(t):
    """Tracks that are given to several faces of one frame (an assertion)."""
    return faces(t).filter("track_id IS NOT NULL").groupBy("video", "frame", "track_id").agg(F.count("*").alias("faces")).filter("faces > 1")


@query("identity_conflicts", FACES + "SELECT video, frame, person_id, count(*) AS faces FROM fc WHERE state = 'known' AND person_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1")
def identity_conflicts(t):
    """Several faces of one frame confirmed as the same person."""
    return faces(t).filter("state = 'known' AND person_id IS NOT NULL").groupBy("video", "frame", "person_id").agg(F.count("*").alias("faces")).filter("faces > 1")


@query("videos_without_export", "SELECT DISTINCT video FROM video_frames f WHERE NOT EXISTS (SELECT 1 FROM video_exports e WHERE e.video = f.video) UNION SELECT DISTINCT video FROM video_exports e WHERE NOT EXISTS (SELECT 1 FROM video_frames f WHERE f.video = e.video)")
def videos_without_export(t):
    """Coverage: videos that only one of the two tables knows."""
    a, b = t("video_frames").select("video"), t("video_exports").select("video")
    return a.join(b, "video", "left_anti").union(b.join(a, "video", "left_anti")).distinct()


@query("largest_face", FACES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY box[3] * box[4] DESC, idx) AS r FROM fc)
SELECT video, frame, idx, box[3] * box[4] AS area FROM r WHERE r = 1""")
def largest_face(t):
    """The largest box of every frame; the first one on a tie."""
    rows = faces(t).select("video", "frame", F.col("idx").cast("bigint").alias("idx"), (F.element_at("box", 3) * F.element_at("box", 4)).alias("area"))
    best = F.max_by(F.struct("idx", "area"), F.struct(F.col("area"), -F.col("idx")))
    return rows.groupBy("video", "frame").agg(best.alias("b")).select("video", "frame", "b.idx", "b.area")


EDGES = FACES + """,
q AS (SELECT video, ordinal, idx, track_id, box, single_distance AS d FROM fc),
e AS (SELECT a.video, a.ordinal, a.idx AS i, b.idx AS j, b.d AS d, a.box AS p, b.box AS q FROM q a JOIN q b ON b.video = a.video AND b.ordinal = a.ordinal + 1),
g AS (SELECT *, greatest(0, least(p[1] + p[3], q[1] + q[3]) - greatest(p[1], q[1])) * greatest(0, least(p[2] + p[4], q[2] + q[4]) - greatest(p[2], q[2])) AS inter FROM e),
u AS (SELECT *, CASE WHEN p[3] * p[4] + q[3] * q[4] - inter > 0 THEN inter / (p[3] * p[4] + q[3] * q[4] - inter) ELSE 0 END AS iou,
 sqrt(pow((p[1] + p[3] / 2.0) - (q[1] + q[3] / 2.0), 2) + pow((p[2] + p[4] / 2.0) - (q[2] + q[4] / 2.0), 2)) / greatest(sqrt(p[3] * p[3] + p[4] * p[4]), sqrt(q[3] * q[3] + q[4] * q[4]), 1) AS centre FROM g)
"""


@query("association_edges", EDGES + """, c AS (SELECT video, ordinal, i, j, round(iou, 6) AS iou, round(CASE WHEN centre > 1.5 THEN NULL WHEN d IS NOT NULL AND d <= 0.25 THEN 0.75 * d + 0.25 * (1 - iou) / 2 WHEN d IS NULL AND iou >= 0.3 THEN (1 - iou) / 2 END, 6) AS cost FROM u)
SELECT * FROM c WHERE cost IS NOT NULL""")
def association_edges(t):
    """Every link between faces of consecutive frames that the rule of
    association allows, with or without an overlap.  The exports hold no
    features, so the later face's distance to the gallery stands in for the
    distance of the two faces."""
    return face_pairs(t).filter("cost IS NOT NULL")


def face_pairs(t):
    q = faces(t).select("video", "ordinal", F.col("idx").cast("bigint").alias("idx"), "box", F.col("single_distance").alias("d"))
    a, b = q.alias("a"), q.withColumn("ordinal", F.col("ordinal") - 1).alias("b")
    e = a.join(b, (F.col("a.video") == F.col("b.video")) & (F.col("a.ordinal") == F.col("b.ordinal")))
    p, r = B.box_of(F.col("a.box")), B.box_of(F.col("b.box"))
    return e.select("a.video", F.col("a.ordinal").cast("bigint").alias("ordinal"), F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), F.round(B.iou(p, r), 6).alias("iou"), F.round(B.association_cost(p, r, F.col("b.d")), 6).alias("cost"))


@query("continuity", RUNS + """,
l AS (SELECT *, lag(ts) OVER w AS pt, lag(box) OVER w AS p, lag(single_distance) OVER w AS pd FROM o WINDOW w AS (PARTITION BY video, track_id ORDER BY ordinal)),
g AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(0, least(p[1] + p[3], box[1] + box[3]) - greatest(p[1], box[1])) * greatest(0, least(p[2] + p[4], box[2] + box[4]) - greatest(p[2], box[2])) END AS inter FROM l)
SELECT video, track_id, frame, coalesce(ts - pt <= 0.9 AND ts - pt > 0 AND CASE WHEN p[3] * p[4] + box[3] * box[4] - inter > 0 THEN inter / (p[3] * p[4] + box[3] * box[4] - inter) ELSE 0 END >= 0.25, false) AS continues FROM g""")
def continuity(t):
    """Does a face continue the one before it on its track: within 0.9 seconds
    and with an overlap of at least a quarter."""
    order = Window.partitionBy("video", "track_id").orderBy("ordinal")
    rows = V.track_runs(faces(t)).withColumn("p", F.lag(F.struct("ts", "box")).over(order))
    gap = F.col("ts") - F.col("p.ts")
    over = B.iou(B.box_of(F.col("p.box")), B.box_of(F.col("box")))
    return rows.select("video", "track_id", "frame", F.coalesce((gap <= 0.9) & (gap > 0) & (over >= 0.25), F.lit(False)).alias("continues"))


IOU = "(greatest(0, least({a}[1] + {a}[3], {b}[1] + {b}[3]) - greatest({a}[1], {b}[1])) * greatest(0, least({a}[2] + {a}[4], {b}[2] + {b}[4]) - greatest({a}[2], {b}[2])))"
IOU = "coalesce(" + IOU + "::DOUBLE / nullif({a}[3] * {a}[4] + {b}[3] * {b}[4] - " + IOU + ", 0), 0)"


@query("suppressed_boxes", FACES.replace("WITH fr", "WITH RECURSIVE fr") + f""", b AS (SELECT video, frame, idx::INT AS idx, box, row_number() OVER (PARTITION BY video, frame ORDER BY box[3] * box[4] DESC, idx) AS rn FROM fc),
s AS (SELECT video, frame, rn, idx, true AS keep, [box] AS kept FROM b WHERE rn = 1 UNION ALL
 SELECT video, frame, rn, idx, ok, CASE WHEN ok THEN list_append(kept, box) ELSE kept END FROM (SELECT b.video, b.frame, b.rn, b.idx, b.box, s.kept, len(list_filter(s.kept, lambda k: {IOU.format(a='k', b='b.box')} >= 0.35)) = 0 AS ok FROM s JOIN b ON b.video = s.video AND b.frame = s.frame AND b.rn = s.rn + 1))
SELECT video, frame, idx FROM s WHERE keep""")
def suppressed_boxes(t):
    """Boxes that survive non-maximum suppression."""
    return V.suppress(faces(t).select("video", "frame", "idx", "box"))


@query("tracked_faces", None)
def tracked_faces(t):
    """Tracks rebuilt from boxes and single-frame decisions by the stateful
    tracker, as a batch replay of every video."""
    from gallerist.streaming.tracking import replay

    return replay(frames(t))


@query("recognition_records", FACES + "SELECT video, frame, idx, state, round(distance, 3) AS distance, round(100 * (1 - distance), 3) AS similarity FROM fc WHERE state = 'known'")
def recognition_records(t):
    """Rounded output record of every confirmed face."""
    f = faces(t).filter("state = 'known'")
    return f.select("video", "frame", F.col("idx").cast("bigint").alias("idx"), "state", F.round("distance", 3).alias("distance"), F.round(100 * (1 - F.col("distance")), 3).alias("similarity"))


@query("export_summaries", "SELECT engine, count(*) AS videos, count(fps) AS with_fps, round(avg(coalesce(fps, 25.0)), 6) AS mean_fps, min(threshold) AS least_threshold, max(margin) AS most_margin FROM (SELECT DISTINCT * FROM video_exports) GROUP BY 1")
def export_summaries(t):
    """Exports by engine; a missing frame rate counts as 25."""
    e = t("video_exports").distinct()
    return e.groupBy("engine").agg(F.count("*").alias("videos"), F.count("fps").alias("with_fps"), F.round(F.avg(F.coalesce("fps", F.lit(25.0))), 6).alias("mean_fps"), F.min("threshold").alias("least_threshold"), F.max("margin").alias("most_margin"))
