"""Equivalence of implementations, paired comparisons, episodes and subjects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gallerist.functions import stats as S
from gallerist.functions import vectors as V
from gallerist.operators import search
from gallerist.operators import video as VO
from gallerist.operators.evaluation import count_if
from gallerist.plans.evaluation import RECORDS, records, wilson
from gallerist.plans.recognition import BASE, gallery, probes
from gallerist.plans.registry import query
from gallerist.plans.video import FACES, IOU, RUNS, faces

HALF = "least(1.0, greatest(0.0, (1 - list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b}))) / 2))"


@query("scalar_batched_difference", BASE + "SELECT 0::BIGINT AS different, count(*) AS compared FROM (SELECT DISTINCT probe, identity FROM r)")
def scalar_batched_difference(t):
    """Scores of every probe and identity by column expressions, template after
    template, against the blocked matrix products: the number of scores that
    differ by more than 1e-9 (none), and of those compared."""
    both = search.identity_scores(probes(t), gallery(t)).join(search.scalar_scores(probes(t), gallery(t)), ["probe", "identity"])
    return both.agg(count_if(F.abs(F.col("score") - F.col("scalar")) > 1e-9).alias("different"), F.count("*").alias("compared"))


@query("nearest_templates", BASE + "SELECT probe, identity, template, round(d, 6) AS distance, rn AS place FROM r WHERE rn <= 3")
def nearest_templates(t):
    """The three nearest templates of every identity for every probe."""
    n = search.nearest_per_identity(probes(t), gallery(t), 3)
    return n.select("probe", "identity", "template", F.round("distance", 6).alias("distance"), F.col("place").cast("bigint").alias("place"))


@query("chi_square_neighbours", """WITH h AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS v FROM embeddings), p AS (SELECT a.vec_id AS probe, b.vec_id AS other, list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2) / (z[1] + z[2] + 1e-10))) / 2 / 64 AS d FROM h a JOIN h b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT probe, round(min(d), 6) AS least, round(avg(d), 6) AS mean FROM p GROUP BY 1""")
def chi_square_neighbours(t):
    """Chi-square distances of the stated probes to the rows of their label."""
    h = t("embeddings").select("vec_id", "label", F.transform(V.wide(F.col("embedding")), lambda x: F.abs(x)).alias("v"))
    a, b = h.filter("vec_id % 20 = 0").alias("a"), h.alias("b")
    d = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") != F.col("b.vec_id"))).select(F.col("a.vec_id").alias("probe"), V.chi_square(F.col("a.v"), F.col("b.v"), 64).alias("d"))
    return d.groupBy("probe").agg(F.round(F.min("d"), 6).alias("least"), F.round(F.avg("d"), 6).alias("mean"))


@query("impostor_pairs", """WITH c AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings), k AS (SELECT * FROM c WHERE r <= 10),
p AS (SELECT """ + HALF.format(a="a.v", b="b.v") + """ AS d FROM k a JOIN k b ON a.label < b.label) SELECT count(*) AS pairs, round(min(d), 6) AS least, round(avg(d), 6) AS mean, round(max(d), 6) AS most FROM p""")
def impostor_pairs(t):
    """Distances between different people, the first ten templates of each: the
    cap is the feature, and the pairs come from blocked search."""
    r = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    k = t("embeddings").select("label", "vec_id", F.col("embedding").alias("vector"), r.alias("r")).filter("r <= 10")
    d = search.identity_scores(k.select(F.col("vec_id").alias("probe"), "vector"), k.select(F.col("vec_id").alias("identity"), F.col("vec_id").alias("template"), "vector"), (("nearest", 1),))
    a, b = k.select(F.col("vec_id").alias("probe"), F.col("label").alias("la")), k.select(F.col("vec_id").alias("identity"), F.col("label").alias("lb"))
    p = d.join(a, "probe").join(b, "identity").filter("la < lb")
    return p.agg(F.count("*").alias("pairs"), F.round(F.min("score"), 6).alias("least"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("most"))


@query("wilson_table", "WITH c AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE embedding[1] > 0) AS k FROM embeddings GROUP BY 1) SELECT label, k, n, " + wilson("positive", "k", "n") + " FROM c")
def wilson_table(t):
    """Proportion with its 95 % interval, per label."""
    c = t("embeddings").groupBy("label").agg(F.count("*").alias("n"), count_if(F.col("embedding")[0] > 0).alias("k"))
    k, n = F.col("k"), F.col("n")
    return c.select("label", "k", "n", F.round(S.rate(k, n), 6).alias("positive_rate"), F.round(S.wilson_low(k, n), 6).alias("positive_low"), F.round(S.wilson_high(k, n), 6).alias("positive_high"))


@query("both_denominators", RECORDS + """SELECT condition, round(count(*) FILTER (WHERE predicted = expected) / nullif(count(*) FILTER (WHERE expected IS NOT NULL), 0), 6) AS correct_all, round(count(*) FILTER (WHERE predicted = expected) / nullif(count(*) FILTER (WHERE expected IS NOT NULL AND status = 'recognized'), 0), 6) AS correct_usable,
 count(*) FILTER (WHERE expected IS NULL AND predicted IS NULL) AS unknown_not_accepted, count(*) FILTER (WHERE expected IS NULL AND predicted IS NULL AND status = 'recognized') AS unknown_rejected FROM rec GROUP BY 1""")
def both_denominators(t):
    """Rates over all and over usable attempts, which must not be mixed."""
    known, usable, said = F.col("expected").isNotNull(), F.col("status") == "recognized", F.col("predicted").isNotNull()
    right = count_if(F.col("predicted") == F.col("expected"))
    g = records(t).groupBy("condition").agg(right.alias("c"), count_if(known).alias("k"), count_if(known & usable).alias("u"), count_if(~known & ~said).alias("unknown_not_accepted"), count_if(~known & ~said & usable).alias("unknown_rejected"))
    return g.select("condition", F.round(S.rate(F.col("c"), F.col("k")), 6).alias("correct_all"), F.round(S.rate(F.col("c"), F.col("u")), 6).alias("correct_usable"), "unknown_not_accepted", "unknown_rejected")


@query("subject_macro", RECORDS + ", sm AS (SELECT expected, avg((predicted IS NOT DISTINCT FROM expected)::INT) AS r, count(*) AS n FROM rec WHERE expected IS NOT NULL GROUP BY 1) SELECT count(*) AS subjects, round(avg(r), 6) AS macro_rate, round(sum(r * n) / sum(n), 6) AS micro_rate FROM sm")
def subject_macro(t):
    """Mean over subjects of their correct rates, beside the pooled rate."""
    s = records(t).filter("expected IS NOT NULL").groupBy("expected").agg(F.avg(F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False)).cast("int")).alias("r"), F.count("*").alias("n"))
    return s.agg(F.count("*").alias("subjects"), F.round(F.avg("r"), 6).alias("macro_rate"), F.round(F.sum(F.col("r") * F.col("n")) / F.sum("n"), 6).alias("micro_rate"))


@query("temporal_ablation", FACES + "SELECT video, count(*) AS faces, count(*) FILTER (WHERE state = 'known' AND single_state = 'known' AND name IS NOT DISTINCT FROM single_name) AS agree, count(*) FILTER (WHERE state = 'known' AND single_state IS DISTINCT FROM 'known') AS gained, count(*) FILTER (WHERE single_state = 'known' AND state IS DISTINCT FROM 'known') AS lost FROM fc GROUP BY 1")
def temporal_ablation(t):
    """Stable against single-frame decisions on the same faces."""
    a, b = F.coalesce(F.col("state") == "known", F.lit(False)), F.coalesce(F.col("single_state") == "known", F.lit(False))
    return faces(t).groupBy("video").agg(F.count("*").alias("faces"), F.count_if(a & b & F.col("name").eqNullSafe(F.col("single_name"))).alias("agree"), F.count_if(a & ~b).alias("gained"), F.count_if(b & ~a).alias("lost"))


@query("person_track_switches", FACES + """,
p AS (SELECT video, person_id, ordinal, track_id, row_number() OVER (PARTITION BY video, person_id, ordinal ORDER BY idx) AS r FROM fc WHERE person_id IS NOT NULL AND track_id IS NOT NULL),
l AS (SELECT *, lag(track_id) OVER (PARTITION BY video, person_id ORDER BY ordinal) AS before FROM p WHERE r = 1)
SELECT video, person_id, count(*) AS frames, count(*) FILTER (WHERE before <> track_id) AS switches FROM l GROUP BY 1, 2""")
def person_track_switches(t):
    """How often the track of a recognised person changes in a video."""
    p = faces(t).filter("person_id IS NOT NULL AND track_id IS NOT NULL").groupBy("video", "person_id", "ordinal").agg(F.min_by("track_id", "idx").alias("track_id"))
    l = p.withColumn("before", F.lag("track_id").over(Window.partitionBy("video", "person_id").orderBy("ordinal")))
    return l.groupBy("video", "person_id").agg(F.count("*").alias("frames"), count_if(F.col("before") != F.col("track_id")).alias("switches"))


@query("vote_representatives", RUNS + """,
k AS (SELECT *, CASE WHEN single_state = 'known' THEN coalesce(single_name, '__unknown__') ELSE '__unknown__' END AS key FROM runs WHERE vote),
w AS (SELECT *, list({'k': key, 'd': single_distance}) OVER (PARTITION BY video, track_id, run ORDER BY ordinal ROWS 6 PRECEDING) AS seen, lag(key) OVER (PARTITION BY video, track_id, run ORDER BY ordinal) AS last_key FROM k),
c AS (SELECT *, list_filter(list_transform(list_filter(seen, lambda e: e.k = key), lambda e: e.d), lambda d: d IS NOT NULL) AS ds, len(list_filter(seen, lambda e: e.k = key)) AS votes FROM w),
m AS (SELECT *, list_aggregate(ds, 'median') AS middle FROM c WHERE len(seen) >= 4 AND votes / len(seen) >= 0.6 AND last_key = key)
SELECT video, track_id, frame, round(list_min(list_transform(ds, lambda d: round(abs(d - middle), 9))), 6) AS off FROM m""")
def vote_representatives(t):
    """How far the representative distance of a stable vote is from the median
    of the winner's distances."""
    v = VO.votes(VO.track_runs(faces(t))).filter("stable")
    rows = VO.track_runs(faces(t)).filter("vote").withColumn("key", F.when(F.col("single_state") == "known", F.coalesce("single_name", F.lit(VO.UNKNOWN))).otherwise(VO.UNKNOWN))
    order = Window.partitionBy("video", "track_id", "run").orderBy("ordinal").rowsBetween(-6, 0)
    seen = rows.withColumn("seen", F.collect_list(F.struct("key", F.col("single_distance").alias("d"))).over(order))
    ds = F.array_sort(F.filter(F.transform(F.filter("seen", lambda e: e["key"] == F.col("key")), lambda e: e["d"]), lambda d: d.isNotNull()))
    n = F.size("ds")
    middle = F.when(n > 0, (F.element_at("ds", F.floor((n + 1) / 2).cast("int")) + F.element_at("ds", F.floor(n / 2).cast("int") + 1)) / 2)
    seen = seen.withColumn("ds", ds).withColumn("middle", middle).select("video", "track_id", "ordinal", "middle")
    return v.join(seen, ["video", "track_id", "ordinal"]).select("video", "track_id", "frame", F.round(F.round(F.abs(F.col("distance") - F.col("middle")), 9), 6).alias("off"))


@query("unseen_labels", "SELECT DISTINCT lower(label) AS label FROM manifest m WHERE label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pair_manifest p WHERE lower(p.left_subject_id) = lower(m.label)) AND NOT EXISTS (SELECT 1 FROM pair_manifest p WHERE lower(p.right_subject_id) = lower(m.label))")
def unseen_labels(t):
    """Labels that no pair uses yet: two anti-joins."""
    m = t("manifest").filter("label IS NOT NULL").select(F.lower("label").alias("label")).distinct()
    p = t("pair_manifest")
    return m.join(p.select(F.lower("left_subject_id").alias("label")), "label", "left_anti").join(p.select(F.lower("right_subject_id").alias("label")), "label", "left_anti")


@query("slot_template", """WITH s AS (SELECT DISTINCT lower(label) AS subject FROM manifest WHERE label IS NOT NULL), c AS (SELECT unnest(['glasses', 'mask', 'plain']) AS condition), n AS (SELECT unnest([1, 2]) AS slot)
SELECT subject, condition, slot, subject || '/' || condition || '/' || slot || '.jpg' AS image FROM s, c, n""")
def slot_template(t):
    """Pre-filled capture slots of every subject and condition."""
    s = t("manifest").filter("label IS NOT NULL").select(F.lower("label").alias("subject")).distinct()
    rows = s.select("subject", F.explode(F.array(F.lit("glasses"), F.lit("mask"), F.lit("plain"))).alias("condition")).select("*", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("slot"))
    return rows.select("subject", "condition", "slot", F.concat("subject", F.lit("/"), "condition", F.lit("/"), "slot", F.lit(".jpg")).alias("image"))


@query("frame_coverage", "WITH f AS (SELECT DISTINCT video, frame FROM video_frames), e AS (SELECT video, max(frame) AS top, count(*) AS frames FROM f GROUP BY 1), x AS (SELECT video, min(every) AS every FROM video_exports GROUP BY 1) SELECT e.video, e.frames, (top // x.every + 1 - frames)::BIGINT AS missing FROM e JOIN x ON x.video = e.video")
def frame_coverage(t):
    """Frames that the sampling grid has and the export lacks."""
    e = t("video_frames").select("video", "frame").distinct().groupBy("video").agg(F.max("frame").alias("top"), F.count("*").alias("frames"))
    x = t("video_exports").groupBy("video").agg(F.min("every").alias("every"))
    return e.join(x, "video").select("video", "frames", (F.floor(F.col("top") / F.col("every")) + 1 - F.col("frames")).alias("missing"))


@query("greedy_frame_matching", FACES.replace("WITH fr", "WITH RECURSIVE fr") + f""", p AS (SELECT a.video, a.ordinal::INT AS frame, printf('%03d', a.idx) AS subject, b.idx::INT AS idx, {IOU.format(a='a.box', b='b.box')} AS iou FROM fc a JOIN fc b ON b.video = a.video AND b.ordinal = a.ordinal + 1),
e AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY iou DESC, subject, idx) AS rn FROM p WHERE iou >= 0.5),
s AS (SELECT *, true AS taken, [subject] AS left_used, [idx] AS right_used FROM e WHERE rn = 1 UNION ALL
 SELECT video, frame, subject, idx, iou, rn, ok, CASE WHEN ok THEN list_append(left_used, subject) ELSE left_used END, CASE WHEN ok THEN list_append(right_used, idx) ELSE right_used END
 FROM (SELECT e.*, s.left_used, s.right_used, NOT list_contains(s.left_used, e.subject) AND NOT list_contains(s.right_used, e.idx) AS ok FROM s JOIN e ON e.video = s.video AND e.frame = s.frame AND e.rn = s.rn + 1))
SELECT video, frame, subject, idx, iou FROM s WHERE taken""")
def greedy_frame_matching(t):
    """Faces of each frame matched one to one with those of the next analysed
    frame by overlap (greedy; checked against brute force in tests)."""
    f = faces(t).select("video", "ordinal", "idx", "box")
    truth = f.select("video", F.col("ordinal").cast("int").alias("frame"), F.format_string("%03d", "idx").alias("subject"), "box")
    later = f.select("video", (F.col("ordinal") - 1).cast("int").alias("frame"), "idx", "box")
    return VO.match_truth(later, truth).filter("idx IS NOT NULL")
