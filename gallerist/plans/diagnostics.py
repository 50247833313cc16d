"""Validity of attempts, usability, acquisition failures, episodes, ablation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gallerist.functions import quality as Q
from gallerist.functions import vectors as V
from gallerist.functions.names import strip
from gallerist.operators import evaluation as E
from gallerist.operators import search
from gallerist.operators import validity
from gallerist.operators import video as VO
from gallerist.operators.evaluation import count_if
from gallerist.plans.evaluation import ACCEPT, COUNTS, WILSON
from gallerist.plans.leakage import manifest, pairs, query
from gallerist.plans.recognition import BASE, MARGIN, SCORES, THRESHOLD, attempts, gallery, probes
from gallerist.plans.video import FACES, FRAMES, faces, frames


@query("attempt_faults", SCORES + """, c AS (SELECT probe, status, max(score) FILTER (WHERE place <= 3) AS most, min(score) FILTER (WHERE place <= 3) AS least FROM k GROUP BY ALL)
SELECT status, count(*) AS attempts, count(*) FILTER (WHERE status <> 'recognized') AS unusable, count(*) FILTER (WHERE least < 0 OR most > 1) AS bad_scores, 0::BIGINT AS bad_names, 0::BIGINT AS disordered FROM c GROUP BY 1""")
def attempt_faults(t):
    """Rules of identification attempts that the probes' three best candidates
    break, by status: here candidates of probes that were not usable."""
    best = search.identity_scores(probes(t), gallery(t), best=3)
    c = best.groupBy("probe").agg(F.sort_array(F.collect_list(F.struct("score", F.col("identity").alias("name")))).alias("candidates"))
    f = validity.attempt_faults(probes(t).select("probe", "status").join(c, "probe"))
    has = lambda name: F.count_if(F.array_contains("faults", name))
    return f.groupBy("status").agg(F.count("*").alias("attempts"), has("unusable").alias("unusable"), has("score").alias("bad_scores"), has("name").alias("bad_names"), has("order").alias("disordered"))


@query("pair_measures", FACES + """, p AS (SELECT single_distance AS distance, CASE WHEN name IS NOT NULL AND single_name IS NOT NULL THEN name = single_name END AS genuine FROM fc),
f AS (SELECT genuine, CASE WHEN genuine IS NULL THEN 'truth' WHEN distance IS NULL OR isnan(distance) OR distance < 0 OR distance > 1 THEN 'distance' END AS fault FROM p)
SELECT genuine, fault, count(*) AS pairs FROM f GROUP BY ALL""")
def pair_measures(t):
    """Single-frame against confirmed names: pairs that can be measured, and
    the faults of those that can't."""
    known = F.col("name").isNotNull() & F.col("single_name").isNotNull()
    p = faces(t).select(F.col("single_distance").alias("distance"), F.when(known, F.col("name") == F.col("single_name")).alias("genuine"))
    return validity.pair_faults(p).groupBy("genuine", "fault").agg(F.count("*").alias("pairs"))


@query("usability_statuses", FRAMES + """, s AS (SELECT video, coalesce(len(faces), 0) AS n, faces[1] AS f FROM fr)
SELECT video, CASE WHEN n = 0 THEN 'no_face' WHEN n > 1 THEN 'multiple_faces' WHEN NOT coalesce(f.quality.accepted, false) THEN 'quality_rejected'
 WHEN NOT coalesce(f.box[1] >= 0 AND f.box[2] >= 0 AND f.box[3] > 0 AND f.box[4] > 0, false) THEN 'invalid_geometry' WHEN f.single_frame.state IS NULL OR f.single_frame.state NOT IN ('known', 'unknown') THEN 'extraction_failed' ELSE 'recognized' END AS status, count(*) AS frames FROM s GROUP BY 1, 2""")
def usability_statuses(t):
    """Frames by whether their face can be used, from the number of faces, the
    gate, the geometry and the decision."""
    f = F.try_element_at("faces", F.lit(1))
    box = lambda i: f["box"][i]
    geometry = (box(0) >= 0) & (box(1) >= 0) & (box(2) > 0) & (box(3) > 0)
    status = Q.usability(F.size("faces"), f["quality"]["accepted"], geometry, f["single_frame"]["state"].isin("known", "unknown"))
    return frames(t).groupBy("video", status.alias("status")).agg(F.count("*").alias("frames"))


EPISODES = FACES + """,
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, track_id, ordinal ORDER BY idx) AS first FROM fc WHERE track_id IS NOT NULL) WHERE first = 1),
nm AS (SELECT video, track_id, min(name) FILTER (WHERE state = 'known') AS expected FROM g GROUP BY 1, 2),
rr AS (SELECT g.video, g.track_id, g.ordinal, nm.expected, CASE WHEN isfinite(ts) AND ts >= 0 THEN ts END AS ts, coalesce(accepted, false) AS usable, CASE WHEN single_state = 'known' THEN single_name END AS said,
 g.ordinal - row_number() OVER (PARTITION BY g.video, g.track_id ORDER BY g.ordinal) AS island FROM g JOIN nm ON nm.video = g.video AND nm.track_id = g.track_id),
e AS (SELECT video, track_id, island, any_value(expected) AS expected, count(*) AS visible, count(*) FILTER (WHERE usable) AS usable, count(*) FILTER (WHERE said = expected) AS correct,
 count(*) FILTER (WHERE said <> expected) AS misidentified, count(*) FILTER (WHERE expected IS NULL AND said IS NOT NULL) AS false_accepts, min(ts) FILTER (WHERE said = expected) - min(ts) AS delay FROM rr GROUP BY 1, 2, 3)
"""


def episodes(t):
    """One row for each unbroken appearance of a track.  The name a track is
    confirmed with stands for the truth, which the exports lack; a track
    without one is of an unknown person."""
    g = faces(t).filter("track_id IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("video", "track_id", "ordinal").orderBy("idx"))).filter("r = 1").drop("r")
    expected = F.min(F.when(F.col("state") == "known", F.col("name"))).over(Window.partitionBy("video", "track_id"))
    ts = F.when((F.col("ts") >= 0) & ~F.isnan("ts") & (F.col("ts") < float("inf")), F.col("ts"))
    g = g.withColumns({"expected": expected, "ts": ts, "said": F.when(F.col("single_state") == "known", F.col("single_name"))})
    said, right = F.col("said").isNotNull(), F.col("said") == F.col("expected")
    return VO.episodes(g, ["video", "track_id"]).groupBy("video", "track_id", "island").agg(
        F.min("expected").alias("expected"), F.count("*").alias("visible"), F.count_if(F.coalesce("accepted", F.lit(False))).alias("usable"), count_if(right).alias("correct"), count_if(~right).alias("misidentified"),
        F.count_if(F.col("expected").isNull() & said).alias("false_accepts"), (F.min(F.when(right, F.col("ts"))) - F.min("ts")).alias("delay"),
    )


@query("episode_summary", EPISODES + """SELECT count(*) FILTER (WHERE expected IS NOT NULL) AS known_episodes, count(*) FILTER (WHERE expected IS NULL) AS unknown_episodes, count(*) FILTER (WHERE correct > 0) AS known_ever_correct,
 count(*) FILTER (WHERE expected IS NOT NULL AND correct = 0) AS known_never_confirmed, count(*) FILTER (WHERE false_accepts > 0) AS unknown_ever_false_accepted, count(*) FILTER (WHERE misidentified > 0) AS known_any_misidentification,
 round(avg(correct / visible) FILTER (WHERE expected IS NOT NULL), 6) AS known_mean_correct_fraction, round(avg(false_accepts / visible) FILTER (WHERE expected IS NULL), 6) AS unknown_mean_false_accept_fraction, round(avg(delay), 6) AS mean_delay FROM e""")
def episode_summary(t):
    """Outcomes of all appearances, each counted once."""
    e, known = episodes(t), F.col("expected").isNotNull()
    part = lambda of, c: F.round(F.avg(F.when(of, F.col(c) / F.col("visible"))), 6)
    return e.agg(
        F.count_if(known).alias("known_episodes"), F.count_if(~known).alias("unknown_episodes"), F.count_if(F.col("correct") > 0).alias("known_ever_correct"), F.count_if(known & (F.col("correct") == 0)).alias("known_never_confirmed"),
        F.count_if(F.col("false_accepts") > 0).alias("unknown_ever_false_accepted"), F.count_if(F.col("misidentified") > 0).alias("known_any_misidentification"), part(known, "correct").alias("known_mean_correct_fraction"),
        part(~known, "false_accepts").alias("unknown_mean_false_accept_fraction"), F.round(F.avg("delay"), 6).alias("mean_delay"),
    )


OUTCOMES = EPISODES + ", o AS (SELECT video, track_id, any_value(expected) AS expected, count(*) AS episodes, count(*) FILTER (WHERE correct > 0) AS confirmed_episodes, sum(visible)::BIGINT AS visible, sum(usable)::BIGINT AS usable, sum(correct)::BIGINT AS correct, sum(misidentified)::BIGINT AS misidentified, sum(false_accepts)::BIGINT AS false_accepts FROM e GROUP BY 1, 2)"


def outcomes(t):
    sums = [F.sum(c).alias(c) for c in ("visible", "usable", "correct", "misidentified", "false_accepts")]
    return episodes(t).groupBy("video", "track_id").agg(F.min("expected").alias("expected"), F.count("*").alias("episodes"), F.count_if(F.col("correct") > 0).alias("confirmed_episodes"), *sums)


@query("subject_outcomes", OUTCOMES + "SELECT *, round(correct / visible, 6) AS correct_fraction, round(false_accepts / visible, 6) AS false_accept_fraction FROM o")
def subject_outcomes(t):
    """One row for each person on a track, summed over the appearances."""
    return outcomes(t).withColumns({"correct_fraction": F.round(F.col("correct") / F.col("visible"), 6), "false_accept_fraction": F.round(F.col("false_accepts") / F.col("visible"), 6)})


@query("subject_outcome_summary", OUTCOMES + """SELECT count(*) FILTER (WHERE expected IS NOT NULL) AS known_subjects, count(*) FILTER (WHERE expected IS NULL) AS unknown_subjects, count(*) FILTER (WHERE correct > 0) AS known_ever_correct,
 count(*) FILTER (WHERE expected IS NOT NULL AND correct = 0) AS known_never_correct, count(*) FILTER (WHERE false_accepts > 0) AS unknown_ever_false_accepted,
 round(avg(correct / visible) FILTER (WHERE expected IS NOT NULL), 6) AS known_macro_correct, round(avg(false_accepts / visible) FILTER (WHERE expected IS NULL), 6) AS unknown_macro_false_accepts FROM o""")
def subject_outcome_summary(t):
    """Rates in which every person counts the same."""
    o, known = outcomes(t), F.col("expected").isNotNull()
    rate = lambda of, c: F.round(F.avg(F.when(of, F.col(c) / F.col("visible"))), 6)
    return o.agg(
        F.count_if(known).alias("known_subjects"), F.count_if(~known).alias("unknown_subjects"), F.count_if(F.col("correct") > 0).alias("known_ever_correct"), F.count_if(known & (F.col("correct") == 0)).alias("known_never_correct"),
        F.count_if(F.col("false_accepts") > 0).alias("unknown_ever_false_accepted"), rate(known, "correct").alias("known_macro_correct"), rate(~known, "false_accepts").alias("unknown_macro_false_accepts"),
    )


@query("macro_genuine_rate", SCORES + f", g AS (SELECT identity, count(*) AS n, count(*) FILTER (WHERE status = 'recognized' AND score <= {THRESHOLD}) AS hits FROM s WHERE identity = expected GROUP BY 1) SELECT count(*) AS subjects, sum(n)::BIGINT AS attempts, sum(hits)::BIGINT AS accepts, round(avg(hits / n), 6) AS macro_rate FROM g")
def macro_genuine_rate(t):
    """Genuine acceptance of one-to-one attempts, the mean over subjects; an
    attempt that was not usable is not accepted."""
    own = probes(t).select("probe", "expected", "status").join(search.identity_scores(probes(t), gallery(t)), "probe").filter("identity = expected")
    g = own.groupBy("identity").agg(F.count("*").alias("n"), F.count_if((F.col("status") == "recognized") & (F.col("score") <= THRESHOLD)).alias("hits"))
    return g.agg(F.count("*").alias("subjects"), F.sum("n").alias("attempts"), F.sum("hits").alias("accepts"), F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("macro_rate"))


STATUS = """, i AS (SELECT image, CASE WHEN bool_or(sha256 IS NOT NULL AND dhash64 IS NOT NULL) THEN 'usable' WHEN bool_or(sha256 IS NOT NULL) THEN 'no_hash' ELSE 'no_digest' END AS status FROM (SELECT DISTINCT * FROM manifest) GROUP BY 1)"""


def image_statuses(t):
    """Acquisition status of every picture of the manifest."""
    has = lambda *cols: F.bool_or(F.greatest(F.lit(False)) if not cols else F.array_min(F.array(*[F.col(c).isNotNull() for c in cols])))
    status = F.when(has("sha256", "dhash64"), "usable").when(has("sha256"), "no_hash").otherwise("no_digest")
    return manifest(t, "image", "sha256", "dhash64").groupBy("image").agg(status.alias("status"))


@query("pair_failures", "WITH p AS (SELECT DISTINCT * FROM pair_manifest)" + STATUS + """, j AS (SELECT genuine, coalesce(a.status, 'missing') AS l, coalesce(b.status, 'missing') AS r FROM p LEFT JOIN i a ON a.image = left_image LEFT JOIN i b ON b.image = right_image)
SELECT genuine, CASE WHEN l <> 'usable' AND r <> 'usable' THEN 'both' WHEN l <> 'usable' THEN 'left' WHEN r <> 'usable' THEN 'right' ELSE 'none' END AS side,
 CASE WHEN l = 'usable' AND r = 'usable' THEN 'none' WHEN l = 'usable' OR l = r THEN r WHEN r = 'usable' THEN l ELSE least(l, r) || '+' || greatest(l, r) END AS combination, count(*) AS pairs FROM j GROUP BY ALL""")
def pair_failures(t):
    """Which sides of the pairs could not be acquired, and why."""
    i = image_statuses(t)
    side = lambda s: i.select(F.col("image").alias(f"{s}_image"), F.col("status").alias(s))
    j = pairs(t, "genuine", "left_image", "right_image").join(side("left"), "left_image", "left").join(side("right"), "right_image", "left")
    both = F.array(F.coalesce("left", F.lit("missing")), F.coalesce("right", F.lit("missing")))
    failed = F.filter(both, lambda x: x != "usable")
    where = F.when(F.size(failed) == 2, "both").when(F.size(failed) == 0, "none").when(both[0] == "usable", "right").otherwise("left")
    what = F.when(F.size(failed) == 0, "none").otherwise(F.array_join(F.array_sort(F.array_distinct(failed)), "+"))
    return j.groupBy("genuine", where.alias("side"), what.alias("combination")).agg(F.count("*").alias("pairs"))


@query("appearance_usability", """WITH m AS (SELECT DISTINCT image, lower(trim(coalesce(label, subject_id))) AS subject, replace(lower(trim(condition)), '-', '_') AS condition, sha256 IS NOT NULL AND dhash64 IS NOT NULL AS usable FROM manifest),
i AS (SELECT subject, image, condition, bool_or(usable) AS usable FROM m WHERE subject IS NOT NULL AND condition IN ('glasses', 'no_glasses') GROUP BY 1, 2, 3),
s AS (SELECT subject, count(*) FILTER (WHERE condition = 'glasses') AS g, count(*) FILTER (WHERE condition = 'no_glasses') AS b, bool_or(usable) FILTER (WHERE condition = 'glasses') AS gu, bool_or(usable) FILTER (WHERE condition = 'no_glasses') AS bu FROM i GROUP BY 1)
SELECT CASE WHEN g <> 1 OR b <> 1 THEN 'ineligible' WHEN gu AND bu THEN 'both' WHEN gu THEN 'glasses_only' WHEN bu THEN 'no_glasses_only' ELSE 'neither' END AS outcome, count(*) AS subjects FROM s GROUP BY 1""")
def appearance_usability(t):
    """People with exactly one picture with and one without glasses, by which
    of the two can be used."""
    m = t("manifest").select("image", F.lower(strip(F.coalesce("label", "subject_id"))).alias("subject"), F.regexp_replace(F.lower(strip("condition")), "-", "_").alias("condition"), (F.col("sha256").isNotNull() & F.col("dhash64").isNotNull()).alias("usable"))
    i = m.filter("subject IS NOT NULL AND condition IN ('glasses', 'no_glasses')").groupBy("subject", "image", "condition").agg(F.bool_or("usable").alias("usable"))
    n = lambda c: F.count_if(F.col("condition") == c)
    u = lambda c: F.bool_or(F.when(F.col("condition") == c, F.col("usable")))
    s = i.groupBy("subject").agg(n("glasses").alias("g"), n("no_glasses").alias("b"), u("glasses").alias("gu"), u("no_glasses").alias("bu"))
    outcome = F.when((F.col("g") != 1) | (F.col("b") != 1), "ineligible").when(F.col("gu") & F.col("bu"), "both").when(F.col("gu"), "glasses_only").when(F.col("bu"), "no_glasses_only").otherwise("neither")
    return s.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("subjects"))


@query("enrollment_minimums", """WITH m AS (SELECT DISTINCT entry_id, lower(trim(label)) AS name_key FROM manifest WHERE section = 'gallery' AND trim(label) <> ''), k AS (SELECT DISTINCT name_key FROM people WHERE active = 1),
n AS (SELECT m.name_key, count(*) AS samples, k.name_key IS NOT NULL AS known FROM m LEFT JOIN k ON k.name_key = m.name_key GROUP BY m.name_key, k.name_key)
SELECT name_key, samples, known, CASE WHEN known THEN 1 ELSE 3 END::INT AS needed, samples >= CASE WHEN known THEN 1 ELSE 3 END AS enough FROM n""")
def enrollment_minimums(t):
    """Samples that an enrollment needs: one for a name that is in the gallery,
    three for a new one."""
    m = manifest(t, "section", "label").filter("section = 'gallery'").select(F.lower(strip("label")).alias("name_key")).filter("name_key <> ''").groupBy("name_key").agg(F.count("*").alias("samples"))
    k = t("people").filter("active = 1").select("name_key", F.lit(True).alias("known")).distinct()
    n = m.join(k, "name_key", "left").withColumn("known", F.coalesce("known", F.lit(False))).withColumn("needed", F.when(F.col("known"), 1).otherwise(3))
    return n.withColumn("enough", F.col("samples") >= F.col("needed"))


#: Templates of a person among which a combination is sought, and the largest
#: distance inside one.
CANDIDATES, CLOSE = 8, 0.49


@query("first_combinations", BASE + f""", c AS (SELECT identity, template, vector, row_number() OVER (PARTITION BY identity ORDER BY template) AS i FROM gallery),
k AS (SELECT * FROM c WHERE i <= {CANDIDATES}), pd AS (SELECT a.identity, a.i AS i, b.i AS j, (1 - list_inner_product(a.vector, b.vector) / sqrt(list_inner_product(a.vector, a.vector) * list_inner_product(b.vector, b.vector))) / 2 AS d FROM k a JOIN k b ON a.identity = b.identity AND a.i < b.i),
n AS (SELECT * FROM pd WHERE d <= {CLOSE}), t AS (SELECT x.identity, x.i, x.j, y.j AS k FROM n x JOIN n y ON y.identity = x.identity AND y.i = x.j JOIN n z ON z.identity = x.identity AND z.i = x.i AND z.j = y.j),
rr AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY i, j, k) AS r, count(*) OVER (PARTITION BY identity) AS combinations FROM t)
SELECT identity, i::INT AS i, j::INT AS j, k::INT AS k, combinations FROM rr WHERE r = 1""")
def first_combinations(t):
    """The first three of a person's first templates, in their order, that are
    all close to each other: a bounded search, since few candidates are let in."""
    c = gallery(t).withColumn("i", F.row_number().over(Window.partitionBy("identity").orderBy("template"))).filter(F.col("i") <= CANDIDATES).select("identity", "i", V.unit(V.wide(F.col("vector"))).alias("v"))
    g = c.groupBy("identity").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
    d = g.select("identity", F.explode("c").alias("a"), "c").select("identity", "a", F.explode("c").alias("b")).filter("a.i < b.i")
    d = d.filter((1 - V.dot(F.col("a.v"), F.col("b.v"))) / 2 <= CLOSE).select("identity", F.col("a.i").alias("i"), F.col("b.i").alias("j"))
    n = d.groupBy("identity").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("near"))
    chains = n.select("identity", "near", F.explode("near").alias("x")).select("identity", "near", "x", F.explode("near").alias("y")).filter("x.j = y.i")
    chains = chains.filter(F.exists("near", lambda z: (z["i"] == F.col("x.i")) & (z["j"] == F.col("y.j"))))
    best = F.min(F.struct(F.col("x.i").alias("i"), F.col("x.j").alias("j"), F.col("y.j").alias("k")))
    return chains.groupBy("identity").agg(best.alias("b"), F.count("*").alias("combinations")).select("identity", "b.i", "b.j", "b.k", "combinations")


@query("quality_ablation", SCORES + f""", q AS (SELECT *, (probe * 53 % 256)::DOUBLE AS brightness, (probe * 29 % 80)::DOUBLE AS contrast, (probe * 37 % 101) / 100.0 AS focus FROM a WHERE status <> 'no_face'),
w AS (SELECT *, brightness < 45 OR brightness > 220 AS light, contrast < 22 AS flat, focus < 0.35 AS blur FROM q), y AS (SELECT unnest(['none', 'brightness_only', 'sharpness_only', 'full']) AS policy),
rec AS (SELECT policy, expected, CASE WHEN ok THEN 'recognized' ELSE 'quality_rejected' END AS status, CASE WHEN ok AND {ACCEPT} THEN candidate END AS predicted FROM (SELECT *, CASE policy WHEN 'none' THEN true WHEN 'brightness_only' THEN NOT light WHEN 'sharpness_only' THEN NOT blur ELSE NOT (light OR flat OR blur) END AS ok FROM w CROSS JOIN y))
SELECT policy, {COUNTS} FROM rec GROUP BY policy""")
def quality_ablation(t):
    """Identification of the same probes under every gate policy: a probe that
    a policy refuses is not identified.  The embeddings have no measures of
    quality; they are made from the ids."""
    p = F.col("probe")
    why = Q.reasons((p * 53 % 256).cast("double"), (p * 29 % 80).cast("double"), p * 37 % 101 / 100.0, F.lit(None).cast("double"))
    a = attempts(t).filter("status <> 'no_face'").withColumn("why", why)
    rows = [a.withColumn("policy", F.lit(name)).withColumn("ok", ~F.arrays_overlap("why", F.array(*[F.lit(x) for x in look])) if look else F.lit(True)) for name, look in Q.POLICIES.items()]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    ok = F.col("ok") & search.accepted(F.col("best"), F.col("second"), THRESHOLD, MARGIN)
    every = every.withColumns({"predicted": F.when(ok, F.col("candidate")), "status": F.when(F.col("ok"), "recognized").otherwise("quality_rejected")})
    return every.groupBy("policy").agg(*E.summary_counts())
