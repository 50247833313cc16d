"""Evaluation and calibration over open-set attempts and verification pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gallerist.operators import calibration as C
from gallerist.operators import evaluation as E
from gallerist.plans.recognition import BASE, MARGIN, SCORES, THRESHOLD, attempts
from gallerist.plans.registry import query
from gallerist.storage import exact_quantiles, materialize

ACCEPT = f"best <= {THRESHOLD} AND (second IS NULL OR second - best >= {MARGIN} OR abs(second - best - {MARGIN}) <= 1e-12)"
RECORDS = SCORES + f", rec AS (SELECT probe, expected, status, CASE WHEN status = 'recognized' AND {ACCEPT} THEN candidate END AS predicted, (probe * 37 % 101) / 4.0 AS ms, CASE probe % 3 WHEN 0 THEN 'glasses' WHEN 1 THEN 'mask' ELSE 'plain' END AS condition FROM a)"
COUNTS = """count(*) AS attempts, count(*) FILTER (WHERE expected IS NOT NULL) AS known_attempts, count(*) FILTER (WHERE predicted = expected) AS known_correct,
 count(*) FILTER (WHERE expected IS NOT NULL AND predicted IS NULL) AS known_rejected, count(*) FILTER (WHERE predicted <> expected) AS known_misidentified,
 count(*) FILTER (WHERE expected IS NULL) AS unknown_attempts, count(*) FILTER (WHERE expected IS NULL AND status = 'recognized') AS unknown_usable,
 count(*) FILTER (WHERE expected IS NULL AND predicted IS NOT NULL) AS unknown_false_accepts,
 count(*) FILTER (WHERE expected IS NULL AND status = 'recognized' AND predicted IS NULL) AS unknown_correct_rejections, count(*) FILTER (WHERE status <> 'recognized') AS acquisition_failures"""
WILSON = """round(CASE WHEN {n} > 0 THEN {k} / {n} END, 6) AS {p}_rate,
 round(CASE WHEN {n} > 0 THEN greatest(0, ({k}/{n} + 3.841458820694124/(2.0*{n}) - 1.959963984540054*sqrt({k}/{n}*(1-{k}/{n})/{n} + 3.841458820694124/(4.0*{n}*{n}))) / (1 + 3.841458820694124/{n})) END, 6) AS {p}_low,
 round(CASE WHEN {n} > 0 THEN least(1, ({k}/{n} + 3.841458820694124/(2.0*{n}) + 1.959963984540054*sqrt({k}/{n}*(1-{k}/{n})/{n} + 3.841458820694124/(4.0*{n}*{n}))) / (1 + 3.841458820694124/{n})) END, 6) AS {p}_high"""


def wilson(name: str, k: str, n: str) -> str:
    return WILSON.format(p=name, k=f"({k})::DOUBLE", n=f"({n})::DOUBLE")


def records(t):
    from gallerist.operators.search import accepted

    ok = (F.col("status") == "recognized") & accepted(F.col("best"), F.col("second"), THRESHOLD, MARGIN)
    condition = F.when(F.col("probe") % 3 == 0, "glasses").when(F.col("probe") % 3 == 1, "mask").otherwise("plain")
    return attempts(t).select("probe", "expected", "status", F.when(ok, F.col("candidate")).alias("predicted"), (F.col("probe") * 37 % 101 / 4.0).alias("ms"), condition.alias("condition"), "candidate")


@query("record_summary", RECORDS + f"SELECT {COUNTS}, round(quantile_cont(ms, 0.5), 6) AS ms_p50, round(quantile_cont(ms, 0.95), 6) AS ms_p95 FROM rec")
def record_summary(t):
    """Outcome counts and latency quantiles of all attempts."""
    r = materialize(records(t), "records")
    q = exact_quantiles(r, "ms", (0.5, 0.95))
    return r.agg(*E.summary_counts()).join(q.select(F.round(F.col("q")[0], 6).alias("ms_p50"), F.round(F.col("q")[1], 6).alias("ms_p95")), how="left")


@query("condition_summary", RECORDS + f"SELECT condition, {COUNTS} FROM rec GROUP BY condition")
def condition_summary(t):
    return records(t).groupBy("condition").agg(*E.summary_counts())


@query("identification_report", RECORDS.replace("FROM a)", ", candidate FROM a)").replace("AS condition", "AS condition") + f""", c AS (SELECT {COUNTS}, count(*) FILTER (WHERE status = 'recognized' AND candidate = expected) AS top1, count(*) FILTER (WHERE status = 'recognized' AND expected IS NOT NULL) AS known_usable FROM rec)
SELECT attempts, {wilson('dir', 'known_correct', 'known_attempts')}, {wilson('fpir_all', 'unknown_false_accepts', 'unknown_attempts')}, {wilson('fpir_usable', 'unknown_false_accepts', 'unknown_usable')},
 round(top1 / known_usable, 6) AS closed_set_top1, round((known_correct + unknown_usable - unknown_false_accepts) / attempts, 6) AS accuracy FROM c""")
def identification_report(t):
    """Detection-and-identification rate, false positive rates over all and
    over usable unknown probes, closed-set top-1, with Wilson intervals."""
    r = records(t)
    c = r.agg(*E.summary_counts(), E.count_if((F.col("status") == "recognized") & (F.col("candidate") == F.col("expected"))).alias("top1"), E.count_if((F.col("status") == "recognized") & F.col("expected").isNotNull()).alias("known_usable"))
    out = [F.col("attempts")]
    for name, k, n in (("dir", "known_correct", "known_attempts"), ("fpir_all", "unknown_false_accepts", "unknown_attempts"), ("fpir_usable", "unknown_false_accepts", "unknown_usable")):
        k, n = F.col(k), F.col(n)
        out += [F.round(E.rate(k, n), 6).alias(f"{name}_rate"), F.round(E.wilson_low(k, n), 6).alias(f"{name}_low"), F.round(E.wilson_high(k, n), 6).alias(f"{name}_high")]
    right = F.col("known_correct") + F.col("unknown_usable") - F.col("unknown_false_accepts")
    return c.select(*out, F.round(F.col("top1") / F.col("known_usable"), 6).alias("closed_set_top1"), F.round(right / F.col("attempts"), 6).alias("accuracy"))


@query("status_counts", RECORDS + "SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM rec GROUP BY status")
def status_counts(t):
    from pyspark.sql import Window

    g = records(t).groupBy("status").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


SWEEP = SCORES + """, m AS (SELECT unnest([0.0, 0.005, 0.01, 0.02]) AS margin),
x AS (SELECT m.margin, a.best AS threshold, count(*) FILTER (WHERE candidate = expected) AS correct, count(*) FILTER (WHERE candidate <> expected) AS misid, count(*) FILTER (WHERE expected IS NULL) AS fa
  FROM a, m WHERE status = 'recognized' AND (second IS NULL OR second - best >= margin OR abs(second - best - margin) <= 1e-12) GROUP BY 1, 2),
u AS (SELECT count(*) FILTER (WHERE status = 'recognized' AND expected IS NULL) AS usable FROM a),
z AS (SELECT margin, 0.0 AS threshold, 0 AS correct, 0 AS misid, 0 AS fa FROM m UNION ALL
  SELECT margin, threshold, sum(correct) OVER w, sum(misid) OVER w, sum(fa) OVER w FROM x WINDOW w AS (PARTITION BY margin ORDER BY threshold))
"""


@query("open_set_sweep", SWEEP + "SELECT margin, round(threshold, 6) AS threshold, correct::BIGINT AS correct, misid::BIGINT AS misidentified, fa::BIGINT AS false_accepts, round(CASE WHEN usable > 0 THEN fa / usable END, 6) AS fpir FROM z, u")
def open_set_sweep(t):
    """Running outcome counts at every threshold event of every margin."""
    s = C.open_set_sweep(attempts(t), (0.0, 0.005, 0.01, 0.02))
    return s.select("margin", F.round("threshold", 6).alias("threshold"), "correct", "misidentified", "false_accepts", F.round("fpir", 6).alias("fpir"))


@query("open_set_point", SWEEP + """, o AS (SELECT *, row_number() OVER (ORDER BY correct DESC, misid, fa, threshold, margin) AS r FROM z, u WHERE fa / usable <= 0.2 + 1e-12)
SELECT margin, round(threshold, 6) AS threshold, correct::BIGINT AS correct, misid::BIGINT AS misidentified, fa::BIGINT AS false_accepts FROM o WHERE r = 1""")
def open_set_point(t):
    """Best threshold and margin under a bound on the false positive rate."""
    p = C.open_set_point(C.open_set_sweep(attempts(t), (0.0, 0.005, 0.01, 0.02)), 0.2)
    return p.select("margin", F.round("threshold", 6).alias("threshold"), "correct", "misidentified", "false_accepts")


@query("margin_controls", SWEEP + """, o AS (SELECT *, row_number() OVER (PARTITION BY margin ORDER BY correct DESC, misid, fa, threshold) AS r FROM z, u WHERE fa / usable <= 0.2 + 1e-12)
SELECT margin, round(threshold, 6) AS threshold, correct::BIGINT AS correct FROM o WHERE r = 1""")
def margin_controls(t):
    """The best threshold of each single margin."""
    p = C.open_set_point(C.open_set_sweep(attempts(t), (0.0, 0.005, 0.01, 0.02)), 0.2, per_margin=True)
    return p.select("margin", F.round("threshold", 6).alias("threshold"), "correct")


PAIRS = BASE + ", v AS (SELECT round(d, 9) AS distance, coalesce(identity = expected, false) AS genuine FROM d)"
ROC = PAIRS + """, p AS (SELECT distance, count(*) FILTER (WHERE genuine) AS g, count(*) FILTER (WHERE NOT genuine) AS i FROM v GROUP BY 1),
c AS (SELECT distance, g, i, sum(g) OVER w AS ta, sum(i) OVER w AS fa, sum(g) OVER () AS tg, sum(i) OVER () AS ti FROM p WINDOW w AS (ORDER BY distance))
"""


def verification_pairs(t):
    """Every probe against every template as one-to-one attempts: distances of
    the stated probes, genuine if both are one person."""
    return C.pair_distances(t)


@query("roc_points", ROC + "SELECT round(distance, 6) AS distance, ta::BIGINT AS true_accepts, fa::BIGINT AS false_accepts, round(ta / tg, 6) AS tar, round(fa / ti, 6) AS far FROM c WHERE distance * 1e9 % 1 IS NOT NULL")
def roc_points(t):
    r = E.roc(verification_pairs(t))
    return r.select(F.round("distance", 6).alias("distance"), "true_accepts", "false_accepts", F.round("tar", 6).alias("tar"), F.round("far", 6).alias("far"))


@query("roc_area", ROC + "SELECT round(sum((i / ti) * ((ta + (ta - g)) / tg) / 2), 6) AS auc FROM c")
def roc_area(t):
    return E.auc(E.roc(verification_pairs(t))).select(F.round("auc", 6).alias("auc"))


@query("tar_at_far", ROC + """, q AS (SELECT unnest([0.1, 0.01, 0.001]) AS target), s AS (SELECT target, ceil(3.841458820694124 * (1 - target) / target)::BIGINT AS needed FROM q),
b AS (SELECT target, needed, ti, ta / tg AS tar, distance, row_number() OVER (PARTITION BY target ORDER BY ta / tg DESC, fa / ti, distance) AS r FROM c, s WHERE fa / ti <= target),
f AS (SELECT s.target, s.needed, (SELECT max(ti) FROM c) AS ti, b.tar, b.distance FROM s LEFT JOIN b ON b.target = s.target AND b.r = 1)
SELECT target, needed, ti::BIGINT AS impostor, CASE WHEN ti >= needed THEN 'estimated' ELSE 'insufficient samples' END AS status, CASE WHEN ti >= needed THEN round(coalesce(tar, 0), 6) END AS tar, CASE WHEN ti >= needed THEN round(distance, 6) END AS distance FROM f""")
def tar_at_far(t):
    r = E.tar_at_far(E.roc(verification_pairs(t)), (0.1, 0.01, 0.001))
    return r.select("target", F.col("needed").cast("bigint").alias("needed"), "impostor", "status", F.round("tar", 6).alias("tar"), F.round("distance", 6).alias("distance"))


@query("verification_counts", PAIRS + """SELECT count(*) FILTER (WHERE genuine AND distance <= 0.4) AS ta, count(*) FILTER (WHERE genuine AND distance > 0.4) AS fr, count(*) FILTER (WHERE NOT genuine AND distance <= 0.4) AS fa, count(*) FILTER (WHERE NOT genuine AND distance > 0.4) AS tr FROM v""")
def verification_counts(t):
    """True and false accepts and rejects at a fixed distance."""
    g, near = F.col("genuine"), F.col("distance") <= 0.4
    return verification_pairs(t).agg(F.count_if(g & near).alias("ta"), F.count_if(g & ~near).alias("fr"), F.count_if(~g & near).alias("fa"), F.count_if(~g & ~near).alias("tr"))


@query("verification_point", ROC + """, z AS (SELECT 0.0 AS distance, 0 AS ta, 0 AS fa, max(ti) AS ti FROM c UNION ALL SELECT distance, ta, fa, ti FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY ta DESC, fa, distance) AS r FROM z WHERE fa / ti <= 0.05)
SELECT round(distance, 6) AS distance, ta::BIGINT AS true_accepts, fa::BIGINT AS false_accepts FROM o WHERE r = 1""")
def verification_point(t):
    """Most true accepts under a bound on the false accept rate."""
    return C.verification_point(E.roc(verification_pairs(t)), 0.05).select(F.round("distance", 6).alias("distance"), "true_accepts", "false_accepts")


@query("gallery_threshold", ROC + """, k AS (SELECT DISTINCT greatest(0.2, least(0.62, x)) AS t FROM (SELECT distance AS x FROM c UNION ALL SELECT 0.43 UNION ALL SELECT 0.2 UNION ALL SELECT 0.62)),
y AS (SELECT t, coalesce((SELECT max(fa) FROM c WHERE distance <= t), 0) / (SELECT max(ti) FROM c) AS far, 1 - coalesce((SELECT max(ta) FROM c WHERE distance <= t), 0) / (SELECT max(tg) FROM c) AS frr FROM k),
o AS (SELECT *, row_number() OVER (ORDER BY round(2 * far + frr, 12), round(abs(t - 0.43), 12), t) AS r FROM y)
SELECT round(t, 6) AS threshold, round(far, 6) AS far, round(frr, 6) AS frr FROM o WHERE r = 1""")
def gallery_threshold(t):
    """In-gallery threshold: least 2 FAR + FRR, then nearest to the fallback."""
    return C.gallery_threshold(E.roc(verification_pairs(t))).select(F.round("threshold", 6).alias("threshold"), F.round("far", 6).alias("far"), F.round("frr", 6).alias("frr"))


@query("report_point", RECORDS.replace("FROM a)", ", best, second, candidate FROM a)") + """, kk AS (SELECT unnest([1e-8, 0.275, 0.4999999999999999]) AS t UNION SELECT best FROM rec WHERE status = 'recognized' AND best > 0 AND best < 0.5),
y AS (SELECT t, count(*) FILTER (WHERE expected IS NOT NULL AND status = 'recognized' AND best <= t AND candidate = expected) AS c, count(*) FILTER (WHERE expected IS NOT NULL AND status = 'recognized' AND best <= t AND candidate <> expected) AS m,
 count(*) FILTER (WHERE expected IS NULL AND status = 'recognized' AND best <= t) AS fa, count(*) FILTER (WHERE expected IS NULL AND status = 'recognized') AS u FROM rec, kk GROUP BY t),
o AS (SELECT *, row_number() OVER (ORDER BY c DESC, m, fa, t) AS r FROM y WHERE fa / u <= 0.2)
SELECT round(t, 6) AS threshold, round(1 - 2 * t, 6) AS cosine_threshold, c AS correct, m AS misidentified, fa AS false_accepts FROM o WHERE r = 1""")
def report_point(t):
    """Operating point of a finished report: thresholds are all observed
    distances below one half and three constants; the point just below an
    observed distance accepts what the next smaller one does, so it never wins
    except against an equal count at a larger threshold."""
    p = C.report_point(attempts(t), 0.2)
    return p.select(F.round("threshold", 6).alias("threshold"), F.round(1 - 2 * F.col("threshold"), 6).alias("cosine_threshold"), "correct", "misidentified", "false_accepts")


@query("paired_comparison", SCORES + """, n AS (SELECT probe, identity AS candidate, row_number() OVER (PARTITION BY probe ORDER BY min(d), identity) AS r FROM d GROUP BY probe, identity),
j AS (SELECT a.expected, a.candidate AS x, n.candidate AS y FROM a JOIN n ON n.probe = a.probe AND n.r = 1 WHERE a.status = 'recognized')
SELECT count(*) AS probes, count(*) FILTER (WHERE x = expected AND y IS DISTINCT FROM expected) AS lost, count(*) FILTER (WHERE x IS DISTINCT FROM expected AND y = expected) AS gained, count(*) FILTER (WHERE x = expected AND y = expected) AS both_right, count(*) FILTER (WHERE x <> y) AS changed FROM j""")
def paired_comparison(t):
    """Same probes under two aggregations (top-3 median, nearest): gained and lost."""
    from gallerist.operators import search
    from gallerist.plans.recognition import gallery, probes

    other = search.identity_scores(probes(t), gallery(t), (("nearest", 1),), best=1).select("probe", F.col("identity").alias("y"))
    j = attempts(t).filter("status = 'recognized'").join(other, "probe")
    x, y = F.coalesce(F.col("candidate") == F.col("expected"), F.lit(False)), F.coalesce(F.col("y") == F.col("expected"), F.lit(False))
    return j.agg(F.count("*").alias("probes"), F.count_if(x & ~y).alias("lost"), F.count_if(~x & y).alias("gained"), F.count_if(x & y).alias("both_right"), F.count_if(F.col("candidate") != F.col("y")).alias("changed"))
