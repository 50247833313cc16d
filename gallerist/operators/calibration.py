"""Threshold searches.  Their tie rules differ on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gallerist.operators.evaluation import count_if, rate, running_sums

#: Fixed values of the in-gallery search.
FALLBACK, MINIMUM, MAXIMUM = 0.43, 0.20, 0.62


def open_set_sweep(attempts: DataFrame, margins: tuple[float, ...]) -> DataFrame:
    """Running outcomes at the thresholds 0 and every observed best distance
    that passes the margin, for each margin.

    ``attempts(expected, status, candidate, best, second)``; only recognised
    attempts can be accepted, and the rate is over usable unknown ones.
    """
    passes = F.col("second").isNull() | (F.col("second") - F.col("best") >= F.col("margin")) | (F.abs(F.col("second") - F.col("best") - F.col("margin")) <= 1e-12)
    usable = attempts.filter("status = 'recognized'")
    events = usable.withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins]))).filter(passes)
    right = F.col("candidate") == F.col("expected")
    counts = events.groupBy("margin", F.col("best").alias("threshold")).agg(count_if(right).alias("correct"), count_if(~right).alias("misidentified"), count_if(F.col("expected").isNull()).alias("false_accepts"))
    sums = ["correct", "misidentified", "false_accepts"]
    runs = running_sums(counts, sums, "threshold", ["margin"]).select("margin", "threshold", *[F.col(f"run_{s}").alias(s) for s in sums])
    zero = attempts.sparkSession.createDataFrame([(float(m), 0.0, 0, 0, 0) for m in margins], "margin double, threshold double, correct bigint, misidentified bigint, false_accepts bigint")
    unknown = usable.agg(count_if(F.col("expected").isNull()).alias("usable"))
    return zero.unionByName(runs).join(F.broadcast(unknown)).withColumn("fpir", rate(F.col("false_accepts"), F.col("usable")))


def open_set_point(sweep: DataFrame, target: float, per_margin: bool = False) -> DataFrame:
    """Most correct, then fewest misidentified, fewest false accepts, lowest
    threshold and margin, with a false positive rate up to the target."""
    keys = ["margin"] if per_margin else []
    order = [F.col("correct"), -F.col("misidentified"), -F.col("false_accepts"), -F.col("threshold"), -F.col("margin")]
    best = F.max_by(F.struct("margin", "threshold", "correct", "misidentified", "false_accepts"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    g = sweep.filter(F.col("fpir") <= target + 1e-12)
    g = g.groupBy(F.col("margin").alias("_m")).agg(best.alias("b")) if keys else g.agg(best.alias("b"))
    return g.select("b.*").filter("threshold IS NOT NULL")


def verification_point(points: DataFrame, target: float) -> DataFrame:
    """Most true accepts, then fewest false ones, then the lowest distance,
    with a false accept rate up to the target (no tolerance); the distance 0
    that accepts nothing is always open."""
    zero = points.sparkSession.createDataFrame([(0.0, 0, 0, 0.0)], "distance double, true_accepts bigint, false_accepts bigint, far double")
    rows = points.select("distance", "true_accepts", "false_accepts", "far").unionByName(zero).filter(F.col("far") <= target)
    key = F.struct(F.col("true_accepts").alias("a"), (-F.col("false_accepts")).alias("b"), (-F.col("distance")).alias("c"))
    return rows.agg(F.max_by(F.struct("distance", "true_accepts", "false_accepts"), key).alias("b")).select("b.*")


def gallery_threshold(points: DataFrame) -> DataFrame:
    """Threshold within [MINIMUM, MAXIMUM] with the least 2 FAR + FRR, then the
    nearest to FALLBACK, then the lowest.

    Candidates are the observed distances, clamped, and the three constants;
    the counts at a constant are those of the last observed distance up to it.
    """
    spark = points.sparkSession
    fixed = spark.createDataFrame([(FALLBACK,), (MINIMUM,), (MAXIMUM,)], "t double")
    inside = points.filter((F.col("distance") >= MINIMUM) & (F.col("distance") <= MAXIMUM)).select(F.col("distance").alias("t"), "far", (1 - F.col("tar")).alias("frr"))
    at = fixed.join(points.select("distance", "far", "tar"), F.col("distance") <= F.col("t"), "left")
    at = at.groupBy("t").agg(F.coalesce(F.max("far"), F.lit(0.0)).alias("far"), (1 - F.coalesce(F.max("tar"), F.lit(0.0))).alias("frr"))
    rows = inside.unionByName(at)
    key = F.struct(F.round(2 * F.col("far") + F.col("frr"), 12).alias("a"), F.round(F.abs(F.col("t") - FALLBACK), 12).alias("b"), F.col("t").alias("c"))
    return rows.agg(F.min_by(F.struct(F.col("t").alias("threshold"), "far", "frr"), key).alias("b")).select("b.*")


def report_point(attempts: DataFrame, target: float) -> DataFrame:
    """Operating point of a report: most known correct, then the lowest rates
    of misidentification and false positives, then the lowest threshold; no
    tolerance on the target.  Candidates are three constants and the observed
    distances below one half."""
    usable = attempts.filter("status = 'recognized'")
    right = F.col("candidate") == F.col("expected")
    counts = usable.groupBy(F.col("best").alias("t")).agg(count_if(right).alias("correct"), count_if(~right).alias("misidentified"), count_if(F.col("expected").isNull()).alias("false_accepts"))
    sums = ["correct", "misidentified", "false_accepts"]
    fixed = attempts.sparkSession.createDataFrame([(x, 0, 0, 0) for x in (1e-8, 0.275, 0.4999999999999999)], "t double, correct bigint, misidentified bigint, false_accepts bigint")
    rows = counts.unionByName(fixed).groupBy("t").agg(*[F.sum(s).alias(s) for s in sums])
    runs = running_sums(rows, sums, "t").filter("t > 0 AND t < 0.5")
    unknown = usable.agg(count_if(F.col("expected").isNull()).alias("usable"))
    open_ = runs.join(F.broadcast(unknown)).filter(F.col("run_false_accepts") / F.col("usable") <= target)
    key = F.struct((-F.col("run_correct")).alias("a"), F.col("run_misidentified").alias("b"), F.col("run_false_accepts").alias("c"), F.col("t").alias("d"))
    return open_.agg(F.min_by(F.struct(F.col("t").alias("threshold"), *[F.col(f"run_{s}").alias(s) for s in sums]), key).alias("b")).select("b.*")


def pair_distances(t) -> DataFrame:
    """``(distance, genuine)`` of the stated probes against all templates, in
    blocks: every template is an identity of its own."""
    from gallerist.operators import search
    from gallerist.plans.recognition import gallery, probes

    g = gallery(t)
    single = search.identity_scores(probes(t), g.select(F.col("template").alias("identity"), "template", "vector"), (("nearest", 1),))
    owner = g.select(F.col("template").alias("identity"), F.col("identity").alias("owner"))
    pairs = single.join(owner, "identity").join(probes(t).select("probe", "expected"), "probe")
    return pairs.select(F.round("score", 9).alias("distance"), F.coalesce(F.col("owner") == F.col("expected"), F.lit(False)).alias("genuine"))
