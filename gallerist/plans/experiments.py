"""Experiments: variants are rows of one job, and the operating points are
frozen before the test attempts are opened."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gallerist.operators import search
from gallerist.operators import selection as S
from gallerist.operators.evaluation import count_if, rate
from gallerist.plans.recognition import BASE, gallery, probes
from gallerist.plans.registry import query
from gallerist.plans.selection import templates
from gallerist.storage import materialize

METHODS = ("first", "quality", "random", "diversity", "coverage")
#: Template budgets, seeds of the random method, and runner-up margins of the matrix.
BUDGETS, SEEDS, MARGINS = (1, 2, 3, 5), (42, 43, 44), (0.0, 0.02, 0.04, 0.06)
AGGREGATIONS = (("nearest", 1), ("mean", 0), ("median", 0), ("topk_mean", 2), ("topk_mean", 3), ("topk_median", 3))


def chosen(rows: DataFrame, method: str, budget: int, seed: int) -> DataFrame:
    if method in ("diversity", "coverage"):
        return S.greedy(rows, budget, method)
    return {"first": S.first, "quality": S.by_quality}[method](rows, budget) if method != "random" else S.random(rows, budget, seed)


def matrix_attempts(all_probes: DataFrame, all_templates: DataFrame, budgets: tuple, methods: tuple = METHODS, seeds: tuple = (0,), aggregations: tuple = AGGREGATIONS) -> DataFrame:
    """``(variant, probe, candidate, best, second)`` of every budget, method,
    seed and aggregation: one gallery whose identities carry their variant, so
    that one pass over the templates scores all of them."""
    packed = None
    for budget, method in product(budgets, methods):
        for seed in seeds if method == "random" else seeds[:1]:
            part = all_templates.join(chosen(all_templates, method, budget, seed).select("identity", "template"), ["identity", "template"]).withColumn("v", F.lit(f"{method}-{budget}-{seed}"))
            packed = part if packed is None else packed.unionByName(part)
    keyed = packed.select(F.to_json(F.struct("v", "identity")).alias("identity"), "template", "vector")
    scores = search.identity_scores(all_probes.select("probe", "vector"), keyed, aggregations)
    who = F.from_json("identity", "v string, identity int")
    rows = scores.select("probe", "score", F.concat_ws("-", who["v"], "strategy", "k").alias("variant"), who["identity"].alias("identity"))
    # only the two best identities of a probe are kept on the way
    place = F.row_number().over(Window.partitionBy("variant", "probe").orderBy("score", "identity"))
    two = rows.withColumn("place", place).filter("place <= 2")
    at = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    return two.groupBy("variant", "probe").agg(at(1, "identity").alias("candidate"), at(1, "score").alias("best"), at(2, "score").alias("second"))


def frozen_points(validation: DataFrame, target: float, margins: tuple[float, ...] = (0.0,)) -> DataFrame:
    """Threshold and margin of each variant on its validation attempts: most
    correct, then fewest misidentified, fewest false accepts, then the lowest
    threshold and margin."""
    from gallerist.operators.evaluation import running_sums

    right, by = F.col("candidate") == F.col("expected"), ["variant", "margin"]
    grid = F.explode(F.array(*[F.lit(float(m)) for m in margins])).alias("margin")
    leads = validation.select("*", grid).filter(search.accepted(F.col("best"), F.col("second"), 1.0, F.col("margin")))
    events = leads.groupBy(*by, F.col("best").alias("threshold")).agg(count_if(right).alias("correct"), count_if(~right).alias("misid"), count_if(F.col("expected").isNull()).alias("fa"))
    unknown = validation.groupBy("variant").agg(count_if(F.col("expected").isNull()).alias("usable"))
    zero = unknown.select("variant", grid, F.lit(0.0).alias("threshold"), *[F.lit(0).cast("bigint").alias(c) for c in ("correct", "misid", "fa")])
    rows = events.unionByName(zero).groupBy(*by, "threshold").agg(*[F.sum(c).alias(c) for c in ("correct", "misid", "fa")])
    runs = running_sums(rows, ["correct", "misid", "fa"], "threshold", by).join(unknown, "variant")
    open_ = runs.filter(F.coalesce(rate(F.col("run_fa"), F.col("usable")), F.lit(0.0)) <= target + 1e-12)
    key = F.struct((-F.col("run_correct")).alias("a"), F.col("run_misid").alias("b"), F.col("run_fa").alias("c"), F.col("threshold").alias("d"), F.col("margin").alias("e"))
    return open_.groupBy("variant").agg(F.min_by(F.struct("threshold", "margin"), key).alias("p")).select("variant", "p.*")


@query("matrix_experiment")
def matrix_experiment(t):
    """Every variant calibrated on the validation probes and scored once on the
    test probes at its frozen threshold and margin."""
    known = probes(t).filter("status = 'recognized'").select("probe", "expected")
    a = materialize(matrix_attempts(probes(t), templates(t), BUDGETS, seeds=SEEDS).join(known, "probe"), "attempts")
    validation, test = a.filter("probe % 40 = 0"), a.filter("probe % 40 <> 0")
    points = frozen_points(validation, 0.2, MARGINS)
    said = search.accepted(F.col("best"), F.col("second"), F.col("threshold"), F.col("margin"))
    r = test.join(points, "variant").groupBy("variant")
    return r.agg(
        F.round(F.max("threshold"), 6).alias("threshold"), F.max("margin").alias("margin"), F.count("*").alias("attempts"), count_if(said & (F.col("candidate") == F.col("expected"))).alias("correct"),
        count_if(said & (F.col("candidate") != F.col("expected"))).alias("misidentified"), count_if(said & F.col("expected").isNull()).alias("false_accepts"),
    )


@query("verification_experiment", BASE + """, p AS (SELECT probe, round(d, 9) AS distance, coalesce(identity = expected, false) AS genuine FROM d),
e AS (SELECT distance, count(*) FILTER (WHERE genuine) AS g, count(*) FILTER (WHERE NOT genuine) AS i FROM p WHERE probe % 40 = 0 GROUP BY 1 UNION ALL SELECT 0, 0, 0),
c AS (SELECT distance, sum(g) OVER w AS ta, sum(i) OVER w AS fa, sum(i) OVER () AS impostors FROM (SELECT distance, sum(g) AS g, sum(i) AS i FROM e GROUP BY 1) WINDOW w AS (ORDER BY distance)),
h AS (SELECT distance AS threshold FROM c WHERE fa / impostors <= 0.05 ORDER BY ta DESC, fa, distance LIMIT 1),
v AS (SELECT threshold, count(*) FILTER (WHERE genuine AND distance <= threshold) AS ta, count(*) FILTER (WHERE genuine) AS genuine, count(*) FILTER (WHERE NOT genuine AND distance <= threshold) AS fa, count(*) FILTER (WHERE NOT genuine) AS impostor FROM p CROSS JOIN h WHERE probe % 40 <> 0 GROUP BY 1)
SELECT round(threshold, 6) AS threshold, ta, genuine, round(ta / genuine, 6) AS tar, fa, impostor, round(fa / impostor, 6) AS far FROM v""")
def verification_experiment(t):
    """One-to-one verification: the distance is calibrated on the pairs of the
    validation probes and counted on those of the test probes."""
    from gallerist.operators import calibration as C
    from gallerist.operators import evaluation as E

    single = search.identity_scores(probes(t), gallery(t).select(F.col("template").alias("identity"), "template", "vector"), (("nearest", 1),))
    owner = gallery(t).select(F.col("template").alias("identity"), F.col("identity").alias("owner"))
    pairs = single.join(owner, "identity").join(probes(t).select("probe", "expected"), "probe")
    pairs = pairs.select("probe", F.round("score", 9).alias("distance"), F.coalesce(F.col("owner") == F.col("expected"), F.lit(False)).alias("genuine"))
    point = C.verification_point(E.roc(pairs.filter("probe % 40 = 0")), 0.05).select(F.col("distance").alias("threshold"))
    g, near = F.col("genuine"), F.col("distance") <= F.col("threshold")
    test = pairs.filter("probe % 40 <> 0").join(F.broadcast(point)).groupBy("threshold").agg(F.count_if(g & near).alias("ta"), F.count_if(g).alias("genuine"), F.count_if(~g & near).alias("fa"), F.count_if(~g).alias("impostor"))
    return test.select(F.round("threshold", 6).alias("threshold"), "ta", "genuine", F.round(rate(F.col("ta"), F.col("genuine")), 6).alias("tar"), "fa", "impostor", F.round(rate(F.col("fa"), F.col("impostor")), 6).alias("far"))
