"""Template selection under a budget, and the experiment over its methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from gallerist.functions.names import strip
from gallerist.operators import search
from gallerist.operators import selection as S
from gallerist.plans.recognition import gallery, probes
from gallerist.plans.registry import query

BUDGET, SEED = 3, 42
T = "WITH g AS (SELECT label AS identity, vec_id AS template, (vec_id * 37 % 101) / 100.0 AS quality FROM embeddings WHERE label < 8 AND vec_id % 20 <> 0) "


def templates(t):
    return gallery(t).withColumn("quality", F.col("template") * 37 % 101 / 100.0)


@query("select_first", T + "SELECT identity, template, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY template)::INT AS r FROM g) WHERE r <= 3")
def select_first(t):
    return S.first(templates(t), BUDGET)


@query("select_quality", T + "SELECT identity, template, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY quality DESC, template)::INT AS r FROM g) WHERE r <= 3")
def select_quality(t):
    return S.by_quality(templates(t), BUDGET)


@query("select_random", T + "SELECT identity, template, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY sha256('42|' || identity || '|' || template))::INT AS r FROM g) WHERE r <= 3")
def select_random(t):
    return S.random(templates(t), BUDGET, SEED)


@query("select_diverse")
def select_diverse(t):
    """Farthest-point selection (greedy; checked against brute force in tests)."""
    return S.greedy(templates(t), BUDGET, "diversity")


@query("select_coverage")
def select_coverage(t):
    """Covering selection (greedy; checked against brute force in tests)."""
    return S.greedy(templates(t), BUDGET, "coverage")


@query("selection_experiment")
def selection_experiment(t):
    """Correct identifications of every method at every budget: the variants
    are rows of one job."""
    rows = None
    known = probes(t).filter("status = 'recognized' AND expected IS NOT NULL").select("probe", "expected")
    for budget in (1, 3, 5):
        for name, f in (("first", S.first), ("quality", S.by_quality), ("random", lambda x, b: S.random(x, b, SEED)), ("diversity", lambda x, b: S.greedy(x, b, "diversity")), ("coverage", lambda x, b: S.greedy(x, b, "coverage"))):
            g = gallery(t).join(f(templates(t), budget).select("identity", "template"), ["identity", "template"])
            part = g.withColumn("variant", F.lit(f"{name}-{budget}"))
            rows = part if rows is None else rows.unionByName(part)
    # one search over all variants: an identity of the search is (variant, identity)
    packed = rows.select(F.struct("variant", "identity").alias("v"), "template", "vector").select(F.to_json("v").alias("identity"), "template", "vector")
    scores = search.identity_scores(probes(t), packed)
    parts = scores.select("probe", "score", F.from_json("identity", "variant string, identity int").alias("v")).select("probe", "score", "v.variant", "v.identity")
    best = parts.groupBy("variant", "probe").agg(F.min_by("identity", F.struct("score", "identity")).alias("said"))
    return best.join(known, "probe").groupBy("variant").agg(F.count("*").alias("probes"), F.count_if(F.col("said") == F.col("expected")).alias("correct"))


@query("synthetic_gallery", "SELECT i AS identity, [1, 2, 3, 5, 8][i % 5 + 1]::BIGINT AS templates, 1.0::DOUBLE AS least_norm, 1.0::DOUBLE AS most_norm FROM range(100) r(i)")
def synthetic_gallery(t):
    """Seeded unit vectors of a synthetic gallery, summarised by profile."""
    from gallerist.sources.synthetic import gallery as made

    g = made(t("meta").sparkSession, identities=100, profile=(1, 2, 3, 5, 8), dim=16, seed=SEED)
    n = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return g.groupBy("identity").agg(F.count("*").alias("templates"), F.round(F.min(n), 6).alias("least_norm"), F.round(F.max(n), 6).alias("most_norm"))


@query("component_bootstrap")
def component_bootstrap(t):
    """Bootstrap interval of the genuine rate over components of subjects."""
    from gallerist.operators.bootstrap import component_interval
    from gallerist.plans.leakage import pair_components, pairs

    c = pair_components(t)
    p = pairs(t, "genuine", "left_subject_id").filter("genuine IS NOT NULL AND left_subject_id IS NOT NULL").join(c, F.lower(strip("left_subject_id")) == F.col("subject"))
    counts = p.groupBy("component").agg(F.count("*").alias("total"), F.count_if("genuine").alias("hits"))
    return component_interval(counts, iterations=2000, seed=SEED)
