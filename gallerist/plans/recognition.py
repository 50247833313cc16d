"""Open-set identification over the embeddings table.

Identities are the labels below 8, labels 8 and 9 are people who are not
enrolled; the probes are the rows whose id is divisible by 20, all other rows
of enrolled people are templates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gallerist.functions import vectors as V
from gallerist.operators import search
from gallerist.plans.registry import query
from gallerist.storage import materialize

#: Templates of a block whose pairs one task compares.
PAIR_ROWS = 1_024
THRESHOLD, MARGIN = 0.36, 0.005

BASE = """
WITH gallery AS (SELECT label AS identity, vec_id AS template, embedding::DOUBLE[] AS vector FROM embeddings WHERE label < 8 AND vec_id % 20 <> 0),
probes AS (SELECT vec_id AS probe, embedding::DOUBLE[] AS vector, CASE WHEN label < 8 THEN label END AS expected,
  CASE WHEN vec_id % 140 = 0 THEN 'quality_rejected' WHEN vec_id % 220 = 0 THEN 'no_face' ELSE 'recognized' END AS status FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT probe, expected, status, identity, template,
  least(1.0, greatest(0.0, (1 - list_inner_product(p.vector, g.vector) / sqrt(list_inner_product(p.vector, p.vector) * list_inner_product(g.vector, g.vector))) / 2)) AS d
  FROM probes p CROSS JOIN gallery g),
r AS (SELECT *, row_number() OVER (PARTITION BY probe, identity ORDER BY d, template) AS rn FROM d)
"""
SCORES = BASE + """,
s AS (SELECT probe, expected, status, identity, median(d) AS score FROM r WHERE rn <= 3 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score, identity) AS place, lead(score) OVER (PARTITION BY probe ORDER BY score, identity) AS second FROM s),
a AS (SELECT probe, expected, status, identity AS candidate, score AS best, second FROM k WHERE place = 1)
"""


def gallery(t):
    return t("embeddings").filter("label < 8 AND vec_id % 20 <> 0").select(F.col("label").alias("identity"), F.col("vec_id").alias("template"), F.col("embedding").alias("vector"))


def probes(t):
    status = F.when(F.col("vec_id") % 140 == 0, "quality_rejected").when(F.col("vec_id") % 220 == 0, "no_face").otherwise("recognized")
    return t("embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("vector"), F.when(F.col("label") < 8, F.col("label")).alias("expected"), status.alias("status"))


def attempts(t):
    """One row per probe: expected, status, candidate, best and second score."""
    found = search.decide(search.identity_scores(probes(t), gallery(t), best=2), 1.0, 0.0)
    return probes(t).select("probe", "expected", "status").join(found.select("probe", "candidate", "best", "second"), "probe")


@query("identity_ranking", SCORES + "SELECT probe, identity, place, round(score, 6) AS score FROM k")
def identity_ranking(t):
    """Full ranking of all identities for every probe (top-3 median)."""
    from pyspark.sql import Window

    s = search.identity_scores(probes(t), gallery(t))
    return s.select("probe", "identity", F.row_number().over(Window.partitionBy("probe").orderBy("score", "identity")).alias("place"), F.round("score", 6).alias("score"))


@query("recognize", SCORES + f""", dec AS (SELECT *, best <= {THRESHOLD} AND (second IS NULL OR second - best >= {MARGIN} OR abs(second - best - {MARGIN}) <= 1e-12) AS known FROM a)
SELECT probe, candidate, round(best, 6) AS best, round(second, 6) AS second, known, CASE WHEN known THEN candidate END AS name, round(100 * (1 - best), 3) AS similarity FROM dec""")
def recognize(t):
    """Open-set decision for every probe: accepted identity or unknown."""
    r = search.decide(search.identity_scores(probes(t), gallery(t), best=2), THRESHOLD, MARGIN)
    return r.select("probe", "candidate", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"), "known", "name", F.round("similarity", 3).alias("similarity"))


GRID = (("nearest", 1), ("mean", 0), ("median", 0), ("topk_mean", 2), ("topk_mean", 3), ("topk_median", 3))


@query("aggregation_grid", BASE + """
SELECT probe, identity, round(min(d), 6) AS nearest, round(avg(d), 6) AS mean, round(median(d), 6) AS median,
  round(avg(d) FILTER (WHERE rn <= 2), 6) AS top2_mean, round(avg(d) FILTER (WHERE rn <= 3), 6) AS top3_mean, round(median(d) FILTER (WHERE rn <= 3), 6) AS top3_median
FROM r GROUP BY ALL""")
def aggregation_grid(t):
    """Six ways to aggregate template distances to an identity's score."""
    s = search.identity_scores(probes(t), gallery(t), GRID)
    pick = lambda name, k: F.round(F.max(F.when((F.col("strategy") == name) & (F.col("k") == k), F.col("score"))), 6)
    return s.groupBy("probe", "identity").agg(
        pick("nearest", 1).alias("nearest"), pick("mean", 0).alias("mean"), pick("median", 0).alias("median"),
        pick("topk_mean", 2).alias("top2_mean"), pick("topk_mean", 3).alias("top3_mean"), pick("topk_median", 3).alias("top3_median"),
    )


@query("vector_facts", """
SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(list_inner_product(e, [1.0 for x in e]) / sqrt(list_inner_product(e, e)), 6) AS unit_sum,
  len(e) = 64 AND sqrt(list_inner_product(e, e)) >= 1e-8 AS valid FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def vector_facts(t):
    """Norm, sum of the unit vector and validity of every embedding."""
    v = V.wide(F.col("embedding"))
    total = F.aggregate(V.unit(v), F.lit(0.0), lambda s, x: s + x)
    return t("embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(total, 6).alias("unit_sum"), V.valid_vector(v, 64).alias("valid"))


@query("template_pairs_genuine", """
WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.label, (1 - list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v))) / 2 AS d
FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, count(*) AS pairs, round(min(d), 6) AS least, round(avg(d), 6) AS mean, round(max(d), 6) AS most FROM p GROUP BY label""")
def template_pairs_genuine(t):
    """Distances between all templates of one person: every unordered pair
    once, per label."""
    return pair_summaries(t("embeddings"))


def pair_summaries(embeddings, rows=PAIR_ROWS):
    """Count, least, mean and largest distance of all pairs of each label, as
    matrix products of blocks of about ``rows``."""
    e = embeddings.filter("label IS NOT NULL AND vec_id IS NOT NULL").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sizes = e.groupBy("label").agg(F.ceil(F.count("*") / rows).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part")
    packed = e.join(F.broadcast(sizes), "label").select("label", part, "vec_id", "v").groupBy("label", "part").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs"))
    packed = materialize(packed, "blocks")
    a, b = packed.alias("a"), packed.alias("b")
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.part") <= F.col("b.part")))
    pairs = pairs.select("a.label", F.col("a.ids").alias("ids_a"), F.col("a.vs").alias("a"), F.col("b.ids").alias("ids_b"), F.col("b.vs").alias("b"), (F.col("a.part") == F.col("b.part")).alias("same"))
    tasks = 4 * int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = embeddings.schema["label"].dataType.simpleString()
    d = pairs.repartition(tasks).mapInPandas(_block_summaries, f"label {kind}, n bigint, total double, least double, most double")
    g = d.groupBy("label").agg(F.sum("n").alias("pairs"), F.round(F.min("least"), 6).alias("least"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"), F.round(F.max("most"), 6).alias("most"))
    return g


def _block_summaries(batches):
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            x, y = (np.stack([np.asarray(v, float) for v in side]) for side in (r.a, r.b))
            x, y = (m / np.sqrt((m * m).sum(axis=1))[:, None] for m in (x, y))
            i, j = np.asarray(r.ids_a)[:, None], np.asarray(r.ids_b)[None, :]
            d = np.clip((1.0 - x @ y.T) / 2.0, 0.0, 1.0)[i < j if r.same else i != j]
            if len(d):
                yield pd.DataFrame({"label": [r.label], "n": [len(d)], "total": [d.sum()], "least": [d.min()], "most": [d.max()]})


@query("set_consistency", BASE + """
, q AS (SELECT template AS sample, identity FROM gallery), m AS (
SELECT p.probe, p.expected, median((1 - list_inner_product(p.vector, g.vector) / sqrt(list_inner_product(p.vector, p.vector) * list_inner_product(g.vector, g.vector))) / 2) AS d
FROM probes p JOIN gallery g ON g.identity = p.expected GROUP BY ALL)
SELECT probe, expected AS identity, round(d, 6) AS median_distance, d <= (1 - 0.05) / 2 AS consistent FROM m""")
def set_consistency(t):
    """Does a new sample fit the enrolled set of its person: its median
    distance to all of that person's templates, against (1 - c) / 2."""
    s = search.identity_scores(probes(t), gallery(t), (("median", 0),))
    own = s.join(probes(t).select("probe", F.col("expected").alias("identity")), ["probe", "identity"])
    return own.select("probe", "identity", F.round("score", 6).alias("median_distance"), (F.col("score") <= (1 - 0.05) / 2).alias("consistent"))


@query("enrollment_check", SCORES + """
SELECT probe, round(min(score) FILTER (WHERE identity = expected), 6) AS own, round(min(score) FILTER (WHERE identity IS DISTINCT FROM expected), 6) AS other,
  CASE WHEN expected IS NULL THEN min(score) > 0.275 WHEN min(score) FILTER (WHERE identity = expected) > 0.36 THEN false
  ELSE min(score) FILTER (WHERE identity IS DISTINCT FROM expected) - min(score) FILTER (WHERE identity = expected) >= 0.005 AND min(score) FILTER (WHERE identity IS DISTINCT FROM expected) >= 0.175 END AS enrollable
FROM s GROUP BY probe, expected""")
def enrollment_check(t):
    """May a sample be added: near its own person, clear of everyone else; a
    new person has to be far from all enrolled ones."""
    s = search.identity_scores(probes(t), gallery(t)).join(probes(t).select("probe", "expected"), "probe")
    mine = F.coalesce(F.col("identity") == F.col("expected"), F.lit(False))
    g = s.groupBy("probe", "expected").agg(F.min(F.when(mine, F.col("score"))).alias("o"), F.min(F.when(~mine, F.col("score"))).alias("x"), F.min("score").alias("least"))
    ok = F.when(F.col("expected").isNull(), F.col("least") > 0.275).when(F.col("o") > 0.36, False).otherwise((F.col("x") - F.col("o") >= 0.005) & (F.col("x") >= 0.175))
    return g.select("probe", F.round("o", 6).alias("own"), F.round("x", 6).alias("other"), ok.alias("enrollable"))
