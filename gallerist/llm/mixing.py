"""Mixing sources to target weights.

Method: entropy balancing.  Document i of source s is to be used w_i times, as
close to once as possible (Kullback-Leibler), subject to the tokens of every
source: sum of t_i w_i = T_s, and w_i <= R_s.  The solution is exponentially
tilted, w_i = min(R_s, exp(l_s t_i)), and the multipliers l_s solve the convex
dual, by Newton iterations whose sums are distributed aggregates.  The rates
are rounded to whole copies systematically: in the order of size, a document
gets as many copies as whole numbers are passed by the running sum of rates.

The total is the largest at which every source can give its share within its
repeats, unless one is set; then sources that cannot reach their share give
all they have and the actual shares say so.

Scale: an iteration runs over (source, size, count), not over documents, and
returns one row per source of the targets table.  Running sums come from one
sort by ranges with an offset per partition and source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gallerist.functions.text import key_or_null
from gallerist.llm.tokens import MODEL, TOKENIZERS, token_counts
from gallerist.storage import materialize

STEPS = 60
TOLERANCE = 1e-9


def source_key(col):
    """Spelling of a source without case, blanks and separators; null if it names none."""
    return F.regexp_replace(key_or_null(col), "[_-]", "")


def solve(sizes: DataFrame, goals: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Multipliers of the dual.

    ``sizes(key, t, n)`` counts documents of t tokens; ``goals`` maps a key to
    (tokens wanted, most uses).  Sizes are scaled by the source's mean.  Newton
    steps are kept inside a bracket and fall back to bisection.
    """
    means = {r["key"]: r["m"] for r in sizes.groupBy("key").agg((F.sum(F.col("n") * F.col("t")) / F.sum("n")).alias("m")).collect()}
    lam, low, high = dict.fromkeys(goals, 0.0), dict.fromkeys(goals, -700.0), dict.fromkeys(goals, 700.0)
    open_ = {k for k in goals if k in means}
    spark = sizes.sparkSession
    for _ in range(STEPS):
        if not open_:
            break
        now = spark.createDataFrame([(k, lam[k] / means[k], float(goals[k][1])) for k in sorted(open_)], "key string, lam double, most double")
        tilt = F.exp(F.least(F.col("lam") * F.col("t"), F.lit(700.0)))
        w = F.least(F.col("most"), tilt)
        grown = F.when(tilt < F.col("most"), F.col("n") * F.col("t") * F.col("t") * tilt).otherwise(0.0)
        sums = sizes.join(F.broadcast(now), "key").groupBy("key").agg(F.sum(F.col("n") * F.col("t") * w).alias("f"), F.sum(grown).alias("g")).collect()
        for r in sums:
            k, goal = r["key"], goals[r["key"]][0]
            off = r["f"] - goal
            if abs(off) <= TOLERANCE * goal:
                open_.discard(k)
                continue
            (high if off > 0 else low)[k] = lam[k]
            slope = r["g"] / means[k]
            step = lam[k] - off / slope if slope > 0 else math.inf
            lam[k] = step if low[k] < step < high[k] else (low[k] + high[k]) / 2
            if high[k] - low[k] < 1e-13 * max(1.0, abs(lam[k])):
                open_.discard(k)
    return {k: lam[k] / means[k] for k in goals if k in means}


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, model: str = MODEL, folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, source, tokens, rate, copies)`` of the documents to use.

    ``source`` is the spelling of the targets table.  A target with a missing
    or non-positive weight or less than one use, and documents of unlisted
    sources or without tokens, get no copies and no row; of repeated targets
    the first in order counts.  Weights are relative to the listed sources
    that have tokens.
    """
    spark = documents.sparkSession
    wanted = targets.select(source_key("source").alias("key"), "source", F.col("target_weight").cast("double").alias("weight"), "max_repeats").filter("key IS NOT NULL AND weight > 0 AND NOT isnan(weight) AND max_repeats >= 1")
    wanted = {r["key"]: r for r in wanted.groupBy("key").agg(F.min(F.struct("source", "weight", "max_repeats")).alias("r")).select("key", "r.*").collect()}
    known = spark.createDataFrame([(k, r["source"], int(r["max_repeats"])) for k, r in sorted(wanted.items())], "key string, source string, most int")
    # spellings of the listed sources, so that texts are never sent to Python for their source's sake
    spellings = documents.select("source").distinct().select(F.col("source").alias("_source"), source_key("source").alias("key")).join(F.broadcast(known.select("key")), "key", "left_semi")
    spellings = materialize(spellings, "spellings")
    listed = documents.select("doc_id", "text", "source").join(spellings, F.col("source") == F.col("_source")).select("doc_id", "text", "key")
    docs = listed.groupBy("doc_id").agg(F.min("key").alias("key"))  # a repeated document has its first source
    sized = token_counts(listed, model, folder).join(docs, "doc_id").join(F.broadcast(known), "key").filter("tokens > 0")
    sized = materialize(sized.select("doc_id", "key", "source", "most", F.col("tokens").cast("bigint").alias("tokens")), "sized")
    sizes = materialize(sized.groupBy("key", F.col("tokens").cast("double").alias("t")).agg(F.count("*").cast("double").alias("n")), "sizes")
    have = {r["key"]: r["tokens"] for r in sizes.groupBy("key").agg(F.sum(F.col("t") * F.col("n")).alias("tokens")).collect()}
    whole = sum(wanted[k]["weight"] for k in have)
    share = {k: wanted[k]["weight"] / whole for k in have}
    most = {k: float(wanted[k]["max_repeats"]) for k in have}
    size = total if total is not None else min((have[k] * most[k] / share[k] for k in have), default=0.0)
    goals = {k: (min(size * share[k], have[k] * most[k]), most[k]) for k in have}
    full = {k for k in have if goals[k][0] >= have[k] * most[k] * (1 - 1e-12)}
    lam = solve(sizes, {k: g for k, g in goals.items() if k not in full})
    rates = spark.createDataFrame([(k, 0.0 if k in full else lam[k], k in full) for k in sorted(have)] or [("", 0.0, False)], "key string, lam double, full boolean")
    rated = sized.join(F.broadcast(rates), "key").withColumn("rate", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.exp(F.least(F.col("lam") * F.col("tokens"), F.lit(700.0))))))
    return _rounded(rated.select("doc_id", "key", "source", "tokens", "most", "rate"))


def _rounded(rated: DataFrame) -> DataFrame:
    """Whole copies by systematic rounding inside each source, by size."""
    parts = int(rated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "tokens", "doc_id"]
    ordered = rated.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    ordered = materialize(ordered, "rated")
    cells = ordered.groupBy("pid", "key").agg(F.sum("rate").alias("w"))
    offsets = cells.select("pid", "key", F.coalesce(F.sum("w").over(Window.partitionBy("key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("offset"))
    run = F.sum("rate").over(Window.partitionBy("pid", "key").orderBy("tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = ordered.withColumn("run", run).join(offsets, ["pid", "key"])
    end = F.floor(F.col("offset") + F.col("run") + 0.5 + 1e-9)
    begin = F.floor(F.col("offset") + F.col("run") - F.col("rate") + 0.5 + 1e-9)
    copies = F.least(F.col("most"), F.greatest(F.lit(0), (end - begin).cast("int")))
    return rows.select("doc_id", "source", "tokens", "rate", copies.alias("copies")).filter("copies > 0")


def shares(copies: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of every listed source."""
    used = copies.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_used"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    every = Window.partitionBy()
    used = used.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(every))
    listed = targets.select("source", F.col("target_weight").alias("weight"), "max_repeats").groupBy("source").agg(F.min(F.struct("weight", "max_repeats")).alias("r")).select("source", "r.*")
    rows = listed.join(used, "source", "left")
    weight = F.when(F.col("tokens").isNotNull(), F.col("weight"))
    return rows.select("source", (weight / F.sum(weight).over(every)).alias("target_share"), "actual_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "most_used", "max_repeats")
