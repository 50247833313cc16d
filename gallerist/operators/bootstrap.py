"""Bootstrap over components: whole groups of related subjects are resampled.

A resample draws as many components as there are, with replacement, which
gives each component a multinomial count; here each count is an independent
Poisson variable of mean one per (component, iteration), the usual form for
distributed data, drawn from a hash so that it is reproducible.  The rows are
components, with their sums, and every component meets every iteration inside
one row; nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.functions.stats import rate

#: Cumulative Poisson(1) probabilities of 0..6 draws.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
LEAST_COMPONENTS = 20


def component_interval(counts: DataFrame, iterations: int = 2000, seed: int = 0) -> DataFrame:
    """``(components, rate, low, high, status)`` of sum(hits) / sum(total).

    The interval is the central 95 % of the resampled rates; it is null, with
    a status saying why, for fewer than ``LEAST_COMPONENTS`` components, an
    empty denominator, or rates that are all equal.
    """
    per_task = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("it")
    draw = F.pmod(F.xxhash64(F.lit(seed), "component", "it"), F.lit(1 << 52)) / float(1 << 52)
    n = sum(((draw >= p).cast("int") for p in POISSON), F.lit(0))
    runs = counts.select("component", "total", "hits", per_task).select("it", "total", "hits", n.alias("n"))
    rates = runs.groupBy("it").agg(F.sum(F.col("n") * F.col("hits")).alias("h"), F.sum(F.col("n") * F.col("total")).alias("t")).select(rate(F.col("h"), F.col("t")).alias("r"))
    spread = rates.agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count_if(F.col("r").isNull()).alias("empty"), F.min("r").alias("least"), F.max("r").alias("most"))
    whole = counts.agg(F.count("*").alias("components"), F.sum("hits").alias("h"), F.sum("total").alias("t"))
    status = F.when(F.col("components") < LEAST_COMPONENTS, "too_few_components").when(F.coalesce(F.col("t"), F.lit(0)) == 0, "no_attempts").when(F.col("empty") > 0, "empty_resample").when(F.col("least") == F.col("most"), "degenerate").otherwise("estimated")
    out = whole.join(F.broadcast(spread)).withColumn("status", status)
    ok = F.col("status") == "estimated"
    return out.select("components", F.round(rate(F.col("h"), F.col("t")), 6).alias("rate"), F.when(ok, F.round(F.col("q")[0], 6)).alias("low"), F.when(ok, F.round(F.col("q")[1], 6)).alias("high"), "status")
