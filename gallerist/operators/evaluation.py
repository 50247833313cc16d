"""Evaluation of open-set and one-to-one attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gallerist.functions.stats import rate, support_needed, wilson_high, wilson_low
from gallerist.storage import materialize


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def with_interval(df: DataFrame, name: str, k: Column, n: Column, digits: int = 6) -> DataFrame:
    """Count, total, rate and 95 % bounds of a proportion as columns."""
    return df.withColumns({f"{name}_count": k, f"{name}_total": n, f"{name}_rate": F.round(rate(k, n), digits), f"{name}_low": F.round(wilson_low(k, n), digits), f"{name}_high": F.round(wilson_high(k, n), digits)})


def summary_counts() -> list[Column]:
    """Aggregates of records (expected, predicted, status, ms).

    Known attempts that were not recognised count as rejected; unknown ones
    are also counted among the usable attempts only."""
    known, usable = F.col("expected").isNotNull(), F.col("status") == "recognized"
    said = F.col("predicted").isNotNull()
    right = said & (F.col("predicted") == F.col("expected"))
    return [
        F.count("*").alias("attempts"),
        count_if(known).alias("known_attempts"),
        count_if(known & right).alias("known_correct"),
        count_if(known & ~said).alias("known_rejected"),
        count_if(known & said & ~right).alias("known_misidentified"),
        count_if(~known).alias("unknown_attempts"),
        count_if(~known & usable).alias("unknown_usable"),
        count_if(~known & said).alias("unknown_false_accepts"),
        count_if(~known & usable & ~said).alias("unknown_correct_rejections"),
        count_if(~usable).alias("acquisition_failures"),
    ]


def running_sums(df: DataFrame, sums: list[str], order: str, within: list[str] = ()) -> DataFrame:
    """Running sums by ``order`` inside ``within``, current row included, in
    one sort by ranges plus an offset per partition; ``order`` is distinct
    inside ``within``.  Adds ``run_<name>`` columns."""
    keys = [*within, order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.repartitionByRange(parts, *keys).withColumn("_pid", F.spark_partition_id()), "sums")
    cells = rows.groupBy("_pid", *within).agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    before = Window.partitionBy(*within).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_pid", *within, *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums])
    inside = Window.partitionBy("_pid", *within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums]).join(cells, ["_pid", *within])
    return rows.select(*df.columns, *[(F.col(f"_in_{s}") + F.col(f"_before_{s}")).alias(f"run_{s}") for s in sums])


def roc(pairs: DataFrame) -> DataFrame:
    """Operating points of ``pairs(distance, genuine)``: at every distinct
    distance, accepting up to it, the running true and false accepts and their
    rates.  Pairs without distance or truth take no part."""
    p = pairs.filter("distance IS NOT NULL AND genuine IS NOT NULL")
    points = p.groupBy("distance").agg(count_if(F.col("genuine")).alias("g"), count_if(~F.col("genuine")).alias("i"))
    sums = running_sums(points, ["g", "i"], "distance")
    totals = points.agg(F.sum("g").alias("genuine"), F.sum("i").alias("impostor"))
    return sums.join(F.broadcast(totals)).select("distance", F.col("run_g").alias("true_accepts"), F.col("run_i").alias("false_accepts"), rate(F.col("run_g"), F.col("genuine")).alias("tar"), rate(F.col("run_i"), F.col("impostor")).alias("far"), F.col("genuine"), F.col("impostor"), "g", "i")


def auc(points: DataFrame) -> DataFrame:
    """Area under a ROC by trapezoids, from the point where nothing is accepted.

    A step from (far', tar') to (far, tar) adds (far - far')(tar + tar') / 2;
    both primes follow from the row's own counts."""
    tar0 = (F.col("true_accepts") - F.col("g")) / F.col("genuine")
    step = F.col("i") / F.col("impostor")
    return points.agg(F.sum(step * (F.col("tar") + tar0) / 2).alias("auc"))


def tar_at_far(points: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    """Best true accept rate at each false accept rate, where there are enough
    impostors to estimate it: highest tar, then lowest far, then lowest
    distance."""
    rows = [F.struct(F.lit(x).alias("target"), F.lit(support_needed(x)).alias("needed")) for x in targets]
    p = points.withColumn("t", F.explode(F.array(*rows))).select("*", "t.target", "t.needed")
    pick = F.struct(F.col("tar"), -F.col("far"), -F.col("distance"))
    best = F.max(F.when(F.col("far") <= F.col("target"), F.struct(F.col("tar").alias("tar"), (-F.col("far")).alias("nf"), (-F.col("distance")).alias("nd"))))
    del pick
    g = p.groupBy("target", "needed").agg(F.max("impostor").alias("impostor"), best.alias("b"))
    enough = F.col("impostor") >= F.col("needed")
    return g.select("target", "needed", "impostor", F.when(enough, "estimated").otherwise("insufficient samples").alias("status"), F.when(enough, F.coalesce("b.tar", F.lit(0.0))).alias("tar"), F.when(enough, -F.col("b.nd")).alias("distance"))
