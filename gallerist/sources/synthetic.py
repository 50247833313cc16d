"""Synthetic galleries of unit vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gallery(spark: SparkSession, identities: int, profile: tuple[int, ...] = (3,), dim: int = 128, seed: int = 42) -> DataFrame:
    """``(identity, template, vector)``: seeded normal vectors at length one;
    identity i has ``profile[i mod len(profile)]`` templates."""
    sizes = F.array(*[F.lit(n) for n in profile])
    n = F.element_at(sizes, (F.col("id") % len(profile) + 1).cast("int"))
    rows = spark.range(identities).select(F.col("id").alias("identity"), F.explode(F.sequence(F.lit(0), n - 1)).alias("j"))
    rows = rows.select("identity", (F.col("identity") * max(profile) + F.col("j")).alias("template"))

    def normal(i):
        # Box-Muller on two hashes, so that a value depends on its place only
        u = lambda s: (F.pmod(F.xxhash64(F.lit(seed), F.lit(s), "template", i), F.lit(1 << 52)) + 1) / float((1 << 52) + 2)
        return F.sqrt(-2.0 * F.ln(u(1))) * F.cos(6.283185307179586 * u(2))

    raw = rows.withColumn("v", F.transform(F.sequence(F.lit(1), F.lit(dim)), normal))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return raw.withColumn("n", length).select("identity", "template", F.transform("v", lambda x: x / F.col("n")).alias("vector"))
