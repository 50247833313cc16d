"""Choosing a varied subset.

Method: Hilbert-curve systematic selection.  Projected, quantised features
become keys on a Hilbert curve; the distinct keys (cells) are sorted globally,
evenly spaced cells are chosen, and each gives its best record.  As cells, not
records, are counted, a large group of alike records has no more weight than
the room it takes.

A Hilbert key is hierarchical: dropping the last ``dims`` bits gives the key
on the next coarser grid.  One pass computes the finest keys and counts the
occupied cells of every grid; the coarsest grid that has ``SPREAD`` times as
many cells as records are wanted is used.

Scale: ranks come from one range-partitioned sort each, with offsets per
partition, so neither a hot cell nor a hot stratum is gathered in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gallerist.functions.text import key_or_null
from gallerist.llm.vectors import DIM, raw_matrix, unit_rows, valid_vectors, vector_facts
from gallerist.storage import materialize, with_rank

DIMS, BITS = 8, 7
SPREAD = 4
SEED = 515


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows x dims), by the
    transpose algorithm: undo the excess rotations from the top bit down, then
    Gray-encode across the dimensions."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(dims):
            flip = (x[i] & np.uint64(q)) != 0
            swap = (x[0] ^ x[i]) & low
            x0 = np.where(flip, x[0] ^ low, x[0] ^ swap)
            xi = np.where(flip, x[i], x[i] ^ swap)
            if i:
                x[i] = xi
            x[0] = x0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def _keyed(dim: int, keep: list[str]):
    turn = np.random.default_rng(SEED).standard_normal((dim, DIMS))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            _, raw = raw_matrix(batch.column("vector"), dim)
            y = unit_rows(raw) @ turn  # standard normal for vectors of any direction
            cells = np.clip(np.floor((y / 6.0 + 0.5) * (1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.record_batch([batch.column(c) for c in keep] + [pa.array(hilbert_keys(cells, BITS))], [*keep, "key"])

    return run


def allocate(strata: DataFrame, k: int) -> DataFrame:
    """``(stratum, places)`` of ``strata(stratum, cells, n)``, with a total of
    ``k``, or all records if there are fewer.

    One place each, the rest in proportion to the square root of the occupied
    cells, by largest remainders; places that a small stratum can't fill go to
    the others in the same way.  With fewer places than strata those with most
    cells get one.  However many strata there are, only sums leave the cluster.
    """
    now = materialize(strata.select("stratum", "cells", "n", F.lit(0).cast("bigint").alias("places")), "strata")
    while True:
        free = F.col("places") < F.col("n")
        s = now.agg(F.sum("n").alias("n"), F.sum("places").alias("given"), F.count_if(free).alias("free"), F.sum(F.when(free, F.sqrt("cells"))).alias("weight")).first()
        left = min(k, s["n"] or 0) - (s["given"] or 0)
        if left <= 0:
            return now.select("stratum", "places")
        open_, full = now.filter(free), now.filter(~free)
        if left <= s["free"]:
            rank = with_rank(open_.withColumn("less", -F.col("cells")), ["less", "stratum"])
            now = rank.select("stratum", "cells", "n", (F.col("places") + (F.col("rank") < left).cast("bigint")).alias("places")).unionByName(full)
        else:
            exact = F.lit(float(left - s["free"])) * F.sqrt("cells") / F.lit(s["weight"])
            shared = materialize(open_.withColumn("whole", F.floor(exact)).withColumn("less", F.floor(exact) - exact), "shares")
            more = left - s["free"] - shared.agg(F.sum("whole")).first()[0]
            given = F.col("places") + 1 + F.col("whole") + (F.col("rank") < int(more)).cast("bigint")
            now = with_rank(shared, ["less", "stratum"]).select("stratum", "cells", "n", F.least("n", given).alias("places")).unionByName(full)
        now = materialize(now, "strata")


def varied_subset(samples: DataFrame, strata: DataFrame, share: float | None = None, size: int | None = None, score: Column | None = None, dim: int = DIM) -> DataFrame:
    """``(id, stratum, cell, score)`` of a varied selection.

    Exactly ``size`` records (or ``share`` of the valid ones, rounded up), or
    all if there are fewer.  ``strata(id, stratum)`` assigns records to
    strata; records without one form a stratum of their own (null).  Each
    stratum present gets at least one place as long as places last.  In a
    stratum the cells are ranked along the curve; if it has more places than
    cells, all cells give their best record, and the further places go to the
    second best of evenly spaced cells, and so on.  Best is the highest
    ``score`` (nulls last), then the smallest id.  Invalid vectors take no
    part; a repeated row counts once.
    """
    extra = samples.withColumn("_score", score if score is not None else F.lit(None).cast("double"))
    clean = valid_vectors(extra, dim, keep=("_score",), clash=vector_facts(samples, dim)[2])
    keyed = clean.mapInArrow(_keyed(dim, ["id", "_score"]), "id string, _score double, key bigint")
    keyed = keyed.groupBy("id").agg(F.max("_score").alias("score"), F.min("key").alias("key"))
    keyed = materialize(keyed.join(strata.groupBy("id").agg(F.min("stratum").alias("stratum")), "id", "left"), "keys")
    grids = [F.approx_count_distinct(F.shiftrightunsigned("key", DIMS * (BITS - b))).alias(f"g{b}") for b in range(1, BITS + 1)]
    seen = keyed.agg(F.count("*").alias("n"), *grids).first()
    k = size if size is not None else math.ceil((share or 0.0) * seen["n"])
    bits = next((b for b in range(1, BITS + 1) if seen[f"g{b}"] >= SPREAD * k), BITS)
    rows = keyed.select("id", "score", "stratum", F.shiftrightunsigned("key", DIMS * (BITS - bits)).alias("cell"))
    cells = rows.groupBy("stratum").agg(F.countDistinct("cell").alias("cells"), F.count("*").alias("n"))
    quota = allocate(cells, k).filter("places > 0")
    rows = rows.withColumn("order", -F.coalesce("score", F.lit(-1e300)))
    layered = with_rank(rows, ["order", "id"], within=["stratum", "cell"], name="layer")
    layered = materialize(layered.alias("r").join(quota.alias("q"), F.col("r.stratum").eqNullSafe(F.col("q.stratum"))).select("r.*", "q.places").filter("layer < places"), "layers")
    from pyspark.sql import Window

    counts = layered.groupBy("stratum", "layer").agg(F.count("*").alias("n"), F.max("places").alias("places"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("stratum").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("take", F.least(F.col("n"), F.col("places") - before)).filter("take > 0").drop("places")
    kept = layered.alias("r").join(counts.alias("c"), F.col("r.stratum").eqNullSafe(F.col("c.stratum")) & (F.col("r.layer") == F.col("c.layer")))
    kept = kept.select("r.id", "r.score", "r.stratum", "r.cell", "r.layer", "c.n", "c.take")
    ranked = with_rank(kept, ["cell", "id"], within=["stratum", "layer"])
    # rank r of n is chosen if an even step falls on it
    step = F.floor((F.col("rank") + 1) * F.col("take") / F.col("n")) - F.floor(F.col("rank") * F.col("take") / F.col("n"))
    return ranked.filter(step > 0).select("id", "stratum", "cell", "score")


def sample_conditions(manifest: DataFrame) -> DataFrame:
    """``(id, stratum)``: the condition under which a sample's picture was taken,
    by ``manifest.sample_id``; spellings are folded, several conditions of one
    sample give the first in order, and values that name none give no row."""
    condition = F.regexp_replace(key_or_null("condition"), "[_-]", "")
    return manifest.filter("sample_id IS NOT NULL").select(F.col("sample_id").alias("id"), condition.alias("stratum")).filter("stratum IS NOT NULL").distinct()


def sample_score() -> Column:
    """Quality of a sample from its JSON: accepted first, then by focus; null
    if the JSON is broken or missing."""
    focus = F.expr("try_cast(get_json_object(quality, '$.focus_score') AS DOUBLE)")
    accepted = F.get_json_object("quality", "$.accepted") == "true"
    return F.when(focus.isNotNull() & ~F.isnan(focus), focus + F.when(accepted, 10.0).otherwise(0.0))
