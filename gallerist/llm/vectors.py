"""Binary float32 vectors: decoding, validity, repeated rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 128
MIN_NORM = 1e-8


def raw_matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of exactly ``dim`` floats, and those floats."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    right = np.diff(offsets) == 4 * dim
    if col.null_count:
        right &= ~np.asarray(col.is_null())
    at = np.flatnonzero(right)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    if len(at) < len(col):
        col = col.take(pa.array(at))
    # now all are of one length, and lie one after another
    begin = np.frombuffer(col.buffers()[1], np.int64)[col.offset]
    return at, np.frombuffer(col.buffers()[2], "<f4", len(at) * dim, begin).reshape(len(at), dim)


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    wide = raw.astype(np.float64)
    return wide / np.sqrt((wide * wide).sum(axis=1))[:, None]


def valid_rows(raw: np.ndarray) -> np.ndarray:
    """Mask of the rows of finite numbers with a norm of at least 1e-8."""
    wide = raw.astype(np.float64)
    return np.isfinite(wide).all(axis=1) & (np.sqrt((wide * wide).sum(axis=1)) >= MIN_NORM)


def half_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise half cosine distance of unit rows, in double precision."""
    return np.clip((1.0 - (a * b).sum(axis=1)) / 2.0, 0.0, 1.0)


def _only_valid(dim: int):
    def run(batches):
        for batch in batches:
            at, raw = raw_matrix(batch.column("vector"), dim)
            keep = at[valid_rows(raw)] if len(at) else at
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def right_length(samples: DataFrame, dim: int, id_col: str, vector_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    df = samples.select(F.col(id_col).alias("id"), F.col(vector_col).cast("binary").alias("vector"), *keep)
    return df.filter((F.octet_length("vector") == 4 * dim) & F.col("id").isNotNull())


def vector_facts(samples: DataFrame, dim: int = DIM, id_col: str = "id", vector_col: str = "vector") -> tuple[int, int, bool]:
    """Rows with a vector of the right length, the largest number of identical
    vectors, and whether an id comes with several: hashes only, in the JVM."""
    zero = F.col("vector") == F.lit(bytes(4 * dim))  # invalid, and often many
    hashed = right_length(samples, dim, id_col, vector_col).filter(~zero).select("id", F.xxhash64("vector").alias("h"))
    by_id = hashed.groupBy("id").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    clash = F.max(F.col("low") != F.col("high"))
    same = by_id.groupBy(F.col("low").alias("h")).agg(F.sum("n").alias("rows"), F.count("*").alias("ids"), clash.alias("clash"))
    r = same.agg(F.sum("rows").alias("rows"), F.max("ids").alias("most"), F.max("clash").alias("clash")).first()
    return int(r["rows"] or 0), int(r["most"] or 0), bool(r["clash"])


def valid_vectors(samples: DataFrame, dim: int = DIM, id_col: str = "id", vector_col: str = "vector", keep: tuple[str, ...] = (), clash: bool = True) -> DataFrame:
    """``(id, vector, *keep)`` of the rows with an id and a valid vector.

    Valid means exactly ``dim`` little-endian floats, all finite, with a norm
    of at least 1e-8.  Rows that repeat another one completely stay repeated
    here.  With ``clash`` (see ``vector_facts``) an id that comes with several
    different valid vectors keeps the one with the smallest hash.
    """
    df = right_length(samples, dim, id_col, vector_col, keep)
    df = df.mapInArrow(_only_valid(dim), df.schema)
    if not clash:
        return df
    hashed = df.select("id", F.xxhash64("vector").alias("h"))
    several = hashed.groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("id", "low")
    df = df.withColumn("_h", F.xxhash64("vector")).join(several, "id", "left")
    return df.filter("low IS NULL OR low = _h").drop("_h", "low")
