"""Percentiles with bounded rank error that can be combined.

Method: a summary of n values is a short list of tuples (value, lowest rank,
highest rank).  Partitions summarise their own values, summaries are merged
hierarchically, and every merge is compressed again by dropping tuples while
the ranks stay certain enough.  A merge adds no uncertainty of its own beyond
that of its inputs; compression adds at most n / (size - 1) / 2 ranks.  The
bound that has really accumulated, the largest half gap between the highest
rank of a tuple and the lowest of the one before, is kept with the result, so
it holds without trusting the analysis.  A summary with room for all values
stays exact.

Scale: the data are shuffled once, only to count redelivered rows once, and
only the key and the measured columns; after that only summaries move, and no
merge takes more than ``FAN_IN`` of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.storage import materialize

FAN_IN = 16
#: Frames of a video that are summarised together.
STRETCH = 65_536
SUMMARY = "n bigint, v array<double>, low array<bigint>, high array<bigint>"


def summarize(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact summary of values without NaN."""
    v = np.sort(np.asarray(values, float))
    rank = np.arange(1, len(v) + 1)
    return v, rank, rank.copy()


def merge(a, b):
    """Summary of the union; ``a`` stands before ``b`` among equal values."""
    (va, la, ha), (vb, lb, hb) = a, b
    if not len(va) or not len(vb):
        return b if len(vb) else a
    na, nb = ha[-1], hb[-1]
    before, after = np.searchsorted(vb, va, "left"), np.searchsorted(vb, va, "left")
    low_a = la + np.where(before > 0, lb[np.maximum(before - 1, 0)], 0)
    high_a = ha + np.where(after < len(vb), hb[np.minimum(after, len(vb) - 1)] - 1, nb)
    before, after = np.searchsorted(va, vb, "right"), np.searchsorted(va, vb, "right")
    low_b = lb + np.where(before > 0, la[np.maximum(before - 1, 0)], 0)
    high_b = hb + np.where(after < len(va), ha[np.minimum(after, len(va) - 1)] - 1, na)
    v, low, high = np.concatenate([va, vb]), np.concatenate([low_a, low_b]), np.concatenate([high_a, high_b])
    order = np.argsort(v, kind="stable")
    return v[order], low[order], high[order]


def compress(s, size: int):
    """At most ``size`` tuples: the ends, and those nearest to an even grid of ranks."""
    v, low, high = s
    if len(v) <= size:
        return s
    grid = np.linspace(1, high[-1], size)
    middle = (low + high) / 2
    at = np.clip(np.searchsorted(middle, grid), 1, len(v) - 1)
    at = np.where(grid - middle[at - 1] <= middle[at] - grid, at - 1, at)
    keep = np.unique(np.concatenate([[0], at, [len(v) - 1]]))
    return v[keep], low[keep], high[keep]


def error_bound(s) -> float:
    """Ranks by which the answer to any rank can be off at most."""
    _, low, high = s
    if len(low) < 2:
        return 0.0 if not len(low) else float(high[0] - low[0])
    return float(max((high[1:] - low[:-1]).max() / 2.0, (high - low).max() / 2.0)) if (high - low).max() or (np.diff(low) > 1).any() else 0.0


def query(s, p: float) -> float:
    """Value at rank ceil(p n) within the error bound."""
    v, low, high = s
    if not len(v):
        return math.nan
    rank = max(1, math.ceil(p * high[-1] - 1e-9))
    return float(v[np.argmin(np.maximum(rank - low, high - rank))])


def _open(v, low, high):
    """A stored summary; one without ranks is exact."""
    v = np.asarray(v, float)
    if not len(low):
        rank = np.arange(1, len(v) + 1)
        return v, rank, rank
    return v, np.asarray(low, np.int64), np.asarray(high, np.int64)


def _stored(s) -> tuple:
    """A summary as stored: ranks are left out while they are 1, 2, 3, ..."""
    v, low, high = s
    exact = len(v) == (high[-1] if len(v) else 0)
    return (v, low[:0], high[:0]) if exact else s


def _runs(batches, keys: list[str]):
    """(key values, table) of runs of equal keys over batches sorted by them."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            same = c[1:] == c[:-1]
            if c.dtype == object:
                same = np.asarray(same, bool) | np.array([x is None and y is None for x, y in zip(c[1:], c[:-1])], bool)
            change |= ~np.asarray(same, bool)
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(batch.column(k)[int(a)].as_py() for k in keys) if not held or a or tuple(batch.column(k)[0].as_py() for k in keys) != now else now
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _fields(df: DataFrame, keys: list[str]) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    part = df.select(*keys).schema
    arrow = list(to_arrow_schema(part)) + [pa.field("n", pa.int64()), pa.field("v", pa.list_(pa.float64())), pa.field("low", pa.list_(pa.int64())), pa.field("high", pa.list_(pa.int64()))]
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in part] + [SUMMARY]), pa.schema(arrow)


def _emit(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _emitted(results, schema: pa.Schema):
    rows, size = [], 0
    for r in results:
        rows.append(r)
        size += len(r[-3]) + 1
        if size > 200_000:
            yield _emit(rows, schema)
            rows, size = [], 0
    if rows:
        yield _emit(rows, schema)


def summaries(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """One summary ``(*keys, n, v, low, high)`` for each run of equal keys of
    ``rows(*keys, value)``, which are sorted by the keys inside partitions.

    A run should be of bounded length: cut large groups by a further key.
    """
    ddl, schema = _fields(rows, keys)

    def run(batches):
        yield from _emitted(((*k, t.num_rows, *_stored(compress(summarize(t.column("value").to_numpy()), size))) for k, t in _runs(batches, keys)), schema)

    return rows.mapInArrow(run, ddl)


def merge_summaries(parts: DataFrame, keys: list[str], size: int, slices: int) -> DataFrame:
    """One summary for each group from summaries in numbered ``_slice``s.

    Each round merges about ``FAN_IN`` neighbouring slices of a group, until
    one is left; with one slice there is nothing to merge.
    """
    ddl, schema = _fields(parts, [*keys, "_slice"])
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def merged(tables):
        for k, t in tables:
            s = [_open(*x) for x in zip(*(t.column(c).to_pylist() for c in ("v", "low", "high")))]
            s.sort(key=lambda x: (len(x[0]), x[0].tobytes(), x[1].tobytes()))  # any order of arrival gives one result
            while len(s) > 1:
                s = [merge(*s[i : i + 2]) if i + 1 < len(s) else s[i] for i in range(0, len(s), 2)]
            yield (*k, sum(t.column("n").to_pylist()), *_stored(compress(s[0], size)))

    def run(batches):
        yield from _emitted(merged(_runs(batches, [*keys, "_slice"])), schema)

    while slices > 1:
        slices = -(-slices // FAN_IN)
        parts = parts.withColumn("_slice", F.floor(F.col("_slice") / FAN_IN).cast("int")).select(*keys, "_slice", "n", "v", "low", "high")
        parts = parts.repartition(tasks, *keys, "_slice").sortWithinPartitions(*keys, "_slice").mapInArrow(run, ddl)
    return parts.drop("_slice")


def percentile_columns(summary: DataFrame, percentiles: tuple[float, ...]) -> DataFrame:
    """Percentile columns p50, p99, ... and ``max_rank_error`` of summaries."""
    keys = [f.name for f in summary.schema if f.name not in ("n", "v", "low", "high")]
    names = ["p" + format(100 * p, "g").replace(".", "_") for p in percentiles]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in summary.select(*keys).schema] + ["n bigint"] + [f"{x} double" for x in names] + ["max_rank_error double"])

    def run(batches):
        for pdf in batches:
            s = [_open(*x) for x in zip(pdf["v"], pdf["low"], pdf["high"])]
            out = pdf[[*keys, "n"]].copy()
            for name, p in zip(names, percentiles):
                out[name] = [query(x, p) for x in s]
            out["max_rank_error"] = [error_bound(x) for x in s]
            yield out

    return summary.mapInPandas(run, schema)


def frame_measures(frames: DataFrame) -> DataFrame:
    """``(video, day, metric, _slice, value)`` of analysed frames, sorted by
    these keys inside partitions.

    A redelivered frame counts once; day is the date of reception.  Null, NaN,
    infinite and negative values are no measurements.  ``_slice`` numbers the
    stretches of ``STRETCH`` frames of a video; a stretch is in one partition,
    so a long video is spread and a short one is together.
    """
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = frames.filter("video IS NOT NULL AND frame IS NOT NULL").select("video", "frame", "received_at", "processing_ms", "timestamp", F.greatest(F.lit(0), F.floor(F.col("frame") / STRETCH)).cast("int").alias("_slice"))
    once = rows.repartition(parts, "video", "_slice").groupBy("video", "_slice", "frame").agg(F.min(F.struct("received_at", "processing_ms", "timestamp")).alias("r"))
    both = F.array(F.struct(F.lit("processing_ms").alias("metric"), F.col("r.processing_ms").alias("value")), F.struct(F.lit("timestamp").alias("metric"), F.col("r.timestamp").alias("value")))
    m = once.select("video", F.to_date("r.received_at").alias("day"), F.explode(both).alias("m"), "_slice").select("video", "day", "m.metric", "_slice", "m.value")
    return m.filter("value >= 0 AND NOT isnan(value) AND value < double('infinity')").sortWithinPartitions("video", "day", "metric", "_slice")


def frame_summaries(frames: DataFrame, exports: DataFrame, error: float = 0.001, size: int | None = None) -> DataFrame:
    """Day summaries ``(video, engine, day, metric, n, v, low, high)``.

    ``error`` bounds the rank error as a share of n over all levels of merges.
    With ``size`` a summary has so many tuples at most instead.  A video
    without an export row has a null engine.
    """
    slices = int(frames.agg(F.max("frame")).first()[0] or 0) // STRETCH + 1
    size = size or _size(slices, error)
    keys = ["video", "day", "metric"]
    parts = merge_summaries(summaries(frame_measures(frames), [*keys, "_slice"], size), keys, size, slices)
    engine = exports.groupBy("video").agg(F.min("engine").alias("engine"))
    return parts.join(engine, "video", "left").select("video", "engine", "day", "metric", "n", "v", "low", "high")


def _size(slices: int, error: float) -> int:
    """Tuples at which the compressions of all levels stay within ``error``."""
    levels = 1 + (math.ceil(math.log(slices, FAN_IN)) if slices > 1 else 0)
    return max(1_000, math.ceil(2 * levels / error))


def combined(summary: DataFrame, keys: list[str], error: float = 0.001) -> DataFrame:
    """Summaries of coarser groups, made of finished summaries only."""
    slices = FAN_IN**3
    parts = materialize(summary, "summaries").withColumn("_slice", F.pmod(F.xxhash64("video", "day"), F.lit(slices)).cast("int"))
    return merge_summaries(parts.select(*keys, "_slice", "n", "v", "low", "high"), keys, _size(slices, error), slices)


def rank_errors(answers: DataFrame, measures: DataFrame, percentiles: dict[str, float], keys: list[str]) -> DataFrame:
    """``(*keys, n, most_error, within)``: how many ranks the percentile columns
    of ``answers`` are off the exact ones of ``measures(*keys, value)`` at most,
    and whether ``max_rank_error`` bounds that.  Only counts are taken, so it is
    as distributed as the answers."""
    on = [F.col(f"m.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    joined = measures.alias("m").join(answers.alias("a"), on)
    counts = [F.count_if(F.col("value") < F.col(c)).alias(f"{c}_below") for c in percentiles] + [F.count_if(F.col("value") <= F.col(c)).alias(f"{c}_to") for c in percentiles]
    g = joined.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.max("n").alias("n"), F.max("max_rank_error").alias("bound"), *counts)
    off = []
    for c, p in percentiles.items():
        rank = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n") - 1e-9))
        off.append(F.greatest(F.lit(0), F.col(f"{c}_below") + 1 - rank, rank - F.col(f"{c}_to")))
    most = F.greatest(*off) if len(off) > 1 else off[0]
    return g.select(*keys, "n", most.alias("most_error"), (most <= F.col("bound")).alias("within"))
