"""Exact search of a stated set of probes in a gallery of templates.

Every identity has one or more templates; an identity's score for a probe is
an aggregate of the distances to its templates.  The probes are a stated query
set: they are written in blocks to shared storage, and every gallery
partition, which holds whole identities, is compared with one block after the
other as matrix products, so no pair of rows is ever materialised, no probe
passes through the driver, and the gallery is read and shuffled once.  Only
the best identities of each partition leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gallerist.functions import vectors as V
from gallerist.storage import new_folder

#: Probes of a block, about.
BLOCK = 20_000
#: Distances computed at once (32 bytes each, with the copies): bounds the
#: templates that are compared together, but never splits an identity.
AT_ONCE = 3_000_000
#: Templates for which a task goes through the blocks of probes.
CHUNK = 16_384
STRATEGIES = ("nearest", "mean", "median", "topk_mean", "topk_median")


def aggregate(distances: np.ndarray, strategy: str, k: int) -> np.ndarray:
    """Scores from template distances along the last axis."""
    if strategy == "nearest":
        return distances.min(axis=-1)
    if strategy.startswith("topk"):
        n = min(k, distances.shape[-1])
        if n < distances.shape[-1]:
            distances = np.partition(distances, n - 1, axis=-1)[..., :n]
    return distances.mean(axis=-1) if strategy.endswith("mean") else np.median(distances, axis=-1)


def _unit_matrix(col) -> np.ndarray:
    """Unit rows of a column of equally long lists of numbers."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    rows = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _usable(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.col("vector").cast("array<double>").alias("vector")).filter("vector IS NOT NULL AND size(vector) > 0 AND exists(vector, x -> x <> 0)")


def _write_probes(probes: DataFrame) -> str:
    """Folder of the blocks of probes."""
    queries = _usable(probes, "probe")
    blocks = max(1, -(-queries.count() // BLOCK))
    path = new_folder(probes.sparkSession, "probes")
    queries.withColumn("block", F.pmod(F.xxhash64("probe"), F.lit(blocks))).repartition(blocks, "block").write.partitionBy("block").parquet(path)
    return path


class _Probes:
    """Blocks of probes of a folder; a single one is kept."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        self.files: dict[str, list[str]] = {}
        for info in self.fs.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.path.endswith(".parquet"):
                self.files.setdefault(info.path.rsplit("/", 2)[1], []).append(info.path)
        self.only = self._read(*self.files.values()) if len(self.files) == 1 else None

    def _read(self, paths: list[str]):
        import pyarrow.parquet as pq

        table = pa.concat_tables([pq.ParquetFile(self.fs.open_input_file(p)).read(use_threads=False) for p in sorted(paths)])
        return table.column("probe").to_numpy(), _unit_matrix(table.column("vector"))

    def __iter__(self):
        if self.only is not None:
            yield self.only
        else:
            yield from map(self._read, self.files.values())


def _whole_identities(batches, rows: int):
    """Tables of whole identities, of about ``rows`` rows, from sorted batches."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            name = table.column("identity").to_numpy()
            other = np.flatnonzero(name != name[-1])
            if len(other):
                yield table.slice(0, other[-1] + 1)
                held = table.slice(other[-1] + 1).to_batches()
                count -= int(other[-1]) + 1
    if held:
        yield pa.Table.from_batches(held)


def _compared(path: str, each):
    """mapInArrow body: ``each(ids, table, starts, sizes, distances)`` for every
    block of probes and pack of whole identities."""

    def run(batches):
        probes = None
        for table in _whole_identities(batches, CHUNK):
            probes = probes or _Probes(path)
            units, name = _unit_matrix(table.column("vector")), table.column("identity").to_numpy()
            begin = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            end = np.append(begin[1:], len(name))
            for ids, queries in probes:
                most, at = max(64, AT_ONCE // len(ids)), 0
                while at < len(begin):
                    to = max(at + 1, int(np.searchsorted(end, begin[at] + most, "right")))
                    a, b = begin[at], end[to - 1]
                    d = np.clip((1.0 - queries @ units[a:b].T) / 2.0, 0.0, 1.0)
                    yield from each(ids, table.slice(a, b - a), begin[at:to] - a, end[at:to] - begin[at:to], d)
                    at = to

    return run


def _cubes(starts: np.ndarray, sizes: np.ndarray, d: np.ndarray):
    """(identities, first templates, distances by probe, identity, template) of
    the identities with equally many templates."""
    for n in np.unique(sizes):
        which = np.flatnonzero(sizes == n)
        at = starts[which][:, None] + np.arange(n)
        yield which, at, d[:, at.ravel()].reshape(len(d), len(which), n)


def _templates(gallery: DataFrame) -> DataFrame:
    """Gallery rows by whole identities: one shuffle serves the removal of
    repeated templates and the scoring."""
    tasks = int(gallery.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _usable(gallery, "identity", "template").repartition(tasks, "identity").dropDuplicates(["identity", "template"]).sortWithinPartitions("identity", "template")


def identity_scores(probes: DataFrame, gallery: DataFrame, strategies: tuple[tuple[str, int], ...] = (("topk_median", 3),), best: int | None = None) -> DataFrame:
    """``(probe, identity, strategy, k, score)``.

    ``probes(probe BIGINT, vector)`` and ``gallery(identity, template,
    vector)`` hold arrays of one dimension; rows with a null or zero vector
    take no part, and a repeated template counts once.  With ``best``, only
    that many best identities of each probe and strategy are kept (ties by
    identity).  An empty side gives an empty result.
    """
    kind = gallery.schema["identity"].dataType.simpleString()

    def each(ids, table, starts, sizes, d):
        names = table.column("identity").take(pa.array(starts))
        tables = {s: np.empty((len(ids), len(sizes))) for s in strategies}
        for which, _, cube in _cubes(starts, sizes, d):
            for s in strategies:
                tables[s][:, which] = aggregate(cube, *s)
        n = len(sizes) if best is None else min(best, len(sizes))
        for (strategy, k), scores in tables.items():
            order = np.argsort(scores, axis=1, kind="stable")[:, :n] if n < len(sizes) else np.broadcast_to(np.arange(n), scores.shape)
            rows = len(ids) * n
            yield pa.record_batch([
                pa.array(np.repeat(ids, n)), names.take(pa.array(order.ravel())).combine_chunks(), pa.array([strategy]).take(pa.array(np.zeros(rows, np.int32))),
                pa.array(np.full(rows, k, np.int32)), pa.array(np.take_along_axis(scores, order, 1).ravel()),
            ], ["probe", "identity", "strategy", "k", "score"])

    out = _templates(gallery).mapInArrow(_compared(_write_probes(probes), each), f"probe bigint, identity {kind}, strategy string, k int, score double")
    if best is None:
        return out
    rank = F.row_number().over(Window.partitionBy("probe", "strategy", "k").orderBy("score", "identity"))
    return out.withColumn("r", rank).filter(F.col("r") <= best).drop("r")


def nearest_per_identity(probes: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """``(probe, identity, template, distance, place)``: the ``k`` nearest
    templates of every identity, places from 1, ties by template; rows as for
    ``identity_scores``."""
    kind, other = (gallery.schema[c].dataType.simpleString() for c in ("identity", "template"))

    def each(ids, table, starts, sizes, d):
        for which, at, cube in _cubes(starts, sizes, d):
            n = min(k, cube.shape[2])
            order = np.argsort(cube, axis=2, kind="stable")[:, :, :n]
            rows = (at[None, :, :1] + order).ravel()
            part = table.take(pa.array(rows)).combine_chunks()
            yield pa.record_batch([
                pa.array(np.repeat(ids, len(which) * n)), part.column("identity").combine_chunks(), part.column("template").combine_chunks(),
                pa.array(np.take_along_axis(cube, order, 2).ravel()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(ids) * len(which))),
            ], ["probe", "identity", "template", "distance", "place"])

    return _templates(gallery).mapInArrow(_compared(_write_probes(probes), each), f"probe bigint, identity {kind}, template {other}, distance double, place int")


def scalar_scores(probes: DataFrame, gallery: DataFrame, k: int = 3, rows: int = 64) -> DataFrame:
    """``(probe, identity, scalar)``: the median of the ``k`` nearest templates
    by column expressions, template after template.  A second plan for the
    default score of ``identity_scores``, to compare the two; the probes meet
    the identities in blocks of about ``rows``."""
    queries = _usable(probes, "probe").withColumn("v", V.unit(F.col("vector")))
    blocks = queries.groupBy(F.pmod(F.xxhash64("probe"), F.lit(max(1, queries.count() // rows)))).agg(F.collect_list(F.struct("probe", "v")).alias("ps")).select("ps")
    people = _templates(gallery).groupBy("identity").agg(F.collect_list(V.unit(F.col("vector"))).alias("vs"))
    pairs = people.crossJoin(blocks).select("identity", "vs", F.explode("ps").alias("p"))
    near = F.slice(F.array_sort(F.transform("vs", lambda v: V.clip01((1 - V.dot(F.col("p.v"), v)) / 2))), 1, k)
    n = pairs.select("p.probe", "identity", near.alias("n"))
    middle = lambda up: F.element_at("n", F.floor((F.size("n") + up) / 2).cast("int"))
    return n.select("probe", "identity", ((middle(1) + middle(2)) / 2).alias("scalar"))


def accepted(best: Column, second: Column, threshold: float | Column, margin: float | Column) -> Column:
    """Inclusive threshold, and a lead over the runner-up (if there is one)."""
    lead = second.isNull() | (second - best >= margin) | (F.abs(second - best - margin) <= 1e-12)
    return (best <= threshold) & lead


def decide(scores: DataFrame, threshold: float, margin: float) -> DataFrame:
    """``(probe, candidate, best, second, known, name, similarity)`` from scores:
    the best identity of each probe (ties by identity), accepted or not."""
    from gallerist.functions.vectors import similarity

    order = Window.partitionBy("probe").orderBy("score", "identity")
    ranked = scores.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).filter("r = 1")
    known = accepted(F.col("score"), F.col("second"), threshold, margin)
    return ranked.select("probe", F.col("identity").alias("candidate"), F.col("score").alias("best"), "second", known.alias("known"), F.when(known, F.col("identity")).alias("name"), similarity(F.col("score")).alias("similarity"))
