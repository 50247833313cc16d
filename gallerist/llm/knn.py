"""Most similar vectors for every vector.

Method: the vectors are projected by a 2-stable (Gaussian) random matrix onto
a few dimensions, and a kd-tree over the projections cuts the collection into
leaves.  A query takes leaves in the order of their projected distance,
verifies the members with exact distances, and stops as soon as a chi-square
test says that no remaining leaf is likely to hold a nearer one: for a point
at squared distance r2, the squared projected difference over c dimensions is
r2 times a chi-square variable with c degrees of freedom, and the point has to
lie on the far side in all c dimensions, so a leaf that is separated from the
query in c dimensions by a squared gap g2 is visited only while

    P(chi2_c >= g2 / r2) / 2^c  >=  miss

where r2 is the distance of the query's k-th neighbour so far (or the range
limit).  ``miss`` is the accuracy parameter.
A pair missed from one side is mostly found from the other, so both directions
of every pair compete for the places.

Scale: the upper planes are fitted on a bounded sample of projections and cut
the collection into blocks; every row is indexed, and inside a block the tree
goes on over the block's own rows, so a leaf stays small at every size.  The
index is one table in shared storage, one file a block, written with a single
shuffle; a search task holds the queries of one block and reads the blocks its
tests ask for, which it finds by going down the upper tree, so no vector is
ever sent to more than one place.  Groups of more than ``k + 1`` byte-identical vectors,
however large, are reduced to their ``k + 1`` smallest ids before indexing,
which is exact, since no other copy can be among anyone's k nearest.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gallerist.llm.vectors import DIM, half_cosine, raw_matrix, unit_rows, valid_vectors, vector_facts
from gallerist.storage import materialize, new_folder

#: Rows of projections, at most, on which the upper planes are fitted, and
#: upper levels at most (2^14 doubles are broadcast; 16 rows fit each plane).
FIT_ROWS, MAX_TOP = 262_144, 14
#: Rows that a leaf should hold; levels of the tree inside a block at most.
LEAF_ROWS, MAX_LOCAL = 128, 16
#: Rows of a block, about; queries that a task takes at once.
BLOCK_ROWS, PIECE_ROWS = 6_400, 8_192
#: Bytes of index blocks that a worker keeps.
CACHE_BYTES = 112 << 20
SEED = 20_240_601
SLACK = 2e-6


def projection(dim: int, depth: int) -> np.ndarray:
    """Random directions as columns; the first ones are the same for every ``depth``."""
    return np.ascontiguousarray(np.random.default_rng(SEED).standard_normal((max(depth, 1), dim)).T)


def upper_chi_square(c: int, x: np.ndarray) -> np.ndarray:
    """P(chi2_c >= x) for whole c, by the finite series."""
    h = np.asarray(x, float) / 2
    if c % 2 == 0:
        return np.exp(-h) * sum(h**j / math.factorial(j) for j in range(c // 2))
    tail = np.vectorize(math.erfc)(np.sqrt(h))
    return tail + np.exp(-h) * sum(h ** (j - 0.5) / math.gamma(j + 0.5) for j in range(1, (c + 1) // 2))


@lru_cache(maxsize=8)
def stop_ratios(depth: int, miss: float) -> np.ndarray:
    """For c = 0..depth, the largest gap2 / r2 at which a leaf is visited."""
    grid = np.linspace(0, 80, 16_001)
    out = [np.inf]
    for c in range(1, depth + 1):
        open_ = grid[upper_chi_square(c, grid) / 2.0**c >= miss]
        out.append(float(open_[-1]) if len(open_) else 0.0)
    return np.array(out)


def fit_planes(projected: np.ndarray, depth: int) -> list[np.ndarray]:
    """Median planes of a kd-tree that cuts dimension l on level l."""
    leaf, planes = np.zeros(len(projected), np.int64), []
    for level in range(depth):
        y = projected[:, level]
        order = np.lexsort((y, leaf))
        bounds = np.searchsorted(leaf[order], np.arange(2**level + 1))
        cut = np.zeros(2**level)
        for node in range(2**level):
            a, b = bounds[node], bounds[node + 1]
            cut[node] = y[order[(a + b) // 2]] if b > a else 0.0
        planes.append(cut)
        leaf = 2 * leaf + (y > cut[leaf])
    return planes


def leaf_of(projected: np.ndarray, planes: list[np.ndarray]) -> np.ndarray:
    leaf = np.zeros(len(projected), np.int64)
    for level, cut in enumerate(planes):
        leaf = 2 * leaf + (projected[:, level] > cut[leaf])
    return leaf


def gaps(projected: np.ndarray, planes: list[np.ndarray], start=None, node: int = 0, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Squared gap and number of separated dimensions, for each row and leaf.

    With ``start``, the gaps and numbers of one node on ``level``, only the
    leaves below that node are followed.
    """
    n = len(projected)
    g2, c = start if start is not None else (np.zeros((n, 1), np.float32), np.zeros((n, 1), np.int8))
    for depth, cut in enumerate(planes[level:], level):
        width = 1 << (depth - level)
        off = (projected[:, depth][:, None] - cut[None, node * width : (node + 1) * width]).astype(np.float32)
        both_g, both_c = np.empty((n, 2 * width), np.float32), np.empty((n, 2 * width), np.int8)
        both_g[:, 0::2] = g2 + np.square(np.maximum(off, 0))
        both_g[:, 1::2] = g2 + np.square(np.minimum(off, 0))
        both_c[:, 0::2] = c + (off > 0)
        both_c[:, 1::2] = c + (off <= 0)
        g2, c = both_g, both_c
    return g2, c


def open_nodes(y: np.ndarray, planes: list[np.ndarray], reach: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks that some query (row of ``y``) at its present distance has to
    visit: their numbers, squared gaps, separated dimensions, and the least
    squared distance at which one does.  Subtrees without any are left out on
    the way down."""
    nodes = np.zeros(1, np.int64)
    g2, c, least = np.zeros((len(y), 1), np.float32), np.zeros((len(y), 1), np.int8), np.zeros(1)
    for level, cut in enumerate(planes):
        off = (y[:, level][:, None] - cut[nodes][None, :]).astype(np.float32)
        nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
        g2 = np.concatenate([g2 + np.square(np.maximum(off, 0)), g2 + np.square(np.minimum(off, 0))], axis=1)
        c = np.concatenate([c + (off > 0), c + (off <= 0)], axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(g2 > 0, g2 / reach[c], 0)
        keep = (need <= r2[:, None]).any(axis=0)
        nodes, g2, c, least = nodes[keep], g2[:, keep], c[:, keep], need[:, keep].min(axis=0)
    return nodes, g2, c, least


class _Blocks:
    """Index blocks of shared storage, decoded, with a bounded cache."""

    def __init__(self, path: str, dim: int):
        from pyarrow import fs

        self.dim, self.cache, self.held = dim, {}, 0
        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        self.files: dict[int, list[str]] = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.root, recursive=True)):
            if info.path.endswith(".parquet"):
                block = int(info.path.rsplit("block=", 1)[1].split("/", 1)[0])
                self.files.setdefault(block, []).append(info.path)

    def get(self, block: int):
        """ids, leaves, vectors, one over their norms, and planes of the leaves;
        by leaf, then id."""
        if block not in self.cache:
            import pyarrow.parquet as pq

            while self.held > CACHE_BYTES and self.cache:
                self.held -= self.cache.pop(next(iter(self.cache)))[2].nbytes
            self.cache[block] = self._read(pq, self.files.get(block, []))
            self.held += self.cache[block][2].nbytes
        return self.cache[block]

    def _read(self, pq, paths: list[str]):
        if not paths:
            return np.zeros(0, object), np.zeros(0, np.int64), np.zeros((0, self.dim), np.float32), np.zeros(0, np.float32), []
        got = pa.concat_tables([pq.ParquetFile(self.fs.open_input_file(p)).read(["id", "vector", "leaf", "planes"], use_threads=False) for p in sorted(paths)])
        _, raw = raw_matrix(got.column("vector"), self.dim)
        cuts = np.frombuffer(got.column("planes").drop_null()[0].as_py(), "<f8")
        planes = [cuts[(1 << level) - 1 : (2 << level) - 1] for level in range((len(cuts) + 1).bit_length() - 1)]
        # the squares without a copy of the block in double precision
        inverse = (1.0 / np.sqrt(np.einsum("ij,ij->i", raw, raw, dtype=np.float64))).astype(np.float32)
        return got.column("id").to_numpy(zero_copy_only=False), got.column("leaf").to_numpy(), raw, inverse, planes


_OPEN: dict[str, _Blocks] = {}


def _search(path: str, dim: int, planes: list[np.ndarray], k: int, limit: float, miss: float):
    """mapInArrow body: queries of the blocks named in ``block``."""
    top = len(planes)
    turn = projection(dim, top + MAX_LOCAL)
    stop = stop_ratios(top + MAX_LOCAL, miss).astype(np.float32)
    reach = np.maximum.accumulate(stop[::-1])[::-1]  # the best ratio that a node's leaves can have
    low = 1.0 - 2.0 * limit - SLACK  # cosine at the range limit

    def piece(store: _Blocks, block: int, begin: int, end: int):
        ids, leaves, raw, _, _ = store.get(block)
        ids, leaves, exact = ids[begin:end], leaves[begin:end], unit_rows(raw[begin:end])
        units, n = exact.astype(np.float32), end - begin
        y = exact @ turn
        best = np.full((n, k), low, np.float32)  # cosines of the k nearest so far
        kth = best[:, 0].copy()
        r2 = 2.0 - 2.0 * kth
        found, held = [], 0
        nothing = np.zeros((n, 1), np.float32), np.zeros((n, 1), np.int8)

        def order():
            """The own block, then the others that are still open, nearest first."""
            yield block, *nothing, 0.0
            nodes, g2, c, least = open_nodes(y, planes, reach, r2)
            for i in np.argsort(least, kind="stable"):
                if nodes[i] != block:
                    yield int(nodes[i]), g2[:, i : i + 1], c[:, i : i + 1], least[i]

        for at, g2, c, least in order():
            if least > r2.max():
                break
            if at != block:
                with np.errstate(divide="ignore", invalid="ignore"):
                    if not (np.where(g2 > 0, g2 / reach[c], 0)[:, 0] <= r2).any():
                        continue
            t_ids, t_leaves, t_raw, t_inv, local = store.get(at)
            lg, lc = gaps(y[:, top:], local, (g2, c))
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.ascontiguousarray(np.where(lg > 0, lg / stop[lc], 0).T)
            if at == block:
                need[leaves, np.arange(n)] = 0
            if not (need <= r2).any():
                continue
            bounds = np.searchsorted(t_leaves, np.arange(len(need) + 1))
            for leaf in np.argsort(need.min(axis=1), kind="stable"):
                a, b = bounds[leaf], bounds[leaf + 1]
                if a == b:
                    continue
                ask = np.flatnonzero(need[leaf] <= r2)
                if not len(ask):
                    continue
                sims = units[ask] @ t_raw[a:b].T
                sims *= t_inv[a:b]
                if at == block:  # not itself
                    own = begin + ask
                    inside = np.flatnonzero((own >= a) & (own < b))
                    sims[inside, own[inside] - a] = -2.0
                rows = np.flatnonzero(sims.max(axis=1) >= kth[ask] - SLACK)
                if not len(rows):
                    continue
                sims, who = sims[rows], ask[rows]
                tops = sims if b - a <= k else np.partition(sims, b - a - k, axis=1)[:, b - a - k :]
                merged = np.concatenate([best[who], tops], axis=1)
                best[who] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
                kth[who] = best[who].min(axis=1)
                r2[who] = 2.0 - 2.0 * kth[who]
                r, col = np.nonzero(sims >= kth[who][:, None] - SLACK)
                found.append((who[r], t_ids[a:b][col], t_raw[a:b][col], sims[r, col]))
                held += len(r)
            if held > 400_000:
                found, held = _still_near(found, kth)
        if not found:
            return None
        q, other, their, _ = _still_near(found, kth)[0][0]
        d = half_cosine(exact[q], unit_rows(their))
        inside = d <= limit
        q, other, d = q[inside], other[inside], d[inside]
        order = np.lexsort((other, d, q))
        q, other, d = q[order], other[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return ids[q[keep]], other[keep], d[keep]

    def run(batches):
        for batch in batches:
            for block in batch.column("block").to_pylist():
                if path not in _OPEN:
                    _OPEN.clear()
                    _OPEN[path] = _Blocks(path, dim)
                store = _OPEN[path]
                size = len(store.get(block)[0])
                for step in range(0, size, PIECE_ROWS):
                    out = piece(store, block, step, min(step + PIECE_ROWS, size))
                    if out is not None:
                        yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["id", "neighbour", "distance"])

    return run


def _still_near(found: list, kth: np.ndarray) -> tuple[list, int]:
    """The candidates that the present k-th distances leave open, as one piece."""
    q, sims = np.concatenate([x[0] for x in found]), np.concatenate([x[3] for x in found])
    keep = sims >= kth[q] - SLACK
    return [(q[keep], np.concatenate([x[1] for x in found])[keep], np.concatenate([x[2] for x in found])[keep], sims[keep])], int(keep.sum())


def _place(dim: int, planes: list[np.ndarray]):
    turn = projection(dim, len(planes))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            _, raw = raw_matrix(batch.column("vector"), dim)
            block = leaf_of(unit_rows(raw) @ turn, planes) if planes else np.zeros(batch.num_rows, np.int64)
            yield pa.record_batch([batch.column("id"), batch.column("vector"), pa.array(block.astype(np.int32))], ["id", "vector", "block"])

    return run


def _settle(dim: int, top: int, leaf_rows: int):
    """The rows of each block by leaf of the block's own tree, then id; a
    repeated row once.  The first row has the planes, level by level."""
    turn = projection(dim, top + MAX_LOCAL)[:, top:]

    def block_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        ids = table.column("id").to_numpy()
        table = table.take(pa.array(np.unique(ids.astype(str), return_index=True)[1]))  # in the order of ids
        _, raw = raw_matrix(table.column("vector"), dim)
        levels = min(MAX_LOCAL, max(0, math.ceil(math.log2(max(len(raw), 1) / leaf_rows))))
        y = unit_rows(raw) @ turn[:, :levels]
        planes = fit_planes(y, levels)
        leaf = leaf_of(y, planes)
        order = np.argsort(leaf, kind="stable")
        cuts = np.concatenate([np.zeros(0), *planes]).astype("<f8").tobytes()
        table = table.take(pa.array(order)).combine_chunks()
        first = pa.array([cuts] + [None] * (len(order) - 1), pa.binary())
        return pa.record_batch([table.column("id").combine_chunks(), table.column("vector").combine_chunks(), pa.array(leaf[order].astype(np.int32)), first, table.column("block").combine_chunks()], ["id", "vector", "leaf", "planes", "block"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else np.zeros(1, int)
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and held[-1].column("block")[0].as_py() != block[a]:
                    yield block_of(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield block_of(held)

    return run


def _project(dim: int, depth: int):
    turn = projection(dim, depth)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, raw = raw_matrix(batch.column("vector"), dim)
                got = (unit_rows(raw) @ turn).astype(np.float32)
                yield pa.record_batch([pa.array(list(got), pa.list_(pa.float32()))], ["y"])

    return run


def nearest(samples: DataFrame, k: int = 5, limit: float = 1.0, miss: float = 0.008, dim: int = DIM, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The ``k`` most similar vectors of every valid vector within ``limit``.

    Returns ``(id, neighbour, distance, place)``: half cosine distances in
    double precision, places from 1, equal distances by smaller id.  Vectors
    that are missing, of another length, not finite or shorter than 1e-8 take
    no part; a repeated row counts once (see ``valid_vectors`` for an id with
    several vectors); a single vector or an empty table gives no rows; other
    columns are not looked at, whatever their names.
    """
    spark: SparkSession = samples.sparkSession
    rows, most, clash = vector_facts(samples, dim, id_col, vector_col)
    clean = valid_vectors(samples, dim, id_col, vector_col, clash=clash)
    answered = None
    if most > k + 1:  # of many identical vectors only the k + 1 smallest ids can be anyone's neighbours
        clean, answered = _reduce_copies(clean, k, limit, dim)
    top = min(MAX_TOP, max(4, math.ceil(math.log2(rows / BLOCK_ROWS)))) if rows > LEAF_ROWS else 0
    planes: list[np.ndarray] = []
    if top:
        part = min(1.0, FIT_ROWS / rows)
        some = valid_vectors(samples.sample(fraction=part, seed=SEED), dim, id_col, vector_col, clash=False) if part < 1 else clean
        y = some.mapInArrow(_project(dim, top), "y array<float>").limit(2 * FIT_ROWS).toArrow().column("y").combine_chunks()
        planes = fit_planes(y.flatten().to_numpy(zero_copy_only=False).reshape(len(y), top).astype(np.float64), top) if len(y) else []
        top = len(planes)
    path = new_folder(spark, "vectors")
    blocks = 1 << top
    placed = clean.mapInArrow(_place(dim, planes), "id string, vector binary, block int")
    parts = min(blocks, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = placed.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_settle(dim, top, LEAF_ROWS), "id string, vector binary, leaf int, planes binary, block int")
    placed.write.partitionBy("block").parquet(path)
    tasks = spark.range(0, blocks, 1, blocks).select(F.col("id").cast("int").alias("block"))
    found = tasks.mapInArrow(_search(path, dim, planes, k, limit, miss), "id string, neighbour string, distance double")
    # a pair that the test of one side missed is mostly found from the other
    turned = F.array(F.struct("id", "neighbour"), F.struct(F.col("neighbour").alias("id"), F.col("id").alias("neighbour")))
    both = found.select(F.explode(turned).alias("p"), "distance").select("p.id", "p.neighbour", "distance").distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    ranked = both.withColumn("place", place).filter(F.col("place") <= k)
    return ranked if answered is None else ranked.unionByName(answered)


def _reduce_copies(clean: DataFrame, k: int, limit: float, dim: int):
    """Rows to index, and the answers of the copies left out.

    Of each group of more than ``k + 1`` identical vectors the ``k + 1``
    smallest ids stay.  The others' neighbours are the ``k`` smallest ids, at
    the distance of the vector from itself.  Groups are told by 96 bits of
    hash.
    """
    hashes = clean.select("id", F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2"))
    groups = hashes.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    large = materialize(groups.filter(F.col("n") > k + 1).select("h1", "h2"), "copies")
    members = hashes.join(large, ["h1", "h2"], "left_semi").distinct()
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("r") <= k + 1)
    kept = materialize(ranked.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")), "kept")
    keyed = clean.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.hash("vector"))
    rest = keyed.join(large, ["h1", "h2"], "left_anti").select("id", "vector")
    heads = keyed.join(large, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("vector").alias("vector"))
    index = rest.unionByName(heads.join(kept, ["h1", "h2"]).select(F.explode("ids").alias("id"), "vector"))

    def own(batches):
        for batch in batches:
            if batch.num_rows:
                _, raw = raw_matrix(batch.column("vector"), dim)
                unit = unit_rows(raw)
                yield pa.record_batch([batch.column("h1"), batch.column("h2"), batch.column("ids"), pa.array(half_cosine(unit, unit))], ["h1", "h2", "ids", "distance"])

    answers = heads.join(kept, ["h1", "h2"]).select("h1", "h2", "vector", "ids").mapInArrow(own, "h1 bigint, h2 int, ids array<string>, distance double")
    others = members.join(answers, ["h1", "h2"]).filter(~F.array_contains("ids", F.col("id")) & (F.col("distance") <= limit))
    answered = others.select("id", F.posexplode(F.slice("ids", 1, k)).alias("p", "neighbour"), "distance").select("id", "neighbour", "distance", (F.col("p") + 1).alias("place"))
    return materialize(index, "index"), answered
