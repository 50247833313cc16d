"""p1, p3, p5 on small vectors: brute force, and every kind of odd row."""

import struct

import numpy as np
import pytest

from gallerist.llm import clusters as C
from gallerist.llm import hilbert as H
from gallerist.llm import knn as K

DIM = 16


def pack(v):
    return struct.pack(f"<{len(v)}f", *v)


def vectors(n=400, groups=60, seed=0, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, DIM))
    v = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, DIM))
    return (v * rng.uniform(0.01, 100, n)[:, None]).astype(np.float32)


def odd_rows(v):
    ids = [f"s{i:04d}" for i in range(len(v))]
    good = [(i, pack(x)) for i, x in zip(ids, v)]
    nan = pack([float("nan")] * DIM)
    bad = [("b1", None), ("b2", b""), ("b3", pack(v[0])[:-1]), ("b4", nan), ("b5", pack([0.0] * DIM)), (None, pack(v[0])), ("b6", pack([float("inf")] * DIM)), ("b7", pack(list(v[0]) * 2))]
    return ids, good, good + good[:20] + bad


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "p", 1, 2) for i, v in rows], "id string, vector binary, person_id string, leaf int, block int")


def exact(v):
    u = v.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    d = np.clip((1 - u @ u.T) / 2, 0, 1)
    np.fill_diagonal(d, 9)
    return d


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAF_ROWS", 40)
    v = vectors()
    ids, _, rows = odd_rows(v)
    got: dict = {}
    for r in K.nearest(frame(spark, rows), k=5, limit=0.2, miss=0.005, dim=DIM).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"], r["distance"]))
    d, hit, total = exact(v), 0, 0
    for i, name in enumerate(ids):
        want = [ids[j] for j in np.argsort(d[i], kind="stable")[:5] if d[i, j] <= 0.2]
        have = [n for _, n, _ in sorted(got.get(name, []))]
        hit, total = hit + len(set(want) & set(have)), total + len(want)
        assert all(abs(x - d[i, ids.index(n)]) < 1e-12 for _, n, x in got.get(name, []))
    assert hit >= 0.97 * total and total > 500


def test_open_blocks_are_those_of_all_gaps():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(500, 7))
    planes = K.fit_planes(y, 7)
    stop = K.stop_ratios(9, 0.01)
    reach = np.maximum.accumulate(stop[::-1])[::-1]
    g2, c = K.gaps(y[:20], planes)
    for size in (0.5, 0.05, 1e-4):
        r2 = rng.random(20) * size
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(g2 > 0, g2 / reach[c], 0)
        nodes, g, n, least = K.open_nodes(y[:20], planes, reach, r2)
        assert sorted(nodes) == list(np.flatnonzero((need <= r2[:, None]).any(axis=0)))
        assert np.allclose(g, g2[:, nodes], rtol=1e-4) and (n == c[:, nodes]).all() and np.allclose(least, need[:, nodes].min(axis=0), rtol=1e-4)
    assert len(nodes) < 128


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAF_ROWS", 8)
    monkeypatch.setattr(K, "BLOCK_ROWS", 10)
    v = vectors(600, 80, seed=2)
    ids, _, rows = odd_rows(v)
    got: dict = {}
    for r in K.nearest(frame(spark, rows), k=5, miss=0.002, dim=DIM).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"]))
    d = exact(v)
    want = {name: {ids[j] for j in np.argsort(d[i], kind="stable")[:5]} for i, name in enumerate(ids)}
    assert all(len(x) == 5 for x in got.values()) and got.keys() == want.keys()
    assert sum(len(want[i] & {n for _, n in got[i]}) for i in want) >= 0.95 * 5 * len(ids)


def test_nearest_many_copies_and_empty(spark):
    v = vectors(30, 30)
    rows = [(f"c{i:03d}", pack(v[0])) for i in range(40)] + [(f"x{i}", pack(v[i])) for i in range(1, 30)]
    got: dict = {}
    for r in K.nearest(frame(spark, rows), k=5, limit=0.1, dim=DIM).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"]))
    assert [n for _, n in sorted(got["c030"])] == [f"c{i:03d}" for i in range(5)]
    assert [n for _, n in sorted(got["c002"])] == ["c000", "c001", "c003", "c004", "c005"]
    assert len(got) >= 40
    assert K.nearest(frame(spark, rows[:0]), dim=DIM).count() == 0
    assert K.nearest(frame(spark, rows[:1]), dim=DIM).count() == 0


def test_one_id_with_several_vectors(spark):
    v = vectors(6, 6)
    rows = [("a", pack(v[0])), ("a", pack(v[1])), ("b", pack(v[0])), ("c", pack(v[1]))]
    got = {(r["id"], r["neighbour"]) for r in K.nearest(frame(spark, rows), k=2, limit=0.01, dim=DIM).collect()}
    assert got in ({("a", "b"), ("b", "a")}, {("a", "c"), ("c", "a")})


def test_chi_square_tail():
    assert K.upper_chi_square(1, np.array([3.841]))[0] == pytest.approx(0.05, abs=1e-4)
    assert K.upper_chi_square(2, np.array([5.991]))[0] == pytest.approx(0.05, abs=1e-4)
    assert K.upper_chi_square(5, np.array([11.07]))[0] == pytest.approx(0.05, abs=1e-4)


def components(d, limit):
    lab = list(range(len(d)))
    changed = True
    while changed:
        changed = False
        for i, j in np.argwhere(d <= limit):
            low = min(lab[i], lab[j])
            if lab[i] != low or lab[j] != low:
                lab[i] = lab[j] = low
                changed = True
    return lab


@pytest.mark.parametrize("caps", [(32_768, 16_384), (25, 12)])
def test_clusters_against_components(spark, caps):
    v = vectors(300, 40, seed=3, spread=0.3)
    ids, _, rows = odd_rows(v)
    got = {r["id"]: (r["cluster_id"], r["size"]) for r in C.clusters(frame(spark, rows), limit=0.12, at=0.12, recall=0.9999, dim=DIM, bucket_cap=caps[0], group_cap=caps[1]).collect()}
    lab = components(exact(v), 0.12)
    size = {x: lab.count(x) for x in lab}
    assert got == {ids[i]: (ids[x], size[x]) for i, x in enumerate(lab) if size[x] > 1} and len(got) > 100


def test_clusters_copies_parts_and_empty(spark):
    v = vectors(10, 10)
    rows = [(f"c{i:03d}", pack(v[0])) for i in range(100)] + [("z", pack(v[1])), ("y", pack(v[0] * 3))]
    got = {r["id"]: r for r in C.clusters(frame(spark, rows), dim=DIM).collect()}
    assert len(got) == 101 and {r["cluster_id"] for r in got.values()} == {"c000"} and {r["size"] for r in got.values()} == {101}
    assert C.clusters(frame(spark, rows[:0]), dim=DIM).count() == 0
    # a chain of three: the ends are not alike, so the middle is the medoid of all
    a, b, c = (np.array([np.cos(t), np.sin(t)] + [0.0] * (DIM - 2), np.float32) for t in (0.0, 0.6, 1.2))
    chain = {r["id"]: r for r in C.clusters(frame(spark, [("a", pack(a)), ("b", pack(b)), ("c", pack(c))]), limit=0.12, at=0.12, recall=0.9999, dim=DIM).collect()}
    assert chain["b"]["medoid"] and chain["b"]["degree"] == 2 and chain["a"]["degree"] == 1 and {r["part_id"] for r in chain.values()} == {"a"}


def test_forest_links_every_group():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = C.forest(x, 0.8)
    lab = C.labels_of(60, i, j)
    assert len(i) == 60 - len(set(lab)) and list(lab) == components(1 - x @ x.T, 0.2)
    i, j = C.forest(x[:30], 0.8, x[30:])
    assert all(x[a] @ x[b] >= 0.8 for a, b in zip(i, j))


def test_hilbert_is_a_walk():
    for dims, bits in ((2, 3), (3, 2)):
        grid = np.stack(np.meshgrid(*[range(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = H.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
        coarse = H.hilbert_keys(grid >> 1, bits - 1)
        assert (coarse == keys >> dims).all()


def test_varied_subset(spark):
    v = vectors(300, 300, seed=5)
    hot = [(f"h{i:03d}", pack(v[0] + 1e-4 * i)) for i in range(200)]
    rows = hot + [(f"s{i:03d}", pack(v[i])) for i in range(1, 200)] + [("bad", None)] + hot[:10]
    df = spark.createDataFrame([(i, x, float(k % 7)) for k, (i, x) in enumerate(rows)], "id string, vector binary, q double")
    strata = spark.createDataFrame([("s001", "rare"), ("h001", "mask"), ("gone", "none")] + [(f"s{i:03d}", "plain") for i in range(2, 100)], "id string, stratum string")
    from pyspark.sql import functions as F

    got = H.varied_subset(df, strata, size=60, score=F.col("q"), dim=DIM).collect()
    assert len(got) == 60 == len({r["id"] for r in got})
    assert {r["stratum"] for r in got} == {"rare", "mask", "plain", None}
    assert sum(r["id"][0] == "h" for r in got) < 12
    assert H.varied_subset(df, strata, size=5000, score=F.col("q"), dim=DIM).count() == 399
    assert H.varied_subset(df.limit(0), strata, size=5, dim=DIM).count() == 0
    assert {r["id"] for r in H.varied_subset(df, strata, size=60, score=F.col("q"), dim=DIM).collect()} == {r["id"] for r in got}


def places_by_hand(strata, k):
    """Places of (name, cells, n) strata, one rule after another."""
    names = sorted((s for s, _, _ in strata), key=lambda s: (s is not None, s))
    cells, room, out = {s: c for s, c, _ in strata}, {s: n for s, _, n in strata}, dict.fromkeys(names, 0)
    while (left := min(k, sum(room.values())) - sum(out.values())) > 0:
        free = [s for s in names if out[s] < room[s]]
        if left <= len(free):
            give = dict.fromkeys(sorted(free, key=lambda s: -cells[s])[:left], 1)
        else:
            spare, whole = left - len(free), sum(cells[s] ** 0.5 for s in free)
            exact = {s: spare * cells[s] ** 0.5 / whole for s in free}
            give = {s: 1 + int(exact[s]) for s in free}
            for s in sorted(free, key=lambda s: int(exact[s]) - exact[s])[: left - sum(give.values())]:
                give[s] += 1
        for s, n in give.items():
            out[s] = min(room[s], out[s] + n)
    return out


def test_places_of_many_strata(spark):
    rng = np.random.default_rng(1)
    strata = [(None, 50, 70)] + [(f"c{i:04d}", int(c), int(c + e)) for i, (c, e) in enumerate(zip(rng.integers(1, 40, 1_200), rng.integers(0, 9, 1_200)))]
    df = spark.createDataFrame(strata, "stratum string, cells bigint, n bigint")
    for k in (0, 7, 1_201, 4_000, 10**6):
        got = {r["stratum"]: r["places"] for r in H.allocate(df, k).collect()}
        assert got == places_by_hand(strata, k) and sum(got.values()) == min(k, sum(n for _, _, n in strata))
    assert H.allocate(df.limit(0), 5).count() == 0


@pytest.mark.parametrize("conditions", [999, 1_001])
def test_every_condition_is_chosen(spark, conditions):
    v = vectors(conditions + 50, 300, seed=6)
    df = spark.createDataFrame([(f"s{i:04d}", pack(x)) for i, x in enumerate(v)], "id string, vector binary")
    strata = spark.createDataFrame([(f"s{i:04d}", f"c{i:04d}") for i in range(conditions)], "id string, stratum string")
    got = H.varied_subset(df, strata, size=conditions + 20, dim=DIM).collect()
    assert len(got) == conditions + 20 and {r["stratum"] for r in got} == {None} | {f"c{i:04d}" for i in range(conditions)}


def test_subset_covers_more_than_chance(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(80, DIM))
    group = np.minimum(rng.geometric(0.08, 2_000) - 1, 79)  # a few groups hold most records
    v = (centres[group] + 0.1 * rng.normal(size=(2_000, DIM))).astype(np.float32)
    df = spark.createDataFrame([(f"s{i:04d}", pack(x)) for i, x in enumerate(v)], "id string, vector binary")
    none = spark.createDataFrame([], "id string, stratum string")
    chosen = [int(r["id"][1:]) for r in H.varied_subset(df, none, size=100, dim=DIM).collect()]
    far = exact(v)
    np.fill_diagonal(far, 0)
    radius = far[:, chosen].min(axis=1)
    chance = [rng.choice(2_000, 100, replace=False) for _ in range(20)]
    assert len(set(group[chosen])) > max(len(set(group[c])) for c in chance)
    assert radius.mean() < min(far[:, c].min(axis=1).mean() for c in chance) and np.bincount(group[chosen]).max() < np.mean([np.bincount(group[c]).max() for c in chance])


def test_neighbours_of_every_sample(spark, tmp_path):
    from gallerist.llm import queries as Q

    rng = np.random.default_rng(9)
    v = rng.normal(size=(60, K.DIM)).astype(np.float32)  # all further apart than ALIKE
    v[1] = v[0] + 0.01
    rows = [(f"s{i:02d}", pack(x), f"p{i}") for i, x in enumerate(v)] + [("bad", None, "p0")]
    spark.createDataFrame(rows, "id string, vector binary, person_id string").write.parquet(str(tmp_path / "samples.parquet"))
    got: dict = {}
    for r in Q.p1_neighbours(spark, str(tmp_path)).collect():
        assert r["person_id"] == "p" + str(int(r["neighbour"][1:]))
        got.setdefault(r["sample_id"], []).append((r["place"], r["neighbour"]))
    d = exact(v)
    assert {i: [n for _, n in sorted(x)] for i, x in got.items()} == {f"s{i:02d}": [f"s{j:02d}" for j in np.argsort(d[i], kind="stable")[:5]] for i in range(60)}
    assert {(r["sample_a"], r["sample_b"]) for r in Q.p1_found(spark, str(tmp_path)).collect()} == {("s00", "s01")}


def rows_of(df):
    return sorted((r["id"], r["cluster_id"], r["size"], r["degree"], r["part_id"], r["part_size"], r["medoid"]) for r in df.collect())


def split_by_hand(ids, d, limit):
    """Degree, part and medoid of every clustered id, one medoid after another."""
    near, lab, out = d <= limit, np.array(components(d, limit)), []
    for head in sorted(set(lab)):
        left = members = np.flatnonzero(lab == head)
        degree = {i: int(near[i][members].sum()) for i in members}
        while len(members) > 1 and len(left):
            top = min(left, key=lambda i: (-near[i][left].sum(), ids[i]))
            part = [i for i in left if near[top, i] or i == top]
            out += [(ids[i], ids[head], len(members), degree[i], ids[part[0]], len(part), bool(i == top)) for i in part]
            left = np.array([i for i in left if i not in part])
    return sorted(out)


def test_large_groups_are_split_as_small_ones(spark):
    v = vectors(160, 12, seed=3, spread=0.65)
    ids = [f"s{i:04d}" for i in range(len(v))]
    want = split_by_hand(ids, exact(v), 0.14)
    assert max(x[2] for x in want) > 16 and len({x[4] for x in want}) > len({x[1] for x in want})
    for cap in (16_384, 8):
        assert rows_of(C.clusters(frame(spark, zip(ids, map(pack, v))), limit=0.14, at=0.14, recall=0.9999, dim=DIM, group_cap=cap)) == want


@pytest.mark.parametrize("cap", [16_384, 8])
def test_copies_count_in_degrees_and_medoids(spark, monkeypatch, cap):
    v = vectors(80, 6, seed=3, spread=0.65)
    hot = np.concatenate([v, np.repeat(v[[5, 40]], [7, 4], axis=0), np.repeat(-vectors(1, 1, seed=8), 5, axis=0)])
    ids = [f"s{i:04d}" for i in range(len(hot))]
    monkeypatch.setattr(C, "COPIES", 3)
    got = rows_of(C.clusters(frame(spark, zip(ids, map(pack, hot))), limit=0.14, at=0.14, recall=0.9999, dim=DIM, group_cap=cap))
    assert got == split_by_hand(ids, exact(hot), 0.14)


def test_bands_in_rounds(spark, monkeypatch):
    """The same clusters however many bands are shuffled at once, and less on disk."""
    rng = np.random.default_rng(12)
    bits = rng.integers(0, 2, (40, C.BITS)).astype(bool)
    assert (C.min_hash_keys(bits, 3, 9)[:, 4:] == C.min_hash_keys(bits, 3, 9, 4)).all()
    heads = rng.standard_normal((60, 128))
    rows = [(f"{i:03d}", (heads[i % 60] + 0.3 * rng.standard_normal(128)).astype("<f4").tobytes()) for i in range(240)]
    frame = spark.createDataFrame(rows, "id string, vector binary")
    monkeypatch.setattr(C, "BUCKET_ROWS", 16)  # several values a band, so several rounds
    r, bands = C.banding(240, 0.99, 0.10)
    assert bands > C.ROUND_BANDS / 4
    asked = []
    monkeypatch.setattr(C, "_sign_buckets", lambda d, r, until, hot, first=0, f=C._sign_buckets: asked.append(until - first) or f(d, r, until, hot, first))
    want = sorted(map(tuple, C.clusters(frame).collect()))
    monkeypatch.setattr(C, "ROUND_BANDS", 4)
    asked.clear()
    assert want and sorted(map(tuple, C.clusters(frame).collect())) == want
    assert sum(asked) == bands and max(asked) <= 4 and len(asked) > 1

def test_vectors_are_read_where_they_lie():
    import pyarrow as pa

    from gallerist.llm.vectors import raw_matrix

    want = np.random.default_rng(3).standard_normal((50, DIM)).astype("<f4")
    rows = [x.tobytes() for x in want]
    column = pa.array(rows, pa.large_binary())
    at, raw = raw_matrix(column, DIM)
    assert (raw == want).all() and len(at) == 50 and np.shares_memory(raw, np.frombuffer(column.buffers()[2], np.uint8))
    at, raw = raw_matrix(pa.array([b"abc", None, *rows[:9], b"", None, *rows[9:]], pa.binary())[1:], DIM)
    assert (raw == want).all() and at.tolist() == [*range(1, 10), *range(12, 53)]
