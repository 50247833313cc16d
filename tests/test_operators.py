import itertools
import random

import numpy as np
import pandas as pd
import pytest

from gallerist.operators import search
from gallerist.operators import selection as S
from gallerist.operators.components import connected_components
from gallerist.operators.debounce import debounce
from gallerist.operators.evaluation import auc, roc, running_sums
from gallerist.operators.video import greedy_pairs, match_truth, suppress
from gallerist.storage import with_rank


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(200, i) for i in range(201, 260)] + [(300, 300), (None, 1)] + [(i, i + 1) for i in range(400, 440)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in (e for e in edges if None not in e):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_rank_and_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab") if i % 9 else None, i, rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    ranks = {(r["g"], r["i"]): r["rank"] for r in with_rank(df, ["i"], within=["g"]).collect()}
    for g in ("a", "b", None):
        order = sorted(i for x, i, _ in rows if x == g)
        assert [ranks[g, i] for i in order] == list(range(len(order)))
    sums = {r["i"]: r["run_v"] for r in running_sums(df.select("i", "v"), ["v"], "i").collect()}
    assert [sums[i] for i in range(200)] == list(itertools.accumulate(v for _, _, v in rows))


def test_search_against_loops(spark):
    rng = np.random.default_rng(1)
    gallery = [(i // 4 if i < 30 else 7, i, rng.normal(size=6).tolist()) for i in range(34)] + [(3, 99, None), (3, 98, [0.0] * 6), (0, 0, None)]
    probes = [(i, rng.normal(size=6).tolist()) for i in range(9)] + [(50, None)]
    g, p = spark.createDataFrame(gallery, "identity int, template int, vector array<double>"), spark.createDataFrame(probes, "probe bigint, vector array<double>")
    strategies = tuple((s, k) for s in search.STRATEGIES for k in (2, 3))
    got = {(r["probe"], r["identity"], r["strategy"], r["k"]): r["score"] for r in search.identity_scores(p, g, strategies).collect()}
    by: dict = {}
    for i, t, v in gallery[:34]:
        by.setdefault(i, []).append(np.array(v))
    for (pid, v), (i, ts), (s, k) in itertools.product(probes[:9], by.items(), strategies):
        d = np.sort([(1 - np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)) / 2 for x in ts])
        d = d[:1] if s == "nearest" else d[:k] if s.startswith("topk") else d
        want = d.min() if s == "nearest" else d.mean() if s.endswith("mean") else np.median(d)
        assert got[pid, i, s, k] == pytest.approx(want, abs=1e-12)
    assert len(got) == 9 * len(by) * len(strategies)
    best = search.identity_scores(p, g, best=2).collect()
    assert len(best) == 18
    assert search.identity_scores(p.limit(0), g).count() == 0 and search.identity_scores(p, g.limit(0)).count() == 0


def test_decide_tie_and_margin(spark):
    rows = [(1, "b", 0.2), (1, "a", 0.2), (2, "a", 0.1), (2, "b", 0.15), (3, "a", 0.3)]
    df = search.decide(spark.createDataFrame(rows, "probe bigint, identity string, score double"), 0.25, 0.05)
    got = {r["probe"]: (r["candidate"], r["known"], r["name"]) for r in df.collect()}
    assert got == {1: ("a", False, None), 2: ("a", True, "a"), 3: ("a", False, None)}


def test_roc(spark):
    rng = random.Random(2)
    rows = [(round(rng.random() * (0.7 if (g := rng.random() < 0.5) else 1.0), 2), g) for _ in range(300)] + [(None, True), (0.2, None)]
    points = roc(spark.createDataFrame(rows, "distance double, genuine boolean"))
    ok = [r for r in rows if None not in r]
    pos, neg = [d for d, g in ok if g], [d for d, g in ok if not g]
    for r in points.collect():
        assert r["tar"] == pytest.approx(sum(d <= r["distance"] for d in pos) / len(pos)) and r["far"] == pytest.approx(sum(d <= r["distance"] for d in neg) / len(neg))
    want = sum((a < b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert auc(points).first()["auc"] == pytest.approx(want)


def test_selection_greedy():
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(9, 5)), np.round(rng.random(9), 1)
    d = S.distances(v)
    picked = S.diverse_order(d, q, 4)
    assert picked[0] == int(np.argmax(q)) and len(set(picked)) == 4
    for n in range(1, 4):
        near = lambda i: round(min(d[i, j] for j in picked[:n]), 12)
        rest = [i for i in range(9) if i not in picked[:n]]
        assert picked[n] == max(rest, key=lambda i: (near(i), q[i], -i))
    cover = S.coverage_order(d, q, 4)
    assert cover[0] == int(np.argmax(q)) and len(set(cover)) == 4
    assert len(S.coverage_order(d, np.zeros(9), 3)) == 3


def test_coverage_against_whole_sums():
    """Every choice has the largest gain, summed anew over all points."""
    rng = np.random.default_rng(5)
    for n, copies in ((1, 1), (2, 1), (12, 1), (9, 3)):
        v, q = np.repeat(rng.normal(size=(n, 3)), copies, axis=0), np.round(rng.random(n * copies), 1)
        d, size = S.distances(v), n * copies
        s = np.clip(1 - d / 0.25, 0, 1)
        c = np.array([np.clip(1 - (np.median(np.delete(d[i], i)) if size > 1 else 0) / 0.55, 0.25, 1) for i in range(size)])
        w = q * c / (0.2 + s.sum(axis=1))
        w = w / w.sum() if w.sum() else c / (0.2 + s.sum(axis=1)) / (c / (0.2 + s.sum(axis=1))).sum()
        order = S.coverage_order(d, q, 6)
        assert len(order) == len(set(order)) == min(6, size) and order[0] == int(np.argmax(q))
        for k in range(1, len(order)):
            covered = s[order[:k]].max(axis=0)
            worth = {j: round(sum(w[i] * max(s[i, j] - covered[i], 0) for i in range(size)) + 0.05 * q[j] * c[j], 9) for j in range(size) if j not in order[:k]}
            assert (worth[order[k]], q[order[k]]) >= max((worth[j], q[j]) for j in worth)


def test_greedy_pairs_and_matching(spark):
    assert greedy_pairs([(0.2, 1, 1), (0.1, 1, 2), (0.3, 2, 2)]) == [(0.1, 1, 2)]
    truth = spark.createDataFrame([("v", 0, "s", [0, 0, 10, 10]), ("v", 0, "t", [1, 0, 10, 10]), ("v", 1, "s", [0, 0, 4, 4])], "video string, frame int, subject string, box array<int>")
    pred = spark.createDataFrame([("v", 0, 1, [0, 0, 10, 10]), ("v", 0, 2, [50, 0, 10, 10])], "video string, frame int, idx int, box array<int>")
    got = {(r["frame"], r["subject"]): r["idx"] for r in match_truth(pred, truth).collect()}
    assert got == {(0, "s"): 1, (0, "t"): None, (1, "s"): None}


def test_suppress(spark):
    rows = [("v", 0, 1, [0, 0, 10, 10]), ("v", 0, 2, [1, 0, 10, 9]), ("v", 0, 3, [30, 0, 5, 5])]
    got = sorted(r["idx"] for r in suppress(spark.createDataFrame(rows, "video string, frame int, idx int, box array<int>")).collect())
    assert got == [1, 3]


def test_debounce(spark):
    rows = [("a", 0, 1), ("a", 5, 2), ("a", 10, 3), ("a", 14, 4), ("b", 3, 5), (None, 1, 6)]
    got = sorted(r["i"] for r in debounce(spark.createDataFrame(rows, "k string, t bigint, i int"), "k", "t", "i", 10).collect())
    assert got == [1, 3, 5]


def test_bootstrap(spark):
    from gallerist.operators.bootstrap import component_interval

    few = spark.createDataFrame([(f"c{i}", 4, 2) for i in range(5)], "component string, total bigint, hits bigint")
    assert component_interval(few, 100).first()["status"] == "too_few_components"
    many = spark.createDataFrame([(f"c{i}", 10, i % 5) for i in range(200)], "component string, total bigint, hits bigint")
    r = component_interval(many, 500).first()
    assert r["status"] == "estimated" and r["low"] < r["rate"] == 0.2 < r["high"] and r["high"] - r["low"] < 0.06
    assert component_interval(spark.createDataFrame([(f"c{i}", 10, 0) for i in range(30)], "component string, total bigint, hits bigint"), 100).first()["status"] == "degenerate"


def test_pandas_available():
    assert pd.__version__


def test_ordinals_over_stretches(spark, monkeypatch):
    from gallerist.operators import video as V

    monkeypatch.setattr(V, "STRETCH", 10)
    frames = [("a", f) for f in (0, 3, 9, 10, 31, 35, 99)] + [("b", 50), ("a", 3), (None, 1), ("a", None)]
    df = spark.createDataFrame(frames, "video string, frame int")
    got = {(r["video"], r["frame"]): r["ordinal"] for r in V.frames_once(df).collect()}
    assert got == {("a", f): i for i, f in enumerate((0, 3, 9, 10, 31, 35, 99), 1)} | {("b", 50): 1}


def test_search_in_blocks_and_chunks(spark, monkeypatch):
    """Many blocks of probes and chunks of templates give the rows of one."""
    rng = np.random.default_rng(6)
    p = spark.createDataFrame([(i, rng.normal(size=4).tolist(), "x") for i in range(30)] + [(90, None, "x"), (91, [0.0] * 4, "x")], "probe bigint, vector array<double>, identity string")
    rows = [(f"p{i % 9}", i, rng.normal(size=4).tolist()) for i in range(80)]
    g = spark.createDataFrame(rows + rows[:9] + [("p0", 99, None)], "identity string, template bigint, vector array<double>")
    take = lambda: ({(r["probe"], r["identity"]): r["score"] for r in search.identity_scores(p, g).collect()}, sorted(tuple(r) for r in search.nearest_per_identity(p, g, 2).collect()))
    scores, near = take()
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "CHUNK", 10)
    monkeypatch.setattr(search, "AT_ONCE", 64)
    again, near_again = take()
    assert len(scores) == 270 and scores.keys() == again.keys() and all(abs(scores[k] - again[k]) < 1e-12 for k in scores)
    assert [r[:3] + r[4:] for r in near] == [r[:3] + r[4:] for r in near_again] and len(near) == 540
    scalar = {(r["probe"], r["identity"]): r["scalar"] for r in search.scalar_scores(p, g, rows=4).collect()}
    assert scalar.keys() == scores.keys() and all(abs(scalar[k] - scores[k]) < 1e-9 for k in scores)


def test_exact_quantiles(spark):
    from gallerist.storage import exact_quantiles

    rng = np.random.default_rng(7)
    rows = [(k, float(x)) for k in ("a", None) for x in rng.integers(0, 20, 101)] + [("b", 3.5), ("c", None), ("c", float("nan"))]
    got = {r["k"]: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, x double"), "x", (0.0, 0.1, 0.5, 0.95, 1.0), ["k"]).collect()}
    assert got.keys() == {"a", None, "b"} and got["b"]["q"] == [3.5] * 5
    for k in ("a", None):
        want = np.quantile([x for n, x in rows if n == k], (0.0, 0.1, 0.5, 0.95, 1.0))
        assert got[k]["n"] == 101 and got[k]["q"] == pytest.approx(want.tolist())


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from gallerist.storage import shared_root

    conf = SimpleNamespace(get=lambda *a: None)
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        context = SimpleNamespace(getConf=lambda: conf, master=master)
        with pytest.raises(RuntimeError):
            shared_root(SimpleNamespace(sparkContext=context, conf=conf))
