"""p2, p4, p6: brute force on small tables with odd rows."""

import math
import random

import numpy as np
import pytest

from gallerist.llm import overlap as O
from gallerist.llm import quantiles as Q
from gallerist.llm import related as R


def test_cosine_join_against_loops(spark):
    rng = random.Random(4)
    make = lambda n: [(i, [(t, round(rng.uniform(0.1, 3), 3)) for t in rng.sample(range(25), rng.randrange(1, 8))]) for i in range(n)]
    a, b = make(60) + [(99, None), (98, [])], make(50)
    kind = "id bigint, terms array<struct<term:bigint,weight:double>>"
    for least in (0.2, 0.5, 0.8):
        got = {(r["left_id"], r["right_id"]): r["cosine"] for r in O.cosine_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), least).collect()}
        want = {}
        for (i, x), (j, y) in ((p, q) for p in a[:60] for q in b):
            x, y = dict(x), dict(y)
            c = sum(w * y.get(t, 0) for t, w in x.items()) / math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values()))
            if c >= least:
                want[i, j] = c
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert O.cosine_join(spark.createDataFrame([], kind), spark.createDataFrame(b, kind), 0.5).count() == 0


COLS = "entry_id bigint, split string, section string, source string, image string, label string, subject_id string, condition string, session_id string, sha256 string, dhash64 bigint, sample_id string, captured_at_utc string, class bigint"
S1, S2 = "desk-20260101-000001", "kios-20260202-000002"


def entry(i, split, image, sha=None, h=None, label=None, session=None, captured=None):
    return (i, split, "x", "src", image, label, None, None, session, sha * 64 if sha else None, h, None, captured, 7)


@pytest.mark.parametrize("hot", [O.HOT, 0])
def test_overlaps(spark, monkeypatch, hot):
    monkeypatch.setattr(O, "HOT", hot)
    h = 0x123456789ABCDEF0
    rows = [
        entry(1, "train", f"desk/{S1}/01.jpg", "a", h, "Ann", S1),
        entry(2, "test", "upload/x.jpg", "a", None, "Bob"),  # the same file under another label
        entry(3, "validation", f"eval/{S1.upper()}/thumb_01.JPG", None, None),  # the same place
        entry(4, "test", "upload/y.jpg", "b", h ^ 0b111, " ANN "),  # re-encoded
        entry(5, "test", "upload/z.jpg", "c", h ^ 1, "Cy", S2),  # another person before the same background
        entry(6, "test", f"desk/{S1}/02.jpg", "d", ~h, "Ann", S1),  # another shot of the session
        entry(7, "train", "upload/q.jpg", "a", h, "Ann"),  # the same picture, but both in train
        entry(8, "test", None, None, None),
        entry(9, None, "a.jpg", "a", h),
        entry(10, "test", f"desk/{S1}/01.jpg", "e", ~h, "Ann", S1),  # the same name, another picture
        entry(11, "train", f"kiosk/{S2}/07.jpg", None, None),
        entry(12, "test", f"eval/{S2}/07_copy.png", "f", h ^ 0xF0F),  # the place of one without a hash
        entry(13, "validation", f"{S2}/07.jpg", None, None),
    ]
    df = spark.createDataFrame(rows + rows[:3], COLS)
    pairs = O.cross_split_overlaps(df)
    got = sorted((r["train_entry"], r["other_entry"]) for r in pairs.collect())
    assert got == [(1, 2), (1, 3), (1, 4), (7, 2), (7, 4), (11, 12), (11, 13)]
    counts = {(r["split"], r["source"]): (r["pairs"], r["entries"]) for r in O.overlap_counts(pairs).collect()}
    assert counts == {("test", "src"): (5, 3), ("validation", "src"): (2, 2)}
    assert O.cross_split_overlaps(df.limit(0)).count() == 0


def test_near_hashes_keep_chunks_and_cosine():
    rng = random.Random(1)
    for _ in range(300):
        x = 0
        for b in rng.sample(range(64), O.NEAR_BITS):
            x |= 1 << b
        assert sum((x >> a) & ((1 << w) - 1) == 0 for a, w in O.WIDE) >= 3
    assert sum(w for _, w in O.WIDE) == 64
    # even if all differing chunks are the rarest and all equal ones the most frequent
    equal, other = np.ones(O.CHUNKS - O.NEAR_BITS), np.full(O.NEAR_BITS, O.RARE)
    assert equal.sum() / ((equal**2).sum() + (other**2).sum()) >= O.LEAST_COSINE - 1e-12


def scene(rng, n):
    """Vectors of contexts of ten whose hashes agree in the upper half."""
    context = np.repeat(np.arange(n), 10)
    room = np.repeat(rng.integers(0, 1 << 32, n), 10)
    dhash = (room << 32 | rng.integers(0, 1 << 32, 10 * n)).astype(np.int64)
    dhash[1::10] = dhash[0::10] ^ 0b1001  # the second is the first, re-encoded
    left = np.tile(np.arange(10) % 2 == 0, n)
    kind, hashed = np.full(10 * n, O.HASH), np.ones(10 * n, bool)
    return O._terms(context, kind, left, dhash, hashed), left, np.full(10 * n, 10)


def test_bounds_keep_the_pairs_and_cut_candidates():
    terms, left, of = scene(np.random.default_rng(0), 200)
    full = O.array_cosine_join(terms, left, of, O.LEAST_COSINE, prune=False)
    cut = O.array_cosine_join(terms, left, of, O.LEAST_COSINE)
    assert [list(x) for x in cut[:2]] == [list(x) for x in full[:2]] and np.allclose(cut[2], full[2])
    assert full[3] == 200 * 25 and cut[3] < 0.6 * full[3]
    for row in range(2):
        assert (cut[0] == 10 * row).sum() >= 1


def test_array_join_against_loops():
    rng = np.random.default_rng(3)
    terms = rng.integers(-1, 6, (80, 5)) * 10 + np.arange(5)
    terms[terms < 0] = -1
    terms[rng.random((80, 5)) < 0.2] = -1
    left, of = rng.random(80) < 0.5, np.full(80, 80)
    df = {x: (terms == x).sum() for x in np.unique(terms) if x >= 0}
    w = [{x: 1 + (O.RARE - 1) * (1 - math.log(df[x]) / math.log(80)) for x in row if x >= 0} for row in terms.tolist()]
    want = {}
    for i in np.flatnonzero(left):
        for j in np.flatnonzero(~left):
            dot = sum(v * w[j].get(x, 0) for x, v in w[i].items())
            if dot and (c := dot / math.sqrt(sum(v * v for v in w[i].values()) * sum(v * v for v in w[j].values()))) >= 0.4:
                want[i, j] = c
    i, j, c, _ = O.array_cosine_join(terms, left, of, 0.4)
    got = dict(zip(zip(i, j), c))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_places():
    from pyspark.sql import Row, functions as F, SparkSession

    spark = SparkSession.getActiveSession()
    same = ["old/x/kiosk/kios-20260113-004962/IMG_0010.JPG", "kiosk\\KIOS-20260113-004962//img_0010.jpg", "kios-20260113-004962/thumb_IMG_0010 (2).png", "a/kios-20260113-004962/IMG_0010 - Copy.jpeg"]
    other = ["kiosk/kios-20260113-004962/IMG_0011.JPG", "atrium/2026/03/atri-20260308-002455-f00056.png", None, "", "upload/x.jpg"]
    rows = [r["k"] for r in spark.createDataFrame([Row(p=x) for x in same + other], "p string").select(O.place_key(F.col("p")).alias("k")).collect()]
    assert set(rows[:4]) == {"kios-20260113-004962/img_0010"} and rows[4:] == ["kios-20260113-004962/img_0011", "atri-20260308-002455-f00056", None, None, None]


def test_summaries_bound_the_rank():
    rng = np.random.default_rng(0)
    parts = [rng.lognormal(size=n) for n in (1, 5000, 333, 12_000, 2, 7000)] + [np.full(3000, 1.0), np.array([])]
    s = Q.summarize(parts[0])
    for p in parts[1:]:
        s = Q.compress(Q.merge(s, Q.compress(Q.summarize(p), 200)), 200)
    whole = np.sort(np.concatenate(parts))
    assert s[2][-1] == len(whole) and len(s[0]) <= 200
    bound = Q.error_bound(s)
    assert bound <= 0.02 * len(whole)
    for p in (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0):
        v, r = Q.query(s, p), max(1, math.ceil(p * len(whole)))
        low, high = np.searchsorted(whole, v, "left") + 1, np.searchsorted(whole, v, "right")
        assert low - bound <= r <= high + bound
    assert math.isnan(Q.query(Q.summarize([]), 0.5)) and Q.query(Q.summarize([3.0]), 0.5) == 3.0


def test_frame_percentiles(spark):
    from datetime import datetime

    rng = random.Random(2)
    rows = [("v", i, rng.choice([None, float("nan"), -1.0, rng.random()]), rng.random() * 9, datetime(2026, 1, 1 + i % 2), "extra") for i in range(300)]
    frames = spark.createDataFrame(rows + rows[:50] + [(None, 1, 1.0, 1.0, None, "")], "video string, frame int, processing_ms double, timestamp double, received_at timestamp, n string")
    exports = spark.createDataFrame([("v", "e"), ("v", "e")], "video string, engine string")
    days = Q.frame_summaries(frames, exports)
    got = {(r["day"].day, r["metric"]): r for r in Q.percentile_columns(days, (0.5, 0.9)).collect()}
    for d in (1, 2):
        x = sorted(r[2] for r in rows if r[4].day == d and r[2] is not None and r[2] >= 0)
        r = got[d, "processing_ms"]
        assert r["n"] == len(x) and r["p50"] == x[math.ceil(len(x) / 2) - 1] and r["p90"] == x[math.ceil(0.9 * len(x) - 1e-9) - 1] and r["max_rank_error"] == 0
    both = {r["metric"]: r for r in Q.percentile_columns(Q.combined(days, ["engine", "metric"]), (0.5,)).collect()}
    x = sorted(r[3] for r in rows)
    assert both["timestamp"]["n"] == 300 and both["timestamp"]["p50"] == x[149]
    assert Q.frame_summaries(frames.limit(0), exports).count() == 0


def test_groups_and_splits(spark):
    kind = "entry_id bigint, label string, subject_id string, session_id string, group_id bigint"
    m = [(1, "Ann", None, "k1", 0), (2, "ＡＮＮ ", None, "n/a", 0), (3, None, "v1", "K1", 0), (4, None, "v9", "", 0), (5, "Zed", None, None, 0), (6, "", "v9", "-", 0), (7, None, None, None, 0), (1, "Ann", None, "k1", 0), (None, "Ann", None, None, 0)]
    p = [(100, "zed", "Q", None, "k7"), (101, None, "q​", "K7", None), (102, "N/A", "none", "tbd", "?")]
    pairs = spark.createDataFrame(p, "pair_id bigint, left_subject_id string, right_subject_id string, left_session_id string, right_session_id string")
    got = {r["record_id"]: r["group_id"] for r in R.related_groups(spark.createDataFrame(m, kind), pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 6: 4, 5: 5, 100: 5, 101: 5, 7: 7, 102: 102}
    splits = R.related_splits(spark.createDataFrame(m, kind), pairs).collect()
    by: dict = {}
    for r in splits:
        by.setdefault(r["group_id"], set()).add(r["split"])
    assert len(splits) == 10 and all(len(x) == 1 for x in by.values())
    totals = {s: sum(r["split"] == s for r in splits) for s in ("train", "validation", "test")}
    assert totals == {"train": 8, "validation": 1, "test": 1}
    assert R.related_groups(spark.createDataFrame([], kind), pairs.limit(0)).count() == 0


def test_closest_counts_against_all_subsets():
    rng = random.Random(3)
    for _ in range(60):
        sizes = {rng.randrange(1, 12): rng.randrange(1, 5) for _ in range(4)}
        every = {0}
        for s, n in sizes.items():
            every = {t + s * k for t in every for k in range(n + 1)}
        target = rng.randrange(0, sum(s * n for s, n in sizes.items()) + 1)
        took = R.closest_counts(sizes, target)
        assert all(0 < n <= sizes[s] for s, n in took.items())
        assert abs(sum(s * n for s, n in took.items()) - target) == min(abs(t - target) for t in every)
    assert R.closest_counts({}, 5) == {} and pytest.approx(1) == 1


def test_large_totals_are_exact():
    rng = random.Random(7)
    for _ in range(6):
        sizes = {rng.randrange(100_000, 4_000_000): rng.randrange(1, 3) for _ in range(6)} | {3: 2, 50: 1}
        every = {0}
        for s, n in sizes.items():
            every = {t + s * k for t in every for k in range(n + 1)}
        target = rng.randrange(5_000_000, 9_000_000)
        total = sum(s * n for s, n in R.closest_counts(sizes, target).items())
        assert abs(total - target) == min(abs(t - target) for t in every)
    # many sizes, and one component that is a third of everything
    sizes = {s: 1 + s % 3 for s in range(1, 400)} | {80_000: 1}
    for target in (1, 12_345, 100_000):
        took = R.closest_counts(sizes, target)
        assert sum(s * n for s, n in took.items()) == target and all(0 < n <= sizes[s] for s, n in took.items())
