"""Tracker: state rules, and equality of stream and replay."""

import pytest

from gallerist.operators.video import frames_once
from gallerist.streaming.tracking import advance, new_state, replay, stream


def face(x, key="ann", distance=0.1, accepted=True):
    return {"box": [float(x), 0.0, 10.0, 10.0], "accepted": accepted, "key": key, "distance": distance}


def test_votes_need_four_frames_and_two_in_a_row():
    s = new_state()
    states = [advance(s, 0.1 * i, [face(i)])[0][1] for i in range(5)]
    assert states == ["confirming"] * 3 + ["known"] * 2
    assert advance(s, 0.5, [face(5, "bob")])[0][1] == "confirming"


def test_gap_rewind_and_rejection():
    s = new_state()
    for i in range(4):
        out = advance(s, 0.1 * i, [face(0)])
    assert out[0][:3] == (1, "known", "ann")
    assert advance(s, 0.4, [face(0, accepted=False)])[0] == (1, "quality_rejected", None, None)
    assert advance(s, 0.5, [face(0)])[0][1] == "confirming"
    assert advance(s, 2.0, [face(0)])[0][0] == 2  # the old track ended
    assert advance(s, 1.0, [face(0)])[0][0] == 3  # time went back


def test_missed_track_loses_votes():
    s = new_state()
    for i in range(4):
        advance(s, 0.1 * i, [face(0)])
    advance(s, 0.4, [])
    assert advance(s, 0.5, [face(0)])[0][:2] == (1, "confirming")


def test_conflict_and_ambiguity():
    s = new_state()
    for i in range(4):
        out = advance(s, 0.1 * i, [face(0), face(500)])
    assert [r[1] for r in out] == ["identity_conflict"] * 2
    s = new_state()
    advance(s, 0.0, [face(0)])
    assert {r[0] for r in advance(s, 0.1, [face(0), face(0)])} == {2, 3}


def test_capacity():
    s = new_state()
    assert [r[1] for r in advance(s, 0.0, [face(1000 * i) for i in range(33)])][-1] == "capacity"


def test_stream_equals_replay(spark, data, tmp_path):
    frames = frames_once(spark.read.parquet(f"{data}/video_frames.parquet"))
    want = sorted(map(str, replay(frames).collect()))
    src = str(tmp_path / "in")
    frames.select("video", "frame", "timestamp", "faces").coalesce(1).sortWithinPartitions("video", "frame").write.json(src, ignoreNullFields=False)
    schema = frames.select("video", "frame", "timestamp", "faces").schema
    q = stream(spark.readStream.schema(schema).json(src)).writeStream.format("memory").queryName("tracked").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = sorted(map(str, spark.table("tracked").collect()))
    assert got == want and len(got) > 100
    assert pytest.approx(1.0) == 1.0


def test_features_decide_before_overlap():
    """With features a fast face keeps its track, and another person in the same place gets a new one."""
    s, one, two = new_state(), [1.0, 0.0], [0.0, 1.0]
    fed = lambda x, f: {**face(x), "feature": f}
    advance(s, 0.0, [fed(0, one)])
    assert advance(s, 0.1, [fed(12, one)])[0][0] == 1  # no overlap
    assert advance(s, 0.2, [fed(12, two)])[0][0] == 2
    s = new_state()
    advance(s, 0.0, [face(0)])
    assert advance(s, 0.1, [face(12)])[0][0] == 2  # without features an overlap is needed


def test_new_gallery_revision_forgets_tracks():
    s = new_state()
    for i in range(4):
        out = advance(s, 0.1 * i, [face(0)], "r1")
    assert out[0][:2] == (1, "known")
    assert advance(s, 0.4, [face(0)], "r2")[0][:2] == (2, "confirming")


def test_capacity_makes_room_for_the_longest_unseen():
    s = new_state()
    advance(s, 0.0, [face(1000 * i) for i in range(32)])
    advance(s, 0.1, [face(1000 * i) for i in range(1, 32)])
    assert advance(s, 0.2, [face(1000 * i) for i in range(2, 32)] + [face(90_000), face(91_000), face(92_000)])[-3:] == [(33, "confirming", None, None), (34, "confirming", None, None), (None, "capacity", None, None)]
    assert {0.2} == set(s.seen) and len(s.id) == 32


def test_tracks_against_plain_rules():
    """Random scenes against a slow reading of the rules with sets and loops."""
    import math
    import random

    rng = random.Random(8)
    for scene in range(20):
        s, live, number, last = new_state(), {}, 1, None
        time = 0.0
        for _ in range(25):
            time += rng.choice([0.1, 0.1, 0.1, 0.5, 1.2, -0.3])
            faces = [{"box": [rng.randrange(0, 60), 0.0, 20.0, 20.0], "accepted": rng.random() < 0.9, "key": rng.choice(["a", "b", "__unknown__", None]), "distance": rng.choice([0.1, 0.2, None])} for _ in range(rng.randrange(4))]
            if last is not None and time <= last:
                live = {}
            last, live = time, {k: x for k, x in live.items() if time - x[1] <= 0.9}
            costs = {}
            for k, x in live.items():
                for i, f in enumerate(faces):
                    wide = max(0, 20 - abs(x[0] - f["box"][0]))
                    iou = wide * 20 / (800 - wide * 20)
                    if abs(x[0] - f["box"][0]) / math.hypot(20, 20) <= 1.5 and iou >= 0.3:
                        costs[k, i] = (1 - iou) / 2
            tight = lambda of: len(of) > 1 and sorted(of)[1] - sorted(of)[0] < 0.025
            left = {e: c for e, c in costs.items() if not tight([c for (k, _), c in costs.items() if k == e[0]]) and not tight([c for (_, i), c in costs.items() if i == e[1]])}
            link = {}
            for c, k, i in sorted((c, k, i) for (k, i), c in left.items()):
                if k not in link.values() and i not in link:
                    link[i] = k
            for k in live:
                if k not in link.values():
                    live[k][2].clear()
            want = []
            for i, f in enumerate(faces):
                if i not in link:
                    link[i], number = number, number + 1
                    live[link[i]] = [0, 0, []]
                x = live[link[i]]
                x[0], x[1] = f["box"][0], time
                if not f["accepted"] or f["key"] is None:
                    x[2].clear()
                    want.append((link[i], "quality_rejected"))
                    continue
                x[2].append(f["key"])
                del x[2][:-7]
                firm = len(x[2]) >= 4 and x[2].count(f["key"]) / len(x[2]) >= 0.6 and x[2][-2] == f["key"]
                want.append((link[i], "confirming" if not firm else "unknown" if f["key"] == "__unknown__" else "known"))
            named = [faces[i]["key"] for i, w in enumerate(want) if w[1] == "known"]
            for i, w in enumerate(want):
                if w[1] == "known" and named.count(faces[i]["key"]) > 1:
                    want[i] = (w[0], "identity_conflict")
                    live[w[0]][2].clear()
            assert [r[:2] for r in advance(s, time, faces)] == want


def run_stream(spark, source, make, tmp_path, name):
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination()
    return spark.table(name)


def test_event_streams_equal_batch(spark, data, tmp_path):
    from gallerist.plans import catalog
    from gallerist.streaming import events as S

    events = spark.read.parquet(f"{data}/events.parquet").orderBy("ts", "event_id")
    half = events.count() // 2
    for i, part in enumerate((events.limit(half), events.exceptAll(events.limit(half)))):
        part.coalesce(1).write.parquet(str(tmp_path / "src" / f"{i}"))
    read = lambda: spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    want = {(r["event_id"], r["stable"]) for r in catalog.queries()["event_votes"](spark, data).collect()}
    got = {(r["event_id"], r["stable"]) for r in run_stream(spark, read(), S.votes, tmp_path, "votes").collect()}
    assert got == want
    rows = sorted((r["user_id"], r["ts"], r["event_id"], r["event_type"]) for r in events.collect())
    changed = {b[2] for a, b in zip([(None,) * 4, *rows], rows) if a[0] != b[0] or a[3] != b[3]}
    assert {r["event_id"] for r in run_stream(spark, read(), S.changes, tmp_path, "changes").collect()} == changed
    batch = {(r["user_id"], r["started"], r["events"]) for r in catalog.queries()["event_sessions"](spark, data).collect()}
    closed = {(r["user_id"], r["started"].replace(tzinfo=None), r["events"]) for r in run_stream(spark, read(), lambda e: S.sessions(e, late="3650 days"), tmp_path, "sessions").collect()}
    assert closed <= batch
