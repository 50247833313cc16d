"""Multi-face tracking with rolling votes, as a stateful operator.

A frame reaches Python as parallel arrays (boxes, decisions, distances, and
features where there are any), which Catalyst makes of the nested faces.  The
live tracks of a stream are a table of arrays as well (``Tracks``), one row a
track, and a frame is one step over both: a matrix of costs, vetoes by row and
column, an assignment, and updates of whole columns.  The batch replay runs
the steps over the sorted frames of each video; the stream runs them in
``applyInPandasWithState`` and keeps the table in typed state fields between
triggers, so both give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gallerist.operators.video import LEAST, SHARE, UNKNOWN, WINDOW, box_iou

#: Seconds a track survives, near-tie of costs, live tracks.
MAX_GAP, AMBIGUITY, MAX_TRACKS = 0.9, 0.025, 32
MAX_OFFSET, MAX_DISTANCE, MIN_IOU = 1.5, 0.25, 0.3
OUT = "video string, frame int, idx int, track int, state string, name string, distance double"
STATE = "time double, following int, revision string, id array<int>, seen array<double>, box array<array<double>>, feature array<array<double>>, votes array<array<struct<key string, distance double>>>"


@dataclass
class Tracks:
    """Live tracks of a stream, by growing number.

    ``key`` and ``distance`` hold the last ``WINDOW`` votes of each track, the
    newest last; a place without a vote has the key None.
    """

    time: float | None = None
    following: int = 1
    revision: str | None = None
    id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0))
    box: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, object))
    key: np.ndarray = field(default_factory=lambda: np.zeros((0, WINDOW), object))
    distance: np.ndarray = field(default_factory=lambda: np.zeros((0, WINDOW)))

    def keep(self, rows: np.ndarray) -> None:
        for name in ("id", "seen", "box", "feature", "key", "distance"):
            setattr(self, name, getattr(self, name)[rows])

    def forget_votes(self, rows: np.ndarray) -> None:
        self.key[rows], self.distance[rows] = None, np.nan

    def begin(self, boxes: np.ndarray, time: float) -> np.ndarray:
        """Rows of new tracks."""
        n, had = len(boxes), len(self.id)
        self.id = np.append(self.id, np.arange(self.following, self.following + n))
        self.seen, self.box = np.append(self.seen, np.full(n, time)), np.concatenate([self.box, boxes])
        self.feature = np.append(self.feature, np.full(n, None, object))
        self.key = np.concatenate([self.key, np.full((n, WINDOW), None, object)])
        self.distance = np.concatenate([self.distance, np.full((n, WINDOW), np.nan)])
        self.following += n
        return np.arange(had, had + n)


def new_state() -> Tracks:
    return Tracks()


def link_costs(boxes: np.ndarray, features: np.ndarray, others: np.ndarray, other_features: np.ndarray) -> np.ndarray:
    """Costs of continuing tracks (rows) with faces (columns); infinite where
    the centres are too far apart, or the features (half cosine distance), or,
    where one has no feature, the boxes overlap too little."""
    missing = (1 - box_iou(boxes, others)) / 2
    off = (boxes[:, None, :2] + boxes[:, None, 2:] / 2) - (others[None, :, :2] + others[None, :, 2:] / 2)
    diagonal = np.maximum(np.maximum(np.hypot(boxes[:, 2], boxes[:, 3])[:, None], np.hypot(others[:, 2], others[:, 3])[None, :]), 1.0)
    cost = np.where(missing <= (1 - MIN_IOU) / 2, missing, np.inf)
    a, b = (np.flatnonzero([f is not None for f in x]) for x in (features, other_features))
    if len(a) and len(b):
        u, v = np.stack(list(features[a])), np.stack(list(other_features[b]))
        apart = np.clip((1 - (u @ v.T) / np.linalg.norm(u, axis=1)[:, None] / np.linalg.norm(v, axis=1)) / 2, 0, 1)
        cost[np.ix_(a, b)] = np.where(apart <= MAX_DISTANCE, 0.75 * apart + 0.25 * missing[np.ix_(a, b)], np.inf)
    return np.where(np.hypot(off[..., 0], off[..., 1]) / diagonal <= MAX_OFFSET, cost, np.inf)


def assign(cost: np.ndarray) -> np.ndarray:
    """Track row of every face, -1 for none: the cheapest link first, each end
    once.  A track or face whose two cheapest links are nearly equal has none."""
    face = np.full(cost.shape[1], -1)
    if not cost.size:
        return face
    veto = np.zeros(cost.shape, bool)
    for axis in (0, 1):
        if cost.shape[axis] > 1:
            low = np.partition(cost, 1, axis=axis).take([0, 1], axis=axis)
            with np.errstate(invalid="ignore"):
                near = (np.diff(low, axis=axis) < AMBIGUITY) & np.isfinite(low.take([1], axis=axis))
            veto |= near
    open_ = np.where(veto, np.inf, cost)
    while np.isfinite(least := open_.min()):
        t, i = np.argwhere(open_ == least)[0]
        face[i] = t
        open_[t, :] = open_[:, i] = np.inf
    return face


def majority(keys: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the newest votes (rows, newest last) are stable, and the
    representative distance: the one nearest to the median of the winner's."""
    newest = keys[:, -1:]
    same = (keys == newest) & (newest != np.array(None))
    n = (keys != np.array(None)).sum(axis=1)
    stable = (n >= LEAST) & (same.sum(axis=1) >= SHARE * n - 1e-12) & same[:, -2]
    mine = np.where(same, distances, np.nan)
    known = stable & ~np.isnan(mine).all(axis=1)
    best = np.full(len(keys), np.nan)
    if known.any():
        off = np.round(np.abs(mine[known] - np.nanmedian(mine[known], axis=1)[:, None]), 12)
        best[known] = mine[known][np.arange(known.sum()), np.nanargmin(off, axis=1)]
    return stable, best


def step(tracks: Tracks, time: float, boxes: np.ndarray, accepted: np.ndarray, keys: np.ndarray, distances: np.ndarray, features: np.ndarray, revision: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One frame: track number (0 for none), state, name and distance of each face.

    A time that is not after the last one, or another revision of the gallery,
    forgets all tracks (numbers go on); tracks unseen for ``MAX_GAP`` seconds
    end; a track that is missed, or seen in a rejected frame, loses its votes;
    beyond ``MAX_TRACKS`` the longest unseen track makes room, and faces
    without room have the state "capacity"; faces confirmed as one person at
    once all lose their votes.
    """
    again = tracks.time is not None and time <= tracks.time or revision != tracks.revision
    tracks.time, tracks.revision = time, revision
    tracks.keep(np.zeros(len(tracks.id), bool) if again else time - tracks.seen <= MAX_GAP)
    row = assign(link_costs(tracks.box, tracks.feature, boxes, features))
    free = np.setdiff1d(np.arange(len(tracks.id)), row)
    tracks.forget_votes(free)
    # room for new tracks: unused numbers, then the longest unseen
    fresh = np.flatnonzero(row < 0)
    lost = max(0, min(len(fresh) - (MAX_TRACKS - len(tracks.id)), len(free)))
    fresh = fresh[: MAX_TRACKS - len(tracks.id) + lost]
    stay = np.ones(len(tracks.id), bool)
    stay[free[np.lexsort((tracks.id[free], tracks.seen[free]))][:lost]] = False
    row = np.where(row >= 0, np.cumsum(stay)[row] - 1 if len(stay) else row, row)
    tracks.keep(stay)
    row[fresh] = tracks.begin(boxes[fresh], time)
    placed = row >= 0
    at = row[placed]
    tracks.box[at], tracks.seen[at] = boxes[placed], time
    voting = placed & accepted & (keys != np.array(None))
    tracks.forget_votes(row[placed & ~voting])
    at = row[voting]
    tracks.feature[at] = features[voting]
    tracks.key[at] = np.concatenate([tracks.key[at][:, 1:], keys[voting][:, None]], axis=1)
    tracks.distance[at] = np.concatenate([tracks.distance[at][:, 1:], distances[voting][:, None]], axis=1)
    stable, best = np.zeros(len(boxes), bool), np.full(len(boxes), np.nan)
    stable[voting], best[voting] = majority(tracks.key[at], tracks.distance[at])
    known = stable & (keys != UNKNOWN)
    _, claim, claims = np.unique(keys[known].astype(str), return_inverse=True, return_counts=True)
    clash = known.copy()
    clash[known] = claims[claim] > 1
    tracks.forget_votes(row[clash])
    state = np.select([~placed, ~voting, clash, ~stable, known], ["capacity", "quality_rejected", "identity_conflict", "confirming", "known"], "unknown")
    shown = stable & ~clash
    number = np.zeros(len(boxes), np.int64)
    number[placed] = tracks.id[row[placed]]
    return number, state, np.where(shown & known, keys, None), np.where(shown, best, np.nan)


def advance(tracks: Tracks, time: float, faces: list[dict], revision: str | None = None) -> list[tuple]:
    """``step`` over faces given as dicts of box, accepted, key, distance and
    perhaps feature; (track, state, name, distance) of each."""
    column = lambda name: np.array([None] * len(faces) + [0], object)[:-1] if not faces else _objects([f.get(name) for f in faces])
    boxes = np.array([f["box"] for f in faces], float).reshape(-1, 4)
    distances = np.array([np.nan if f["distance"] is None else f["distance"] for f in faces], float)
    features = _objects([None if f.get("feature") is None else np.asarray(f["feature"], float) for f in faces])
    got = step(tracks, time, boxes, np.array([f["accepted"] for f in faces], bool), column("key"), distances, features, revision)
    return [(int(n) or None, str(s), k, None if np.isnan(d) else float(d)) for n, s, k, d in zip(*got)]


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    for i, v in enumerate(values):
        out[i] = v
    return out


def observed(frames: DataFrame) -> DataFrame:
    """Frames with their faces as parallel arrays.

    The key of a face is its single-frame name, ``UNKNOWN`` for an unknown one
    and null without a decision.  A ``feature`` of the faces and a ``revision``
    of the frames are used where the frames have them.
    """
    face = frames.schema["faces"].dataType.elementType
    each = lambda f: F.transform("faces", f)
    single = lambda x: x["single_frame"]
    key = each(lambda x: F.when(single(x)["state"] == "known", F.coalesce(single(x)["name"], F.lit(UNKNOWN))).when(single(x)["state"] == "unknown", F.lit(UNKNOWN)))
    feature: Column = each(lambda x: x["feature"].cast("array<double>")) if "feature" in face.fieldNames() else F.lit(None).cast("array<array<double>>")
    revision = F.col("revision").cast("string") if "revision" in frames.columns else F.lit(None).cast("string")
    timed = frames.filter("timestamp IS NOT NULL AND NOT isnan(timestamp) AND abs(timestamp) < double('infinity')")  # others can't be placed
    return timed.select(
        "video", "frame", "timestamp", F.flatten(each(lambda x: x["box"].cast("array<double>"))).alias("boxes"), each(lambda x: F.coalesce(x["quality"]["accepted"], F.lit(False))).alias("accepted"),
        key.alias("keys"), each(lambda x: F.coalesce(single(x)["distance"], F.lit(float("nan")))).alias("distances"), feature.alias("features"), revision.alias("revision"),
    )


def _rows(tracks: Tracks, pdf: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for video, frame, time, boxes, accepted, keys, distances, features, revision in zip(*(pdf[c] for c in ("video", "frame", "timestamp", "boxes", "accepted", "keys", "distances", "features", "revision"))):
        n = 0 if accepted is None else len(accepted)
        seen = [None if f is None else np.asarray(f, float) for f in features] if features is not None else [None] * n
        got = step(tracks, float(time), np.asarray(boxes if n else [], float).reshape(n, 4), np.asarray(accepted if n else [], bool), _objects(list(keys) if n else []), np.asarray(distances if n else [], float), _objects(seen), revision)
        parts.append((video, frame, n, *got))
    counts = [p[2] for p in parts]
    join = lambda i: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0)
    number, distance = pd.Series(join(3)), pd.Series(join(6), dtype=float)
    return pd.DataFrame({
        "video": np.repeat(np.array([p[0] for p in parts], object), counts), "frame": np.repeat(np.array([p[1] for p in parts], np.int64), counts),
        "idx": np.concatenate([np.arange(1, n + 1) for n in counts]) if parts else np.zeros(0, int), "track": number.astype("Int32").where(number > 0),
        "state": join(4).astype(object), "name": join(5).astype(object), "distance": distance.astype(object).where(distance.notna(), None),
    })


def replay(frames: DataFrame) -> DataFrame:
    """Tracks of every video from its frames, in one pass over sorted frames.

    Frames of a video have to be taken in order; videos are independent, and
    only one batch is held at a time, so a long video needs no more memory
    than a short one.
    """
    rows = observed(frames).repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video").sortWithinPartitions("video", "frame")

    def run(batches):
        now, tracks = None, None
        for pdf in batches:
            for video, part in pdf.groupby("video", sort=False):
                if video != now:
                    now, tracks = video, new_state()
                yield _rows(tracks, part)

    return rows.mapInPandas(run, OUT)


def _saved(t: Tracks) -> tuple:
    votes = [[(k, None if np.isnan(d) else float(d)) for k, d in zip(ks, ds) if k is not None] for ks, ds in zip(t.key, t.distance)]
    feature = [None if f is None else [float(x) for x in f] for f in t.feature]
    return (t.time, int(t.following), t.revision, [int(i) for i in t.id], [float(x) for x in t.seen], [[float(x) for x in b] for b in t.box], feature, votes)


def _restored(saved) -> Tracks:
    time, following, revision, ids, seen, box, feature, votes = saved
    t = Tracks(time, following, revision, np.array(ids, np.int64), np.array(seen, float), np.array([list(b) for b in box], float).reshape(-1, 4), _objects([None if f is None else np.array(list(f), float) for f in feature]))
    t.key, t.distance = np.full((len(ids), WINDOW), None, object), np.full((len(ids), WINDOW), np.nan)
    for i, row in enumerate(votes):
        for place, (k, d) in enumerate(row, WINDOW - len(row)):
            t.key[i, place], t.distance[i, place] = k, np.nan if d is None else d
    return t


def stream(frames: DataFrame, idle_hours: float | None = None) -> DataFrame:
    """The same over a stream of frames, one state per video.

    Frames of a trigger are sorted by number; a redelivered or late frame is
    not after the last one and therefore resets the tracks, as in a replay.
    With ``idle_hours`` the state of a video is dropped after so many hours
    without a frame, which a stream that runs for ever should set; a query that
    ends by itself (``availableNow``) can't, as Spark goes on waiting for it.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def body(key, batches, store):
        if store.hasTimedOut:
            store.remove()
            return
        tracks = _restored(store.get) if store.exists else new_state()
        pdf = pd.concat(list(batches)).sort_values("frame", kind="stable")
        yield _rows(tracks, pdf)
        store.update(_saved(tracks))
        if idle_hours is not None:
            store.setTimeoutDuration(int(idle_hours * 3_600_000))

    timeout = GroupStateTimeout.NoTimeout if idle_hours is None else GroupStateTimeout.ProcessingTimeTimeout
    return observed(frames).groupBy("video").applyInPandasWithState(body, OUT, STATE, "append", timeout)
