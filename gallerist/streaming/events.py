"""Stream forms of the vote, of sessions and of changed decisions over events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.operators.video import LEAST, SHARE, WINDOW


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of each user's sessions, which end after an idle ``gap``; rows
    later than ``late`` are dropped with the state they would need.  In append
    mode a session appears once the watermark has passed its end."""
    timed = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    return timed.groupBy("user_id", F.session_window("t", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def _stateful(rows: DataFrame, body, out: str, state: str, first):
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, store):
        now = list(store.get) if store.exists else first()
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"], kind="stable")
        kept = []
        for r in pdf.itertuples(index=False):
            now, extra = body(now, r)
            if extra is not None:
                kept.append((r.user_id, r.event_id, *extra))
        store.update(tuple(now))
        yield pd.DataFrame(kept, columns=[c.split()[0] for c in out.split(", ")])

    timed = rows.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return timed.groupBy("user_id").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def votes(events: DataFrame) -> DataFrame:
    """The rolling vote of every user: the state is the last few types."""

    def body(now, r):
        seen = [*now[0], r.event_type][-WINDOW:]
        stable = len(seen) >= LEAST and seen.count(r.event_type) / len(seen) >= SHARE and seen[-2] == r.event_type
        return [seen], (r.event_type, stable)

    return _stateful(events, body, "user_id bigint, event_id bigint, event_type string, stable boolean", "seen array<string>", lambda: [[]])


def changes(events: DataFrame) -> DataFrame:
    """Rows whose type differs from the one emitted before for the user."""

    def body(now, r):
        new = now[0] != r.event_type
        return [r.event_type], (r.event_type,) if new else None

    return _stateful(events, body, "user_id bigint, event_id bigint, event_type string", "last string", lambda: [None])
