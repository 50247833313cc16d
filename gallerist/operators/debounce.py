"""Keeping rows that follow the last kept one after a pause."""

from __future__ import annotations

from pyspark.sql import DataFrame


def debounce(rows: DataFrame, key: str, time: str, tie: str, pause: int) -> DataFrame:
    """Rows kept in the order of ``time`` (then ``tie``): the first of each key,
    and each that comes at least ``pause`` after the last kept one.  Rows
    without key or time are left out.  Only one value of state is held."""
    parts = rows.filter(f"{key} IS NOT NULL AND {time} IS NOT NULL").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, time, tie)

    def run(batches):
        now, last = None, None
        for pdf in batches:
            keep = []
            for k, x in zip(pdf[key], pdf[time]):
                if k != now:
                    now, last = k, None
                keep.append(last is None or x - last >= pause)
                if keep[-1]:
                    last = x
            yield pdf[keep]

    return parts.mapInPandas(run, parts.schema)
