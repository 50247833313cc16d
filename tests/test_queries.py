"""Every query of the engine against its SQL twin on the small tables."""

import math
from collections import Counter
from pathlib import Path

import pytest

from gallerist.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in SQL:  # other tests compare the operators of these with brute force
        assert got
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    want = Counter(str([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert got == want


def test_links_without_overlap(spark, data):
    links = QUERIES["association_edges"](spark, data).collect()
    assert any(r["iou"] == 0 for r in links) and all(r["cost"] is not None for r in links)


def test_pairs_of_all_templates_in_blocks(spark, data):
    from gallerist.plans.recognition import pair_summaries
    from gallerist.storage import table

    e = table(spark, data, "embeddings")
    got = {r["label"]: r for r in pair_summaries(e, rows=9).collect()}
    n = {r["label"]: r["count"] for r in e.groupBy("label").count().collect()}
    assert {k: r["pairs"] for k, r in got.items()} == {k: c * (c - 1) // 2 for k, c in n.items()}
    whole = {r["label"]: r for r in QUERIES["template_pairs_genuine"](spark, data).collect()}
    assert all(plain(got[k][c]) == plain(whole[k][c]) for k in n for c in ("least", "mean", "most"))


def test_matrix_has_every_variant_and_margin(spark, data):
    from gallerist.plans.experiments import frozen_points

    rows = QUERIES["matrix_experiment"](spark, data).collect()
    heads = {tuple(r["variant"].split("-")[:3]) for r in rows}
    assert len(rows) == 168 and {h[1] for h in heads} == {"1", "2", "3", "5"} and {h[2] for h in heads if h[0] == "random"} == {"42", "43", "44"}
    # the unknown one is nearer than the last known one, but has no lead
    made = [("v", 1, 1, 0.10, 0.30), ("v", None, 2, 0.20, 0.21), ("v", 3, 3, 0.25, 0.40)]
    frame = spark.createDataFrame(made, "variant string, expected int, candidate int, best double, second double")
    assert [tuple(r) for r in frozen_points(frame, 0.0, (0.0, 0.02, 0.04)).collect()] == [("v", 0.25, 0.02)]


def test_near_duplicates_without_broadcast(spark):
    import random

    from gallerist.plans.leakage import near_duplicate_warnings

    draw, rows = random.Random(5), []
    for n in range(200):  # one subject; hashes that differ in up to six bits
        h = draw.getrandbits(64)
        for split, flips in (("train", 0), ("test", n % 7)):
            x = h
            for bit in draw.sample(range(64), flips):
                x ^= 1 << bit
            rows.append((len(rows), split, "A", None, x - (1 << 64) if x >> 63 else x))
    frame = spark.createDataFrame(rows, "entry_id bigint, split string, label string, subject_id string, dhash64 bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        found = near_duplicate_warnings(lambda _: frame)
        got = {(r["entry_a"], r["entry_b"]): r["bits"] for r in found.collect()}
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    differ = {(b[0], a[0]): bin((a[4] ^ b[4]) & (1 << 64) - 1).count("1") for a in rows if a[1] == "train" for b in rows if b[1] == "test"}
    assert got == {k: n for k, n in differ.items() if n <= 4}
