"""Splits that keep related records together.

Method: records that share a subject or session are joined to components by
parallel hooking and shortcutting over parent tables, and subset-sum bitsets
over the multiplicities of the component sizes choose which components make up
each split.

Scale: a shared key is represented by its smallest record, so a key that a
third of all rows hold gives a star of edges and no pairs.  The driver sees
only the histogram of component sizes (at most the square root of twice the
rows different sizes), never components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.functions.text import key_or_null
from gallerist.operators.components import connected_components
from gallerist.storage import materialize, with_rank


def record_keys(manifest: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(record_id, key)`` of every subject and session that a record names.

    A manifest entry names its label, else its subject_id, and its session; a
    pair names both sides' subjects and sessions.  Keys are compared without
    regard to case, blanks, invisible characters and Unicode form; values that
    name nothing give no row.  Records without id are left out.
    """
    entry = manifest.filter("entry_id IS NOT NULL").select(F.col("entry_id").alias("record_id"), F.coalesce(key_or_null("label"), key_or_null("subject_id")).alias("s1"), key_or_null("session_id").alias("k1"))
    pair = pairs.filter("pair_id IS NOT NULL").select(
        F.col("pair_id").alias("record_id"), key_or_null("left_subject_id").alias("s1"), key_or_null("right_subject_id").alias("s2"),
        key_or_null("left_session_id").alias("k1"), key_or_null("right_session_id").alias("k2"),
    )
    tagged = lambda c, tag: F.when(F.col(c).isNotNull(), F.concat(F.lit(tag), F.col(c)))
    rows = entry.select("record_id", F.array(tagged("s1", "s:"), tagged("k1", "k:")).alias("keys"))
    rows = rows.unionByName(pair.select("record_id", F.array(tagged("s1", "s:"), tagged("s2", "s:"), tagged("k1", "k:"), tagged("k2", "k:")).alias("keys")))
    return rows.select("record_id", F.explode("keys").alias("key")).filter("key IS NOT NULL").distinct()


def related_groups(manifest: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(record_id, group_id, size)`` of every record; group_id is the
    smallest record of the group.  A redelivered record counts once; records
    that name nothing are groups of one."""
    keys = materialize(record_keys(manifest, pairs), "keys")
    first = keys.groupBy("key").agg(F.min("record_id").alias("head"))
    edges = keys.join(first, "key").select(F.col("record_id").alias("u"), F.col("head").alias("v"))
    roots = connected_components(edges)
    everyone = manifest.selectExpr("entry_id AS record_id").unionByName(pairs.selectExpr("pair_id AS record_id")).filter("record_id IS NOT NULL").distinct()
    groups = everyone.join(roots, everyone.record_id == roots.node, "left").select("record_id", F.coalesce("root", "record_id").alias("group_id"))
    groups = materialize(groups, "groups")
    return groups.join(groups.groupBy("group_id").agg(F.count("*").alias("size")), "group_id").select("record_id", "group_id", "size")


def reachable(sizes: list[tuple[int, int]], top: int) -> int:
    """Totals up to ``top`` of choices among (size, multiplicity), as the bits
    of an integer, by binary splitting of the multiplicities."""
    bits, mask = 1, (1 << (top + 1)) - 1
    for size, n in sizes:
        left, step = min(n, top // size), 1
        while left > 0:
            take = min(step, left)
            bits |= (bits << (take * size)) & mask
            left, step = left - take, step * 2
    return bits


def _reversed_bits(bits: int, width: int) -> int:
    """The lowest ``width`` bits in opposite order."""
    raw = np.frombuffer(bits.to_bytes(width // 8 + 1, "little"), np.uint8)
    return int.from_bytes(np.packbits(np.unpackbits(raw, bitorder="little")[:width][::-1], bitorder="little").tobytes(), "little")


def _counts_for(sizes: list[tuple[int, int]], total: int) -> dict[int, int]:
    """A choice with exactly ``total``, which is reachable.

    The sizes are halved; a total of one half whose rest the other half
    reaches is found, and both go on alone.  Only two sets are held at once,
    and the totals of a level add up to ``total``.
    """
    if not total:
        return {}
    if len(sizes) == 1:
        return {sizes[0][0]: total // sizes[0][0]}
    half = len(sizes) // 2
    both = reachable(sizes[:half], total) & _reversed_bits(reachable(sizes[half:], total), total + 1)
    first = (both & -both).bit_length() - 1
    return _counts_for(sizes[:half], first) | _counts_for(sizes[half:], total - first)


def closest_counts(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many components of each size to take so that the total is as close
    to ``target`` as any total can be.

    ``sizes`` maps a size to its multiplicity.  The sets of reachable totals
    have one bit for each total up to the target and one size beyond, so an
    eighth of a byte for each record wanted.  A tie goes to the smaller total.
    """
    if target <= 0 or not sizes:
        return {}
    every = sorted(sizes.items(), reverse=True)
    bits = reachable(every, target + every[0][0])
    below = (bits & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = bits >> (target + 1)
    beyond = target + (above & -above).bit_length() if above else None
    best = below if beyond is None or target - below <= beyond - target else beyond
    return _counts_for(every, best)


def related_splits(manifest: DataFrame, pairs: DataFrame, proportions: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1))) -> DataFrame:
    """``(record_id, group_id, split)``: whole groups in one split each, with
    totals as close to the proportions as the group sizes allow, smallest
    share first; what is left goes to the largest share."""
    groups = materialize(related_groups(manifest, pairs), "groups")
    heads = groups.select("group_id", "size").distinct()
    sizes = {int(r["size"]): int(r["n"]) for r in heads.groupBy("size").agg(F.count("*").alias("n")).toLocalIterator()}
    total = sum(s * n for s, n in sizes.items())
    whole = sum(p for _, p in proportions)
    ranked = with_rank(heads, ["group_id"], within=["size"])
    rest, used, plan = dict(sizes), dict.fromkeys(sizes, 0), []
    order = sorted(proportions, key=lambda x: x[1])
    for name, share in order[:-1]:
        for size, n in closest_counts({s: n for s, n in rest.items() if n}, round(total * share / whole)).items():
            plan.append((size, used[size], used[size] + n, name))
            used[size] += n
            rest[size] -= n
    spark = groups.sparkSession
    largest = order[-1][0]
    if not plan:
        return groups.select("record_id", "group_id", F.lit(largest).alias("split"))
    table = spark.createDataFrame(plan, "size bigint, low bigint, high bigint, split string")
    chosen = ranked.alias("h").join(table.alias("p"), (F.col("h.size") == F.col("p.size")) & (F.col("h.rank") >= F.col("p.low")) & (F.col("h.rank") < F.col("p.high")), "left")
    chosen = chosen.select("h.group_id", F.coalesce("p.split", F.lit(largest)).alias("split"))
    return groups.join(chosen, "group_id").select("record_id", "group_id", "split")
