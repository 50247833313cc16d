"""Same or near-same records across splits.

Method: weighted cosine join.  Every record is a sparse vector of weighted
terms; the vectors of one side are kept in inverted lists, and only as many of
a vector's terms are listed as are needed: with the terms in the order of what
they can contribute, the tail of a vector stays out of the lists while its dot
product with any vector of the other side is bound below the threshold, either
by the maximum weights of its terms there or by its own residual norm.
Joining the lists gives partial dot products; pairs whose partial product plus
residual bound stays below the threshold are dropped, the others get their
exact product.

A picture has one vector for each thing that can tie it to another picture: its
pixels, and each context (subject, session, time of capture, place in a file
tree).  In a context the terms are the chunks of its difference hash, and rare
chunks weigh more: the pictures of a session agree in the chunks that show the
room, so these stay out of the lists and the lists hold the few that tell the
pictures apart.  Weights lie between 1 and ``RARE``, so pairs within
``NEAR_BITS`` of each other can't fall below ``LEAST_COSINE``.

Scale: terms belong to a context, so all lists of a context are in one place:
the records are shuffled once by context, and whole contexts are joined as
arrays.  Contexts beyond ``HOT`` records are never gathered; there the terms
are triples of longer chunks, whose lists are short, and ``cosine_join`` joins
them as tables.  The exact check of the hash distance makes both agree.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gallerist.functions.text import folded, key_or_null
from gallerist.storage import materialize

#: Bits by which re-encoding changes a difference hash at most.
NEAR_BITS = 7
#: Chunks of a hash, of four bits each: at least ``CHUNKS - NEAR_BITS`` of them
#: stay equal.
CHUNKS = 16
#: Weight of the rarest term; of a term that all vectors of a context have: 1.
RARE = 1.25
LEAST_COSINE = (CHUNKS - NEAR_BITS) / (CHUNKS - NEAR_BITS + NEAR_BITS * RARE**2)
#: Records of a context that are joined in one place.
HOT = 2_048
#: In larger contexts: (lowest bit, bits) of ten chunks, of which three stay
#: equal, so that three equal chunks (19 bits or so) are a term.
WIDE = tuple((i * 64 // 10, (i + 1) * 64 // 10 - i * 64 // 10) for i in range(NEAR_BITS + 3))
TRIPLES = tuple(combinations(range(len(WIDE)), 3))
LEAST_TRIPLE = 1 / len(TRIPLES)
#: Rows of whole contexts that are joined at once.
AT_ONCE = 65_536


def cosine_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a left and a right vector with a cosine of at least ``threshold``.

    Both sides hold ``(id BIGINT, terms ARRAY<STRUCT<term BIGINT, weight
    DOUBLE>>)`` with positive weights, one row for each id and no term twice.
    Returns ``(left_id, right_id, cosine)``.  Null or empty vectors pair with
    nothing; an empty side gives an empty result.
    """

    def sized(df: DataFrame) -> DataFrame:
        norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))
        return df.filter(F.size("terms") > 0).select("id", norm.alias("norm"), "terms")

    def terms(df: DataFrame) -> DataFrame:
        return df.select("id", "norm", F.explode("terms").alias("x")).select("id", F.col("x.term").alias("term"), (F.col("x.weight") / F.col("norm")).alias("weight"))

    a, b = materialize(sized(left), "left"), materialize(sized(right), "right")
    probe = terms(b)
    top = probe.groupBy("term").agg(F.max("weight").alias("most"))
    posts = terms(a).join(top, "term")  # terms that the other side lacks bind nothing
    # the tail of each vector that can stay out of the lists: by maximum weights, or by residual norm
    listed = posts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((F.col("weight") * F.col("most")).alias("bound"), "weight", "term"))).alias("t"))
    run = F.aggregate(
        "t",
        F.struct(F.lit(0.0).alias("bound"), F.lit(0.0).alias("square"), F.lit(0.0).alias("rest"), F.lit(0).alias("out")),
        lambda s, x: F.when(
            F.least(s["bound"] + x["bound"], F.sqrt(s["square"] + x["weight"] * x["weight"])) < threshold - 1e-9,
            F.struct((s["bound"] + x["bound"]).alias("bound"), (s["square"] + x["weight"] * x["weight"]).alias("square"), F.least(s["bound"] + x["bound"], F.sqrt(s["square"] + x["weight"] * x["weight"])).alias("rest"), (s["out"] + 1).alias("out")),
        ).otherwise(F.struct((s["bound"] + 9.0).alias("bound"), (s["square"] + 9.0).alias("square"), s["rest"].alias("rest"), s["out"].alias("out"))),
    )
    listed = listed.select("id", "t", run.alias("run"))
    index = listed.select("id", F.col("run.rest").alias("rest"), F.explode(F.slice("t", F.col("run.out") + 1, F.size("t"))).alias("x"))
    index = index.select(F.col("id").alias("left_id"), "rest", F.col("x.term").alias("term"), F.col("x.weight").alias("wa"))
    right_terms = probe.select(F.col("id").alias("right_id"), "term", F.col("weight").alias("wb"))
    partial = index.join(right_terms, "term").groupBy("left_id", "right_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("part"), F.max("rest").alias("rest"))
    open_ = materialize(partial.filter(F.col("part") + F.col("rest") >= threshold - 1e-9), "open")
    # a vector without a tail has its exact product already; the tails of the others are looked up
    tails = listed.filter("run.out > 0").select(F.col("id").alias("left_id"), F.explode(F.slice("t", 1, F.col("run.out"))).alias("x")).select("left_id", F.col("x.term").alias("term"), F.col("x.weight").alias("wa"))
    more = open_.filter("rest > 0").join(tails, "left_id").join(right_terms, ["right_id", "term"]).groupBy("left_id", "right_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("more"))
    exact = open_.join(more, ["left_id", "right_id"], "left").select("left_id", "right_id", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("cosine"))
    return exact.filter(F.col("cosine") >= threshold - 1e-9)


def rarity_weights(df: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Weights from 1 (a term that all ``of`` vectors have) to ``RARE`` (one has it)."""
    return 1.0 + (RARE - 1.0) * (1.0 - np.log(df) / np.log(np.maximum(of, 2)))


def array_cosine_join(terms: np.ndarray, left: np.ndarray, of: np.ndarray, threshold: float, prune: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same join over arrays, with weights by rarity.

    ``terms`` (rows x places) holds term numbers, -1 for none; a term has one
    place, ``left`` tells the sides, and ``of`` is the number of vectors of a
    row's context.  Returns left rows, right rows, cosines, and the number of
    pairs that met in a list (candidates).
    """
    n = len(terms)
    row, place = np.nonzero(terms >= 0)
    _, code, df = np.unique(terms[row, place], return_inverse=True, return_counts=True)
    w = rarity_weights(df[code], of[row])
    w /= np.sqrt(np.bincount(row, w * w, n))[row]
    dense = np.zeros(terms.shape)
    dense[row, place] = w
    is_left = left[row]
    most = np.zeros(len(df))
    np.maximum.at(most, code[~is_left], w[~is_left])
    a, b = np.flatnonzero(is_left & (most[code] > 0)), np.flatnonzero(~is_left)
    bound = w[a] * most[code[a]]
    order = np.lexsort((bound, row[a]))
    a, bound = a[order], bound[order]
    rest = np.zeros(n)
    if prune and len(a):
        begin = np.searchsorted(row[a], row[a])  # where the terms of the same vector begin
        run_b, run_s = np.cumsum(bound), np.cumsum(w[a] * w[a])
        tail = np.minimum(run_b - (run_b - bound)[begin], np.sqrt(np.maximum(run_s - (run_s - w[a] * w[a])[begin], 0.0)))
        out = tail < threshold - 1e-9
        np.maximum.at(rest, row[a[out]], tail[out])
        a = a[~out]
    a = a[np.argsort(code[a], kind="stable")]
    low, high = np.searchsorted(code[a], code[b], "left"), np.searchsorted(code[a], code[b], "right")
    meets = high - low
    at = np.repeat(low, meets) + np.arange(meets.sum()) - np.repeat(np.cumsum(meets) - meets, meets)
    i, j = row[a[at]], np.repeat(row[b], meets)
    pair, where = np.unique(i * n + j, return_inverse=True)
    part = np.bincount(where, w[a[at]] * np.repeat(w[b], meets), len(pair))
    i, j = pair // n, pair % n
    open_ = part + rest[i] >= threshold - 1e-9
    i, j = i[open_], j[open_]
    cosine = (dense[i] * dense[j] * ((terms[i] == terms[j]) & (terms[i] >= 0))).sum(axis=1)
    keep = cosine >= threshold - 1e-9
    return i[keep], j[keep], cosine[keep], len(pair)


def place_key(image: Column) -> Column:
    """The end of a path from its last component that carries a date (eight
    digits in a row), without file type, letter case, path style, and marks of
    copies (thumb_, _copy, ~1, (1), -resized, _640x480, .q70); null if none does."""
    path = F.regexp_replace(F.lower(F.regexp_replace(image, r"\\", "/")), "/+", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"\.(jpe?g|png|bmp|webp|tiff?|gif)$", ""), r"(^|/)thumb[_-]([^/]*)$", "$1$2")
    path = F.regexp_replace(path, r"([ ._-]*(copy|small|resized|edited|thumb|[0-9]{2,5}x[0-9]{2,5}|q[0-9]{1,3})|~[0-9]+| ?\([0-9]+\))+$", "")
    last = F.regexp_extract(path, r"^(?:.*/)?([^/]*[0-9]{8}.*)$", 1)
    return F.when(last != "", last)


def prepared_entries(manifest: DataFrame) -> DataFrame:
    """One row for each entry, with the cleaned fields the join needs.

    A redelivered entry counts once; of differing rows under one entry id the
    first in the order of all fields counts.  Entries without id or split take
    no part.
    """
    fields = ["entry_id", "split", "source", "image", "label", "subject_id", "session_id", "sha256", "dhash64", "captured_at_utc"]
    rows = manifest.select(*fields).filter("entry_id IS NOT NULL AND split IS NOT NULL")
    rows = rows.groupBy("entry_id").agg(F.min(F.struct(*fields[1:])).alias("r")).select("entry_id", "r.*")
    digest = F.lower(F.trim("sha256"))
    return rows.select(
        "entry_id", F.lower(F.trim("split")).alias("split"), "source",
        F.when(digest.rlike("^[0-9a-f]{64}$"), digest).alias("digest"), F.col("dhash64").alias("dhash"), place_key(F.col("image")).alias("place"),
        F.coalesce(key_or_null("label"), key_or_null("subject_id")).alias("subject"), key_or_null("session_id").alias("session"),
        F.expr("try_to_timestamp(captured_at_utc)").alias("captured"),
    )


#: Kinds of vectors: the pixels; the hash in a context; the place alone, where
#: one of two pictures has no hash.
PIXELS, HASH, BLANK = 0, 1, 2


def _vectors(entries: DataFrame) -> DataFrame:
    """``(key, kind, entry_id, is_train, dhash)``: one row for each vector of an
    entry.  Keys are 64-bit hashes of what two pictures must share."""
    row = lambda kind, name, value, when: F.when(when, F.struct(F.xxhash64(F.lit(name), value).alias("key"), F.lit(kind).alias("kind")))
    hashed = F.col("dhash").isNotNull()
    kinds = [row(PIXELS, "pixels", F.col("digest"), F.col("digest").isNotNull()), row(BLANK, "blank", F.col("place"), F.col("place").isNotNull())]
    kinds += [row(HASH, c, F.col(c), F.col(c).isNotNull() & hashed) for c in ("subject", "session", "captured", "place")]
    return entries.select("entry_id", "is_train", "dhash", F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("v")).select("v.key", "v.kind", "entry_id", "is_train", "dhash")


def _terms(context: np.ndarray, kind: np.ndarray, left: np.ndarray, dhash: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Term numbers (rows x CHUNKS) of vectors of numbered contexts.

    Pixels have one term.  In a place, where a picture may have no hash, two
    hashed pictures share no term, and all others do.
    """
    out = np.full((len(context), CHUNKS), -1, np.int64)
    base = context.astype(np.int64) * (16 * CHUNKS)
    at = np.flatnonzero(kind == HASH)
    shift = (4 * np.arange(CHUNKS)).astype(np.uint64)
    nibble = (dhash[at].view(np.uint64)[:, None] >> shift) & np.uint64(15)
    out[at] = base[at][:, None] + 16 * np.arange(CHUNKS) + nibble.astype(np.int64)
    for n, has in enumerate((~(left & hashed), left == hashed)):
        at = (kind == BLANK) & has
        out[at, n] = base[at] + 16 * n
    out[kind == PIXELS, 0] = base[kind == PIXELS]
    return out


def _joined(key, kind, entry, left, dhash, hashed):
    """Pairs of entries of whole contexts: train entry, other entry, cosine."""
    content = np.where(kind == HASH, dhash, np.where(kind == BLANK, hashed, 0))
    order = np.lexsort((content, left, key))
    key, kind, entry, left, dhash, hashed, content = (x[order] for x in (key, kind, entry, left, dhash, hashed, content))
    first = np.ones(len(key), bool)  # equal vectors of a side are one class
    first[1:] = (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (content[1:] != content[:-1])
    head = np.flatnonzero(first)
    size = np.diff(np.append(head, len(key)))
    context = np.cumsum(np.append(True, key[head][1:] != key[head][:-1])) - 1
    of = np.bincount(context)[context]
    i, j, cosine, _ = array_cosine_join(_terms(context, kind[head], left[head], dhash[head], hashed[head]), left[head], of, LEAST_COSINE)
    far = np.bitwise_count(dhash[head[i]].view(np.uint64) ^ dhash[head[j]].view(np.uint64))
    keep = (kind[head[i]] != HASH) | (far <= NEAR_BITS)
    i, j, cosine = i[keep], j[keep], cosine[keep]
    many = size[i] * size[j]
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    i, j, cosine = np.repeat(i, many), np.repeat(j, many), np.repeat(cosine, many)
    return entry[head[i] + nth // size[j]], entry[head[j] + nth % size[j]], cosine


def _join_contexts(batches):
    """mapInArrow body over vectors sorted by context."""
    held, count = [], 0

    def done(table: pa.Table):
        table = table.combine_chunks()
        hashed = ~np.asarray(table.column("dhash").is_null())
        dhash = table.column("dhash").fill_null(0).to_numpy()
        a, b, cosine = _joined(table.column("key").to_numpy(), table.column("kind").to_numpy(), table.column("entry_id").to_numpy(), table.column("is_train").to_numpy(zero_copy_only=False), dhash, hashed)
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(cosine)], ["train_entry", "other_entry", "cosine"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= AT_ONCE:
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last context may go on
            if cut:
                yield done(table.slice(0, cut))
            held, count = table.slice(cut).to_batches(), len(key) - cut
    if count:
        yield done(pa.Table.from_batches(held))


def _triple_terms() -> Column:
    """Weighted terms of a vector of a large context: its triples of long chunks."""
    parts = []
    for n, triple in enumerate(TRIPLES):
        mask = sum(((1 << WIDE[c][1]) - 1) << WIDE[c][0] for c in triple)
        parts.append(F.struct(F.xxhash64("key", F.lit(n), F.col("dhash").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))).alias("term"), F.lit(1.0).alias("weight")))
    one = lambda n: F.struct(F.xxhash64("key", F.lit(-n)).alias("term"), F.lit(1.0).alias("weight"))
    blank = F.when(F.col("is_train") & F.col("hashed"), F.array(one(2))).when(~F.col("is_train") & ~F.col("hashed"), F.array(one(1), one(2))).otherwise(F.array(one(1)))
    return F.when(F.col("kind") == HASH, F.array(*parts)).when(F.col("kind") == PIXELS, F.array(one(1))).otherwise(blank)


def _large_contexts(rows: DataFrame) -> DataFrame:
    """The pairs of contexts beyond ``HOT`` records, by joins of tables."""
    hashed = F.col("dhash").isNotNull()
    content = F.when(F.col("kind") == HASH, F.col("dhash")).when(F.col("kind") == BLANK, hashed.cast("bigint")).otherwise(F.lit(0))
    member = materialize(rows.withColumn("class", F.xxhash64("key", "is_train", content)).withColumn("hashed", hashed), "members")
    classes = member.groupBy("class").agg(F.first(F.struct("key", "kind", "is_train", "dhash", "hashed")).alias("r")).select("class", "r.*")
    classes = materialize(classes, "classes")
    vectors = classes.select("is_train", F.col("class").alias("id"), _triple_terms().alias("terms"))
    pairs = cosine_join(vectors.filter("is_train").select("id", "terms"), vectors.filter("NOT is_train").select("id", "terms"), LEAST_TRIPLE)
    a = classes.select(F.col("class").alias("left_id"), "kind", F.col("dhash").alias("a_hash"))
    b = classes.select(F.col("class").alias("right_id"), F.col("dhash").alias("b_hash"))
    far = F.bit_count(F.col("a_hash").bitwiseXOR(F.col("b_hash")))
    pairs = pairs.join(a, "left_id").join(b, "right_id").filter((F.col("kind") != HASH) | (far <= NEAR_BITS)).select("left_id", "right_id", "cosine")
    pairs = pairs.join(member.select(F.col("class").alias("left_id"), F.col("entry_id").alias("train_entry")), "left_id")
    return pairs.join(member.select(F.col("class").alias("right_id"), F.col("entry_id").alias("other_entry")), "right_id").select("train_entry", "other_entry", "cosine")


def overlapping_entries(entries: DataFrame) -> DataFrame:
    """``(train_entry, other_entry, cosine)`` of ``entries(entry_id, is_train,
    digest, dhash, place, subject, session, captured)``: the pairs that share a
    digest; or a place, where a hash is missing; or have near hashes and share
    a subject, session, time of capture or place."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = _vectors(entries)
    sides = vectors.groupBy("key").agg(F.count_if("is_train").alias("a"), F.count_if(~F.col("is_train")).alias("b")).filter("a > 0 AND b > 0")
    sides = materialize(sides.select("key", (F.col("a") + F.col("b") > HOT).alias("hot")), "contexts")
    vectors = vectors.join(sides, "key")
    ordinary = vectors.filter("NOT hot").drop("hot").repartition(4 * parts, "key").sortWithinPartitions("key")
    found = ordinary.mapInArrow(_join_contexts, "train_entry bigint, other_entry bigint, cosine double")
    if not sides.filter("hot").isEmpty():
        found = found.unionByName(_large_contexts(vectors.filter("hot").drop("hot")))
    return found.groupBy("train_entry", "other_entry").agg(F.max("cosine").alias("cosine"))


def cross_split_overlaps(manifest: DataFrame, train: str = "train") -> DataFrame:
    """Pairs of a train entry and another split's entry made from the same shot.

    Returns ``(train_entry, other_entry, split, source, cosine)``, split and
    source being the other entry's.  A near hash alone does not make a case:
    different people before one background have near hashes too, so the two
    pictures share a subject, session, time of capture or place besides (see
    ``overlapping_entries``).  Entries with neither digest, hash nor place pair
    with nothing; an empty table gives no rows.
    """
    entries = materialize(prepared_entries(manifest).withColumn("is_train", F.col("split") == train), "entries")
    about = entries.filter("NOT is_train").select(F.col("entry_id").alias("other_entry"), "split", "source")
    return overlapping_entries(entries).join(about, "other_entry").select("train_entry", "other_entry", "split", "source", "cosine")


def overlap_counts(pairs: DataFrame) -> DataFrame:
    """Number of overlaps, and of entries in them, for each split and source."""
    source = folded("source")
    return pairs.groupBy("split", source.alias("source")).agg(
        F.count("*").alias("pairs"), F.countDistinct("other_entry").alias("entries"), F.countDistinct("train_entry").alias("train_entries")
    )
