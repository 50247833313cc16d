"""Encoding a corpus with a public byte-level tokenizer.

Method: overlapping chunk encoding.  A text of more than ``chunk`` characters
is cut into chunks that reach ``overlap`` characters into their successors.
Every chunk is pre-tokenised on its own, in parallel; the first boundaries of
a chunk may be wrong, as it may begin inside a pre-token, but once a boundary
coincides with a right one of the chunk before, all later ones are right too,
because a pre-token depends on the text from its own start only.  So the
chunks are stitched at the first boundary on which both agree, and the pieces
between these boundaries are encoded independently.  A text with a chunk where
no boundary agrees (a pre-token longer than the overlap) is cut in the order
of its chunks instead, each time going on from the last right boundary, so it
needs no more memory than a chunk or its longest pre-token.  Decoding
concatenates the bytes of the ids.

Only boundaries after a character that is not white space serve as stitches:
how a run of blanks is cut depends on what follows it.

Scale: a task never holds more than a chunk of a long text while
pre-tokenising; only boundaries near the stitches are exchanged.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gallerist.storage import materialize

TOKENIZERS = os.environ.get("GALLERIST_TOKENIZERS", "/opt/tokenizers")
MODEL = "byte_bpe_50k.json"
CHUNK, OVERLAP = 4_096, 512


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file; strings of special tokens in a text are text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def boundaries(path: str, text: str, start: int) -> np.ndarray:
    """Ends of the pre-tokens of ``text`` after non-blank characters, plus ``start``."""
    ends = [e for _, (_, e) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]
    return np.array([e + start for e in ends if not text[e - 1].isspace()], np.int64)


def _cut(chunk: int, overlap: int, path: str):
    def run(batches):
        for batch in batches:
            rows = {"doc_id": [], "k": [], "start": [], "body": [], "head": [], "tail": []}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for k, start in enumerate(range(0, len(text), chunk)):
                    rows["doc_id"].append(doc)
                    rows["k"].append(k)
                    rows["start"].append(start)
                    rows["body"].append(text[start : start + chunk + overlap])
                    if sum(map(len, rows["body"][-64:])) > 1 << 18 and len(rows["body"]) >= 64:
                        yield _chunk_batch(rows)
                        rows = {c: [] for c in rows}
            if rows["doc_id"]:
                yield _chunk_batch(rows)

    return run


def _chunk_batch(rows: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["k"], pa.int32()), pa.array(rows["start"], pa.int64()), pa.array(rows["body"], pa.string())], ["doc_id", "k", "start", "body"])


def _ends(chunk: int, overlap: int, path: str):
    """Boundaries of a chunk in the overlap with its predecessor (head) and with
    its successor (tail).  The last pre-tokens of a chunk that goes on are left
    out of the tail, as they may be cut."""

    def run(batches):
        for batch in batches:
            heads, tails = [], []
            for start, body in zip(batch.column("start").to_pylist(), batch.column("body").to_pylist()):
                e = boundaries(path, body, start)
                heads.append(e[e <= start + overlap])
                tail = e[e >= start + chunk]
                tails.append(tail[tail < start + len(body) - 1])  # a match at the very end may be cut short
            cols = [batch.column(c) for c in ("doc_id", "k")]
            yield pa.record_batch([*cols, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["doc_id", "k", "head", "tail"])

    return run


def pieces_in_order(rows, chunk: int, path: str):
    """Pieces (document, number, text) of the texts whose chunks come in order:
    what is left after the last boundary that is certain begins the next piece."""
    now, left, n, tried = None, "", 0, 0
    for doc, body in rows:
        if doc != now:
            if left:
                yield now, n, left
            now, left, n, tried = doc, "", 0, 0
        left += body[:chunk]
        if len(left) < 2 * tried:
            continue  # inside a very long pre-token: looked at again when it has doubled
        ends = boundaries(path, left, 0)
        ends = ends[ends < len(left) - 1]  # a match at the very end may be cut short
        if len(ends):
            yield now, n, left[: ends[-1]]
            left, n, tried = left[ends[-1] :], n + 1, 0
        else:
            tried = len(left)
    if left:
        yield now, n, left


def _encode_in_order(chunk: int, path: str):
    """Pieces are cut and encoded by one worker, which has one tokenizer."""

    def run(batches):
        rows = ((d, b) for batch in batches for d, b in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()))
        for doc, n, text in pieces_in_order(rows, chunk, path):
            ids = tokenizer(path).encode(text, add_special_tokens=False).ids
            yield pa.record_batch([pa.array([doc], pa.int64()), pa.array([n], pa.int32()), pa.array([np.asarray(ids, np.int32)], pa.list_(pa.int32()))], ["doc_id", "k", "ids"])

    return run


def _encode(path: str):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [np.asarray(e.ids, np.int32) for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]
            keys = [batch.column(c) for c in ("doc_id", "k")]
            yield pa.record_batch([*keys, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "k", "ids"])

    return run


def encode_corpus(documents: DataFrame, model: str = MODEL, folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, ids ARRAY<INT>)`` of every document, without special tokens.

    The ids equal those of encoding the whole text at once.  A null, empty or
    missing text gives an empty list.  Each row gives one row; for a repeated
    doc_id the rows must be equal, and one is kept.
    """
    path = os.path.join(folder, model)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"))
    short = rows.filter(F.coalesce(F.char_length("text"), F.lit(0)) <= chunk)
    whole = short.select("doc_id", F.lit(0).alias("k"), "text").mapInArrow(_encode(path), "doc_id bigint, k int, ids array<int>").select("doc_id", "ids")
    long = rows.filter(F.char_length("text") > chunk)
    chunks = materialize(long.mapInArrow(_cut(chunk, overlap, path), "doc_id bigint, k int, start bigint, body string"), "chunks")
    spread = chunks.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "k")
    ends = materialize(spread.mapInArrow(_ends(chunk, overlap, path), "doc_id bigint, k int, head array<bigint>, tail array<bigint>"), "ends")
    # stitch of chunk k: the first boundary that its predecessor and it agree on
    before = ends.select("doc_id", (F.col("k") + 1).alias("k"), "tail")
    agreed = F.array_min(F.array_intersect("head", "before.tail"))
    stitch = ends.alias("own").join(before.alias("before"), ["doc_id", "k"], "left").select("doc_id", "k", F.when(F.col("k") == 0, 0).otherwise(agreed).alias("cut"))
    stitch = materialize(stitch, "stitches")
    gaps = stitch.filter("cut IS NULL").select("doc_id").distinct()
    plan = stitch.join(gaps, "doc_id", "left_anti").withColumn("next", F.lead("cut").over(Window.partitionBy("doc_id").orderBy("k")))
    parts = chunks.join(plan, ["doc_id", "k"])
    begin = F.col("cut") - F.col("start")
    length = F.when(F.col("next").isNull(), F.char_length("body")).otherwise(F.col("next") - F.col("cut"))  # up to the next stitch, or the end
    begin = F.when(F.col("k") == 0, 0).otherwise(begin)
    pieces = parts.select("doc_id", "k", F.substr("body", (begin + 1).cast("int"), length.cast("int")).alias("text"))
    sequel = chunks.join(gaps, "doc_id", "left_semi").select("doc_id", "k", "body").repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "k")
    schema = "doc_id bigint, k int, ids array<int>"
    coded = pieces.mapInArrow(_encode(path), schema).unionByName(sequel.select("doc_id", "body").mapInArrow(_encode_in_order(chunk, path), schema))
    joined = coded.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.unionByName(joined)


@lru_cache(maxsize=2)
def byte_table(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary.

    Byte-level vocabularies write each byte as one printable character: bytes
    that are printable in Latin-1 as themselves, the others as the code points
    from 256 upwards, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocab = tokenizer(path).get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def decode_corpus(coded: DataFrame, model: str = MODEL, folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, text)`` of encoded documents: the bytes of the ids in a row."""
    path = os.path.join(folder, model)

    def run(batches):
        for batch in batches:
            out = byte_table(path)
            texts = [b"".join(out[i] for i in ids or ()).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_counts(documents: DataFrame, model: str = MODEL, folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, tokens)`` of every document."""
    return encode_corpus(documents, model, folder).select("doc_id", F.size("ids").alias("tokens"))
