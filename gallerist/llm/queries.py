"""Queries of the training-data operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from gallerist.storage import table

#: p1, p3: the half cosine distance up to which two faces count as alike.
ALIKE = 0.12


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from gallerist.llm.knn import nearest

    near = nearest(table(spark, folder, "samples"), k=5, limit=ALIKE)
    return near.select(F.least("id", "neighbour").alias("sample_a"), F.greatest("id", "neighbour").alias("sample_b")).distinct()


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Five most similar templates of every valid sample, with their persons."""
    from gallerist.llm.knn import nearest

    samples = table(spark, folder, "samples")
    owner = samples.groupBy(F.col("id").alias("neighbour")).agg(F.min("person_id").alias("person_id"))
    near = nearest(samples, k=5)
    return near.join(owner, "neighbour").select(F.col("id").alias("sample_id"), "neighbour", "person_id", "distance", "place")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from gallerist.llm.overlap import cross_split_overlaps

    pairs = cross_split_overlaps(table(spark, folder, "manifest"))
    return pairs.select(F.least("train_entry", "other_entry").alias("entry_a"), F.greatest("train_entry", "other_entry").alias("entry_b")).distinct()


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    from gallerist.llm.overlap import cross_split_overlaps, overlap_counts

    return overlap_counts(cross_split_overlaps(table(spark, folder, "manifest")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from gallerist.llm.clusters import clusters

    return clusters(table(spark, folder, "samples"), limit=ALIKE).select(F.col("id").alias("sample_id"), "cluster_id").distinct()


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Size, medoid and five most typical members of each cluster part."""
    from gallerist.llm.clusters import clusters

    members = clusters(table(spark, folder, "samples"), limit=ALIKE)
    typical = F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), F.col("id").alias("id"))
    rank = F.row_number().over(Window.partitionBy("part_id").orderBy(typical))
    top = members.withColumn("r", rank).filter("r <= 5")
    return top.groupBy("part_id").agg(
        F.min("cluster_id").alias("cluster_id"), F.max("part_size").alias("size"), F.max("size").alias("cluster_size"),
        F.min(F.when(F.col("medoid"), F.col("id"))).alias("medoid"), F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"),
    )


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per video, engine and day."""
    from gallerist.llm.quantiles import frame_summaries, percentile_columns

    return percentile_columns(frame_summaries(table(spark, folder, "video_frames"), table(spark, folder, "video_exports")), (0.5, 0.9, 0.95, 0.99))


def p4_engine_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per engine over all days, combined from the day summaries."""
    from gallerist.llm.quantiles import combined, frame_summaries, percentile_columns

    days = frame_summaries(table(spark, folder, "video_frames"), table(spark, folder, "video_exports"))
    return percentile_columns(combined(days, ["engine", "metric"]), (0.5, 0.9, 0.95, 0.99))


def p4_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of 64 tuples only: are all percentiles of every group within
    the rank error that was tracked?"""
    from gallerist.llm.quantiles import frame_measures, frame_summaries, percentile_columns, rank_errors

    frames, keys = table(spark, folder, "video_frames"), ["video", "day", "metric"]
    answers = percentile_columns(frame_summaries(frames, table(spark, folder, "video_exports"), size=64), (0.5, 0.9, 0.95, 0.99))
    return rank_errors(answers, frame_measures(frames), {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, keys).select(*keys, "n", "within")


def p5_subset(spark: SparkSession, folder: str) -> DataFrame:
    """A twentieth of the valid samples, spread over vectors and conditions."""
    from gallerist.llm.hilbert import sample_conditions, sample_score, varied_subset

    chosen = varied_subset(table(spark, folder, "samples"), sample_conditions(table(spark, folder, "manifest")), share=0.05, score=sample_score())
    return chosen.select(F.col("id").alias("sample_id"), F.col("stratum").alias("condition"), "cell", "score")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from gallerist.llm.related import related_groups

    groups = related_groups(table(spark, folder, "manifest"), table(spark, folder, "pair_manifest"))
    return groups.filter("size > 1").select("record_id", "group_id")


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    from gallerist.llm.related import related_splits

    return related_splits(table(spark, folder, "manifest"), table(spark, folder, "pair_manifest"))


def p6_split_check(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a split, and groups whose records are in several (none)."""
    splits = p6_splits(spark, folder)
    per = splits.groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct("split").alias("splits"))
    return per.agg(F.sum("n").alias("records"), F.count_if(F.col("splits") > 1).alias("broken_groups"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    from gallerist.llm.tokens import encode_corpus

    return encode_corpus(table(spark, folder, "documents"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document decoded from its ids, and whether that is its text."""
    from gallerist.llm.tokens import decode_corpus, encode_corpus

    documents = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    decoded = decode_corpus(encode_corpus(table(spark, folder, "documents")))
    return decoded.join(documents, "doc_id").select("doc_id", (F.col("text") == F.col("original")).alias("same"))


def p8_copies(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used in the mixture."""
    from gallerist.llm.mixing import mix

    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    from gallerist.llm.mixing import mix, shares

    targets = table(spark, folder, "mix_targets")
    return shares(mix(table(spark, folder, "documents"), targets), targets)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from gallerist.llm.subjects import subject_areas

    return subject_areas(table(spark, folder, "documents"), table(spark, folder, "subject_areas"), table(spark, folder, "subject_labels"))


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each subject area and their share of all documents."""
    found = p9_found(spark, folder).groupBy("subject").agg(F.count("*").alias("documents"))
    total = table(spark, folder, "documents").agg(F.countDistinct("doc_id").alias("n")).first()["n"]
    return found.select("subject", "documents", (F.col("documents") / F.lit(total)).alias("share"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
