"""Shared storage: where intermediate tables live and how lineage is cut.

Every intermediate that has to survive the loss of an executor is written as
a Parquet table below ``spark.checkpoint.dir`` (the folder all executors
share) and read back.  A folder of our own is used only where that setting is
missing and everything runs in one process; on a cluster its absence is an
error, as executors would write to their own disks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="gallerist-"))
        root = "file://" + _OWN_FOLDER[0]
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared root; removed when the driver ends."""
    path = f"{shared_root(spark)}/gallerist/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(remove)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to shared storage and continue from the written table."""
    return written(df, new_folder(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it.  The shuffle files of the write go
    at its end, not when the driver happens to collect its garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``new_folder`` before the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_rank(df: DataFrame, order: list[str], within: list[str] = (), name: str = "rank", parts: int | None = None) -> DataFrame:
    """Zero-based rank by ``order`` inside each ``within`` group, without ever
    gathering a group in one task.

    Rows are range-partitioned and sorted once; a rank is the offset of its
    (partition, group) plus the position inside the sorted partition.  The
    offsets table has one row per partition and group met there.  ``order``
    must be a total order for the ranks to be reproducible.
    """
    spark = df.sparkSession
    keys = [*within, *order]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    ordered = ordered.withColumn("_mid", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ranked").withColumn("_pid", F.shiftright("_mid", 33))
    ordered = ordered.withColumn("_pos", F.col("_mid").bitwiseAND((1 << 33) - 1))
    cells = ordered.groupBy("_pid", *within).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    from pyspark.sql import Window

    before = Window.partitionBy(*within).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    on = F.col("a._pid") == F.col("b._pid")
    for k in within:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    out = ordered.alias("a").join(cells.alias("b"), on, "inner")
    return out.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("b._offset") + F.col("a._pos") - F.col("b._first")).alias(name))


def exact_quantiles(df: DataFrame, value: str, ps: tuple[float, ...], within: list[str] = ()) -> DataFrame:
    """``(*within, n, q)``: quantiles of ``value`` by linear interpolation, as
    an array in the order of ``ps``, from global ranks: no group is gathered.

    Nulls and NaN don't count; a group without values has no row.
    """
    rows = df.select(*within, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    # equal values are one row with their number, which makes the order total
    counted = rows.groupBy(*within, "_v").agg(F.count("*").alias("_c"))
    keys = [*within, "_v"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = materialize(counted.repartitionByRange(parts, *keys).withColumn("_pid", F.spark_partition_id()), "values")
    from pyspark.sql import Window

    cells = counted.groupBy("_pid", *within).agg(F.sum("_c").alias("_s"))
    before = Window.partitionBy(*within).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_pid", *within, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy(*within)).alias("n"))
    inside = Window.partitionBy("_pid", *within).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = F.col("a._pid") == F.col("b._pid")
    for k in within:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    run = counted.withColumn("_run", F.sum("_c").over(inside))
    placed = run.alias("a").join(cells.alias("b"), on).select(*[F.col(f"a.{k}") for k in within], "_v", "n", (F.col("_run") + F.col("_before")).alias("_last"), "_c")
    at = lambda place: F.max(F.when((F.col("_last") > place) & (F.col("_last") - F.col("_c") <= place), F.col("_v")))
    q = []
    for p in ps:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, part = at(F.floor(place)), F.max(place - F.floor(place))
        q.append(low + part * (at(F.ceil(place)) - low))
    return placed.groupBy(*within).agg(F.max("n").alias("n"), F.array(*q).alias("q"))
