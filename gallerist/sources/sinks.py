"""Writers: versioned gallery, event log, create-only results, journal."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
import warnings
from contextlib import contextmanager
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gallerist.functions.names import name_key, normalized_name, valid_name

PEOPLE = "id string, name string, name_key string, created_at string, active int"
SAMPLES = "id string, person_id string, vector array<double>, quality string, created_at string"
ARCHIVES = "id string, person_id string, restored int"


def write_json_once(path: str | Path, value) -> None:
    """Create a JSON file as a whole, or fail if there is one; NaN is refused."""
    path = Path(path)
    text = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with open(part, "x", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(part, path)  # fails if the name exists
    finally:
        part.unlink()


@contextmanager
def new_result_directory(path: str | Path):
    """Fill a staging folder that becomes ``path`` on success and vanishes on
    failure; an existing path is never touched."""
    path = Path(path)
    if path.exists():
        raise FileExistsError(path)
    stage = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    stage.mkdir(parents=True)
    try:
        yield stage
        os.rename(stage, path)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Ordered columns with a header as one CSV file; other columns are left
    out.  For results of a size that one file suits."""
    df.select(*columns).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def log_events(df: DataFrame, path: str) -> bool:
    """Append ``(event, ...)`` rows with a time stamp as JSON lines.  A log that
    can't be written is warned of and doesn't stop the caller."""
    try:
        df.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), "*").write.mode("append").json(path)
    except Exception as e:
        warnings.warn(f"events were not logged: {type(e).__name__}", RuntimeWarning, stacklevel=2)
        return False
    return True


def write_video_exports(exports: DataFrame, frames: DataFrame, path: str) -> None:
    """Exports as JSON lines, a file for each video: its metadata, its frames
    in order, and a summary.  An existing path is refused; a redelivered frame
    is written once, and frames of videos without metadata are left out."""
    meta = exports.filter("video IS NOT NULL").dropDuplicates(["video"])
    once = frames.filter("frame IS NOT NULL").dropDuplicates(["video", "frame"]).join(meta.select("video"), "video", "left_semi")
    ends = meta.select("video").join(once.groupBy("video").agg(F.count("*").alias("n")), "video", "left")
    line = lambda kind, *cols: F.to_json(F.struct(F.lit(kind).alias("type"), *cols)).alias("value")
    rows = meta.select("video", F.lit(-1).cast("bigint").alias("at"), line("metadata", *[c for c in meta.columns if c != "type"]))
    rows = rows.unionByName(once.select("video", F.col("frame").cast("bigint").alias("at"), line("frame", "frame", "timestamp", "processing_ms", "faces")))
    last = line("summary", "video", F.coalesce("n", F.lit(0)).alias("analyzed_frames"))
    rows = rows.unionByName(ends.select("video", F.lit((1 << 63) - 1).alias("at"), last))
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "video").sortWithinPartitions("video", "at").select("video", "value").write.mode("errorifexists").partitionBy("video").text(path)


class Journal:
    """Single-use record of a run: each state once, in order."""

    STATES = ("started", "frozen", "test_opening", "completed")

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def __enter__(self) -> "Journal":
        self.folder.mkdir(parents=True)  # a used journal is refused
        self.mark("started")
        return self

    def mark(self, state: str, **facts) -> None:
        done = [s for s in self.STATES if (self.folder / f"{s}.json").exists()]
        if state != "failed" and (state not in self.STATES or self.STATES.index(state) != len(done)):
            raise ValueError(f"{state} after {done}")
        write_json_once(self.folder / f"{state}.json", {"at": datetime.now(timezone.utc).isoformat(), **facts})

    def __exit__(self, kind, error, _) -> None:
        if kind is not None:
            self.mark("failed", error=kind.__name__)  # the text of an error may hold private names


class Gallery:
    """People, samples and archives as immutable numbered versions.

    A version lists the folders that make up each table.  A change writes only
    what is new, or the tables it changes, lists that, and moves the pointer by
    creating the file of the next number, which fails if another writer was
    first.  The revision is the version's number.  There is one winner per
    version, but no merging of concurrent changes.
    """

    def __init__(self, spark: SparkSession, folder: str, signature: str, dimension: int):
        self.spark, self.folder, self.dimension = spark, Path(folder), dimension
        if not self.folder.exists():
            self.folder.mkdir(parents=True)
            write_json_once(self.folder / "meta.json", {"signature": signature, "dimension": dimension, "schema": 1})
            empty = {n: spark.createDataFrame([], s) for n, s in (("people", PEOPLE), ("samples", SAMPLES), ("archives", ARCHIVES))}
            self._commit(0, empty)
        meta = json.loads((self.folder / "meta.json").read_text())
        if (meta["signature"], meta["dimension"], meta["schema"]) != (signature, dimension, 1):
            raise ValueError("another feature space, dimension or schema")

    @property
    def revision(self) -> int:
        return max(int(p.stem) for p in (self.folder / "commits").glob("*.json"))

    def _folders(self, revision: int) -> dict[str, list[str]]:
        return json.loads((self.folder / "commits" / f"{revision}.json").read_text())

    def read(self, name: str, revision: int | None = None) -> DataFrame:
        where = self._folders(self.revision if revision is None else revision)[name]
        return self.spark.read.schema({"people": PEOPLE, "samples": SAMPLES, "archives": ARCHIVES}[name]).parquet(*[str(self.folder / w) for w in where])

    def _commit(self, revision: int, tables: dict[str, DataFrame], kept: dict[str, list[str]] | None = None) -> int:
        """Write ``tables`` behind the folders that are ``kept``."""
        where = {n: list(w) for n, w in (kept or {}).items()}
        for name, df in tables.items():
            folder = f"data/{revision}-{name}-{uuid.uuid4().hex}"
            df.write.parquet(str(self.folder / folder))
            where.setdefault(name, []).append(folder)
        (self.folder / "commits").mkdir(exist_ok=True)
        write_json_once(self.folder / "commits" / f"{revision}.json", where)
        return revision

    def _next(self, new: dict[str, DataFrame] | None = None, whole: dict[str, DataFrame] | None = None) -> int:
        """The next version, with ``new`` rows behind those of some tables and
        some tables ``whole``."""
        r = self.revision
        kept = {n: w for n, w in self._folders(r).items() if n not in (whole or {})}
        return self._commit(r + 1, (whole or {}) | (new or {}), kept)

    def add(self, new: DataFrame) -> int:
        """Append ``new(name, vector, quality)``: names resolve to active people
        by key, others are created; all or nothing."""
        from gallerist.functions.vectors import valid_vector

        now = datetime.now(timezone.utc).isoformat()
        rows = new.select(normalized_name(F.col("name")).alias("name"), name_key(F.col("name")).alias("name_key"), F.col("vector").cast("array<double>").alias("vector"), F.col("quality").cast("string").alias("quality"), valid_name(F.col("name")).alias("ok"))
        bad = rows.filter(~F.coalesce(F.col("ok") & valid_vector(F.col("vector"), self.dimension), F.lit(False)))
        if not bad.isEmpty():
            raise ValueError("a name or vector is not valid; nothing was added")
        live = self.read("people").filter("active = 1").select("name_key", F.col("id").alias("known"))
        found = rows.join(live, "name_key", "left")
        made = F.sha2(F.concat_ws("|", F.lit(now), F.lit(time.time_ns()), "name_key"), 256).substr(1, 32)
        found = found.withColumn("person_id", F.coalesce("known", made))
        created = found.filter("known IS NULL").groupBy("person_id", "name_key").agg(F.min("name").alias("name"))
        people = created.select(F.col("person_id").alias("id"), "name", "name_key", F.lit(now).alias("created_at"), F.lit(1).alias("active"))
        samples = found.select(F.expr("replace(uuid(), '-', '')").alias("id"), "person_id", "vector", "quality", F.lit(now).alias("created_at"))
        return self._next(new={"people": people, "samples": samples})

    def archive(self, person_id: str | None = None) -> str:
        """Deactivate one person, or all; returns the archive's id."""
        people = self.read("people")
        gone = F.lit(True) if person_id is None else F.col("id") == person_id
        hit = people.filter(gone & (F.col("active") == 1))
        if hit.isEmpty():
            raise KeyError(person_id)
        name = uuid.uuid4().hex
        entry = hit.select(F.lit(name).alias("id"), F.col("id").alias("person_id"), F.lit(0).alias("restored"))
        self._next(new={"archives": entry}, whole={"people": people.withColumn("active", F.when(gone, F.lit(0)).otherwise(F.col("active")))})
        return name

    def restore(self, archive_id: str) -> int:
        """Reactivate an archive once; a name in use stops it."""
        archives, people = self.read("archives"), self.read("people")
        mine = archives.filter((F.col("id") == archive_id) & (F.col("restored") == 0))
        back = mine.select(F.col("person_id").alias("id"))
        if back.isEmpty():
            raise KeyError(archive_id)
        keys = people.join(back, "id", "left_semi").select("name_key")
        if not people.filter("active = 1").join(keys, "name_key", "left_semi").isEmpty():
            raise ValueError("a name of the archive is in use")
        ids = back.withColumn("b", F.lit(1))
        people = people.join(ids, "id", "left").withColumn("active", F.when(F.col("b") == 1, F.lit(1)).otherwise(F.col("active"))).drop("b")
        archives = archives.withColumn("restored", F.when(F.col("id") == archive_id, F.lit(1)).otherwise(F.col("restored")))
        return self._next(whole={"people": people, "archives": archives})

    def scan(self) -> DataFrame:
        """Active templates in the order of name key, person and sample."""
        p = self.read("people").filter("active = 1").select(F.col("id").alias("person_id"), "name", "name_key")
        rows = p.join(self.read("samples"), "person_id").select("person_id", "name", "name_key", F.col("id").alias("template"), "vector")
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("person_id").orderBy("template")))
