"""The vector table: Parquet partitioned by video, in versions, appended by id, scanned with partition pruning."""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import REPORTS, VECTORS


class VectorStore:
    """A durable collection. A missing one reads as empty.

    Each append writes a folder of its own, and counts once a version that lists it is there: a small file, numbered, that
    is put in place by a rename that doesn't replace. So readers see whole appends only, a writer that finds its number
    taken looks at what came in between and tries the next, and clearing is a version that lists nothing. A version also
    holds the last batch of each stream, so a batch that runs again is known without reading anything. (As exclusive as
    the file system's rename: HDFS's is; a local one looks first and renames then.)
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType = VECTORS) -> None:
        self.spark, self.path = spark, path
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _path(self, *parts: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self) -> JavaObject:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, dict]:
        """The newest version's number, -1 if there is none, and what it lists: folders, and last batches by stream."""
        fs, folder = self._fs(), self._path("_versions")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        number = max((int(n[:-5]) for n in names if n.endswith(".json")), default=-1)
        if number < 0:
            return -1, {"folders": [], "streams": {}}
        found = self.spark._jvm.org.apache.commons.io.IOUtils
        stream = fs.open(self._path("_versions", f"{number:012}.json"))
        try:
            return number, json.loads(bytes(found.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _put(self, number: int, listed: dict) -> bool:
        """Puts a version in place; false if its number is taken."""
        fs, made = self._fs(), self._path("_versions", f".{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration()).rename(made, self._path("_versions", f"{number:012}.json"), options)
            return True
        except Py4JJavaError as e:
            fs.delete(made, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def create(self) -> VectorStore:
        """Creates the collection if it is missing."""
        if self._latest()[0] < 0:
            self._put(0, {"folders": [], "streams": {}})
        return self

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/{f}" for f in folders)).select(*self.schema.fieldNames())

    def scan(self, video_id=None, *columns: str) -> DataFrame:
        """All rows or one video's, of the columns asked for, as of now: later appends aren't in it."""
        rows = self._read(self._latest()[1]["folders"])
        if video_id is not None:
            rows = rows.where(F.col("video_id") == F.lit(video_id))
        return rows.select(*columns) if columns else rows

    def _videos(self, folder: str) -> list[str] | None:
        """The videos of an append, by the names of its folders; None if a name isn't the plain value."""
        names = [x.getPath().getName() for x in self._fs().listStatus(self._path("data", folder)) if x.isDirectory()]
        values = [n.partition("=")[2] for n in names]
        return None if any("%" in v or v.startswith("__HIVE") for v in values) else values

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        folder, seen = f"append={uuid.uuid4().hex}", Observation()
        rows.select(*self.schema.fieldNames()).observe(seen, F.count("*").alias("n")).write.partitionBy("video_id").parquet(f"{self.path}/data/{folder}")
        return folder, seen.get["n"]

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None, unique: bool = True) -> int:
        """Adds the rows whose id isn't there yet, each id once; returns how many. `rows` are computed once.

        Only ids of the videos that the rows belong to are read. batch: a stream's name and the number of its batch; one
        that was taken in before adds nothing. unique: false takes rows as they are.
        """
        number, listed = self._latest()
        if batch and listed["streams"].get(batch[0], -1) >= batch[1]:
            return 0
        folder, n = self._write(rows.dropDuplicates(["id"]) if unique else rows)
        against: list[str] = listed["folders"]  # what the rows haven't been held against yet
        while True:
            if unique and n and against:
                own, had = self._read([folder]), self._read(against)
                if (videos := self._videos(folder)) is not None:
                    had = had.where(F.col("video_id").cast("string").isin(videos) if len(videos) > 1_000 else F.col("video_id").isin(*(F.lit(v).cast(self.schema["video_id"].dataType) for v in videos)))
                if (again := own.join(had.select("id"), "id", "left_semi").count()):
                    folder, n = self._write(new_rows(own, had)) if again < n else (folder, 0)
            after = {"folders": listed["folders"] + [folder] * bool(n), "streams": listed["streams"] | ({batch[0]: batch[1]} if batch else {})}
            if self._put(number + 1, after):
                return n
            before, (number, listed) = set(listed["folders"]), self._latest()
            if batch and listed["streams"].get(batch[0], -1) >= batch[1]:
                return 0
            against = [f for f in listed["folders"] if f not in before]

    def clear(self) -> None:
        """Drops all rows; the collection stays, and readers of older versions finish. Media files are not touched."""
        while True:
            number, listed = self._latest()
            if self._put(number + 1, {"folders": [], "streams": listed["streams"]}):
                return

    def vacuum(self) -> int:
        """Deletes folders that the newest version doesn't list, and older versions; no reader or writer may be at work. Returns how many folders."""
        fs, (number, listed) = self._fs(), self._latest()
        kept = set(listed["folders"])
        there = [x.getPath() for x in fs.listStatus(self._path("data"))] if fs.exists(self._path("data")) else []
        gone = [p for p in there if p.getName() not in kept]
        for p in gone:
            fs.delete(p, True)
        for x in fs.listStatus(self._path("_versions")) if number > 0 else []:
            if x.getPath().getName() != f"{number:012}.json":
                fs.delete(x.getPath(), False)
        return len(gone)


class SessionReports:
    """One row a processed video, appended as videos are taken in; a reset forgets them all."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._rows = VectorStore(spark, path, REPORTS)

    def append(self, reports: DataFrame) -> int:
        """Adds reports (`plans.timeline.video_report`, with `name`); returns how many. A video may be reported again."""
        rows = reports.select(*(F.col(c) if c in reports.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in REPORTS.split(", "))))
        return self._rows.append(rows, unique=False)

    def scan(self) -> DataFrame:
        return self._rows.scan()

    def reset(self) -> None:
        self._rows.clear()


def new_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows with ids that don't exist; of equal ids one."""
    return rows.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")


def vector_records(keyframes: DataFrame, compat_audio: bool = False) -> DataFrame:
    """Keyframe records flattened to what the table holds. keyframes: id, embedding, prompt, semantic, audio_text and the rest."""
    return keyframes.select(
        "id",
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.col("prompt").alias("document"),
        "frame_number",
        "timestamp",
        "frame_path",
        "scene_change_score",
        F.col("semantic.main_subject").alias("main_subject"),
        F.col("semantic.scene_type").alias("scene_type"),
        F.col("semantic.text_content").alias("text_content"),
        (F.lit("") if compat_audio else F.col("audio_text")).alias("audio_context"),
        "differential_norm",
        F.col("video_id").cast("string").alias("video_id"),
    )
