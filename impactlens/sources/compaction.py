"""Compaction of a stream's archive while it is written and read.

The fan-out writes each micro-batch under ``batch_id=N/date=D``, so a day ends
up in as many small files as there were batches. :func:`compact_days` rewrites
the days that are over into files of a target size. Nothing is replaced in
place: a run writes a folder of its own and then, as its last step, a
generation, the table of (date, run) that counts from now on and the last batch
it covers. A reader takes the newest complete generation and the rows of later
batches; one that began before goes on with the files it listed, because they
stay until :func:`remove_superseded`. A run that fails leaves a folder that no
generation names. Rows that arrive late for a day that is over are read from
their batch until the next run takes them in.

    folder/batch_id=N/date=D/...            as the stream writes it
    folder/_compact/run=R/date=D/...        rewritten days
    folder/_generations/G/...               (date, run, through): the table

One compaction runs at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .sinks import telemetry_archive_schema

TARGET_BYTES = 256 << 20
_TABLE = "date string, run string, through long"


class _Folder:
    """Names and removal of what lies in a folder, by Spark's file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def _schema(*folders: StructField) -> StructType:
    names = {f.name for f in folders}
    return StructType([f for f in telemetry_archive_schema().fields if f.name not in names] + list(folders))


_DATE, _BATCH = StructField("date", StringType()), StructField("batch_id", LongType())


def _generation(spark: SparkSession, folder: _Folder) -> tuple[int, list]:
    """(number, rows of the table) of the newest complete generation."""
    done = [int(n) for n in folder.names("_generations") if n.isdigit() and folder.has(f"_generations/{n}/_SUCCESS")]
    if not done:
        return 0, []
    newest = max(done)
    return newest, spark.read.schema(_TABLE).json(f"{folder.path}/_generations/{newest}").collect()


def _batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_schema(_BATCH, _DATE)).parquet(path)


def _taken_in(table: list):
    """Whether a batch's row is in a rewritten day."""
    found = F.lit(False)
    for through in {r.through for r in table}:
        days = [r.date for r in table if r.through == through]
        found = found | (F.col("date").isin(days) & (F.col("batch_id") <= through))
    return found


def _rewritten(spark: SparkSession, path: str, table: list) -> list[DataFrame]:
    """The days that the table takes from each run."""
    runs = sorted({r.run for r in table})
    return [spark.read.schema(_schema(_DATE)).parquet(f"{path}/_compact/run={run}")
            .filter(F.col("date").isin([r.date for r in table if r.run == run])) for run in runs]


def read_stream_archive(spark: SparkSession, path: str) -> DataFrame:
    """All telemetry of a fan-out, from rewritten days and later batches."""
    path = path.rstrip("/")
    _, table = _generation(spark, _Folder(spark, path))
    rows = _batches(spark, path).filter(~_taken_in(table)).drop("batch_id")
    for own in _rewritten(spark, path, table):
        rows = rows.unionByName(own)
    return rows


def compact_days(spark: SparkSession, path: str, before: str, target_bytes: int = TARGET_BYTES) -> int:
    """Rewrites the days before a date (``yyyy-MM-dd``) that have rows in
    complete batches not taken in yet; returns the number of days."""
    path = path.rstrip("/")
    folder = _Folder(spark, path)
    number, table = _generation(spark, folder)
    batches = [int(n.partition("=")[2]) for n in folder.names() if n.startswith("batch_id=") and folder.has(f"{n}/_SUCCESS")]
    if not batches:
        return 0
    through = max(batches)
    fresh = _batches(spark, path).filter((F.col("batch_id") <= through) & (F.col("date") < before) & ~_taken_in(table)).drop("batch_id")
    days = [r.date for r in fresh.select("date").distinct().collect()]
    if not days:
        return 0
    rows = fresh
    for own in _rewritten(spark, path, table):
        rows = rows.unionByName(own.filter(F.col("date").isin(days)))
    run = uuid.uuid4().hex
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    held = spark.conf.get(advisory, None)
    spark.conf.set(advisory, str(target_bytes))
    try:
        rows.hint("rebalance", "date").write.partitionBy("date").parquet(f"{path}/_compact/run={run}")
    finally:
        spark.conf.set(advisory, held) if held else spark.conf.unset(advisory)
    now = [(r.date, r.run, r.through) for r in table if r.date not in days] + [(d, run, through) for d in days]
    spark.createDataFrame(now, _TABLE).coalesce(1).write.json(f"{path}/_generations/{number + 1}")
    return len(days)


def remove_superseded(spark: SparkSession, path: str) -> None:
    """Removes files that no reader of the newest generation takes: days of
    batches that were rewritten, replaced runs, older generations. For a time
    when no reader of an older generation is left."""
    folder = _Folder(spark, path)
    number, table = _generation(spark, folder)
    through = {r.date: r.through for r in table}
    for batch in folder.names():
        if batch.startswith("batch_id="):
            for day in folder.names(batch):
                if int(batch.partition("=")[2]) <= through.get(day.partition("=")[2], -1):
                    folder.remove(f"{batch}/{day}")
    for run in folder.names("_compact"):
        kept = {r.date for r in table if f"run={r.run}" == run}
        for day in folder.names(f"_compact/{run}"):
            if day.startswith("date=") and day.partition("=")[2] not in kept:
                folder.remove(f"_compact/{run}/{day}")
        if not kept:
            folder.remove(f"_compact/{run}")
    for generation in folder.names("_generations"):
        if generation.isdigit() and int(generation) < number:
            folder.remove(f"_generations/{generation}")
