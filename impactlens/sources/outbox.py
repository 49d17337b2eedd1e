"""Publishing a stream exactly once to a shared folder.

:class:`OutboxSource` is a streaming sink that commits. Tasks write their
documents to files of their own; the driver then writes one commit that lists
the files of the batch, in a single step. A reader takes what commits list and
nothing else, so the files of failed tasks, of tasks that ran twice and of
batches that failed half-way are never seen. A batch that is run again finds
its commit and adds nothing, so a batch is published once, whatever fails.

    folder/data/<unique>.json      documents, one a line
    folder/commits/<batch>.json    the batch's files and their numbers of rows

One query writes to a folder. Folders are whatever ``pyarrow.fs`` opens; an
object store must show a written object at once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from .messages import _filesystem

_BYTES = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """A task's file; none if it had no rows."""

    file: str | None
    rows: int


class _Writer(DataSourceStreamWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        fs, folder = _filesystem(self.folder)
        name, rows, out = f"{uuid.uuid4().hex}.json", 0, None
        held, size = [], 0
        for row in iterator:
            if out is None:
                fs.create_dir(f"{folder}/data", recursive=True)
                out = fs.open_output_stream(f"{folder}/data/{name}")
            line = (row[0] or "").encode()
            held.append(line)
            rows, size = rows + 1, size + len(line)
            if size > _BYTES:
                out.write(b"\n".join(held) + b"\n")
                held, size = [], 0
        if out is None:
            return Written(None, 0)
        with out:
            if held:
                out.write(b"\n".join(held) + b"\n")
        return Written(name, rows)

    def commit(self, messages: list, batchId: int) -> None:
        from pyarrow.fs import FileType

        fs, folder = _filesystem(self.folder)
        target = f"{folder}/commits/{batchId}.json"
        if fs.get_file_info(target).type != FileType.NotFound:
            self.abort(messages, batchId)  # published before; this run's files go
            return
        fs.create_dir(f"{folder}/commits", recursive=True)
        files = [[m.file, m.rows] for m in messages if m is not None and m.file]
        made = f"{folder}/commits/_{batchId}-{uuid.uuid4().hex}"
        with fs.open_output_stream(made) as f:
            f.write(json.dumps({"batch": batchId, "files": files}).encode())
        fs.move(made, target)

    def abort(self, messages: list, batchId: int) -> None:
        fs, folder = _filesystem(self.folder)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{folder}/data/{m.file}")


class OutboxSource(DataSource):
    """Option ``path``: the folder. Rows have one string column."""

    @classmethod
    def name(cls) -> str:
        return "impactlens_outbox"

    def schema(self) -> str:
        return "value string"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options["path"])


def write_outbox(documents: DataFrame, folder: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """A stream of documents (``value``) into the folder, each batch once."""
    documents.sparkSession.dataSource.register(OutboxSource)
    return (documents.select("value").writeStream.format(OutboxSource.name()).option("path", folder)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The documents (``value``) of all committed batches and their batch. The
    commits say which files count; both sides are read by Spark."""
    commits = (spark.read.schema("batch long, files array<array<string>>").json(f"{folder}/commits")
               .select("batch", F.explode("files").alias("file")).select("batch", F.col("file")[0].alias("file")))
    lines = spark.read.text(f"{folder}/data").select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    return lines.join(commits, "file").select("batch", "value")
