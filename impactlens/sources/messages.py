"""A stream of messages admitted by number, from a folder of JSON lines.

Spark's file source limits a micro-batch by files or bytes; a message queue is
polled for a number of messages. :class:`MessageSource` is a streaming data
source with that limit: whatever the size of the landed files, a micro-batch
holds at most ``maxMessages`` lines.

What is admitted is written down before Spark hears of it: admission ``n`` is
an immutable file that lists the byte spans of its messages, and the offset of
the stream is ``n`` alone. A batch that is run again reads the same spans, so a
restart loses and repeats nothing. The next admission is made only when the
last one has been planned, that is, after Spark has logged its offset; until
then the last one is offered again. Admissions that no restart can ask for any
more are removed. The driver reads the admitted bytes once,
to find where messages end (bounded by the limit); executors read their spans.

Several streams may share a folder, each with an admissions folder of its own:
a stream admits the messages from one place (file, byte) to before another, in
order of file names. Places that :func:`shares` finds lie whole micro-batches
apart, so that the shares together make the micro-batches of a single stream.
Files that come or grow later belong to the share their place lies in.

Files are admitted by name. They must be complete when they appear (moved into
the folder) and may grow by whole lines later; names that start with ``_`` or
``.`` are left out. Messages end with a line feed (a carriage return before it
is dropped), the last one of a file may lack it. Compressed files have no byte
spans and are refused. Folders are whatever ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Messages of one micro-batch where nothing else is asked for.
MAX_MESSAGES = 100
#: Messages read by one task.
MESSAGES_PER_TASK = 10_000
#: A snapshot of all admissions so far is kept every so many.
SNAPSHOT = 50
_CHUNK = 1 << 20
_COMPRESSED = (".gz", ".bz2", ".zst", ".snappy", ".lz4")


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path)


def _is_hidden(name: str) -> bool:
    return name.startswith(("_", "."))


class Admissions:
    """The admissions of one stream, in a folder of its own: ``n.json`` lists
    spans [file, start, end, messages], ``n.planned`` says that Spark has taken
    admission n, ``n.state`` holds the end reached in every file. Only messages
    from the place ``begin`` to before ``stop`` are admitted, where given."""

    def __init__(self, folder: str, log: str, begin: tuple | None = None, stop: tuple | None = None) -> None:
        self.begin, self.stop = begin, stop
        self.fs, self.folder = _filesystem(folder)
        self.log_fs, self.log = _filesystem(log)
        self.log_fs.create_dir(self.log, recursive=True)
        names = [f.base_name for f in self._list(self.log_fs, self.log) if not _is_hidden(f.base_name)]
        numbers = {kind: [int(n.partition(".")[0]) for n in names if n.endswith(kind)] for kind in (".json", ".planned", ".state")}
        self.last = max(numbers[".json"], default=0)
        self.planned = max(numbers[".planned"], default=0)
        kept = max(numbers[".state"], default=0)
        self.ends: dict[str, int] = self._read(f"{kept}.state") if kept else {}
        for n in range(kept + 1, self.last + 1):
            self._advance(self.spans(n))

    @staticmethod
    def _list(fs, path: str) -> list:
        from pyarrow.fs import FileSelector, FileType

        return [f for f in fs.get_file_info(FileSelector(path, allow_not_found=True)) if f.type == FileType.File]

    def _read(self, name: str):
        with self.log_fs.open_input_stream(f"{self.log}/{name}") as f:
            return json.loads(f.read())

    def _write(self, name: str, value) -> None:
        """A file appears whole, or not at all."""
        made = f"{self.log}/_{name}"
        with self.log_fs.open_output_stream(made) as f:
            f.write(json.dumps(value).encode())
        self.log_fs.move(made, f"{self.log}/{name}")

    def spans(self, n: int) -> list:
        return self._read(f"{n}.json")

    def _advance(self, spans: list) -> None:
        for name, _, end, _ in spans:
            self.ends[name] = max(end, self.ends.get(name, 0))

    def take(self, n: int) -> None:
        if n > self.planned:
            self._write(f"{n}.planned", None)
            self.planned = n

    def done(self, n: int) -> None:
        """Admissions up to ``n`` have been processed: from time to time the
        older ones, which a snapshot holds, go."""
        if n % SNAPSHOT == 0:
            for f in self._list(self.log_fs, self.log):
                if not _is_hidden(f.base_name) and int(f.base_name.partition(".")[0]) < n:
                    self.log_fs.delete_file(f"{self.log}/{f.base_name}")

    def _own(self, name: str, size: int) -> tuple[int, int]:
        """The bytes of a file, from and to, that are this stream's."""
        start = 0 if not self.begin or name > self.begin[0] else self.begin[1] if name == self.begin[0] else size
        end = size if not self.stop or name < self.stop[0] else min(size, self.stop[1]) if name == self.stop[0] else 0
        return start, end

    def admit(self, most: int) -> int:
        """Number of the admission on offer."""
        if self.last > self.planned:
            return self.last
        spans, left, listed = [], most, {}
        for f in sorted(self._list(self.fs, self.folder), key=lambda f: f.base_name):
            name = f.base_name
            if _is_hidden(name):
                continue
            if name.endswith(_COMPRESSED):
                raise ValueError(f"{name}: compressed files cannot be admitted by messages")
            listed[name] = f.size
            start, size = self._own(name, f.size)
            while left and self.ends.get(name, start) < size:
                at = spans[-1][2] if spans and spans[-1][0] == name else self.ends.get(name, start)
                if at >= size:
                    break
                end, messages = _end_of(self.fs, f"{self.folder}/{name}", at, size, min(left, MESSAGES_PER_TASK))
                spans.append([name, at, end, messages])
                left -= messages
        if spans:
            self._write(f"{self.last + 1}.json", spans)
            self.last += 1
            self._advance(spans)
            if self.last % SNAPSHOT == 0:
                # Files that have been taken away need not be remembered.
                self.ends = {name: end for name, end in self.ends.items() if name in listed}
                self._write(f"{self.last}.state", self.ends)
        return self.last


def _end_of(fs, path: str, start: int, size: int, most: int) -> tuple[int, int]:
    """(end, number) of the next ``most`` messages, or of what is left."""
    found, at = 0, start
    with fs.open_input_file(path) as f:
        f.seek(start)
        while at < size:
            chunk = f.read(min(_CHUNK, size - at))
            here = chunk.count(b"\n")
            if found + here >= most:
                place = -1
                for _ in range(most - found):
                    place = chunk.index(b"\n", place + 1)
                return at + place + 1, most
            found, at = found + here, at + len(chunk)
            tail = chunk
    return size, found + (not tail.endswith(b"\n"))


class Span(InputPartition):
    """Consecutive messages of one file."""

    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.log = options["path"], options["admissions"]
        self.most = int(options.get("maxmessages", MAX_MESSAGES))
        self.begin, self.stop = (json.loads(options.get(place, "null")) for place in ("begin", "stop"))
        if self.most < 1:
            raise ValueError("maxMessages must be 1 or more")
        self._admissions: Admissions | None = None

    @property
    def admissions(self) -> Admissions:
        if self._admissions is None:  # on the driver only
            self._admissions = Admissions(self.folder, self.log, self.begin, self.stop)
        return self._admissions

    def initialOffset(self) -> dict:
        return {"admission": 0}

    def latestOffset(self) -> dict:
        return {"admission": self.admissions.admit(self.most)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        numbers = range(start["admission"] + 1, end["admission"] + 1)
        spans = [Span(name, a, b) for n in numbers for name, a, b, _ in self.admissions.spans(n)]
        self.admissions.take(end["admission"])
        return spans

    def commit(self, end: dict) -> None:
        self.admissions.done(end["admission"])

    def read(self, partition: Span) -> Iterator:
        import pyarrow as pa

        fs, folder = _filesystem(self.folder)
        with fs.open_input_file(f"{folder}/{partition.file}") as f:
            f.seek(partition.start)
            at, rest = partition.start, b""
            while at < partition.end:
                chunk = f.read(min(_CHUNK, partition.end - at))
                at += len(chunk)
                lines = (rest + chunk).split(b"\n")
                rest = lines.pop()
                yield from self._batch(pa, lines)
        yield from self._batch(pa, [rest] if rest else [])

    @staticmethod
    def _batch(pa, lines: list[bytes]) -> Iterator:
        if lines:
            texts = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_admissions": None}


class MessageSource(DataSource):
    """Options: ``path`` (folder of the messages), ``admissions`` (a folder for
    this stream alone), ``maxMessages`` (of a micro-batch), ``begin`` and
    ``stop`` (places, as JSON lists of a file's name and a byte)."""

    @classmethod
    def name(cls) -> str:
        return "impactlens_messages"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


@dataclass(frozen=True)
class Share:
    """Messages of a folder from one place to before another (None: no end),
    ``batches`` micro-batches as it stands, after ``first`` of the shares before."""

    first: int = 0
    batches: int = 0
    begin: tuple[str, int] | None = None
    stop: tuple[str, int] | None = None


def shares(spark: SparkSession, folder: str, most: int, least: int = 1, max_messages: int = MAX_MESSAGES) -> list[Share]:
    """Cuts a folder into ``most`` shares or fewer, each (but the last) of
    ``least`` whole micro-batches or more. Spark counts the messages of the
    files; the driver reads those that are cut."""
    counted = (spark.read.option("lineSep", "\n").text(folder).groupBy(F.col("_metadata.file_name").alias("file"))
               .agg(F.count(F.lit(1)).alias("messages"), F.first("_metadata.file_size").alias("size")).orderBy("file").collect())
    batches = -(-sum(f["messages"] for f in counted) // max_messages)
    each = max(least, -(-batches // most))
    fs, path = _filesystem(folder)
    places, before, files = [None], 0, iter(counted)
    file = next(files, None)
    for first in range(each, batches, each):
        while before + file["messages"] <= first * max_messages:
            before, file = before + file["messages"], next(files)
        left = first * max_messages - before
        end = _end_of(fs, f"{path}/{file['file']}", 0, file["size"], left)[0] if left else 0
        places.append((file["file"], end))
    return [Share(k * each, min(each, batches - k * each), begin, stop)
            for k, (begin, stop) in enumerate(zip(places, [*places[1:], None]))]


def stream_messages(spark: SparkSession, folder: str, admissions: str, max_messages: int = MAX_MESSAGES,
                    share: Share = Share()) -> DataFrame:
    """The messages of a folder, or of a share of it, as a stream (``value``),
    at most ``max_messages`` of them in a micro-batch."""
    spark.dataSource.register(MessageSource)
    return (spark.readStream.format(MessageSource.name()).option("admissions", admissions)
            .option("maxMessages", str(max_messages)).option("begin", json.dumps(share.begin))
            .option("stop", json.dumps(share.stop)).load(folder))
