"""WARC archives of pages, and a salvage reader.

Writing: one record per page. Of pages with equal payloads (of at least
``min_revisit_bytes``) the one with the smallest page id is a response, the
others revisit it. Tasks write gzip members, one per record, to files of
bounded size in a folder all executors share; file names carry the task
attempt, and only files that successful tasks report are read, so a lost
executor's remains do no harm.

Reading (:func:`salvage`): every record must have a version line, a header
block, its declared length and matching digests. After a failed check the
reader searches for the next gzip member or version line that starts a valid
record and goes on from there; the bytes passed over are reported as a
quarantined gap (start, end, reason). Compressed and plain records may mix. A
member may hold several records: all but the last are reported at the member's
start, with no bytes of their own; damage inside a member is a gap there, and
the search goes on behind it. Other writers' records are read too: record ids
are text (``page_id`` is null unless the id is one of ours), folded header
lines belong to the line before, a length or an id that is no number is null.

Defined results: a null payload is empty, a null url leaves its header out;
pages with a null id come after all others when the smallest is sought and are
responses among themselves only if no id is known; repeated rows (equal id and
payload) are written as often as they occur, all of the same type. Empty
tables give no archive and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialise, table

VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
MAX_FILE = 32 << 20
#: First read of a plain record's headers; longer ones are read on.
HEAD = 1 << 16
WINDOW = 1 << 18
#: Archives that one task reads.
READ_BYTES = 64 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


_PAGE = re.compile(r"<urn:page:(-?[0-9]{1,18})>")


def page_of(urn: str | None) -> int | None:
    """The page of one of our record ids; null for any other id."""
    found = _PAGE.fullmatch(urn or "")
    return int(found[1]) if found else None


def record(page, url: str | None, payload: bytes, refers_to, revisits: bool, date: str = DATE) -> bytes:
    """One record, not compressed."""
    head = {"WARC-Type": "revisit" if revisits else "response", "WARC-Record-ID": record_id(page), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisits else http + payload
    if revisits:
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(refers_to)}
    head |= {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}",
             "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_START = re.compile(rb"WARC/1\.[01]\r\n")


class Damaged(ValueError):
    pass


def _number(text: str | bytes | None) -> int | None:
    """A length as a header has it, else null."""
    text = text.decode("latin-1") if isinstance(text, bytes) else text
    return int(text) if text and re.fullmatch("[0-9]{1,18}", text) else None


def _split(data: bytes) -> tuple[dict, bytes, int]:
    """(headers, block, bytes used) of the record that ``data`` starts with."""
    if not _START.match(data):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("no end of headers")
    head = {}
    name = None
    for line in data[:end].split(b"\r\n")[1:]:
        if name and line[:1] in (b" ", b"\t"):  # folded: more of the line before
            head[name] = f"{head[name]} {line.decode('utf-8', 'replace').strip()}".strip()
            continue
        raw, colon, value = line.partition(b":")
        if not colon or not _NAME.fullmatch(raw):
            raise Damaged("no header line")
        name = raw.decode("latin-1").strip().lower()
        head[name] = value.decode("utf-8", "replace").strip()
    if "warc-type" not in head or "warc-record-id" not in head:
        raise Damaged("no record type or id")
    if (length := _number(head.get("content-length"))) is None:
        raise Damaged("no content length")
    stop = end + 4 + length
    if len(data) < stop + 4 or data[stop:stop + 4] != b"\r\n\r\n":
        raise Damaged("block not as long as declared")
    block = data[end + 4:stop]
    if (d := head.get("warc-block-digest")) and d != f"sha1:{digest(block)}":
        raise Damaged("block digest differs")
    if head.get("warc-type") == "response" and (d := head.get("warc-payload-digest")):
        if d != f"sha1:{digest(block.partition(b'\r\n\r\n')[2])}":
            raise Damaged("payload digest differs")
    return head, block, stop + 4


class _File:
    """Random reads of a file in the shared store."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size

    def at(self, start: int, n: int) -> bytes:
        self.handle.seek(start)
        return self.handle.read(min(n, self.size - start))


class _Unpacked:
    """The bytes of a gzip member, unpacked as they are asked for; what has
    been read is dropped, so a member of any size needs one record's memory."""

    def __init__(self, f: _File, at: int):
        self.f, self.pos, self.z = f, at, zlib.decompressobj(31)
        self.data, self.error = bytearray(), None

    def more(self) -> bool:
        """Unpacks some more; false at the end of the member, or of what can be
        unpacked of it (then ``error`` says why)."""
        if self.z.eof or self.error:
            return False
        try:
            packed = self.z.unconsumed_tail
            if not packed:
                packed = self.f.at(self.pos, WINDOW)
                self.pos += len(packed)
                if not packed:
                    raise Damaged("member is cut off")
            self.data += self.z.decompress(packed, 4 * WINDOW)
        except (zlib.error, Damaged) as e:
            self.error = f"member: {e}" if isinstance(e, zlib.error) else str(e)
            return False
        return True

    def fill(self, n: int) -> bool:
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n

    @property
    def end(self) -> int:
        return self.pos - len(self.z.unused_data)

    def record(self) -> tuple[dict, bytes]:
        """Takes the record that the data starts with."""
        if not self.fill(10) or not _START.match(self.data):
            raise Damaged("no version line")
        while (end := self.data.find(b"\r\n\r\n")) < 0 and self.more():
            pass
        length = _length_of(bytes(self.data[:max(end, 0)]))
        whole = end + 8 + length if length is not None else 0
        if whole and not self.fill(whole):
            raise Damaged(self.error or "block not as long as declared")
        head, block, used = _split(bytes(self.data[:whole] if whole else self.data))
        del self.data[:used]
        return head, block

    def skip(self) -> bool:
        """Goes on to the next version line; false if there is none."""
        at = 1
        while True:
            found = self.data.find(b"WARC/1.", at)
            if found >= 0:
                del self.data[:found]
                return True
            del self.data[:max(0, len(self.data) - 6)]
            at = 0
            if not self.more():
                return False


def _length_of(headers: bytes) -> int | None:
    return next((_number(line.partition(b":")[2].strip()) for line in headers.split(b"\r\n")
                 if line.lower().startswith(b"content-length:")), None)


def _member(f: _File, at: int) -> Iterator[tuple]:
    """("record", headers, block) and ("gap", reason) of a gzip member, then
    ("end", where it ends). Raises Damaged where nothing more can be unpacked;
    a member that cannot be checked to its end keeps no last record that has
    no digest of its own."""
    unpacked, held, good = _Unpacked(f, at), None, False
    while unpacked.fill(1):
        try:
            head, block = unpacked.record()
        except Damaged as e:
            if not good and not _START.match(unpacked.data) or not unpacked.skip():
                if held:
                    yield held
                if unpacked.error or not good:
                    raise Damaged(unpacked.error or str(e)) from None
                yield "gap", str(e)
                yield "end", unpacked.end
                return
            yield "gap", str(e)
            continue
        if held:
            yield held
        held, good = ("record", head, block), True
    if unpacked.error or not held:
        if held and "warc-block-digest" in held[1]:
            yield held
        raise Damaged(unpacked.error or "member holds no record")
    yield held
    yield "end", unpacked.end


def _plain_at(f: _File, at: int) -> tuple[dict, bytes, int]:
    data = f.at(at, HEAD)
    while (end := data.find(b"\r\n\r\n")) < 0 and at + len(data) < f.size:
        # Only lines that may be headers are read on.
        if not all(line[:1] in (b" ", b"\t") or _NAME.fullmatch(line.partition(b":")[0]) and b":" in line
                   for line in data.split(b"\r\n")[1:-1]):
            raise Damaged("no header line")
        data = f.at(at, 2 * len(data))
    if (length := _length_of(data[:max(end, 0)])) is None:
        raise Damaged("no content length")
    if (whole := end + 8 + length) > f.size - at:
        raise Damaged("block not as long as declared")
    head, block, used = _split(f.at(at, whole))
    return head, block, at + used


def _next_start(f: _File, at: int) -> int:
    """Where the next gzip member or version line may start; the size if none."""
    while at < f.size:
        data = f.at(at, WINDOW)
        found = [i for i in (data.find(MEMBER), data.find(b"WARC/1.")) if i >= 0]
        if found:
            return at + min(found)
        if at + len(data) >= f.size:
            break
        at += len(data) - 6
    return f.size


def salvage(handle, size: int) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, reason)
    in the order of the file; together they cover every byte."""
    f, at, gap = _File(handle, size), 0, None
    while at < size:
        start = f.at(at, 7)
        try:
            if start.startswith(MEMBER):
                held = None
                for kind, *found in _member(f, at):
                    if gap:
                        yield "gap", gap[0], at, gap[1], None
                        gap = None
                    if kind == "end":
                        end = found[0]
                        yield held[0], at, end, *held[3:]
                        held = None
                        break
                    if held:
                        yield held
                    held = ("record", at, at, *found) if kind == "record" else ("gap", at, at, f"in member: {found[0]}", None)
                at = end
                continue
            if start != b"WARC/1.":
                raise Damaged("neither member nor version line")
            head, block, end = _plain_at(f, at)
        except Damaged as e:
            if start.startswith(MEMBER) and held:
                yield held
            gap = gap or (at, str(e))
            at = _next_start(f, at + 1)
            continue
        if gap:
            yield "gap", gap[0], at, gap[1], None
            gap = None
        yield "record", at, end, head, block
        at = end
    if gap:
        yield "gap", gap[0], size, gap[1], None


def mark_revisits(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html") -> DataFrame:
    """page, url, payload (null for revisits), bytes, sha1, refers_to, revisits.

    Only groups of equal payloads join back, on the digest; they are counted
    with map-side sums first, and a digest that holds many rows is split by
    adaptive execution, as both sides of the join are plain exchanges."""
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = (pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
            .withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload")))
    groups = (rows.where(F.col("bytes") >= min_revisit_bytes).groupBy("sha1")
              .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"))
    groups = materialise(groups.select(F.col("sha1").alias("_sha1"), "first"), "warc-groups")
    marked = rows.join(groups, rows.sha1 == groups._sha1, "left")
    revisits = F.coalesce(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.lit(False))
    return marked.select("page", "url", "payload", "bytes", "sha1", F.when(revisits, F.col("first")).alias("refers_to"),
                         revisits.alias("revisits"))


def write_archives(marked: DataFrame, folder: str, max_file: int = MAX_FILE) -> DataFrame:
    """Writes the records; returns path, records, bytes of every archive."""
    arrow = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        task = TaskContext.get()
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, done, n, size = None, 0, 0, 0
        report = {"path": [], "records": [], "bytes": []}

        def close():
            out.close()
            for k, v in zip(report, (f"{folder}/{name}-{done:04d}.warc.gz", n, size)):
                report[k].append(v)

        for batch in batches:
            for page, url, payload, first, revisits in zip(*(batch.column(i) for i in range(5))):
                data = member(record(page.as_py(), url.as_py(), payload.as_py() or b"", first.as_py(), revisits.as_py()))
                if out and size + len(data) > max_file:
                    close()
                    out, done, n, size = None, done + 1, 0, 0
                if not out:
                    out = fs.open_output_stream(f"{root}/{name}-{done:04d}.warc.gz", compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            close()
            yield table(report, arrow)

    return marked.select("page", "url", "payload", "refers_to", "revisits").mapInArrow(
        run, "path string, records long, bytes long")


def read_archives(paths: DataFrame, parts: int) -> DataFrame:
    """Records and gaps of archives, in ``parts`` partitions: path, kind, start,
    stop, reason, page_id, record_type, refers_to, url, payload_bytes,
    payload_digest, block, record_id, refers_to_id."""
    arrow = pa.schema([("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()),
                       ("reason", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
                       ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("block", pa.binary()), ("record_id", pa.string()),
                       ("refers_to_id", pa.string())])

    def row(path, kind, start, stop, head, block):
        if kind == "gap":
            return path, kind, start, stop, head, *(None,) * 9
        http = block.partition(b"\r\n\r\n")[0].lower()
        length = next((_number(x.partition(b":")[2].strip()) for x in http.split(b"\r\n") if x.startswith(b"content-length:")), None)
        own, other = head.get("warc-record-id"), head.get("warc-refers-to")
        return (path, kind, start, stop, None, page_of(own), head.get("warc-type"), page_of(other), head.get("warc-target-uri"),
                length, head.get("warc-payload-digest", "").removeprefix("sha1:") or None, block, own, other)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(at) as handle:
                    for found in salvage(handle, handle.size()):
                        rows.append(row(path, *found))
                        held += len(found[4] or b"")
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield table({f.name: c for f, c in zip(arrow, zip(*rows))}, arrow)
                            rows, held = [], 0
                if rows:
                    yield table({f.name: c for f, c in zip(arrow, zip(*rows))}, arrow)

    schema = ("path string, kind string, start long, stop long, reason string, page_id long, record_type string, "
              "refers_to long, url string, payload_bytes long, payload_digest string, block binary, record_id string, "
              "refers_to_id string")
    return paths.select("path").repartition(max(1, parts), "path").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0,
                  max_file: int = MAX_FILE, **names) -> DataFrame:
    """Writes all pages and reads the archives back (see :func:`read_archives`)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = folder.replace("file:", "", 1) if folder.startswith("file:") else folder
        folder = f"file://{folder}"
    written = materialise(write_archives(mark_revisits(pages, min_revisit_bytes, **names), folder, max_file), "warc-files")
    packed = written.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return read_archives(written, -(-packed // READ_BYTES))
