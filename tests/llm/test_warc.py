import io
import os
import random
from urllib.parse import unquote

from impactlens.llm import queries, warc
from impactlens.llm.common import read_table


def read(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


def test_salvage():
    rng = random.Random(3)
    plain = [warc.record(i, f"http://x/{i}", rng.randbytes(rng.randrange(3000)), None, False) for i in range(20)]
    parts = [warc.member(r) if i % 3 else r for i, r in enumerate(plain)]
    whole = b"".join(parts)
    assert [x[0] for x in read(whole)] == ["record"] * 20
    starts = [sum(map(len, parts[:i])) for i in range(21)]
    for _ in range(150):
        hit = rng.randrange(20)
        data = bytearray(whole)
        at = rng.randrange(starts[hit], starts[hit + 1])
        kind = rng.randrange(3)
        if kind == 0:
            data[at] ^= 1 << rng.randrange(8)
        elif kind == 1:
            del data[at:starts[hit + 1]]
        else:
            data[at:at] = b"WARC/1.1\r\n\x1f\x8b\x08junk"
        got = read(bytes(data))
        pages = {warc.page_of(x[3]["warc-record-id"]) for x in got if x[0] == "record"}
        assert pages >= set(range(20)) - {hit, hit + 1 if kind == 1 else hit}
        assert [x[1] for x in got] == [0, *[x[2] for x in got][:-1]] and got[-1][2] == len(data)
    assert read(b"") == [] and read(b"abc") == [("gap", 0, 3, "neither member nor version line", None)]


FOREIGN = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:6d058047-ede2-4a13-be79-90c17c631dd4>\r\n"
           b"X-Note: a\r\n b\r\n\tc\r\nWARC-Target-URI: http://x/\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n")


def foreign(http=b"HTTP/1.1 200 OK\r\nContent-Length: 5, 5\r\n\r\nhello"):
    return FOREIGN % (len(http), http)


def test_foreign_records(spark, tmp_path):
    """Ids that are no numbers, lengths that are none, folded lines, a file of
    one member; none stops a task."""
    own = warc.record(7, "http://x/7", b"seven", None, False)
    bad = FOREIGN.replace(b"Content-Length: %d", b"Content-Length: 1e3") % b"x"
    data = {"plain": foreign() + own, "members": warc.member(foreign()) + warc.member(own), "one": warc.member(foreign() * 3 + own),
            "bad": bad + own, "huge": FOREIGN.replace(b"%d", b"9" * 30) % b"x" + own, "lone": foreign(b"\xff\x00")}
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in data], "path string")
    got = {}
    for r in warc.read_archives(paths, 2).collect():
        got.setdefault(r.path.rpartition("/")[2], []).append(r)
    assert [(r.page_id, r.payload_bytes, r.record_id[:9]) for r in got["plain"]] == [(None, None, "<urn:uuid"), (7, 5, "<urn:page")]
    assert [r.record_id[:9] for r in got["members"]] == ["<urn:uuid", "<urn:page"]
    assert [r.record_id[:9] for r in got["one"]] == ["<urn:uuid"] * 3 + ["<urn:page"]
    assert [(r.start, r.stop) for r in got["one"]] == [(0, 0)] * 3 + [(0, len(data["one"]))]
    for name in ("bad", "huge"):
        assert [(r.kind, r.reason) for r in got[name]][0][0] == "gap" and got[name][-1].page_id == 7
    assert [(r.kind, r.payload_bytes) for r in got["lone"]] == [("record", None)]
    head, _, _ = warc._split(foreign())
    assert head["x-note"] == "a b c"


def test_damage_inside_a_shared_member():
    records = [warc.record(i, "u", b"page %d" % i * 3000, None, False) for i in range(6)]
    hurt = bytearray(records[2])
    hurt[len(hurt) // 2] ^= 1
    whole = warc.member(b"".join([*records[:2], bytes(hurt), *records[3:]])) + warc.member(records[0])
    found = read(whole)
    assert [warc.page_of(x[3]["warc-record-id"]) for x in found if x[0] == "record"] == [0, 1, 3, 4, 5, 0]
    assert [x[3] for x in found if x[0] == "gap"] == ["in member: block digest differs"]
    assert [x[1] for x in found] == [0, *[x[2] for x in found][:-1]] and found[-1][2] == len(whole)
    # A stream that breaks off: what came before it stays.
    cut = whole[:len(warc.member(b"".join(records))) // 2]
    assert [x[0] for x in read(cut + records[5])][-2:] == ["gap", "record"]
    junk = read(warc.member(records[0] + b"rest of it"))
    assert [x[0] for x in junk] == ["record", "gap"] and junk[-1][2] == len(warc.member(records[0] + b"rest of it"))
    assert [x[0] for x in read(warc.member(b"no record"))] == ["gap"]


def test_long_url():
    """Headers of more than 64 KiB, in members and plain; the file may go on or end there."""
    urls = ["http://x/" + "é" * n for n in (5, 11_000, 200_000)]
    plain = [warc.record(i, url, b"page", None, False) for i, url in enumerate(urls * 2)]
    for whole in (b"".join(map(warc.member, plain)), b"".join(plain)):
        found = read(whole)
        assert [x[0] for x in found] == ["record"] * 6
        assert [unquote(x[3]["warc-target-uri"]) for x in found] == urls * 2
    cut = plain[1] + plain[2][:100_000]
    assert [x[0] for x in read(cut)] == ["record", "gap"]
    assert [x[0] for x in read(b"WARC/1.1\r\n" + b"no header\r\n" * 20_000 + plain[1])] == ["gap", "record"]


def test_cases(spark, tmp_path):
    rows = [(5, "u", "same", "x"), (3, None, "same", "x"), (9, "u\r\nX: y", "same", "x"), (7, "u", None, "x"),
            (8, "u", "", "x"), (None, "u", "same", "x"), (2, "u", "é" * 400_000, "x"), (4, "u", "one", "x"), (4, "u", "one", "x"),
            (None, "u", "lone", "x"), (None, "u", "lone", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    got = warc.archive_pages(df, f"file://{tmp_path}/a", max_file=200).where("kind = 'record'").collect()
    assert len(os.listdir(tmp_path / "a")) > 3
    key = lambda r: (r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=key) == sorted(
        [(3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3), (7, "response", None),
         (8, "revisit", 7), (2, "response", None), (4, "response", None), (4, "response", None),
         (None, "response", None), (None, "response", None)], key=key)
    assert {(r.page_id, r.payload_bytes) for r in got if r.page_id in (2, 3, 5, 7)} == {(2, 800_000), (3, 4), (5, 4), (7, 0)}
    few = warc.archive_pages(df, f"file://{tmp_path}/b", min_revisit_bytes=1).where("kind = 'record'").collect()
    assert {r.page_id for r in few if r.record_type == "revisit"} == {5, 9, None}
    assert warc.archive_pages(df.limit(0)).collect() == []


def test_damage_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"text {i}" * 50) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/a"
    files = warc.write_archives(warc.mark_revisits(df), folder).collect()
    path = files[0].path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 255
    open(path, "wb").write(data)
    got = warc.read_archives(spark.createDataFrame(files), len(files)).collect()
    assert len([r for r in got if r.kind == "record"]) == 29
    assert [(r.reason is not None, r.stop > r.start) for r in got if r.kind == "gap"] == [(True, True)]


def test_pages(spark, sf_small):
    pages = read_table(spark, sf_small, "pages").collect()
    first = {}
    for r in pages:
        first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    want = {(r.page_id, len((r.html or "").encode()), warc.digest((r.html or "").encode()),
             "response" if first[r.html or ""] == r.page_id else "revisit",
             None if first[r.html or ""] == r.page_id else first[r.html or ""]) for r in pages}
    assert {tuple(r) for r in queries.op7_warc(spark, sf_small).collect()} == want
