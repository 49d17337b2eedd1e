"""Packing of documents into training sequences.

Documents become token ids (a public word-level BPE through the tokenizers
library, then the id that ends a document) and are cut into pieces of at most
``cut`` tokens. Shortest-pack-first packing works on the histogram of piece
lengths alone: lengths are placed longest first, each time into the packs with
the most room, all packs of one pattern at once, so that the work depends on
the number of lengths (at most ``size``) and patterns, not of documents. Every
pattern then takes pieces by their rank among the pieces of their length.

Ranks come from one range-partitioned sort on (length, row), whose key is
unique, so a length that a third of all pieces have is split like any other.
To the driver go one count per length and partition; from it the table of
patterns. Texts and ids are never shuffled: each piece's checksum is taken
where it is tokenised (``with_ids`` carries the ids along for
:func:`sequences`).

White space separates words in the vocabulary's own rules, so the distinct words
of some texts are encoded one by one and remembered (a bounded number per
worker); their ids then go to all places of the words at once.

Defined results: null text is empty: one piece, the end id; a null doc_id is
carried like any other; repeated rows are packed as often as they occur; an
empty table gives no rows; columns other than the id and the text are ignored.
Lengths over half of ``size`` that find no shorter partner leave padding; a
smaller ``cut`` bounds it.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_sizes, materialise, slices, table, texts_of

SIZE = 2048
END = 1
WORDS = 500_000
CHUNK_BYTES = 2 << 20
_RANK_BITS = 48


#: A symbol after a letter: the vocabulary's rules end a token before it.
_SYMBOL = re.compile(rb"[!-/:-@\[-`{-~](?<=[a-z].)")


def _spaced(text: str) -> bytes:
    """A text whose words, between white space, are encoded independently. The
    vocabulary folds case and never joins letters and symbols, so both are done
    here once, where no special token (``<|...``) can be in the way."""
    raw = text.encode("utf-8", "replace")
    return raw if b"<|" in raw else _SYMBOL.sub(rb" \g<0>", raw.lower())


class WordCoder:
    """Ids (little-endian, 32 bits) of texts, word by word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        """Encodes words as one text, white space between; offsets tell them apart."""
        for at in range(0, len(words), 20_000):
            part = words[at:at + 20_000]
            texts = [w.decode() for w in part]
            got = self.model.encode(" ".join(texts), add_special_tokens=False)
            starts = np.array([o[0] for o in got.offsets], np.int64)
            ends = 4 * np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]), side="left")
            raw, last = np.array(got.ids, "<u4").tobytes(), 0
            for word, end in zip(part, ends.tolist()):
                self.known[word] = raw[last:end]
                last = end

    def encode(self, texts: list[str]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(map(_spaced, texts), pa.string()))
        found = split.flatten().dictionary_encode()
        words = found.dictionary.cast(pa.binary()).to_pylist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > WORDS:
            self.known.clear()
            new = words
        self._learn([w for w in new if w])
        # Each word's ids once, then in all its places: the taken values lie one after another.
        ids = pa.array([self.known[w] if w else b"" for w in words], pa.large_binary()).take(found.indices)
        _, ends, raw = ids.buffers()
        bounds = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        raw = memoryview(raw or b"")
        return [bytes(raw[a:b]) for a, b in zip(bounds, bounds[1:])]


@functools.lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def pieces(docs: DataFrame, path: str | None = None, cut: int = SIZE, end: int = END, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    arrow = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens")),
                       *([("ids", pa.binary())] if with_ids else [])])
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        for batch in batches:
            for a, b in slices(byte_sizes(batch.column(1)), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                out = {f.name: [] for f in arrow}
                for doc, raw in zip(part.column(0).to_pylist(), coder(path).encode(texts_of(part.column(1)))):
                    raw += last
                    n = len(raw) // 4
                    for start in range(0, n, cut):
                        own = raw[4 * start:4 * (start + cut)]
                        values = (doc, start, len(own) // 4, zlib.crc32(own), n, own)
                        for name, value in zip(out, values):
                            out[name].append(value)
                yield table(out, arrow)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths of a pattern, number of packs with it). Places the longest
    lengths first, each into the packs with the most room left."""
    room: list[tuple[int, int]] = []  # heap of (-room, pattern)
    patterns: list[list[int]] = []  # last length, how often, pattern before it, packs

    def add(length, times, before, packs, left):
        if packs:
            heapq.heappush(room, (-left, len(patterns)))
            patterns.append([length, times, before, packs])

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count and room and -room[0][0] >= length:
            left, at = room[0]
            packs = patterns[at][3]
            use = min(count, packs)
            patterns[at][3] -= use
            if use == packs:
                heapq.heappop(room)
            add(length, 1, at, use, -left - length)
            count -= use
        # No pack has room: a new one has the most, until it is full.
        times = size // length
        add(length, times, -1, count // times, size - times * length)
        if rest := count % times:
            add(length, rest, -1, 1, size - rest * length)
    out = []
    for length, times, before, packs in patterns:
        if packs:
            lengths = [length] * times
            while before >= 0:
                length, times, before, _ = patterns[before]
                lengths += [length] * times
            out.append((lengths[::-1], packs))
    return out


def slots(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: from rank ``first`` on, a
    pattern takes ``repeat`` pieces a sequence, from sequence ``base`` and
    offset ``offset`` on. Sorted by (length, first)."""
    used: Counter = Counter()
    rows, base = [], 0
    for lengths, packs in plan:
        at = 0
        for length, repeat in sorted(Counter(lengths).items(), reverse=True):
            rows.append(((length << _RANK_BITS) + used[length], used[length], repeat, base, at))
            used[length] += repeat * packs
            at += repeat * length
        base += packs
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("key", "first", "repeat", "base", "offset"))}


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    columns = cut_pieces.columns
    own = materialise(cut_pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    ranked = materialise(
        own.repartitionByRange("length", "_row").sortWithinPartitions("length", "_row")
        .select(*columns, F.spark_partition_id().alias("_part"),
                F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "pack-ranked")
    # One row per partition and length it holds: sorted ranges share a length
    # at their ends only, so these are at most partitions + size rows.
    held = sorted(ranked.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("at")).collect())
    histogram: Counter = Counter()
    starts = []
    for r in held:
        starts.append(((r["length"] << 32) + r["_part"], histogram[r["length"]] - r["at"]))
        histogram[r["length"]] += r["n"]
    sent = cut_pieces.sparkSession.sparkContext.broadcast(
        (np.array([s[0] for s in starts], np.int64), np.array([s[1] for s in starts], np.int64),
         slots(shortest_pack_first(dict(histogram), size))))
    at = {c: i for i, c in enumerate(ranked.columns)}

    def run(batches):
        keys, shift, where = sent.value
        for batch in batches:
            length, part, row = (batch.column(at[c]).to_numpy().astype(np.int64) for c in ("length", "_part", "_at"))
            rank = row + shift[np.searchsorted(keys, (length << 32) + part)]
            i = np.searchsorted(where["key"], (length << _RANK_BITS) + rank, side="right") - 1
            nth = rank - where["first"][i]
            sequence = where["base"][i] + nth // where["repeat"][i]
            offset = where["offset"][i] + nth % where["repeat"][i] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], pa.array(sequence), pa.array(offset)],
                                             names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = SIZE, cut: int | None = None, **options) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(pieces(docs, cut=cut or size, **options), size)


def sequences(packed: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """sequence_id, ids (of ``size`` tokens, padded), used: from pieces with ids."""
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    arrow = pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("used", pa.int64())])

    def run(batches):
        for batch in batches:
            raw = [b"".join(x["ids"] for x in p) for p in batch.column(1).to_pylist()]
            ids = [np.frombuffer(r, "<u4").astype(np.int32) for r in raw]
            yield table({"sequence_id": batch.column(0), "used": [len(i) for i in ids],
                         "ids": [np.concatenate([i, np.full(size - len(i), pad, np.int32)]) for i in ids]}, arrow)

    return grouped.mapInArrow(run, "sequence_id long, ids array<int>, used long")
