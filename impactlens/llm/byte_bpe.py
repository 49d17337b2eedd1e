"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file (one base64 byte string and its rank a line) becomes a
``tokenizers`` BPE model: every byte maps to one printable character (the
byte-to-character table), every token of two or more bytes to the merge that
forms it under the lower ranks. Text is split by the public pattern; each
distinct match is encoded once per worker (a bounded memory of matches, as
words repeat) and all matches not met before go to the tokenizer in one
pre-tokenised call. Offsets are code points of the text; a token that holds
part of a character has that whole character's span.

Decoding reverses the byte table. Ids decode to bytes exactly; as text, bytes
that are no UTF-8 become U+FFFD. :func:`decode_chunks` decodes a document cut
anywhere: a character split between two chunks appears whole with the chunk
that completes it. An id that is in no table (negative, too large, null)
decodes to U+FFFD.

Null text is the empty text (no ids). Repeated rows give repeated rows; an
empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models, pre_tokenizers

from .common import byte_sizes, slices, table, texts_of

#: Distinct matches one worker remembers before it starts afresh.
MEMORY = 400_000
CHUNK_CHARS = 1 << 20


def byte_table() -> dict[int, str]:
    """Byte to character: printable Latin-1 stays, the rest goes from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def _merge_of(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """The two parts left when ``token`` is merged by all lower ranks."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while True:
        found = [(r, i) for i in range(len(parts) - 1)
                 if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank]
        if not found:
            return parts
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def model_json(path: str) -> str:
    """The tokenizers model of a rank file, as text (bounded by the vocabulary)."""
    ranks, chars = read_ranks(path), byte_table()
    say = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = _merge_of(token, rank, ranks)
            if len(parts) != 2:
                raise ValueError(f"rank {rank} is not a merge of two lower ranks")
            merges.append((say(parts[0]), say(parts[1])))
    model = Tokenizer(models.BPE({say(t): r for t, r in ranks.items()}, merges, cache_capacity=0))
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False,
                                                   trim_offsets=False)
    return model.to_str()


class Codec:
    def __init__(self, model: str, pattern: str):
        self.split = regex.compile(pattern).findall
        self.model = Tokenizer.from_str(model)
        self.known: dict[str, bytes] = {}
        back = {c: b for b, c in byte_table().items()}
        vocabulary = self.model.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self._table = [*self.bytes_of, "\ufffd".encode()]

    def _learn(self, pieces: Iterable[str]) -> None:
        new = list(pieces)
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
        got = self.model.encode(new, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, dtype="<u4")
        ends = np.searchsorted(np.array(got.word_ids), np.arange(len(new)), side="right")
        raw, at = ids.tobytes(), 0
        for piece, end in zip(new, (4 * ends).tolist()):
            self.known[piece] = raw[at:end]
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for a, b in slices([len(t) for t in texts], CHUNK_CHARS):
            split = [self.split(t) for t in texts[a:b]]
            if new := {p for pieces in split for p in pieces if p not in self.known}:
                if len(self.known) + len(new) > MEMORY:
                    new = {p for pieces in split for p in pieces}
                self._learn(new)
            of = self.known.__getitem__
            out += [b"".join(map(of, pieces)) for pieces in split]
        return out

    def offsets(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids with the code points each token starts and ends at."""
        pieces = self.split(text)
        got = self.model.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(int)
        base = [int(at[w]) for w in got.word_ids]
        return (got.ids, [b + s for b, (s, _) in zip(base, got.offsets)],
                [b + e for b, (_, e) in zip(base, got.offsets)])

    def decode(self, ids: bytes) -> bytes:
        return self.decode_ids(np.frombuffer(ids, dtype="<u4"))

    def decode_ids(self, ids: Iterable[int | None]) -> bytes:
        n = len(self.bytes_of)
        known = ids if isinstance(ids, np.ndarray) else [n if i is None or not 0 <= i < n else i for i in ids]
        if isinstance(known, np.ndarray):
            known = np.minimum(known, n).tolist()
        return b"".join(map(self._table.__getitem__, known))


@functools.lru_cache(maxsize=2)
def codec(model: str, pattern: str) -> Codec:
    return Codec(model, pattern)


def decode_chunks(chunks: Iterable[Iterable[int]], coder: Codec) -> Iterator[str]:
    """Text of consecutive chunks of one document's ids; see the module's text."""
    text = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in chunks:
        yield text.decode(coder.decode_ids(list(ids)))
    if rest := text.decode(b"", True):
        yield rest


def _apply(df: DataFrame, path: str, pattern: str, schema: str, arrow: pa.Schema, work) -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(model_json(path))

    def run(batches):
        coder = codec(model.value, pattern)
        for batch in batches:
            for a, b in slices(byte_sizes(batch.column(1)), 8 * CHUNK_CHARS):
                yield table(work(coder, batch.slice(a, b - a)), arrow)

    return df.mapInArrow(run, schema)


def _id_type(df: DataFrame, name: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[name].dataType
    return kind.simpleString(), to_arrow_type(kind)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, starts, ends (arrays): tokens and their spans in code points."""
    sql, kind = _id_type(docs, id_col)
    ints = pa.list_(pa.int32())
    arrow = pa.schema([(id_col, kind), ("ids", ints), ("starts", ints), ("ends", ints)])

    def work(coder, batch):
        got = [coder.offsets(t) for t in texts_of(batch.column(1))]
        return {id_col: batch.column(0), "ids": [g[0] for g in got], "starts": [g[1] for g in got],
                "ends": [g[2] for g in got]}

    return _apply(docs.select(id_col, text_col), path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
                  pattern, f"`{id_col}` {sql}, ids array<int>, starts array<int>, ends array<int>", arrow, work)


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
           id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded (bytes), text (UTF-8, U+FFFD where the bytes are none)."""
    sql, kind = _id_type(encoded, id_col)
    arrow = pa.schema([(id_col, kind), ("decoded", pa.binary()), ("text", pa.string())])

    def work(coder, batch):
        got = [coder.decode_ids(v or []) for v in batch.column(1).to_pylist()]
        return {id_col: batch.column(0), "decoded": got, "text": [g.decode("utf-8", "replace") for g in got]}

    model = encoded.sparkSession.sparkContext.broadcast(
        model_json(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))

    def run(batches):
        coder = codec(model.value, pattern)
        for batch in batches:
            yield table(work(coder, batch), arrow)

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {sql}, decoded binary, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass: id, n_tokens, ids_sha256
    (of the little-endian 32-bit ids), decoded_sha256 (of the decoded bytes)."""
    sql, kind = _id_type(docs, id_col)
    arrow = pa.schema([(id_col, kind), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                       ("decoded_sha256", pa.string())])

    def work(coder, batch):
        got = coder.encode(texts_of(batch.column(1)))
        return {id_col: batch.column(0), "n_tokens": [len(g) // 4 for g in got],
                "ids_sha256": [hashlib.sha256(g).hexdigest() for g in got],
                "decoded_sha256": [hashlib.sha256(coder.decode(g)).hexdigest() for g in got]}

    return _apply(docs.select(id_col, text_col), path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
                  pattern, f"`{id_col}` {sql}, n_tokens long, ids_sha256 string, decoded_sha256 string",
                  arrow, work)
