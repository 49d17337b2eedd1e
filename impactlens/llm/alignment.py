"""Alignment of the tokens of two tokenizers over the same bytes.

A is a byte-level BPE of the tokenizers library and reads a space before the
text; B is a sentencepiece model that adds that space itself. Byte offsets at
which tokens of both end cut a text into groups; an A and a B token are linked
when their byte ranges overlap. For every pair of ids the corpus has a count:
the number of documents that hold it linked.

Method: the identity map, an array from A id to the B id of the same bytes, is
worked out once. Nearly all groups are one A token and the B token the map
names: they need no pair, only the A id, and their documents are counted in a
vector as long as A's vocabulary. Only pairs of the other groups are counted by
a shuffle, each once a document. (Such a group may hold a pair of the map too;
it then joins that document's A ids, so that no document counts twice.)

Tokens of neither tokenizer go on past certain places (``_PARTS``: between a
letter, digit or sign and a space, say), so both end there: texts are cut there
and each distinct part is encoded and aligned once, as long as a worker
remembers it. A document's ids and pairs with their numbers are written to the
shared folder. The vector, and the highest count of each A id,
are as long as the vocabulary and go to every task. Of the pair counts only the
most frequent do: pairs that hold at least one ``frequent``-th of all entries,
of which there are ``frequent`` at most. The rest are joined by pair, and no
key among them holds more than that share of the rows.

Defined results: null and empty texts, and texts whose tokens' joined bytes
differ from space + text (characters B rewrites), have no tokens: zeros, an
empty groups text and an empty digest. A must split text by the public pattern
(PATTERN of the vocabularies' package); if B has pieces across those places,
texts stay whole. Special tokens inside texts are plain
text. Repeated rows count as documents of their own; an empty table gives an
empty one; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_table
from .common import byte_sizes, materialise, slices, table, texts_of

FREQUENT = 200_000
#: Parts of texts one worker remembers before it starts afresh.
MEMORY = 400_000
TEXT_BYTES = 4 << 20
#: Places that tokens of A never cross: A splits words, signs and white space
#: there, and no rule of its looks back. (After a line feed only if it is alone:
#: a run of white space before a word is split by its own length.)
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r".,;:!?%$&*#)\]|"
_CUT = rf"(?<=[!-~\w])(?= )|(?<=[{_LETTERS}])(?=[\n{_SIGNS}])|(?<=[!-~\w]\n)(?=[{_LETTERS}])"
#: Parts between such places: a word, signs, a line feed, or up to the next place.
_PARTS = re.compile(rf" ?[{_LETTERS}]++(?=[ \n{_SIGNS}])|[{_SIGNS}]++(?:\n(?=[{_LETTERS}])|(?= ))"
                    rf"|(?<=[!-~\w])\n(?=[{_LETTERS}])|(?s:.+?)(?:{_CUT}|\Z)")
_CROSSING = re.compile(rf"[^▁]▁|[{_LETTERS}][{_SIGNS}]|\n")


class Vocabularies:
    """Both tokenizers, the bytes of their ids and the identity map."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = {c: b for b, c in byte_table().items()}
        said = (self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size()))
        self.bytes_a = [bytes(map(of.__getitem__, t)) if all(c in of for c in t) else t.encode() for t in said]
        pieces = range(self.b.get_piece_size())
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        ordinary = {self.bytes_b[i]: i for i in sorted(pieces, key=self.b.is_byte, reverse=True)}
        self.same = np.array([ordinary.get(t, -1) for t in self.bytes_a], np.int64)
        self.size_a, self.size_b = (np.array([len(t) for t in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        a, b = ([b"%d" % i for i in range(len(v))] for v in (self.bytes_a, self.bytes_b))
        #: Texts of ids inside and at the end of a group's side.
        self.said = [t + end for ids, ends in ((a, b",|"), (b, b",;")) for end in (ends[:1], ends[1:]) for t in ids]

        ordinary = (self.b.id_to_piece(i) for i in pieces if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        self.space, self.feed = self.b.piece_to_id("▁"), self.b.encode("\n")
        self.cut = not any(map(_CROSSING.search, ordinary)) and self.feed == [self.space, self.b.piece_to_id("<0x0A>")]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.parts: dict = {}

    def split(self, text: str) -> list[str]:
        """Parts of space + text; none of the empty text."""
        return (_PARTS.findall(" " + text) if self.cut else [" " + text]) if text else []

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of parts of texts; none where the bytes differ."""
        a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        # B adds a space: it takes the place of the part's own, or stands
        # before a line feed, which joins with nothing and goes with it.
        b = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in parts], num_threads=1)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for i, part in enumerate(parts):
            if part[0] != " ":
                b[i] = b[i][len(self.feed):]
            elif part == " ":
                b[i] = [self.space]
            raw = part.encode("utf-8", "replace")
            if b"".join(map(of_a, a[i])) != raw or b"".join(map(of_b, b[i])) != raw:
                a[i], b[i] = [], []
        return a, b

    def look_up(self, parts: list[str]) -> tuple[dict, np.ndarray]:
        """The table of parts met and the place of each part there."""
        new = list(dict.fromkeys(p for p, at in zip(parts, map(self.number.get, parts)) if at is None))
        if len(self.number) + len(new) > MEMORY:
            self.forget()
            new = list(dict.fromkeys(parts))
        for at in range(0, len(new), 50_000):
            own = new[at:at + 50_000]
            self.number.update(zip(own, range(len(self.number), len(self.number) + len(own))))
            self.parts = _joined(self.parts, align_parts(self, own))
        return self.parts, np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))


@functools.lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def _before(counts: np.ndarray) -> np.ndarray:
    """0 and the running sums of ``counts``."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _expand(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (``many[i]`` of them) of each i."""
    return np.repeat(starts - _before(many)[:-1], many) + np.arange(int(many.sum()))


def _by_row(rows: np.ndarray, keys: np.ndarray, times: np.ndarray, n: int, most: int) -> tuple:
    """(number of distinct keys of each of n rows, the keys, their times)."""
    found, at = np.unique(rows * most + keys, return_inverse=True)
    summed = np.bincount(at, times, len(found)).astype(np.int64)
    return np.bincount(found // most, minlength=n), found % most, summed


def align_parts(v: Vocabularies, parts: list[str]) -> dict:
    """Of each part: n_a, n_b, n_groups (0 tokens: the bytes differ) and the
    groups as text; ``same`` and ``pairs``: (number of entries of each part,
    entries, times) of the A ids of identity pairs and of all other pairs."""
    ids_a, ids_b = v.encode(parts)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
    end_a, end_b = np.cumsum(v.size_a[a]), np.cumsum(v.size_b[b])
    ends = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, np.uint8)
    ends[end_a] += 1
    ends[end_b] += 2
    cuts = np.cumsum(ends == 3)
    group_a, group_b = cuts[end_a - 1], cuts[end_b - 1]
    groups = int(cuts[-1])
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    part_a = np.repeat(np.arange(len(parts)), n_a)

    # Regular groups: one token each, the one the map names.
    single = (in_a == 1) & (in_b == 1)
    at_a, at_b = np.flatnonzero(single[group_a]), np.flatnonzero(single[group_b])
    mapped = v.same[a[at_a]] == b[at_b]
    regular = np.zeros(len(a), bool)
    regular[at_a[mapped]] = True
    # The others: every B token over each A token.
    odd = np.flatnonzero(~regular)
    first = np.searchsorted(end_b, end_a[odd] - v.size_a[a[odd]], "right")
    over = np.searchsorted(end_b - v.size_b[b], end_a[odd], "left") - first
    pair_a, pair_b = np.repeat(odd, over), b[_expand(first, over)]
    pair_part, pair_a = part_a[pair_a], a[pair_a]
    known = v.same[pair_a] == pair_b

    def each(rows, keys, most):
        return _by_row(rows, keys, np.ones(len(keys)), len(parts), most)

    same = each(np.concatenate([part_a[regular], pair_part[known]]), np.concatenate([a[regular], pair_a[known]]), len(v.bytes_a))
    pairs = each(pair_part[~known], pair_a[~known] * len(v.bytes_b) + pair_b[~known], len(v.bytes_a) * len(v.bytes_b))

    # Groups as text: each group's A tokens, then its B tokens.
    last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    said = np.empty(len(a) + len(b), np.int64)
    said[np.arange(len(a)) + _before(in_b)[group_a]] = a + len(v.bytes_a) * last_a
    said[np.arange(len(b)) + _before(in_a)[group_b + 1]] = 2 * len(v.bytes_a) + b + len(v.bytes_b) * last_b
    text_of, at = v.said.__getitem__, _before(n_a + n_b).tolist()
    spoken = [b"".join(map(text_of, said[i:j].tolist()))[:-1] for i, j in zip(at[:-1], at[1:])]
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(part_a[last_a], minlength=len(parts)),
            "groups": spoken, "same": same, "pairs": pairs}


def _joined(a: dict, b: dict) -> dict:
    """Two tables of :func:`align_parts`, one after the other."""
    if not a:
        return b
    out = {}
    for k in a:
        if isinstance(a[k], tuple):
            out[k] = tuple(np.concatenate(x) for x in zip(a[k], b[k]))
        else:
            out[k] = a[k] + b[k] if isinstance(a[k], list) else np.concatenate([a[k], b[k]])
    return out


def align(v: Vocabularies, texts: list[str]) -> dict:
    """:func:`align_parts` of whole texts, and n_links."""
    split = [v.split(t) for t in texts]
    n, sizes = len(texts), np.array([len(own) for own in split], np.int64)
    found, part = v.look_up(list(itertools.chain.from_iterable(split)))
    row = np.repeat(np.arange(n), sizes)
    found = found or align_parts(v, [])
    lost = np.bincount(row[found["n_a"][part] == 0], minlength=n) > 0
    row, part = row[~lost[row]], part[~lost[row]]
    out = {k: np.bincount(row, found[k][part], n).astype(np.int64) for k in ("n_a", "n_b", "n_groups")}
    # Two ways to cut a line: each token of either side beyond a group's first adds a link.
    out["n_links"] = out["n_a"] + out["n_b"] - out["n_groups"]
    said, ends = list(map(found["groups"].__getitem__, part.tolist())), np.cumsum(np.bincount(row, minlength=n)).tolist()
    out["groups"] = [b";".join(said[i:j]) for i, j in zip([0, *ends], ends)]
    own, times = np.unique(row * (len(v.number) + 1) + part, return_counts=True)
    row, part = own // (len(v.number) + 1), own % (len(v.number) + 1)
    for k, most in (("same", len(v.bytes_a)), ("pairs", len(v.bytes_a) * len(v.bytes_b))):
        many, keys, each = found[k]
        place = _expand(_before(many)[part], many[part])
        out[k] = _by_row(np.repeat(row, many[part]), keys[place], each[place] * np.repeat(times, many[part]), n, most)
    return out


_ENCODED = pa.schema([
    ("doc_id", pa.int64()), ("totals", pa.bool_()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
    ("groups", pa.string()), ("groups_sha256", pa.string()), ("same", pa.list_(pa.int32())), ("same_times", pa.list_(pa.int64())),
    ("pairs", pa.list_(pa.int64())), ("pair_times", pa.list_(pa.int32()))])
_ENCODED_SQL = ("doc_id long, totals boolean, n_a long, n_b long, n_groups long, n_links long, groups string, "
                "groups_sha256 string, same array<int>, same_times array<long>, pairs array<long>, pair_times array<int>")


def _lists(numbers, values, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_before(numbers), pa.int32()), pa.array(values, kind))


def _record(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns.get(f.name, [None] * n), f.type)
        for f in _ENCODED], schema=_ENCODED)


def token_groups(df: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """One row per text: its groups (as text ``a1,a2|b1;a3|b2,b3`` if asked
    for, and as digest), the A ids of identity pairs and the other pairs with
    their numbers. Each task adds a row (``totals``) with its part of the
    vector: how many of its texts hold each A id's identity pair."""
    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        v = vocabularies(path_a, path_b)
        vector = np.zeros(len(v.bytes_a), np.int64)
        for batch in batches:
            for i, j in slices(byte_sizes(batch.column(1)), TEXT_BYTES):
                part = batch.slice(i, j - i)
                found = align(v, texts_of(part.column(1)))
                vector += np.bincount(found["same"][1], minlength=len(vector))
                (many, ids, times), (many_pairs, pairs, pair_times) = found["same"], found["pairs"]
                yield _record({k: found[k] for k in ("n_a", "n_b", "n_groups", "n_links")} | {
                    "doc_id": part.column(0), "totals": np.zeros(len(part), bool),
                    "groups": [g.decode() if with_groups else None for g in found["groups"]],
                    "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]],
                    "same": _lists(many, ids, pa.int32()), "same_times": _lists(many, times, pa.int64()),
                    "pairs": _lists(many_pairs, pairs, pa.int64()), "pair_times": _lists(many_pairs, pair_times, pa.int32()),
                }, len(part))
        held = np.flatnonzero(vector)
        yield _record({"totals": [True], "same": _lists([len(held)], held, pa.int32()),
                       "same_times": _lists([len(held)], vector[held], pa.int64())}, 1)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, _ENCODED_SQL)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(running numbers of entries, entries) of an Arrow list column."""
    return _before(column.value_lengths().to_numpy()), column.flatten().to_numpy()


def _sums(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.diff(_before(values)[at])


def pair_counts(groups: DataFrame, size_b: int) -> tuple[DataFrame, DataFrame]:
    """From stored :func:`token_groups`: documents by A id of the identity
    pairs (a, documents), summed from the vectors of the tasks, and by pair of
    all others (pair = a * size_b + b, documents)."""
    vector = (groups.where("totals").select(F.inline(F.arrays_zip("same", "same_times")))
              .groupBy(F.col("same").alias("a")).agg(F.sum("same_times").alias("documents")))
    pairs = (groups.where("not totals").select(F.explode("pairs").alias("pair"))
             .groupBy("pair").agg(F.count(F.lit(1)).alias("documents")))
    return vector, pairs


def link_statistics(df: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id",
                    text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per text: numbers of tokens, groups and links, the digest of the
    groups, ``n_best`` (links whose count is the highest of their A id) and
    ``count_sum`` (the counts of all links)."""
    spark = df.sparkSession
    v = vocabularies(path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"))
    size_a, size_b = len(v.bytes_a), len(v.bytes_b)
    groups = materialise(token_groups(df, path_a, path_b, id_col, text_col, with_groups=False).drop("groups")
                         .withColumn("row", F.monotonically_increasing_id()), "token-groups")
    vector, pairs = pair_counts(groups, size_b)
    pairs = materialise(pairs.withColumn("a", F.expr(f"cast(pair div {size_b} as int)")), "pair-counts")
    # One row for each A id at most.
    vector = materialise(vector, "identity-counts")
    top = materialise(vector.unionByName(pairs.select("a", "documents")).groupBy("a").agg(F.max("documents").alias("top")), "top-counts")
    entries = pairs.agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
    often = F.col("documents") * frequent >= entries

    def dense(rows: DataFrame, value: str) -> np.ndarray:
        found = rows.select("a", value).toArrow()
        out = np.zeros(size_a, np.int64)
        out[found["a"].to_numpy()] = found[value].to_numpy()
        return out

    hot = pairs.where(often).select("pair", "documents").toArrow().sort_by("pair")
    told = spark.sparkContext.broadcast((dense(vector, "documents"), dense(top, "top"),
                                         hot["pair"].to_numpy(), hot["documents"].to_numpy()))

    def looked_up(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, 0 where the pair is rare; whether it is frequent)."""
        _, _, keys, counts = told.value
        at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        there = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
        return np.where(there, counts[at] if len(keys) else 0, 0), there

    base_schema = pa.schema([("row", pa.int64()), ("best", pa.int64()), ("counted", pa.int64())])
    rare_schema = pa.schema([("row", pa.int64()), ("pair", pa.int64()), ("times", pa.int64())])
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def base(batches):
        for batch in batches:
            documents, highest, _, _ = told.value
            at, ids = _flat(batch.column("same"))
            times = batch.column("same_times").flatten().to_numpy()
            pair_at, pair = _flat(batch.column("pairs"))
            pair_times = batch.column("pair_times").flatten().to_numpy().astype(np.int64)
            count, there = looked_up(pair)
            best = _sums(at, times * (documents[ids] == highest[ids])) + _sums(pair_at, pair_times * (there & (count == highest[pair // size_b])))
            counted = _sums(at, times * documents[ids]) + _sums(pair_at, pair_times * count)
            made = table({"row": batch.column("row"), "best": best, "counted": counted}, base_schema)
            yield pa.RecordBatch.from_arrays([*made.columns, *(batch.column(c) for c in plain)], names=[*base_schema.names, *plain])

    def rare(batches):
        for batch in batches:
            at, pair = _flat(batch.column("pairs"))
            odd = ~looked_up(pair)[1]
            yield table({"row": np.repeat(batch.column("row").to_numpy(), np.diff(at))[odd], "pair": pair[odd],
                         "times": batch.column("pair_times").flatten().to_numpy()[odd]}, rare_schema)

    own = groups.where("not totals")
    held = own.select("row", "same", "same_times", "pairs", "pair_times", *plain).mapInArrow(
        base, "row long, best long, counted long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")
    counts = (pairs.where(~often).join(F.broadcast(top), "a")
              .select("pair", "documents", (F.col("documents") == F.col("top")).alias("is_best")))
    rest = (own.where(F.size("pairs") > 0).select("row", "pairs", "pair_times").mapInArrow(rare, "row long, pair long, times long")
            .join(counts, "pair").groupBy("row").agg(
                F.sum(F.col("times") * F.col("documents")).alias("_counted"),
                F.sum(F.when(F.col("is_best"), F.col("times"))).alias("_best")))
    zero = F.lit(0)
    return held.join(rest, "row", "left").select(
        F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        (F.col("best") + F.coalesce("_best", zero)).alias("n_best"),
        (F.col("counted") + F.coalesce("_counted", zero)).alias("count_sum"), "groups_sha256")
