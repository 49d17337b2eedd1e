"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels (level q holds counts
from 2^(q-1) to 2^q - 1) and an n-gram of level q is stored as the q items
(n-gram, 1) ... (n-gram, q) of a Bloom filter. A count is read by probing the
items in turn until one is missing. The filter grows with the corpus: it has
``BITS_PER_ITEM`` bits for every item there can be, and no n-gram is left out.

A filter of a large corpus fits no worker, so it is not sent to the text; the
probes go to the filter, and the work grows with the text alone:

1. texts become chunks: files in the shared folder with the documents' ids,
   the chunk's distinct words (hashes) and where they stand;
2. a chunk's distinct words and pairs, with their training counts, are dealt
   by runs of filter blocks, packed as arrays;
3. the task of a run adds the counts up, fills the run's blocks and probes them
   with every n-gram it was dealt; levels go back to their chunks in order, and
   with those of words their exact counts, which the base score needs;
4. chunks are read with their levels, once to fit the weights, once to score.

An n-gram's block is set by its hash and the number of training tokens; how
many blocks make a run (``RUN_BLOCKS``) changes no score. A run's task gets a
frequent n-gram once from every chunk, never once for every place.

The probability of word w after word v is
``L * count(v w) / count(v) + (1 - L) * (count(w) + 0.1) / (N + 0.1 (V + 1))``
with dequantised counts. The weight L depends on the level of v and on how
many of the three pairs before were known; expectation maximisation fits it
on all training documents, each position scored without its own count.

Documents whose crc32(id as text) mod 10 is 0 are held out. Defined results:
null text is empty (its end is its only token); without training documents
counts are 0, every base probability is 1 (log 0); repeated rows count as
often as they occur; a null id counts as the empty text for the remainder (held
out); empty tables give no rows; columns other than the id and the text are
ignored. No text is cut; a task holds one chunk or one run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .byte_bpe import _id_type
from .common import byte_sizes, materialise, slices, texts_of
from .words import P, mix, word_hashes

BITS_PER_ITEM = 9
PROBES = 5
BLOCK = 1 << 19
#: Blocks that one task fills and probes at a time (64 KiB each).
RUN_BLOCKS = 64
CHUNK_BYTES = 8 << 20
#: Chunks and runs of one task. Their tables are small beside their work, so
#: the number of tasks is said, not left to the size of the tables.
TASK_CHUNKS, TASK_RUNS = 8, 2
LEVELS = 40
#: The end of a text; no word is empty, so its hash is free.
END = np.uint64(0x2D06800538D394C2)
KNOWN = 3
#: Sets pairs apart from words of the same hash.
PAIR = np.uint64(0x8F14C2B6A93D5E71)


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of an end, then of every text's words and its end; the tokens of
    each text."""
    found, sizes = word_hashes(texts)
    ends = np.cumsum(sizes + 1)  # where each text's end stands, after the first
    out = np.empty(len(found) + len(sizes) + 1, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[0] = True
    is_end[ends] = True
    out[is_end], out[~is_end] = END, found
    return out, sizes + 1


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens[:-1] * P + tokens[1:])


def level_of(counts):
    """0 for none, q for counts from 2^(q-1) to 2^q - 1."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 0)


#: The middle of each level's counts.
COUNT_OF = np.array([0.0] + [(2.0 ** (q - 1) + 2.0 ** q - 1) / 2 for q in range(1, LEVELS + 1)])


def blocks_for(tokens: int) -> int:
    """Blocks for the items of so many training tokens: the levels of all words
    sum to one item a token at most, and so do those of all pairs."""
    return max(1, -(-2 * tokens * BITS_PER_ITEM // BLOCK))


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each n-gram; grows with its hash."""
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


class Filter:
    """A run of blocks, from block ``first`` on, as an array of bytes."""

    def __init__(self, blocks: int, first: int = 0, count: int | None = None):
        self.blocks, self.first = blocks, first
        self.flags = np.zeros((blocks if count is None else count) * BLOCK, bool)
        self.bits = np.zeros(0, np.uint8)

    @staticmethod
    def places(items: np.ndarray, level: int):
        """Bit places of the items' probes inside their block, one array a probe."""
        x = mix(items ^ mix(np.array([level], np.uint64)))
        step = (x >> np.uint64(32)) | np.uint64(1)
        for _ in range(PROBES):
            yield (x & np.uint64(BLOCK - 1)).astype(np.int64)
            x = x + step

    def _base(self, h: np.ndarray) -> np.ndarray:
        return (block_of(h, self.blocks) - self.first) * BLOCK

    def add(self, h: np.ndarray, q: np.ndarray, salt: np.uint64 = np.uint64(0)) -> None:
        """Stores n-grams of the levels q; before :meth:`seal`."""
        base, items = self._base(h), h ^ salt
        for level in range(1, int(q.max(initial=0)) + 1):
            own = np.flatnonzero(q >= level)
            for place in self.places(items[own], level):
                self.flags[base[own] + place] = True

    def seal(self) -> Filter:
        self.bits, self.flags = np.packbits(self.flags, bitorder="little"), np.zeros(0, bool)
        return self

    def levels(self, h: np.ndarray, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
        """Level of each n-gram: probes until an item is missing."""
        out = np.zeros(len(h), np.int64)
        alive, items, base = np.arange(len(h)), h ^ salt, self._base(h)
        for level in range(1, LEVELS + 1):
            for place in self.places(items, level):
                at = base + place
                hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                if not hit.all():
                    # A probe's places follow from the items, which go on with the few.
                    alive, items, base = alive[hit], items[hit], base[hit]
                    break
            else:
                out[alive] = level
                continue
            ok = np.ones(len(items), bool)
            for place in self.places(items, level):
                at = base + place
                ok &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            alive, items, base = alive[ok], items[ok], base[ok]
            if not len(alive):
                break
            out[alive] = level
        return out


@dataclass
class Chunk:
    """Documents of one chunk: ids, whether held out, tokens of each; distinct
    words in order of their hashes, and the word at every place (an end first)."""

    ids: pa.Array
    held: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    at: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs, in order, and the pair that ends at every place."""
        return np.unique(pairs_of(self.words[self.at]), return_inverse=True)

    def trained(self) -> np.ndarray:
        """Whether each place (but the first end) belongs to a training text."""
        return np.repeat(~self.held, self.sizes)

    def save(self, sink) -> None:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in (pa.RecordBatch.from_arrays([self.ids, pa.array(self.held), pa.array(self.sizes)], names=["id", "held", "size"]),
                      pa.RecordBatch.from_arrays([pa.array(self.words)], names=["word"]),
                      pa.RecordBatch.from_arrays([pa.array(self.at.astype(np.uint32))], names=["at"])):
            with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                out.write_batch(batch)

    @staticmethod
    def load(path: str) -> Chunk:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(at) as source:
            docs, words, places = (pa.ipc.open_stream(source).read_all().combine_chunks() for _ in range(3))
        column = lambda t, name: t.column(name).to_numpy()
        return Chunk(docs.column("id").combine_chunks() if isinstance(docs.column("id"), pa.ChunkedArray) else docs.column("id"),
                     column(docs, "held"), column(docs, "size"), column(words, "word"), column(places, "at"))


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0


def _shared(spark: SparkSession, name: str) -> str:
    folder = scratch_path(spark, name)
    return folder if "://" in folder else f"file://{folder.removeprefix('file:')}"


def write_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Writes the chunks; (chunk, path, tokens, trained): one row each. Only
    files that successful tasks report are read."""
    folder = _shared(docs.sparkSession, "lm-chunks")

    def run(batches):
        task, n = TaskContext.get(), 0
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for a, b in slices(byte_sizes(batch.column(1)), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                tokens, sizes = stream(texts_of(part.column(1)))
                words, at = np.unique(tokens, return_inverse=True)
                held = part.column(2).to_numpy(zero_copy_only=False)
                name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{n:06d}.arrow"
                with fs.open_output_stream(f"{root}/{name}") as sink:
                    Chunk(part.column(0), held, sizes, words, at).save(sink)
                n += 1
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "tokens": [int(sizes.sum())],
                                                  "trained": [int(sizes[~held].sum())]})

    rows = docs.select(id_col, text_col, held_out(id_col).alias("_held"))
    return materialise(rows.mapInArrow(run, "path string, tokens long, trained long")
                       .withColumn("chunk", F.monotonically_increasing_id()), "lm-list")


def _deal(listed: DataFrame, blocks: int, run_blocks: int, tasks: int = 1) -> DataFrame:
    """(run, chunk, words, word_counts, pairs, pair_counts): the distinct
    n-grams of every chunk and their training counts, by run of blocks."""
    names = ["run", "chunk", "words", "word_counts", "pairs", "pair_counts"]

    def run(batches):
        for batch in batches:
            for key, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunk = Chunk.load(path)
                pairs, pair_at = chunk.pairs()
                weight = chunk.trained().astype(float)
                counts = [np.bincount(at, weight, n).astype(np.uint32) for at, n in ((chunk.at[1:], len(chunk.words)), (pair_at, len(pairs)))]
                runs = [block_of(h, blocks) // run_blocks for h in (chunk.words, pairs)]
                for r in np.union1d(runs[0], runs[1]).tolist():
                    (a, b), (c, d) = (np.searchsorted(x, [r, r + 1]) for x in runs)
                    yield pa.RecordBatch.from_pydict(dict(zip(names, (
                        [r], [key], [chunk.words[a:b].tobytes()], [counts[0][a:b].tobytes()],
                        [pairs[c:d].tobytes()], [counts[1][c:d].tobytes()]))))

    return listed.select("chunk", "path").repartition(tasks, "chunk").mapInArrow(
        run, "run long, chunk long, words binary, word_counts binary, pairs binary, pair_counts binary")


def _answer(dealt: DataFrame, blocks: int, run_blocks: int) -> DataFrame:
    """(run, chunk, fresh, word_levels, word_counts, pair_levels): what the
    blocks say, for each row of :func:`_deal` in its order. ``fresh``, in one
    row of a run: its number of different training words."""
    names = ["run", "chunk", "fresh", "word_levels", "word_counts", "pair_levels"]

    def whole(rows):
        first = rows[0][0] * run_blocks
        probed = Filter(blocks, first, min(run_blocks, blocks - first))
        found = []
        for k, salt in ((2, np.uint64(0)), (4, PAIR)):
            h = np.frombuffer(b"".join(r[k] for r in rows), np.uint64)
            c = np.frombuffer(b"".join(r[k + 1] for r in rows), np.uint32)
            distinct, at = np.unique(h, return_inverse=True)
            total = np.bincount(at, c, len(distinct)).astype(np.int64)
            probed.add(distinct, level_of(total), salt)
            found.append((distinct, at, total, salt))
        probed.seal()
        (word, word_at, word_total, _), (pair, pair_at, _, _) = found
        levels = [probed.levels(h, salt).astype(np.uint8)[at] for h, at, _, salt in found]
        counts = word_total[word_at]
        fresh, a, b = int((word_total > 0).sum()), 0, 0
        for r in rows:
            n, m = len(r[2]) // 8, len(r[4]) // 8
            yield pa.RecordBatch.from_pydict(dict(zip(names, (
                [r[0]], [r[1]], [fresh], [levels[0][a:a + n].tobytes()], [counts[a:a + n].tobytes()], [levels[1][b:b + m].tobytes()]))))
            fresh, a, b = 0, a + n, b + m

    def run(batches):
        rows = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if rows and rows[0][0] != row[0]:
                    yield from whole(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from whole(rows)

    runs = -(-blocks // run_blocks)
    # Neighbouring runs go to a task by number: a hash would pile some up.
    task = F.floor(F.col("run") / F.lit(TASK_RUNS)).cast("int")
    ordered = dealt.repartitionById(-(-runs // TASK_RUNS), task).sortWithinPartitions("run", "chunk")
    return ordered.mapInArrow(run, "run long, chunk long, fresh long, word_levels binary, word_counts binary, pair_levels binary")


def _collected(answers: DataFrame, tasks: int) -> DataFrame:
    """One row per chunk: the answers of all runs, one after the other."""
    names = ["chunk", "fresh", "word_levels", "word_counts", "pair_levels"]

    def run(batches):
        held = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and held[0] != row[0]:
                    yield pa.RecordBatch.from_pydict({k: [v if isinstance(v, int) else b"".join(v)] for k, v in zip(names, held)})
                    held = None
                held = held or [row[0], 0, [], [], []]
                held[1] += row[1]
                for k in (2, 3, 4):
                    held[k].append(row[k])
        if held:
            yield pa.RecordBatch.from_pydict({k: [v if isinstance(v, int) else b"".join(v)] for k, v in zip(names, held)})

    ordered = answers.repartition(tasks, "chunk").sortWithinPartitions("chunk", "run")
    return ordered.select(*names).mapInArrow(run, "chunk long, fresh long, word_levels binary, word_counts binary, pair_levels binary")


@dataclass
class Model:
    """What all chunks share; what the filter says comes with each chunk."""

    tokens: int
    vocabulary: int
    weights: np.ndarray | None = None  # by level of the word before, known pairs before

    @property
    def total(self) -> float:
        return self.tokens + 0.1 * (self.vocabulary + 1)

    def parts(self, chunk: Chunk, word_levels: np.ndarray, pair_levels: np.ndarray, leave_out: bool):
        """Per place: word and pair probability, cell of the weight table."""
        levels, known = word_levels.astype(np.int64)[chunk.at], pair_levels.astype(np.int64)[chunk.pairs()[1]]
        less = 1.0 if leave_out else 0.0
        count = np.maximum(COUNT_OF[levels] - less, 0)
        seen = np.maximum(COUNT_OF[known] - less, 0)
        word = (count[1:] + 0.1) / self.total
        pair = np.minimum(np.where(count[:-1] > 0, seen / np.maximum(count[:-1], 1), 0.0), 1.0)
        hit = seen > 0
        at = np.arange(len(hit)) - np.repeat(np.cumsum(chunk.sizes) - chunk.sizes, chunk.sizes)
        before = np.zeros(len(hit), np.int64)
        for k in range(1, KNOWN + 1):
            before[k:] += hit[:-k] & (at[k:] >= k)
        return word, pair, levels[:-1] * (KNOWN + 1) + before


def _fit_weights(answered: DataFrame, model: Model) -> np.ndarray:
    """EM over a table of (cell, ratio of pair to word probability)."""
    cells, ratios = (LEVELS + 1) * (KNOWN + 1), 64

    def run(batches):
        total = np.zeros(cells * ratios, np.int64)
        for batch in batches:
            for path, words, pairs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                chunk = Chunk.load(path)
                word, pair, cell = model.parts(chunk, np.frombuffer(words, np.uint8), np.frombuffer(pairs, np.uint8), True)
                with np.errstate(divide="ignore"):
                    ratio = np.where(pair > 0, np.clip(np.rint(2 * np.log2(pair / word)) + 20, 1, ratios - 1), 0).astype(np.int64)
                total += np.bincount((cell * ratios + ratio)[chunk.trained()], minlength=cells * ratios)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = answered.select("path", "word_levels", "pair_levels")
    got = rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(cells * ratios)
    for r in got:
        seen[r["at"]] = r["n"]
    seen = seen.reshape(cells, ratios) + 0.0
    value = np.concatenate([[0.0], 2.0 ** ((np.arange(1, ratios) - 20) / 2)])
    weight = np.full(cells, 0.1)
    for _ in range(200):
        mass = weight[:, None] * value
        weight = (seen * mass / (mass + 1 - weight[:, None])).sum(axis=1) + 0.05
        weight = np.clip(weight / (seen.sum(axis=1) + 1), 1e-6, 0.95)
    return weight


def answer_chunks(docs: DataFrame, run_blocks: int = RUN_BLOCKS, id_col: str = "doc_id",
                  text_col: str = "text") -> tuple[DataFrame, Model]:
    """(path, word_levels, word_counts, pair_levels) of every chunk of
    ``docs``, and the model without its weights."""
    listed = write_chunks(docs, id_col, text_col)
    trained, chunks = map(int, listed.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count(F.lit(1))).first())
    blocks, tasks = blocks_for(trained), max(1, -(-chunks // TASK_CHUNKS))
    answers = _answer(_deal(listed, blocks, run_blocks, tasks), blocks, run_blocks)
    collected = materialise(_collected(answers, tasks).join(listed.select("chunk", "path"), "chunk"), "lm-answers")
    fresh = int(collected.agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0])
    return collected, Model(trained, fresh)


def score(docs: DataFrame, run_blocks: int = RUN_BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the training documents and scores all: id, held_out,
    n_tokens, n_known, train_tokens, base_score, score."""
    sql, kind = _id_type(docs, id_col)
    answered, model = answer_chunks(docs, run_blocks, id_col, text_col)
    model.weights = _fit_weights(answered, model)

    def run(batches):
        for batch in batches:
            for path, words, counts, pairs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                chunk = Chunk.load(path)
                word, pair, cell = model.parts(chunk, np.frombuffer(words, np.uint8), np.frombuffer(pairs, np.uint8), False)
                share = model.weights[cell]
                logs = np.log10(share * pair + (1 - share) * word)
                count = np.frombuffer(counts, np.int64)[chunk.at[1:]]
                base = np.log10((count + 0.1) / model.total)
                starts = np.cumsum(chunk.sizes) - chunk.sizes
                n = len(chunk.sizes)
                yield pa.RecordBatch.from_arrays(
                    [chunk.ids.cast(kind), pa.array(chunk.held), pa.array(chunk.sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
                     pa.array(np.full(n, model.tokens)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts))],
                    [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return answered.select("path", "word_levels", "word_counts", "pair_levels").mapInArrow(
        run, f"`{id_col}` {sql}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
