"""MinHash near-duplicates with odd sketches.

A document's set: hashes (64 bits) of its distinct runs of ``width`` words, of
its whole sequence if it has fewer. Documents with equal sets form a class,
represented by its smallest id. MinHash samples of the set are banded
(``BANDS`` of ``ROWS``; a pair at the threshold meets in some band with
probability 0.999997) and all samples are folded into an odd sketch: a bitmap
in which every sample flips one bit, so the XOR of two sketches has a
population count that tells high similarities precisely. Candidates below
``FLOOR`` by that estimate are dropped (computed for independent samples: 8 in
100 million pairs at the threshold, less than the bands miss); the rest are
confirmed on full sets.

Groups of near copies are never expanded into pairs. First every class is
confirmed against one partner: the smallest class of the bucket it shares most
often. Then components are formed, and classes that still differ in component
are compared inside their buckets, by sketch, in blocks of bounded size
(:mod:`blocks`). Only the full sets of those that have an alike partner travel
to their blocks, where pairs of unlike component are confirmed, most alike
first; what leaves a block is the links that join components. No cap limits
buckets, partners or candidates.

Defined results: null, empty and blank texts have an empty set, link with
nothing and stay; a row with a null id has a null component and stays; each row
is returned, with the component of its own text (rows of one id that hold
unlike texts share the id's links; :func:`drop_copies` tells them apart). Empty tables
give no rows. Columns other than the id and the text are ignored
(:func:`drop_copies` returns all).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import in_blocks, map_groups
from .common import byte_sizes, materialise, slices, table, texts_of
from .components import connected_components
from .words import P, mix, word_hashes

BANDS, ROWS, SAMPLES = 24, 4, 128
SKETCH_BITS = 256
FLOOR = 0.5
BLOCK = 768
CHUNK_BYTES = 4 << 20

_MULTIPLIERS = np.random.default_rng(20240611).integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str], width: int = 4):
    """Sorted distinct hashes of each text's set."""
    hashes, sizes = word_hashes(texts)
    for part in np.split(hashes, np.cumsum(sizes)[:-1]) if len(texts) else []:
        yield shingles(part, width)


def shingles(h: np.ndarray, width: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the set of a sequence of word hashes."""
    if not len(h):
        return h
    if len(h) < width:
        total = np.uint64(len(h))
        with np.errstate(over="ignore"):
            for w in h:
                total = total * P + w
        return mix(np.array([total], np.uint64))
    n = len(h) - width + 1
    total = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        total = total * P + h[i:i + n]
    return np.unique(mix(total))


def minhash(items: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 1024):
        np.minimum(least, (items[at:at + 1024, None] * _MULTIPLIERS).min(axis=0), out=least)
    return least


def bands(samples: np.ndarray) -> np.ndarray:
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        total = mix(total * P + samples[i * BANDS:(i + 1) * BANDS])
    return total.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    """Each (index, sample) flips one bit."""
    bit = mix(samples + np.arange(1, SAMPLES + 1, dtype=np.uint64) * P) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two sketches."""
    odd = np.clip(1 - 2 * np.asarray(differing, float) / SKETCH_BITS, 1e-9, 1)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(odd)


#: The most differing bits with an estimate of FLOOR or more.
MOST_BITS = int(np.flatnonzero(estimate(np.arange(SKETCH_BITS + 1)) >= FLOOR).max())


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


def signatures(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, digest (of the set), bands, sketch; the last three are
    null for an empty set."""
    arrow = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                       ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def rows(texts):
        for items in shingle_sets(texts, width):
            if len(items):
                samples = minhash(items)
                yield (len(items), hashlib.blake2b(items.tobytes(), digest_size=16).digest(), bands(samples), odd_sketch(samples))
            else:
                yield 0, None, None, None

    def run(batches):
        for batch in batches:
            for a, b in slices(byte_sizes(batch.column(1)), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                columns = zip(arrow.names[1:], zip(*rows(texts_of(part.column(1)))))
                yield table({"id": part.column(0)} | {k: list(v) for k, v in columns}, arrow)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(
        run, "id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def _sets(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, items) of the documents in ``ids``."""
    wanted = docs.select(F.col(id_col).cast("long").alias("node"), text_col).join(ids, "node", "left_semi")

    def run(batches):
        for batch in batches:
            for a, b in slices(byte_sizes(batch.column(1)), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(
                    [x.tobytes() for x in shingle_sets(texts_of(part.column(1)), width)], pa.binary())], ["node", "items"])

    return wanted.mapInArrow(run, "node long, items binary")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(docs: DataFrame, pairs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = materialise(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "near-ids")
    sets = materialise(_sets(docs, ids, width, id_col, text_col), "near-sets")
    first = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                keep.append(_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches say FLOOR or more."""
    joined = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
              .join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y"))

    def run(batches):
        for batch in batches:
            if len(batch):
                ok = _bits(_sketches(batch.column(2)), _sketches(batch.column(3))) <= MOST_BITS
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return joined.mapInArrow(run, "a long, b long").distinct()


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in names]


def _band_table(rows: pa.Table) -> np.ndarray:
    return rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)


def _marked(rows: pa.Table, starts: list):
    """The rows that have a partner of another component in their group whose
    sketch is alike and which they meet here first: every row is compared with
    the one d rows on, for all d."""
    n = len(rows)
    group = np.zeros(n, np.int64)
    group[starts] = 1
    group = np.cumsum(group)
    key, lo, hi, part, comp = _columns(rows, "key", "lo", "hi", "part", "component")
    sketch, band, mark = _sketches(rows.column("sketch")), _band_table(rows), np.zeros(n, bool)
    for d in range(1, int(np.diff([*starts, n]).max())):
        i = np.flatnonzero((group[:-d] == group[d:]) & (comp[:-d] != comp[d:]) & ((lo[:-d] == hi[:-d]) | (part[:-d] != part[d:])))
        i = i[_bits(sketch[i], sketch[i + d]) <= MOST_BITS]
        first = (band[i] == band[i + d]).argmax(axis=1)
        i = i[band[i, first] == key[i]]
        mark[i] = mark[i + d] = True
    if mark.any():
        kept = ["key", "lo", "hi", "node", "part", "component", "sketch", "bands"]
        yield from rows.select(kept).filter(pa.array(mark)).combine_chunks().to_batches()


def _linked(percent: int):
    """Links confirmed on full sets between the components of a group: most
    alike first, and none between components that a link has joined already."""

    def work(rows: pa.Table, starts: list):
        node, lo, hi, key, part, comp = _columns(rows, "node", "lo", "hi", "key", "part", "component")
        sketch, band = _sketches(rows.column("sketch")), _band_table(rows)
        items = rows.column("items")
        out = {"a": [], "b": []}
        for s, e in zip(starts, [*starts[1:], len(rows)]):
            pairs = []
            for i in range(s, e - 1):
                j = np.arange(i + 1, e)
                j = j[(comp[j] != comp[i]) & ((lo[i] == hi[i]) | (part[j] != part[i]))]
                bits = _bits(sketch[j], sketch[i][None])
                j, bits = j[bits <= MOST_BITS], bits[bits <= MOST_BITS]
                here = band[i, (band[j] == band[i]).argmax(axis=1)] == key[i] if len(j) else np.zeros(0, bool)
                pairs.append(np.stack([bits[here].astype(np.int64), np.full(here.sum(), i), j[here]]))
            pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), int)
            of: dict = {}

            def root(c):
                while (up := of.get(c, c)) != c:
                    c = up
                return c

            sets: dict = {}
            for _, i, j in pairs[:, np.argsort(pairs[0], kind="stable")].T.tolist():
                p, q = root(comp[i]), root(comp[j])
                if p == q:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = np.frombuffer(items[k].as_py(), np.uint64)
                if _similar(sets[i], sets[j], percent):
                    of[q] = p
                    out["a"].append(node[i])
                    out["b"].append(node[j])
        if out["a"]:
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return work


def link_classes(docs: DataFrame, signed: DataFrame, classes: DataFrame, percent: int = 80, width: int = 4,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component) of the classes that link with another one."""
    nodes = materialise(signed.join(classes.select("digest", F.col("node").alias("id")), ["digest", "id"])
                        .select(F.col("id").alias("node"), "bands", "sketch").dropDuplicates(["node", "bands"]), "near-nodes")
    rows = nodes.select(F.explode("bands").alias("key"), "node")
    buckets = materialise(rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
                          .where("hub < last").select("key", "hub"), "near-buckets")
    held = materialise(rows.join(buckets, "key"), "near-rows")
    best = (held.where("hub < node").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("node").agg(F.max(F.struct("n", (-F.col("hub")).alias("m"))).alias("x"))
            .select(F.col("node").alias("a"), (-F.col("x.m")).alias("b")))
    links = materialise(_confirm(docs, materialise(_alike(best, nodes), "near-best"), percent, width, id_col, text_col), "near-links")
    found = materialise(connected_components(links), "near-found")
    known = held.select("key", "node").join(found, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    known = materialise(known, "near-known")
    mixed = (known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"))
             .where("x < y").select("key", "n"))
    mixed = materialise(mixed, "near-mixed")
    sketched = nodes.dropDuplicates(["node"])
    keys = ["key", "lo", "hi"]
    dealt = in_blocks(known.join(mixed.select("key"), "key"), mixed, "key", "node", BLOCK).join(sketched, "node")
    marked = materialise(map_groups(dealt, keys, "node", _marked, "key long, lo int, hi int, node long, part int, "
                                    "component long, sketch binary, bands array<long>"), "near-marked")
    sets = materialise(_sets(docs, materialise(marked.select("node").distinct(), "near-ids"), width, id_col, text_col), "near-sets")
    more = map_groups(marked.join(sets, "node"), keys, "node", _linked(percent), "a long, b long")
    more = materialise(more.distinct(), "near-more")
    if more.isEmpty():
        return found
    return connected_components(links.unionByName(more))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: one row per row of ``docs``."""
    signed = materialise(signatures(docs, width, id_col, text_col), "near-signed")
    classes = materialise(signed.where("digest is not null and id is not null").groupBy("digest")
                          .agg(F.min("id").alias("node"), F.max("id").alias("last")), "near-classes")
    links = materialise(link_classes(docs, signed, classes, percent, width, id_col, text_col), "near-components")
    # Only classes of several documents, or linked with others, differ from the id.
    named = materialise(classes.join(links, "node", "left").where("last > node or component is not null")
                        .select("digest", F.coalesce("component", "node").alias("component_id")), "near-named")
    out = signed.select("id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles",
                      F.when(F.col("id").isNotNull(), component).alias("component_id"),
                      (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))


def _with_digests(rows: DataFrame, width: int, text_col: str) -> DataFrame:
    """``rows`` with the digest of each text's set as ``_digest``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("_digest", BinaryType())])
    names, at = to_arrow_schema(schema).names, rows.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = []
            for a, b in slices(byte_sizes(batch.column(at)), CHUNK_BYTES):
                for items in shingle_sets(texts_of(batch.column(at).slice(a, b - a)), width):
                    found.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=names)

    return rows.mapInArrow(run, schema)


def _own_nodes(docs: DataFrame, rows: DataFrame, unlike: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with a number of its own (``_node``) for every id and set: the
    id, but for ids in ``unlike``, whose ``rows`` (with digests) hold unlike
    texts. Of those the least digest has the id and the others come after all
    ids."""
    own = docs[id_col].cast("long")
    plain = docs.join(unlike, own == unlike["_unlike"], "left_anti").withColumn("_node", F.col(id_col).cast("long"))
    rows = rows.join(unlike, rows[id_col].cast("long") == unlike["_unlike"], "left_semi")
    sets = materialise(rows.select(F.col(id_col).cast("long").alias("_id"), F.col("_digest").alias("_set")).distinct(), "near-unlike-sets")
    first = sets.groupBy(F.col("_id").alias("_first_id")).agg(F.min("_set").alias("_first"))
    last = docs.agg(F.max(F.col(id_col).cast("long"))).first()[0]
    # Numbers in the order of (id, digest), whatever the partitions.
    rest = (sets.join(first, (F.col("_id") == F.col("_first_id")) & (F.col("_set") == F.col("_first")), "left_anti")
            .repartitionByRange("_id", "_set").sortWithinPartitions("_id", "_set")
            .withColumn("_after", F.lit(max(last, 0) + 1) + F.monotonically_increasing_id()))
    rest = materialise(rest, "near-unlike-nodes")
    named = rows.join(rest, (rows[id_col].cast("long") == rest["_id"]) & (rows["_digest"] == rest["_set"]), "left")
    return plain.unionByName(named.withColumn("_node", F.coalesce("_after", F.col(id_col).cast("long")))
                             .select(*docs.columns, "_node"))


def _first_rows(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """Of the rows of each key the one with the smallest text, then the
    smallest hash of the whole row."""
    hashed = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]
    one = Window.partitionBy(F.col(key).cast("long")).orderBy(text_col, F.xxhash64(*hashed))
    return rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")


def drop_copies(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: its
    smallest id. Rows of one id and equal sets are one document, of which the
    row with the smallest text (then the smallest hash of the whole row)
    stays; rows of one id and unlike texts are documents of their own, of
    which all but the least digest's count as after every id. All rows
    without id stay. Ids are below 2^62."""
    again = materialise(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_again"))
                        .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again"), "near-again")
    columns, node, repeated = docs.columns, id_col, not again.isEmpty()
    if repeated:
        rows = materialise(_with_digests(docs.join(again, docs[id_col].cast("long") == again["_again"], "left_semi"), width, text_col), "near-repeated")
        unlike = materialise(rows.groupBy(F.col(id_col).cast("long").alias("_unlike")).agg(
            F.min("_digest").alias("x"), F.max("_digest").alias("y")).where("x <> y").select("_unlike"), "near-unlike-ids")
        if not unlike.isEmpty():
            node = "_node"
            docs = materialise(_own_nodes(docs, rows, unlike, id_col), "near-nodes")
            again = materialise(again.unionByName(docs.where(F.col("_node") != F.col(id_col)).select(
                F.col("_node").alias("_again")).distinct()), "near-again-nodes")
    found = near_duplicates(docs, percent, width, node, text_col)
    gone = materialise(found.where("not kept").select(F.col(node).alias("_gone")).distinct(), "near-gone")
    kept = docs.join(gone, docs[node].cast("long") == gone["_gone"], "left_anti")
    if not repeated:
        return kept
    same = kept[node].cast("long") == again["_again"]
    several = _first_rows(kept.join(again, same, "left_semi"), node, text_col)
    return kept.join(again, same, "left_anti").unionByName(several).select(*columns)
