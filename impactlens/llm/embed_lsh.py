"""Near-duplicate vectors by random-hyperplane signs.

Vectors of equal label are compared by cosine in double precision. Equal
vectors form a class, represented by the smallest id. Each table hashes a
class to the signs of its products with random hyperplanes; the number of
signs follows the largest label (so that a bucket has about ``bucket`` rows)
and the number of tables follows from it: a pair exactly at the threshold
meets in some table with probability ``recall``, a closer one more likely.
Inside a bucket all cosines are computed as matrix products over blocks of
bounded size (:mod:`blocks`); a pair is counted in the first table it meets
in only, and what leaves a block is a link count per class and a spanning
forest, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without label, link with nothing; vectors of different
lengths do not link; a null id is its own component (null) and is kept; rows of
equal id and vector are copies of each other and count as links. Empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import in_blocks, map_groups
from .common import materialise, table
from .components import connected_components

BLOCK = 1500


def plan(largest: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """(signs per table, tables)."""
    signs = min(24, max(4, math.ceil(math.log2(max(1, largest) / bucket))))
    meets = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - recall) / math.log(1 - meets))


def planes(length: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).normal(size=(length, count))


def vector(values) -> np.ndarray | None:
    """The vector in double precision; None if it can link with nothing."""
    if not values or None in values:
        return None
    x = np.array(values, dtype=np.float64) + 0.0  # no negative zeros
    return x if np.isfinite(x).all() and np.isfinite(x @ x) and x.any() else None


def signatures(rows: DataFrame, id_col: str, vector_col: str, label_col: str, kind: str) -> DataFrame:
    """id, label, digest, data (components); the last two null if it can't link."""
    arrow = pa.schema([("id", pa.int64()), ("label", pa.string()), ("digest", pa.binary()), ("data", pa.binary())])

    def run(batches):
        for batch in batches:
            digests, data = [], []
            for label, values in zip(batch.column(1).to_pylist(), batch.column(2)):
                x = None if label is None else vector(values.as_py())
                raw = None if x is None else x.astype(kind).tobytes()
                data.append(raw)
                digests.append(None if raw is None else hashlib.blake2b(raw, digest_size=16, key=label.encode()[:64]).digest())
            yield table({"id": batch.column(0), "label": batch.column(1), "digest": digests, "data": data}, arrow)

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector_col).mapInArrow(
        run, "id long, label string, digest binary, data binary")


def _signs(nodes: DataFrame, signs: int, tables: int, seed: int, kind: str) -> DataFrame:
    """node, n, data, codes (of all tables), keys (buckets of all tables)."""
    arrow = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("codes", pa.binary()),
                       ("keys", pa.list_(pa.int64()))])

    def run(batches):
        made = {}
        weights = 1 << np.arange(signs, dtype=np.int64)
        for batch in batches:
            codes, keys = [], []
            for label, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x = np.frombuffer(raw, kind).astype(np.float64)
                if len(x) not in made:
                    made[len(x)] = planes(len(x), signs * tables, seed)
                own = ((x @ made[len(x)] > 0).reshape(tables, signs) @ weights).astype(np.uint32)
                codes.append(own.tobytes())
                base = f"{len(x)}:{label}".encode()
                keys.append([int.from_bytes(hashlib.blake2b(b"%d:%d:" % (t, c) + base, digest_size=8).digest(), "little", signed=True)
                             for t, c in enumerate(own.tolist())])
            yield table({"node": batch.column(0), "n": batch.column(1), "data": batch.column(3), "codes": codes, "keys": keys}, arrow)

    return nodes.select("node", "n", "label", "data").mapInArrow(
        run, "node long, n long, data binary, codes binary, keys array<long>")


def _near(x: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows have a cosine of at least the threshold."""
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    cosine = unit @ unit.T
    near = cosine >= threshold
    for i, j in np.argwhere(np.abs(cosine - threshold) < 1e-12):  # rounding decides: as the formula is written
        near[i, j] = (x[i] @ x[j]) / (math.sqrt(x[i] @ x[i]) * math.sqrt(x[j] @ x[j])) >= threshold
    np.fill_diagonal(near, False)
    return near


def _group_links(threshold: float, kind: str):
    def work(rows: pa.Table, starts: list):
        node, n, at, part, lo, hi = (rows.column(c).to_numpy() for c in ("node", "n", "t", "part", "lo", "hi"))
        out = {"node": [], "links": [], "root": []}
        for s, e in zip(starts, [*starts[1:], len(rows)]):
            if e - s < 2:
                continue
            x = np.frombuffer(b"".join(rows.column("data").slice(s, e - s).to_pylist()), kind).reshape(e - s, -1).astype(np.float64)
            codes = np.frombuffer(b"".join(rows.column("codes").slice(s, e - s).to_pylist()), np.uint32).reshape(e - s, -1)
            near = _near(x, threshold)
            if lo[s] != hi[s]:
                near &= part[s:e, None] != part[None, s:e]
            if not near.any():
                continue
            new = near.copy()
            for t in range(int(at[s])):  # counted in an earlier table already
                new &= codes[:, t, None] != codes[None, :, t]
            links = new @ n[s:e]
            root = np.full(e - s, -1)
            for i in np.flatnonzero(near.any(axis=1)):
                front = [i] if root[i] < 0 else []
                while len(front):
                    root[front] = i
                    front = np.flatnonzero(near[front].any(axis=0) & (root < 0))
            own = np.flatnonzero(root >= 0)
            out["node"].append(node[s:e][own])
            out["links"].append(links[own])
            out["root"].append(node[s:e][root[own]])
        if out["node"]:
            yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()})

    return work


def near_vectors(rows: DataFrame, threshold: float = 0.93, recall: float = 0.999, bucket: int = 512, seed: int = 7,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept: one row per row of ``rows``."""
    # Single-precision components travel as such; products are in doubles.
    kind = "<f4" if rows.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    signed = materialise(signatures(rows, id_col, vector_col, label_col, kind), "vec-signed")
    classes = materialise(signed.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "vec-classes")
    nodes = materialise(signed.join(classes.select("digest", F.col("node").alias("id"), "n"), ["digest", "id"])
                        .dropDuplicates(["digest"]).select(F.col("id").alias("node"), "n", "label", "data"), "vec-nodes")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    signs, tables = plan(largest, threshold, recall, bucket)
    hashed = materialise(_signs(nodes, signs, tables, seed, kind), "vec-hashed")
    sizes = hashed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = materialise(sizes.where(F.col("n") > BLOCK), "vec-large")
    spread = hashed.select("node", "n", "data", "codes", F.posexplode("keys").alias("t", "key"))
    dealt = in_blocks(spread, large, "key", "node", BLOCK)
    found = materialise(map_groups(dealt, ["key", "lo", "hi"], "node", _group_links(threshold, kind), "node long, links long, root long"), "vec-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = materialise(classes.join(links, "node", "left").join(components, "node", "left")
                        .where("n > 1 or links is not null")
                        .select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                                F.coalesce("component", "node").alias("component")), "vec-named")
    out = signed.select("id", "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))
