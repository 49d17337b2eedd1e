"""Periodic runs: stretches of consecutive words that repeat with a period.

A run is a stretch with smallest period q (words q apart are the same) that is
at least ``shortest`` words and ``repeats`` periods long and that neither
neighbouring word extends.

Method: block convolution. At every dyadic scale B the words are cut into
aligned blocks; a run whose period is at least B and less than 2B holds a whole
block in its first two periods, and that block occurs again one period later.
For all blocks at once a number theoretic transform gives the sum of squared
differences between the block and every place of the following window; where
it is zero the block occurs, and the distance is a candidate period. Each
candidate is compared word by word and extended both ways to the whole stretch.

The transform works modulo 65537 on words folded to codes so small that no sum
of squares reaches the modulus: its sums are exact integers. A transform of M
points is two products with matrices of up to 64 x 64 (in float64, where all
sums stay below 2^53 and therefore exact). Blocks have at most ``WIDEST``
words; for longer periods the block is the first part of its scale's block and
the window is covered in several steps, so no period is too long. The smallest
scale has blocks of 8 words and covers the periods below 16: with 24 words or
more, a run of a period below 8 holds such a block too.

Defined results: a null or empty text has no words and no run; a text of any
length is taken whole; repeated rows give repeated results, an empty table an
empty one; other columns stay unless they have a name of the result. Work and
memory of a task are bounded by one batch of texts, or one text if it is longer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_sizes, slices, table, texts_of

PRIME = 65537
ROOT = 3
LEAST = 8
WIDEST = 2048
TEXT_BYTES = 1 << 20
POINTS = 1 << 17

Run = tuple[int, int, int]
_transforms: dict[int, "_Transform"] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` brought near the modulus in place: congruent, within two of it."""
    t = x * (1.0 / PRIME)
    np.floor(t, out=t)
    t *= PRIME
    x -= t
    return x


class _Transform:
    """Transforms of M points as (rows, M1, M2) grids; spectra lie by (k1, k2)
    with k = k1 + M1 * k2, which the inverse expects."""

    def __init__(self, m: int) -> None:
        self.m = m
        self.m1 = 1 << (m.bit_length() // 2)
        self.m2 = m // self.m1
        w = pow(ROOT, (PRIME - 1) // m, PRIME)

        def powers(step: int, rows: int, cols: int) -> np.ndarray:
            table = [1]
            for _ in range(m - 1):
                table.append(table[-1] * w % PRIME)
            at = np.outer(np.arange(rows), np.arange(cols)) * step % m
            return np.array(table, np.float64)[at]

        def inverse(step: int, rows: int, cols: int) -> np.ndarray:
            return powers(m - step % m, rows, cols)

        self.first, self.second = powers(self.m2, self.m1, self.m1), powers(self.m1, self.m2, self.m2)
        self.twist = powers(1, self.m1, self.m2)
        unit = pow(m, -1, PRIME)
        self.back_first = inverse(self.m2, self.m1, self.m1) * unit % PRIME
        self.back_second, self.back_twist = inverse(self.m1, self.m2, self.m2), inverse(1, self.m1, self.m2)
        k = np.arange(self.m1)[:, None] + self.m1 * np.arange(self.m2)[None, :]
        #: Moves a row by half its points, and reads it backwards.
        self.half = np.where(k % 2, -1.0, 1.0)
        other = (-k) % m
        self.mirror = ((other % self.m1) * self.m2 + other // self.m1).ravel()

    def forward(self, rows: np.ndarray) -> np.ndarray:
        x = _reduced(np.matmul(self.first, rows.reshape(-1, self.m1, self.m2)))
        x *= self.twist
        return _reduced(np.matmul(_reduced(x), self.second))

    def inverse(self, spectra: np.ndarray) -> np.ndarray:
        x = _reduced(np.matmul(spectra, self.back_second))
        x *= self.back_twist
        return np.matmul(self.back_first, _reduced(x)).reshape(len(spectra), self.m)


def _transform(m: int) -> _Transform:
    if m not in _transforms:
        _transforms[m] = _Transform(m)
    return _transforms[m]


def occurrences(ids: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(place, distance) of the aligned blocks of ``ids`` at this scale that
    occur again ``scale`` to 2 * ``scale`` - 1 words later (at the smallest
    scale: 1 word later or more), and the length of a block. Blocks of equal
    codes; those of equal words are among them."""
    width = min(scale, WIDEST)
    steps, n = scale // width, len(ids)
    most = int((65536 / width) ** 0.5)
    code = ((ids * 2654435761 & 0xFFFFFFFF) >> 7) % (most + 1)
    offsets = range(0 if scale == LEAST else steps, 2 * steps)
    blocks = -(-n // width)
    x = np.zeros((blocks + 2 * steps + 2) * width)
    x[:n] = code
    squares = np.concatenate([[0.0], np.cumsum(x * x)])
    norm = squares[width:] - squares[:-width]
    t = _transform(2 * width)
    grid = x.reshape(-1, width)
    spectra = np.empty((len(grid), t.m1, t.m2), np.int32)
    part = max(1, POINTS // t.m)
    for a in range(0, len(grid), part):
        own = np.zeros((min(part, len(grid) - a), t.m))
        own[:, :width] = grid[a:a + part]
        spectra[a:a + part] = t.forward(own)
    places, distances = [], []
    anchors = np.arange(0, blocks, steps)
    for a in range(0, len(anchors), part):
        c = anchors[a:a + part]
        block = spectra[c].reshape(len(c), -1)[:, t.mirror].reshape(-1, t.m1, t.m2).astype(np.float64)
        for o in offsets:
            product = spectra[c + o + 1] * t.half
            product += spectra[c + o]
            product *= block
            shared = t.inverse(_reduced(product))[:, :width]
            at = (c * width)[:, None] + (o * width + np.arange(width))[None, :]
            shared *= -2.0
            shared += norm[at]
            shared += norm[c * width][:, None]
            _reduced(shared)
            row, shift = np.nonzero((shared == 0) | (shared == PRIME) | (shared == -PRIME))
            places.append(c[row] * width)
            distances.append(o * width + shift)
    s, d = np.concatenate(places or [np.zeros(0, int)]), np.concatenate(distances or [np.zeros(0, int)])
    real = (d > 0) & (s + d + width <= n)
    return s[real], d[real], width


def _extend(ids: np.ndarray, s: int, e: int, d: int) -> tuple[int, int]:
    """The whole stretch of period d around the words s to e + d - 1."""
    n, step, lo = len(ids), 64, s
    while lo > 0:
        a = max(0, lo - step)
        bad = np.flatnonzero(ids[a:lo] != ids[a + d:lo + d])
        if len(bad):
            lo = a + int(bad[-1]) + 1
            break
        lo, step = a, step * 2
    step, hi = 64, e
    while hi + d < n:
        z = min(n - d, hi + step)
        bad = np.flatnonzero(ids[hi:z] != ids[hi + d:z + d])
        if len(bad):
            hi += int(bad[0])
            break
        hi, step = z, step * 2
    return lo, hi + d


def _runs_at(ids: np.ndarray, s: np.ndarray, d: np.ndarray, width: int, found: list, shortest: int, repeats: int) -> None:
    """Adds the runs that the candidates (sorted by d, then s) of one text
    seed. A candidate inside a run whose period divides its distance belongs
    to no other run: its stretch has the smaller period too."""

    def outside(s, d, run):
        return ~((d % run[2] == 0) & (s >= run[0]) & (s + d + width <= run[1]))

    for run in found:
        keep = outside(s, d, run)
        s, d = s[keep], d[keep]
    i = 0
    while i < len(s):
        a, q = int(s[i]), int(d[i])
        if not np.array_equal(ids[a:a + width], ids[a + q:a + q + width]):
            i += 1
            continue
        lo, hi = _extend(ids, a, a + width, q)
        if hi - lo >= max(shortest, repeats * q):
            run = (lo, hi, q)
            found.append(run)
            keep = outside(s[i:], d[i:], run)
            s, d, i = s[i:][keep], d[i:][keep], 0
        else:  # every candidate of this stretch has been answered
            i += 1
            while i < len(s) and d[i] == q and s[i] + q + width <= hi:
                i += 1


def find_runs(texts: list[np.ndarray], shortest: int = 24, repeats: int = 3) -> list[list[Run]]:
    """(start, length, period) of the runs of each text, given as arrays of
    word numbers (at least 0), by start, then period."""
    if shortest < 3 * LEAST or repeats < 3:
        raise ValueError("runs are at least 24 words and three periods long")
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    ends = np.cumsum(sizes + 1)  # each text is followed by a word of its own
    out: list[list[Run]] = [[] for _ in texts]
    if not len(texts) or sizes[0] < shortest:
        return out
    ids = np.empty(int(ends[-1]), np.int64)
    top = max(int(t.max()) for t in texts if len(t)) + 1
    for rank, i in enumerate(order):
        ids[ends[rank] - 1 - sizes[rank]:ends[rank] - 1] = texts[i]
        ids[ends[rank] - 1] = top + rank
    begins = ends - 1 - sizes
    found: dict[int, list] = {}
    scale = LEAST
    while repeats * scale <= sizes[0]:
        long_enough = int(np.searchsorted(-sizes, -max(shortest, repeats * scale), "right"))
        s, d, width = occurrences(ids[:ends[long_enough - 1]], scale)
        rank = np.searchsorted(ends, s, "right")
        inside = s + d + width <= ends[rank] - 1
        s, d, rank = s[inside], d[inside], rank[inside]
        by = np.lexsort((s, d, rank))
        s, d, rank = s[by], d[by], rank[by]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(rank)]):
            if b > a:
                r = int(rank[a])
                own = ids[begins[r]:ends[r] - 1]
                _runs_at(own, s[a:b] - begins[r], d[a:b], width, found.setdefault(r, []), shortest, repeats)
        scale *= 2
    for r, runs in found.items():
        out[order[r]] = sorted((lo, hi - lo, q) for lo, hi, q in runs)
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Numbers of the words that no run holds after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return np.flatnonzero(keep)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shortest: int = 24, repeats: int = 3,
                  rewrite: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """``df``'s id with n_words, the runs of its text and the text without their
    repetitions (words joined by one space). Words end at ASCII white space.
    ``rewrite(id, n)`` may name a word and a period (a, p): the words from a on
    are then replaced by the p words there, over and over, before the search."""
    schema = pa.schema([("n_words", pa.int64()), ("runs", _RUN_TYPE), ("collapsed", pa.string())])

    def run(batches):
        for batch in batches:
            for a, b in slices(byte_sizes(batch.column("text")), TEXT_BYTES):
                part = batch.slice(a, b - a)
                numbers: dict = {}
                words, ids = [], []
                for key, text in zip(part.column("id").to_pylist(), texts_of(part.column("text"))):
                    own = text.encode("utf-8", "replace").split()
                    if rewrite and own and (at := rewrite(key, len(own))):
                        first, p = at
                        own[first:] = [own[first + i % p] for i in range(len(own) - first)]
                    words.append(own)
                    ids.append(np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int64))
                runs = find_runs(ids, shortest, repeats)
                cols = {"n_words": [len(w) for w in words],
                        "runs": [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs],
                        "collapsed": [b" ".join(w if not own else [w[i] for i in kept_words(len(w), own)]).decode()
                                      for w, own in zip(words, runs)]}
                made = table(cols, schema)
                yield pa.RecordBatch.from_arrays([part.column("id"), *made.columns], names=["id", *schema.names])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; the first of equals."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per text of :func:`periodic_runs`: the strongest run, and
    digests of all runs and of the collapsed text."""
    best = found.withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
