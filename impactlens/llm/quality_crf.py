"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its potentials come from binned surface features
(symbols, capitals, digits, repeated words ...) of the line itself and of the
line before and after it, and from the transition between neighbouring labels.
Forward-backward marginals, weighted by line length, average to the document's
share of good text; a logistic curve fitted on the training documents turns
that share into the score.

Training takes a bounded sample: at most ``max_docs`` labelled documents
(smallest hash of the id first) and ``max_lines`` lines of each, so at most
max_docs * max_lines short feature rows reach the driver. Only documents whose
crc32(id as text) mod 5 is not 0 are learnt from; a line's label is its
document's. Scoring reads every line of every text.

Defined results: null text is empty; a text without any visible character
scores 0; without labelled documents of both kinds every other text scores the
share of good ones (0.5 without any). Repeated rows score alike, a repeated
label row counts once more. Empty tables give no rows. Only the text is an
input of the score; other columns are ignored (``keep_good`` returns them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _id_type
from .common import byte_sizes, slices, table, texts_of

CHUNK_BYTES = 2 << 20
THRESHOLD = 0.3
#: Upper bin edges of each feature of a line.
EDGES = {
    "symbols": (0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "capitals": (0.0, 0.03, 0.06, 0.1, 0.2, 0.5, 0.8),
    "digits": (0.0, 0.02, 0.1, 0.3),
    "pipes": (0.0, 0.01, 0.03, 0.06),
    "exclaims": (0.0, 0.01, 0.03, 0.08),
    "stops": (0.0, 0.01, 0.02, 0.04, 0.08),
    "words": (0, 1, 3, 6, 12, 25, 50, 100, 200),
    "distinct": (0.2, 0.4, 0.6, 0.8, 0.9, 0.97),
    "word_length": (2, 3, 4, 5, 6, 8, 12, 20),
    "end": (0, 1),
    "start": (0, 1),
    "seen": (0,),
}
BINS = max(map(len, EDGES.values())) + 1
WIDTH = len(EDGES)
#: Weights of the line, of the one before and of the one after it; the last
#: bin of a neighbour's feature says that there is none.
SLOTS = 3 * WIDTH * (BINS + 1)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in '.?!"\')']] = True
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _STOP)
_SYMBOL[[ord(c) for c in "!|'-\"()?"]] = False
_SYMBOL[:32] = False


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of every line, visible bytes of every line, lines of each text)."""
    raw = "\n".join(texts).encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate([[0], breaks + 1])
    stop = np.concatenate([breaks, [len(data)]])
    size = stop - start

    def count(mask):
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (total[stop] - total[start]).astype(np.float64)

    space = _SPACE[data]
    visible = size - count(space)
    first = ~space
    first[1:] &= space[:-1]
    words = count(first)
    whole, letters = np.maximum(visible, 1), np.maximum(count(_LETTER[data]), 1)
    distinct, seen = np.ones(len(start)), np.zeros(len(start))
    lines, at = raw.split(b"\n"), 0
    counts = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    for n in counts.tolist():
        known = set()
        for i in range(at, at + n):
            line = lines[i]
            if line:
                seen[i] = line in known
                known.add(line)
                found = line.split()
                distinct[i] = len(set(found)) / max(1, len(found))
        at += n
    edge = lambda i, t: np.where(size > 0, t[data[np.clip(i, 0, max(0, len(data) - 1))]] if len(data) else False, False)
    value = {
        "symbols": count(_SYMBOL[data]) / whole, "capitals": count(_UPPER[data]) / letters,
        "digits": count(_DIGIT[data]) / whole, "pipes": count(data == 124) / whole,
        "exclaims": count(data == 33) / whole, "stops": count(_STOP[data]) / whole,
        "words": words, "distinct": distinct, "word_length": visible / np.maximum(words, 1),
        "end": edge(stop - 1, _END), "start": edge(start, _UPPER) + 2.0 * ~edge(start, _LETTER), "seen": seen,
    }
    bins = np.stack([np.searchsorted(EDGES[k], value[k], side="left") for k in EDGES], axis=1)
    return bins.astype(np.uint8), visible.astype(np.int64), counts


def slots(bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weight indices of every line: its own, its predecessor's, its successor's."""
    none = np.full((1, WIDTH), BINS, np.int64)
    own = bins.astype(np.int64)
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    ends = np.cumsum(counts)
    before[ends - counts] = BINS
    after[ends - 1] = BINS
    column = np.arange(WIDTH) * (BINS + 1)
    step = WIDTH * (BINS + 1)
    return np.concatenate([own + column, before + column + step, after + column + 2 * step], axis=1)


def forward_backward(s: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the label good, and expected transitions summed over all
    chains. ``s``: log potential of good against bad; all chains advance
    together, longest first."""
    order = np.argsort(-counts, kind="stable")
    begin, length = (np.cumsum(counts) - counts)[order], counts[order]
    steps = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(steps), side="left")
    a, b = np.zeros((len(s), 2)), np.zeros((len(s), 2))
    a[:, 1] = s
    for t in range(1, steps):
        at = begin[:live[t]] + t
        before = a[at - 1]
        a[at, 0] = np.logaddexp(before[:, 0] + trans[0, 0], before[:, 1] + trans[1, 0])
        a[at, 1] += np.logaddexp(before[:, 0] + trans[0, 1], before[:, 1] + trans[1, 1])
    for t in range(steps - 2, -1, -1):
        at = begin[:live[t + 1]] + t
        good = s[at + 1] + b[at + 1, 1]
        b[at, 0] = np.logaddexp(trans[0, 0] + b[at + 1, 0], trans[0, 1] + good)
        b[at, 1] = np.logaddexp(trans[1, 0] + b[at + 1, 0], trans[1, 1] + good)
    both = a + b
    marginal = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    pair = np.zeros((2, 2))
    joins = np.ones(len(s), bool)
    if len(s):
        joins[np.cumsum(counts) - 1] = False
    i = np.flatnonzero(joins)
    if len(i):
        z = np.logaddexp(both[i, 0], both[i, 1])
        for y in (0, 1):
            for x in (0, 1):
                pair[y, x] = np.exp(a[i, y] + trans[y, x] + x * s[i + 1] + b[i + 1, x] - z).sum()
    return marginal, pair


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    base: float

    def shares(self, bins, visible, counts) -> np.ndarray:
        """Length-weighted mean marginal of each text; nan for an empty one."""
        good, _ = forward_backward(self.weights[slots(bins, counts)].sum(axis=1), self.trans, counts)
        at = np.cumsum(counts) - counts
        total = np.add.reduceat(visible, at).astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.add.reduceat(good * visible, at) / total

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        share = self.shares(*line_features(texts))
        score = 1 / (1 + np.exp(-np.clip(self.base + self.slope * _logit(share), -30, 30)))
        return np.where(np.isnan(share), 0.0, score)


def _logit(share):
    x = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log(x / (1 - x))


def train(bins, visible, counts, labels, steps: int = 120, rate: float = 0.15, penalty: float = 1e-3) -> Model:
    """Maximum likelihood by Adam; then the curve from share to score."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(SLOTS), np.zeros((2, 2)), 0.0, float(_logit(share)))
    at, y = slots(bins, counts), np.repeat(labels, counts)
    joins = counts - 1
    seen = np.array([[((1 - labels) * joins).sum(), 0.0], [0.0, (labels * joins).sum()]])
    w, trans = np.zeros(SLOTS), np.zeros((2, 2))
    m1, m2 = np.zeros(SLOTS + 4), np.zeros(SLOTS + 4)
    flat = at.ravel()
    for k in range(1, steps + 1):
        good, pair = forward_backward(w[at].sum(axis=1), trans, counts)
        slope = np.bincount(flat, np.repeat(good - y, at.shape[1]), SLOTS) / len(y) + penalty * w
        slope = np.concatenate([slope, ((pair - seen) / len(y) + penalty * trans).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.99 * m2 + 0.01 * slope ** 2
        move = rate * (m1 / (1 - 0.9 ** k)) / (np.sqrt(m2 / (1 - 0.99 ** k)) + 1e-8)
        w -= move[:SLOTS]
        trans -= move[SLOTS:].reshape(2, 2)
    model = Model(w, trans, 1.0, 0.0)
    x = _logit(np.nan_to_num(model.shares(bins, visible, counts), nan=0.5))
    slope, base = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(base + slope * x, -30, 30)))
        g = np.array([((p - labels) * x).sum() + 0.1 * (slope - 1), (p - labels).sum() + 0.1 * base])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        slope, base = max(0.05, slope - float(np.clip(step[0], -0.5, 0.5))), base - float(np.clip(step[1], -0.5, 0.5))
    return Model(w, trans, slope, base)


def _remainder(column: str):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 2500, max_lines: int = 300, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from the labelled documents; see the module's text for the bounds."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    own = own.where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (_remainder("_id") != 0))
    picked = own.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_docs)
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(
        F.broadcast(picked), F.col("_key") == F.col("_id")).select("_text", "_y", "_id")
    arrow = pa.schema([("id", pa.string()), ("y", pa.int32()), ("bins", pa.binary()), ("visible", pa.binary())])

    def run(batches):
        for batch in batches:
            for text, y, key in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                bins, visible, _ = line_features([text])
                yield table({"id": [str(key)], "y": [y], "bins": [bins[:max_lines].tobytes()],
                             "visible": [visible[:max_lines].tobytes()]}, arrow)

    # More rows than max_docs only where ids repeat; which of them is not left to chance.
    made = rows.mapInArrow(run, "id string, y int, bins binary, visible binary")
    got = sorted(made.orderBy("id", "y", "bins", "visible").limit(2 * max_docs).collect())
    bins = np.frombuffer(b"".join(r.bins for r in got), np.uint8).reshape(-1, WIDTH)
    visible = np.frombuffer(b"".join(r.visible for r in got), np.int64)
    return train(bins, visible, np.array([len(r.visible) // 8 for r in got], dtype=np.int64), [r.y for r in got])


def _per_batch(model, batches, text_at: int):
    for batch in batches:
        for a, b in slices(byte_sizes(batch.column(text_at)), CHUNK_BYTES):
            part = batch.slice(a, b - a)
            yield part, model.scores(texts_of(part.column(text_at)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted."""
    sql, kind = _id_type(docs, id_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.schema([(id_col, kind), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for part, found in _per_batch(sent.value, batches, 1):
            yield table({id_col: part.column(0), "held_out": part.column(2), "score": found,
                         "predicted": (found >= threshold).astype(np.int32)}, arrow)

    return docs.select(id_col, text_col, (_remainder(id_col) == 0).alias("_held")).mapInArrow(
        run, f"`{id_col}` {sql}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores the threshold."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for part, found in _per_batch(sent.value, batches, at):
            yield part.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)
