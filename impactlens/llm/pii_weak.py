"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always count.
Around them, looser candidates (spoken e-mail addresses, local phone numbers,
national ids, personal names, and pattern matches whose check fails) get votes
of three labelers: the pattern and its check, a gazetteer (domains, networks,
issuers, calling codes, first names) and the words before the candidate. Each
votes yes, no or abstains. Expectation maximisation over the counts of all
vote combinations in the corpus estimates how reliable each labeler is per
kind; its posteriors train a logistic span classifier on votes and surface
features. Candidates it accepts that touch no base span become spans of the
additional kinds.

Only counts of vote and feature combinations reach the driver: at most
len(KINDS) * 27 * 4 * 5 rows, whatever the corpus holds. All patterns run in
linear time. Offsets are code points, ends exclusive.

Defined results: null text is empty (no spans); repeated rows give repeated
rows; an empty table gives no rows and a classifier that knows only its
priors; columns other than the id and the text are ignored (``redact`` returns
all columns; there null text stays null).
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _id_type
from .common import byte_sizes, slices, table, texts_of

BASE = ("email", "ip", "card", "phone")
MORE = ("spoken_email", "local_phone", "national_id", "name")
KINDS = BASE + MORE
CHUNK_BYTES = 4 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPOKEN = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,24}\b")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NAME = re.compile(r"(?<![A-Za-z])[A-Z][a-z]{1,20}(?= ([A-Z][a-z]{1,20})(?![A-Za-z]))")

#: Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov io co de fr es it uk us ca au nl se no ch at be pl eu info".split())
FIRST_NAMES = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth "
    "Barbara Susan Jessica Sarah Karen Hans Peter Klaus Wolfgang Ursula Monika Pierre Jean Marie Jacques Sophie "
    "Camille Carlos Maria Jose Juan Carmen Lucia Miguel Ana Paul Anna Emma Daniel Laura Mark Julia Simon".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46",
                 "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81",
                 "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "351", "352", "353", "358", "420", "421")
_CUES = {
    "email": r"e-?mail|mail|contact|write|correo|courriel|kontakt", "ip": r"\bip\b|host|server|address|client|from",
    "card": r"card|visa|master|amex|credit|pay|karte|carte|tarjeta", "phone": r"phone|tel\b|call|mobile|fax|cell|ruf",
    "spoken_email": r"e-?mail|mail|contact|write", "local_phone": r"phone|tel\b|call|mobile|fax|cell",
    "national_id": r"ssn|social|security|national|tax", "name": r"name|mr\.?|mrs\.?|ms\.?|dr\.?|dear|herr|frau|madame|se[nñ]or",
}
_YES = {k: re.compile(f"(?:{v})", re.I) for k, v in _CUES.items()}
_NO = re.compile(r"version|release|token|hash|sha|isbn|serial|order|section|build|\bv$|[#=\"]\s*$", re.I)


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _emails(text: str):
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if domain and start < at:
            yield "email", start, domain.end(), True
            last = domain.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _matches(text: str):
    """(kind, start, end, check passed) of all matches of the base patterns."""
    yield from _emails(text)
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        yield "card", m.start(), m.end(), 16 <= len(digits) <= 19 and _luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 8 <= sum(c.isdigit() for c in m[0]) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as listed and start."""
    return [(k, s, e) for k, s, e, ok in _matches(text) if ok]


def _gazetteer(kind: str, found: str) -> int:
    if kind == "email":
        return 1 if found.rpartition(".")[2].lower() in TOP_DOMAINS else -1
    if kind == "spoken_email":
        return 1 if re.split(r"[ \])]", found)[-1].lower() in TOP_DOMAINS else -1
    if kind == "ip":
        parts = [int(p[-9:]) for p in found.split(".")]
        return -1 if parts[0] in (0, 127) or max(parts) > 255 else 1
    if kind == "card":
        return 1 if found[0] in "3456" else -1
    if kind == "phone":
        digits = re.sub(r"[^0-9]", "", found)
        return 1 if digits.startswith(CALLING_CODES) else -1
    if kind == "local_phone":
        digits = re.sub(r"[^0-9]", "", found)
        return 1 if digits[0] in "23456789" and digits[3] in "23456789" else -1
    if kind == "national_id":
        return -1 if found[:3] in ("000", "666") or found[0] == "9" or found[4:6] == "00" else 1
    return 1 if found.split(" ")[0] in FIRST_NAMES else -1


def candidates(text: str, base: bool = True) -> list[tuple]:
    """(kind, start, end, pattern of votes and features) of every candidate;
    ``base``: those of the fixed patterns too."""
    found = [(k, s, e, 1 if ok else -1) for k, s, e, ok in _matches(text)] if base else []
    if " dot " in text or "dot)" in text or "dot]" in text:
        found += [("spoken_email", m.start(), m.end(), 0) for m in _SPOKEN.finditer(text)]
    found += [("local_phone", m.start(), m.end(), 0) for m in _LOCAL_PHONE.finditer(text)]
    found += [("national_id", m.start(), m.end(), 0) for m in _NATIONAL.finditer(text)]
    found += [("name", m.start(), m.end(1), 0) for m in _NAME.finditer(text)]
    out = []
    for kind, s, e, vote in found:
        before = text[max(0, s - 32):s]
        context = 1 if _YES[kind].search(before) else -1 if _NO.search(before) else 0
        left = int(s > 0 and text[s - 1].isalnum())
        right = int(e < len(text) and text[e].isalnum())
        out.append((kind, s, e, (kind, vote, _gazetteer(kind, text[s:e]), context, left, right, min(4, (e - s) // 6))))
    return out


@dataclass
class Classifier:
    reliability: dict  # kind -> labeler -> {vote: (P(vote | no), P(vote | yes))}
    prior: dict
    weights: dict

    def probability(self, pattern: tuple) -> float:
        return _sigmoid(sum(self.weights.get(x, 0.0) for x in _inputs(pattern)))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _inputs(pattern: tuple) -> list:
    kind, rule, names, context, left, right, length = pattern
    return ["one", ("kind", kind), ("rule", rule), ("names", names), ("context", context), ("left", left),
            ("right", right), (kind, "length", length)]


def em(counts: dict, rounds: int = 40) -> tuple[dict, dict, dict]:
    """Reliabilities and priors per kind, and the posterior of each pattern."""
    votes = lambda p: p[1:4]
    post = {p: _sigmoid(1.5 * sum(votes(p)) - 0.5) for p in counts}
    reliability, prior = {}, {}
    for _ in range(rounds):
        for kind in KINDS:
            own = {p: n for p, n in counts.items() if p[0] == kind}
            yes = 1 + sum(n * post[p] for p, n in own.items())
            no = 2 + sum(n * (1 - post[p]) for p, n in own.items())
            prior[kind] = yes / (yes + no)
            reliability[kind] = []
            for j in range(3):
                seen = {}
                for v in (-1, 0, 1):
                    hits = {p: n for p, n in own.items() if votes(p)[j] == v}
                    # The pseudo-counts say that a labeler is better than chance.
                    seen[v] = ((sum(n * (1 - post[p]) for p, n in hits.items()) + (4, 2, 1)[v + 1]) / (no + 5),
                               (sum(n * post[p] for p, n in hits.items()) + (1, 2, 4)[v + 1]) / (yes + 6))
                reliability[kind].append(seen)
        for p in counts:
            odds = math.log(prior[p[0]] / (1 - prior[p[0]]))
            for j, v in enumerate(votes(p)):
                no, yes = reliability[p[0]][j][v]
                odds += math.log(yes / no)
            post[p] = _sigmoid(odds)
    return reliability, prior, post


def train(counts: dict, steps: int = 300, rate: float = 0.5, penalty: float = 0.002) -> Classifier:
    """EM, then logistic regression on its posteriors (log-damped counts)."""
    reliability, prior, post = em(counts)
    weights: dict = {"one": -1.0, ("rule", 1): 2.0, ("names", 1): 1.6, ("context", 1): 1.6,
                     ("rule", -1): -2.0, ("names", -1): -1.6, ("context", -1): -1.6}
    rows = [(_inputs(p), post[p], math.log1p(n)) for p, n in sorted(counts.items())]
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(steps if rows else 0):
        slope: dict = {}
        for inputs, y, n in rows:
            g = (_sigmoid(sum(weights.get(x, 0.0) for x in inputs)) - y) * n / total
            for x in inputs:
                slope[x] = slope.get(x, 0.0) + g
        for x, g in slope.items():
            weights[x] = weights.get(x, 0.0) - rate * (g + penalty * weights.get(x, 0.0))
    return Classifier(reliability, prior, weights)


def fit(docs: DataFrame, text_col: str = "text") -> Classifier:
    """Counts the vote combinations of all documents and trains on them."""
    fields = "kind string, rule int, names int, context int, `left` int, `right` int, length int"
    arrow = pa.schema([("kind", pa.string()), *((c, pa.int32()) for c in ("rule", "names", "context", "left", "right", "length")),
                       ("n", pa.int64())])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in texts_of(batch.column(0)):
                counts.update(c[3] for c in candidates(t))
        if counts:
            yield table({f.name: [p[i] for p in counts] for i, f in enumerate(list(arrow)[:7])} | {"n": list(counts.values())}, arrow)

    rows = docs.select(text_col).mapInArrow(run, f"{fields}, n long").groupBy(*arrow.names[:7]).agg(F.sum("n").alias("n"))
    return train({tuple(r)[:7]: r.n for r in rows.collect()})


def spans_of(text: str, model: Classifier, threshold: float = 0.5) -> list[tuple[str, int, int]]:
    """All spans: the base ones, then accepted candidates of the other kinds
    that overlap no span before them, by kind as listed and start."""
    base = base_spans(text)
    more, starts, ends = [], [], []  # disjoint runs of what is taken
    for s, e in sorted((s, e) for _, s, e in base):
        if starts and s < ends[-1]:
            ends[-1] = max(e, ends[-1])
        else:
            starts.append(s)
            ends.append(e)
    for kind, s, e, pattern in candidates(text, base=False):
        i = bisect.bisect_left(starts, e)
        if (i == 0 or ends[i - 1] <= s) and model.probability(pattern) >= threshold:
            more.append((kind, s, e))
            starts.insert(i, s)
            ends.insert(i, e)
    return base + sorted(more, key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    sql, kind = _id_type(docs, id_col)
    arrow = pa.schema([(id_col, kind), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for batch in batches:
            found = [spans_of(t, model) for t in texts_of(batch.column(1))]
            own = [[x for x in f if x[0] in BASE] for f in found]
            yield table({id_col: batch.column(0), "spans": [joined(f) for f in found],
                         "base_sha256": [hashlib.sha256(joined(o).encode()).hexdigest() for o in own]}
                        | {f"n_{k}": [sum(x[0] == k for x in o) for o in own] for k in BASE}, arrow)

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {sql}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, model: Classifier) -> str:
    """The text with every span replaced by its kind in brackets; overlapping
    spans become one. Repeats while replacing has made new matches."""
    spans = spans_of(text, model)
    while spans:
        out, at, merged = [], 0, []
        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if merged and s < merged[-1][2]:
                merged[-1][2] = max(e, merged[-1][2])
            else:
                merged.append([kind, s, e])
        for kind, s, e in merged:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
        text = "".join(out) + text[at:]
        spans = base_spans(text)
    return text


def redact(docs: DataFrame, model: Classifier, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with redacted texts; the column of text lengths follows."""
    at = docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for batch in batches:
            for a, b in slices(byte_sizes(batch.column(at)), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                texts = [None if t is None else redacted(t, model) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array(texts, type=part.schema.field(at).type)
                if chars_at is not None:
                    old = part.column(chars_at).to_pylist()
                    columns[chars_at] = pa.array([n if t is None else len(t) for n, t in zip(old, texts)],
                                                 type=part.schema.field(chars_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
