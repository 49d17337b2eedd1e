"""Chat formatting by schema fingerprint.

A record is a JSON object in any of several layouts (prompt and response,
instruction and output, message lists ...). Its fingerprint is a hash of the
sorted set of its nested field paths (list items are ``[]``). The fingerprint
of those paths that any layout knows selects a declarative mapping, which turns
the record into canonical turns (role, text); further fields are left out.
Adding a layout means adding a row to :data:`LAYOUTS`. The text of a message
may be a list of parts: the texts of the parts that have one, joined.

The template writes each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside
roles and texts every ``<``, backslashes, ``|`` gets one more backslash, so no
control string can occur there; reading back takes it off again. Roles also
have backslash and line feed escaped. The loss mask covers the texts of the
training role. Formatting is turn by turn, so a long conversation is formatted
in records of bounded size (:func:`assemble`), whose outputs follow one another;
:func:`digest_conversations` walks them in order and holds one at a time.

Defined results: null text or role is empty; a record that is null, no JSON
object, or in no known layout has null turns and output and its fingerprint;
an empty list of messages gives zero turns and an empty output; half a
surrogate pair becomes U+FFFD; a record nested too deep is no JSON object; a
formatted text that :func:`render` did not write reads back as nulls; repeated rows
give repeated rows; columns other than the named ones are ignored. Rows of a
conversation are ordered by (turn, role, text), nulls first; each row without
conv_id is a conversation of its own.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import _id_type
from .common import byte_sizes, slices, table

START, END = "<|im_start|>", "<|im_end|>"
#: Text of one record of a conversation.
RECORD_BYTES = 4 << 20

#: Names that layouts which say who speaks (not in which role)
#: give the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``fields``: (path, role) of single texts, in the order of the turns; a
    path ending in ``?`` may be absent. Several fields of one role in a row
    join to one turn, ``\\n\\n`` between. ``items``: path of a list, and the
    names of its items' role and text."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None


#: The layouts in use by public chat data sets.
LAYOUTS = (
    Layout("messages", items=("messages", "role", "content")),
    Layout("conversations", items=("conversations", "from", "value")),
    Layout("dialogue", items=("dialogue", "speaker", "text")),
    Layout("prompt-response", (("system?", "system"), ("prompt", "user"), ("response", "assistant"))),
    Layout("prompt-completion", (("system?", "system"), ("prompt", "user"), ("completion", "assistant"))),
    Layout("question-answer", (("context?", "user"), ("question", "user"), ("answer", "assistant"))),
    Layout("instruction", (("system?", "system"), ("instruction", "user"), ("input?", "user"), ("output", "assistant"))),
    Layout("nested", (("data.system?", "system"), ("data.user", "user"), ("data.assistant", "assistant"))),
)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint_of(found: set[str]) -> str:
    return hashlib.sha1("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _choices(layout: Layout) -> list[set[str]]:
    """The sets of paths of a layout's records, with every choice of the
    optional fields and of messages that are texts, parts, or both."""
    if layout.items:
        at, role, text = layout.items
        said = [f"{at}[].{text}{kind}" for kind in ("", "[].text", "[]")]
        return [{f"{at}[]"}] + [{f"{at}[].{role}", *some} for n in (1, 2, 3) for some in itertools.combinations(said, n)]
    optional = [p for p, _ in layout.fields if p.endswith("?")]
    absent = itertools.product((False, True), repeat=len(optional))
    gone = ({p for p, a in zip(optional, choice) if a} for choice in absent)
    return [{p.rstrip("?") for p, _ in layout.fields if p not in g} for g in gone]


@functools.lru_cache
def known() -> tuple[dict[str, Layout], frozenset[str]]:
    """Fingerprint to layout, and the paths that any layout knows."""
    found = [(paths_of, layout) for layout in LAYOUTS for paths_of in _choices(layout)]
    return {fingerprint_of(p): layout for p, layout in found}, frozenset().union(*(p for p, _ in found))


_HALF = re.compile("[\ud800-\udfff]")


def _text(value) -> str:
    if isinstance(value, list):
        parts = [p if isinstance(p, str) else p.get("text") for p in value if isinstance(p, (str, dict))]
        value = "".join(map(_text, parts))
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return _HALF.sub("\ufffd", text)


def canonical(record: str | None) -> tuple[str | None, str | None, list[tuple[str, str]] | None]:
    """(fingerprint, layout name, turns) of a JSON record."""
    try:
        value = json.loads(record)
        if not isinstance(value, dict):
            return None, None, None
        found = paths(value)
        key = fingerprint_of(found)
    except (TypeError, ValueError, RecursionError):
        return None, None, None
    layouts, any_layouts = known()
    if not (layout := layouts.get(fingerprint_of(found & any_layouts))):
        return key, None, None
    if layout.items:
        at, role, text = layout.items
        names = {} if role == "role" else ROLES
        messages = [m for m in value[at] if isinstance(m, dict)]
        turns = [(names.get(r := _text(m.get(role)), r), _text(m.get(text))) for m in messages]
        return key, layout.name, turns
    turns = []
    for path, role in layout.fields:
        step = value
        for name in path.rstrip("?").split("."):
            step = step.get(name) if isinstance(step, dict) else None
        if path.endswith("?") and step in (None, ""):
            continue
        if turns and turns[-1][0] == role:
            turns[-1] = (role, f"{turns[-1][1]}\n\n{_text(step)}")
        else:
            turns.append((role, _text(step)))
    return key, layout.name, turns


_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _role_in(text: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text))


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The formatted text and the spans (code points) of its loss mask."""
    out, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = f"{START}{_role_out(role)}\n", escape(text)
        if role == trained:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """Canonical turns of a formatted text; ValueError if it is none."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        turns.append((_role_in(formatted[at + len(START):line]), unescape(formatted[line + 1:end])))
        at = end + len(END) + 1
    return turns


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """id, fingerprint, layout, formatted, loss_starts, loss_ends, and the
    columns to ``keep``."""
    spans = pa.list_(pa.int32())
    kept = {c: _id_type(records, c) for c in (id_col, *keep)}
    made_here = [("fingerprint", pa.string()), ("layout", pa.string()), ("formatted", pa.string()),
                 ("loss_starts", spans), ("loss_ends", spans)]
    arrow = pa.schema([*((c, kind) for c, (_, kind) in kept.items()), *made_here])

    def run(batches):
        for batch in batches:
            for a, b in slices(byte_sizes(batch.column(0)), RECORD_BYTES):
                part = batch.slice(a, b - a)
                got = [canonical(r) for r in part.column(0).to_pylist()]
                made = [(None, None, None) if g[2] is None else render(g[2]) for g in got]
                yield table({c: part.column(1 + i) for i, c in enumerate(kept)} | {
                    "fingerprint": [g[0] for g in got], "layout": [g[1] for g in got], "formatted": [m[0] for m in made],
                    "loss_starts": [m[1] for m in made], "loss_ends": [m[2] for m in made]}, arrow)

    own = ", ".join(f"`{c}` {sql}" for c, (sql, _) in kept.items())
    return records.select(F.col(record_col).cast("string").alias("_record"), *kept).mapInArrow(
        run, f"{own}, fingerprint string, layout string, formatted string, loss_starts array<int>, loss_ends array<int>")


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what the formatted texts and their loss masks hold: id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, layout."""
    sql, kind = _id_type(formatted, id_col)
    arrow = pa.schema([(id_col, kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                       ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                       ("formatted_chars", pa.int64()), ("layout", pa.string())])

    def one(text, starts, ends):
        try:
            turns = parse(text)
        except (ValueError, AttributeError, TypeError):
            return None, None, None, None, None
        said = "".join(f"{role}\n{body}\n" for role, body in turns)
        loss = "".join(unescape(text[s:e]) for s, e in zip(starts or (), ends or ()))
        return (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                hashlib.sha256(loss.encode()).hexdigest(), len(text))

    def run(batches):
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in (1, 2, 3)]
            got = [one(*x) for x in zip(*cols)]
            yield table({id_col: batch.column(0), "layout": batch.column(4)} | {
                f.name: [g[i] for g in got] for i, f in enumerate(list(arrow)[1:6])}, arrow)

    return formatted.select(id_col, "formatted", "loss_starts", "loss_ends", "layout").mapInArrow(
        run, f"`{id_col}` {sql}, n_turns long, turns_sha256 string, loss_chars long, "
             "loss_sha256 string, formatted_chars long, layout string")


def assemble(rows: DataFrame, id_col: str = "conv_id", record_bytes: int = RECORD_BYTES) -> DataFrame:
    """JSON records of (conv_id, turn, role, text) rows: id, lone, part, record.
    A conversation is cut into parts of ``record_bytes`` of text at most (or one
    turn); nearly all have one. A single user-assistant exchange becomes prompt
    and response, one with a system turn before it instruction and output, all
    others a message list. Rows without an id have a number in ``lone``.

    The turns of a conversation are sorted with spilling and cut as they come:
    nothing larger than a part is ever held."""
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    turns = rows.select(F.col(id_col), alone.alias("lone"), "turn", F.col("role").cast("string").alias("role"),
                        F.col("text").cast("string").alias("text"))
    before = (Window.partitionBy(id_col, "lone").orderBy("turn", "role", "text")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("role"), F.lit(0)) + F.lit(64)
    cut = turns.withColumn("part", F.floor((F.sum(size.cast("long")).over(before) - 1) / F.lit(record_bytes)))
    parts = cut.groupBy(id_col, "lone", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = F.transform("t", lambda x: F.struct(F.coalesce(x.role, F.lit("")).alias("role"),
                                               F.coalesce(x.text, F.lit("")).alias("content")))
    parts = parts.select(id_col, "lone", "part", said.alias("t"))
    roles = F.concat_ws(",", F.transform(F.slice("t", 1, 4), lambda x: x.role))
    at = lambda i: F.col("t")[i].content
    record = (F.when((F.size("t") == 2) & (roles == "user,assistant"),
                     F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
              .when((F.size("t") == 3) & (roles == "system,user,assistant") & (at(0) != ""),
                    F.to_json(F.struct(at(0).alias("system"), at(1).alias("instruction"), at(2).alias("output"))))
              .otherwise(F.to_json(F.struct(F.col("t").alias("messages")))))
    return parts.select(id_col, "lone", "part", record.alias("record"))


def digest_conversations(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of whole conversations from their formatted parts (see
    :func:`assemble`), read back in order: id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars; nulls where a part has no output."""
    sql, kind = _id_type(formatted, id_col)
    arrow = pa.schema([(id_col, kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                       ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    class Digests:
        def __init__(self, key):
            self.key, self.good, self.turns, self.loss, self.chars = key, True, 0, 0, 0
            self.said_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

        def add(self, text, starts, ends):
            try:
                turns = parse(text)
            except (ValueError, AttributeError, TypeError):
                self.good = False
                return
            for role, body in turns:
                self.said_sha.update(f"{role}\n{body}\n".encode())
            for s, e in zip(starts or (), ends or ()):
                own = unescape(text[s:e])
                self.loss_sha.update(own.encode())
                self.loss += len(own)
            self.turns, self.chars = self.turns + len(turns), self.chars + len(text)

        def row(self):
            if not self.good:
                return self.key[0], None, None, None, None, None
            return (self.key[0], self.turns, self.said_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars)

    def run(batches):
        rows, held = [], None
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(len(batch)):
                key = columns[0][i].as_py(), columns[1][i].as_py()
                if held is None or held.key != key:
                    if held:
                        rows.append(held.row())
                    held = Digests(key)
                held.add(*(c[i].as_py() for c in columns[2:]))
            if rows:
                yield table({f.name: c for f, c in zip(arrow, zip(*rows))}, arrow)
                rows = []
        if held:
            yield table({f.name: c for f, c in zip(arrow, zip(held.row()))}, arrow)

    ordered = formatted.repartition(id_col, "lone").sortWithinPartitions(id_col, "lone", "part")
    return ordered.select(id_col, "lone", "formatted", "loss_starts", "loss_ends").mapInArrow(
        run, f"`{id_col}` {sql}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversations(rows: DataFrame, id_col: str = "conv_id", record_bytes: int = RECORD_BYTES) -> DataFrame:
    """Formats (conv_id, turn, role, text) rows and reads them back."""
    parts = assemble(rows, id_col, record_bytes)
    return digest_conversations(format_records(parts, id_col, keep=("lone", "part")), id_col)
