"""Chat formatting: conversations become text segments with loss flags, by a declarative template.

A finite-state machine over roles tells whether the turns come in a valid order. The template says what stands around
each role's text and whether the text is trained on. Control strings of the template inside a text are escaped by a
backslash after their first character, which keeps the text readable and can be undone exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowset.llm.common import checkpointed, small_or_shuffled


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Every `before` and `after` begins with [ or <, has a second character and holds no backslash; each `before` is
    used once; and no control string's end is another one's beginning. That makes turns and escapes unambiguous, and
    other templates are errors.

    Roles without an entry are written between other_before and other_after with the role's name escaped in between.
    transitions: state -> role -> next state; a turn without a transition is out of order and leaves the state as it is.
    """

    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>", "<</SYS>>"),
            "user": Role("[INST]", "[/INST]"),
            "assistant": Role("<s>", "</s>", loss=True),
        }
    )
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        starts = [*(r.before for r in self.roles.values()), *self.other[:2]]
        if len({*starts}) < len(starts) or {*starts} & {*(r.after for r in self.roles.values()), self.other[2]}:
            raise ValueError("What stands before a text must be different for each role and from what stands after")
        for c in self.controls:
            if len(c) < 2 or c[0] not in "[<" or "\\" in c:
                raise ValueError(f"Not a control string: {c!r}")
            for end in (c[k:] for k in range(1, len(c)) if c[k] in "[<"):
                if other := [d for d in self.controls if d.startswith(end) or end.startswith(d)]:
                    raise ValueError(f"{c!r} and {other[0]!r} can be mistaken for each other")

    @property
    def controls(self) -> list[str]:
        return sorted({*self.other, *(x for r in self.roles.values() for x in (r.before, r.after))}, key=lambda x: (-len(x), x))

    def _pattern(self, backslashes: str) -> re.Pattern:
        return re.compile("|".join(f"(?:{re.escape(c[0])}{backslashes}{re.escape(c[1:])})" for c in self.controls))

    def escape(self, text: str) -> str:
        return self._pattern(r"\\*").sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._pattern(r"\\+").sub(lambda m: m[0][0] + m[0][2:], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of one turn, in order."""
        r = self.roles.get(role)
        if r is None:
            return [(self.other[0] + self.escape(role) + self.other[1], False), (self.escape(text), False), (self.other[2], False)]
        return [(r.before, False), (self.escape(text), r.loss), (r.after, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of what segments() wrote."""
        by_start = {r.before: name for name, r in self.roles.items()}
        turns, role, at = [], None, 0
        for m in self._pattern("").finditer(formatted):
            if m[0] in by_start:
                role = by_start[m[0]]
            elif m[0] == self.other[1]:
                role = self.unescape(formatted[at : m.start()])
            elif m[0] != self.other[0]:
                turns.append((role, self.unescape(formatted[at : m.start()])))
            at = m.end()
        return turns


DEFAULT = Template()
#: Turns of one conversation that are formatted together: those whose numbers share this quotient.
CHUNK_TURNS = 1000
START = "start"
TURNS = "conv_id long, chunk long, pos long, turn long, role string, segments array<struct<text:string,loss:boolean>>, in_order boolean"


def _step(template: Template, state: str, role: str) -> tuple[str, bool]:
    """(next state, whether the turn was in order)."""
    nxt = template.transitions.get(state, {}).get(role)
    return (state if nxt is None else nxt), nxt is not None


def _by_chunk(rows: DataFrame, *more: str) -> DataFrame:
    """Chunks whole in a partition, their rows in order; a hot conversation's chunks go to many partitions."""
    return rows.repartition("conv_id", "chunk").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "chunk", F.col("turn").asc_nulls_first(), "role", *more)


def chunk_states(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, chunk, state: the machine's state before each chunk of the conversations that have several.

    A chunk maps each state to the state after it, whatever came before; these maps, one row for each chunk, are then
    applied in order. Only roles are read, and only of such conversations.
    """
    spans = rows.groupBy(F.col("conv_id").alias("id")).agg(F.min("chunk").alias("first"), F.max("chunk").alias("last")).filter("first < last")
    long = rows.select("conv_id", "chunk", "turn", "role").join(spans, F.col("conv_id").eqNullSafe(F.col("id")), "left_semi")
    states = sorted({START, *template.transitions, *(s for t in template.transitions.values() for s in t.values())})

    def maps(batches):
        import pyarrow as pa

        names = ["conv_id", "chunk", "after"]
        last, after = None, []
        for batch in batches:
            for conv, chunk, role in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "chunk", "role")), strict=True):
                if last != (conv, chunk):
                    if last:
                        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([after], pa.list_(pa.string()))], names)
                    last, after = (conv, chunk), states
                after = [_step(template, s, role)[0] for s in after]
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([after], pa.list_(pa.string()))], names)

    def fold(batches):
        import pyarrow as pa

        last, state = object(), START
        for batch in batches:
            found = []
            for conv, chunk, after in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if conv != last:
                    last, state = conv, START
                found.append(state)
                state = after[states.index(state)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["conv_id", "chunk", "state"])

    after = _by_chunk(long).mapInArrow(maps, "conv_id long, chunk long, after array<string>")
    return after.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "chunk").mapInArrow(fold, "conv_id long, chunk long, state string")


def format_turns(df: DataFrame, template: Template = DEFAULT, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row per turn: conv_id, chunk, pos, turn, role, segments, in_order. (chunk, pos) is its place in the
    conversation.

    df: conv_id, turn, role, text; other columns are not read. Turns are ordered by turn, null first, equal ones by role
    and text; null roles and texts are empty; rows with null conv_id are one conversation. Repeated rows are turns of
    their own. An empty table gives no rows. A conversation of many turns is dealt out by chunks of turn numbers, each
    of which starts in the state that the chunks before it lead to; rows stream through the tasks and aren't gathered.
    """
    chunk = F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(-(1 << 62)))
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("chunk", chunk)
    states = checkpointed(chunk_states(rows, template)).select(F.col("conv_id").alias("id"), F.col("chunk").alias("at"), "state")
    begun = rows.join(small_or_shuffled(states), F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("chunk") == F.col("at")), "left").select(*rows.columns, "state")

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), ("in_order", pa.bool_())])
        last, state, pos = None, START, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if last != (r["conv_id"], r["chunk"]):
                    last, state, pos = (r["conv_id"], r["chunk"]), r["state"] or START, 0
                state, in_order = _step(template, state, r["role"])
                out.append({"conv_id": r["conv_id"], "chunk": r["chunk"], "pos": pos, "turn": r["turn"], "role": r["role"], "segments": [{"text": t, "loss": x} for t, x in template.segments(r["role"], r["text"])], "in_order": in_order})
                pos += 1
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return _by_chunk(begun, "text").mapInArrow(run, TURNS)


class _Digest:
    """What is read back of one conversation: numbers and running hashes, whatever its length."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars, self.valid, self.role = conv_id, 0, 0, 0, True, ""
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, r: dict, template: Template) -> None:
        formatted = "".join(s["text"] for s in r["segments"])
        self.chars += len(formatted)
        for role, text in template.parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            self.role = role
        for s in r["segments"]:
            if s["loss"]:
                text = template.unescape(s["text"])
                self.loss_chars += len(text)
                self.loss.update(text.encode())
        self.valid &= r["in_order"]

    def row(self, template: Template) -> dict:
        ended = self.role in template.accepting
        return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "valid": self.valid and ended}


def read_back(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation, from the segments that format_turns gives: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, and valid (all turns in order, the last of a role that may end).

    A digest of a whole conversation has to see it in order, so each one streams through one task, whose memory holds
    numbers and running hashes only.
    """

    def digests(rows: Iterable[dict]) -> Iterator[dict]:
        now: _Digest | None = None
        for r in rows:
            if now is None or r["conv_id"] != now.conv_id:
                if now:
                    yield now.row(template)
                now = _Digest(r["conv_id"])
            now.add(r, template)
        if now:
            yield now.row(template)

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
        out: list[dict] = []
        for row in digests(r for batch in batches for r in batch.to_pylist()):
            out.append(row)
            if len(out) == 2000:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    ordered = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "chunk", "pos")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
