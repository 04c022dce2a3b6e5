"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The template gives each role the text before and after its turns, the roles that may follow
it, and whether its text is trained on. The machine walks a conversation's turns in order;
a role that may not come next is marked as such and formatted all the same, so no turn is
lost. A turn yields three segments (opening, text, closing), each with its loss flag.

Control strings inside a text are escaped, so the output has them only where the template
put them, and the output alone gives back turns, texts and the loss mask. Every escape is
the escape character before a control string or before another escape character.

Conversations stream through a task in turn order with constant memory: a running hash and
counts are kept, never the turns, so a conversation of any length does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    opening: str
    closing: str
    follows: tuple[str, ...]  # what may come before; "" is the start
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("### System: ", "</turn>\n", ("",)),
            "user": Role("### User: ", "</turn>\n", ("", "system", "assistant", "tool")),
            "assistant": Role("### Assistant: ", "</turn>\n", ("user", "tool"), True),
            "tool": Role("### Tool: ", "</turn>\n", ("assistant", "tool")),
        }
    )
    other: tuple[str, str] = ("### Role [", "]: ")  # of a role without an entry: its name stands between
    other_closing: str = "</turn>\n"
    final: tuple[str, ...] = ("assistant",)  # where a conversation may end
    escape: str = "\\"

    def control(self) -> re.Pattern:
        """What is escaped in texts: the escape itself, closings, and openings without trailing blanks."""
        marks = {self.escape, self.other[0].strip(), self.other[1].strip(), self.other_closing.strip()}
        for r in self.roles.values():
            marks |= {r.opening.strip(), r.closing.strip()}
        return re.compile("|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True) if m))

    def protect(self, text: str, found: re.Pattern) -> str:
        return found.sub(lambda m: self.escape + m[0], text)

    def restore(self, text: str, found: re.Pattern) -> str:
        return re.sub(re.escape(self.escape) + f"({found.pattern})", lambda m: m[1], text)


@dataclass(frozen=True)
class Segment:
    text: str
    loss: bool
    valid: bool  # the machine allowed this turn's role here


class Machine:
    """Formats turns one after another; state is the last role."""

    def __init__(self, template: Template):
        self.template, self.found, self.state = template, template.control(), ""

    def turn(self, role: str, text: str) -> list[Segment]:
        t, r = self.template, self.template.roles.get(role)
        valid = r is not None and self.state in r.follows
        self.state = role
        opening, closing = (r.opening, r.closing) if r else (t.other[0] + t.protect(role, self.found) + t.other[1], t.other_closing)
        return [Segment(opening, False, valid), Segment(t.protect(text, self.found), r is not None and r.loss, valid), Segment(closing, False, valid)]

    def may_end(self) -> bool:
        return self.state in self.template.final


def read_back(template: Template, text: str, mask: list[tuple[int, int]], found: re.Pattern | None = None) -> Iterator[tuple[str, str, list[str]]]:
    """(role, text, texts under the loss mask) of each turn of formatted text, from it alone.

    mask: (start, end) of what is trained on, in order.
    """
    found = found or template.control()
    esc = re.escape(template.escape)
    heads = [(re.escape(r.opening), name) for name, r in template.roles.items()]
    head = re.compile("|".join([f"({p})" for p, _ in heads] + [re.escape(template.other[0]) + f"((?:{esc}(?:{found.pattern})|(?!{found.pattern})[\\s\\S])*)" + re.escape(template.other[1])]))
    body = re.compile(f"(?:{esc}(?:{found.pattern})|(?!{found.pattern})[\\s\\S])*")
    at = k = 0
    while at < len(text):
        m = head.match(text, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        role = heads[m.lastindex - 1][1] if m.lastindex <= len(heads) else template.restore(m[m.lastindex], found)
        b = body.match(text, m.end())
        closing = template.roles[role].closing if role in template.roles else template.other_closing
        if not text.startswith(closing, b.end()):
            raise ValueError(f"the turn at {at} isn't closed")
        end = b.end() + len(closing)
        under = []
        while k < len(mask) and mask[k][1] <= end:
            under.append(template.restore(text[mask[k][0] : mask[k][1]], found))
            k += 1
        yield role, template.restore(b[0], found), under
        at = end


FORMATTED = "conv_id bigint, turn bigint, seq bigint, role string, segments array<struct<text:string,loss:boolean>>, formatted string, loss_start bigint, loss_end bigint, valid boolean, may_end boolean"
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, seq = None, object(), 0
        for b in batches:
            out = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if machine is None or conv != now:
                    machine, now, seq = Machine(template), conv, 0
                parts = machine.turn(role, text)
                start = len(parts[0].text)
                out.append((conv, turn, seq, role, [{"text": s.text, "loss": s.loss} for s in parts], "".join(s.text for s in parts), start if parts[1].loss else None, start + len(parts[1].text) if parts[1].loss else None, parts[1].valid, machine.may_end()))
                seq += 1
            if out:
                cols = list(zip(*out, strict=True))
                seg = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), seg, pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
                names = ["conv_id", "turn", "seq", "role", "segments", "formatted", "loss_start", "loss_end", "valid", "may_end"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def format_chats(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) in order within partitions, formatted one row a turn.

    formatted joined by seq is the conversation's output; loss_start and loss_end bound the
    trained text in it. Null texts and roles are empty. Turns of one number (repeated rows,
    null turns first) are ordered by role, then text. A null conv_id is a conversation of
    its own. Other columns are ignored.
    """
    t = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(Template()), FORMATTED)


def _digest(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = template.control()
        now, state, begun = None, None, False

        def row():
            n, turns, chars, loss, size, valid, end = state
            return (now, n, turns.hexdigest(), chars, loss.hexdigest(), size, valid and end)

        for b in batches:
            out = []
            for conv, formatted, start, end, valid, may_end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or conv != now:
                    if begun:
                        out.append(row())
                    begun, now, state = True, conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, False]
                for role, text, under in read_back(template, formatted, [(start, end)] if start is not None else [], found):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    for x in under:
                        state[2] += len(x)
                        state[3].update(x.encode())
                state[4] += len(formatted)
                state[5] &= valid
                state[6] = may_end
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DIGESTS, strict=True)], schema=DIGESTS)
        if begun:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(row(), strict=True), DIGESTS, strict=True)], schema=DIGESTS)

    return run


def chat_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted output: counts, digests, validity."""
    f = format_chats(turns).select("conv_id", "formatted", "loss_start", "loss_end", "valid", "may_end")
    return f.mapInArrow(_digest(Template()), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")
