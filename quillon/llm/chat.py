"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

Rows are ordered by turn (then role and text, for ties; nulls first) within their conversation and streamed, so a conversation
of any length needs no memory but its current turn. Every turn is emitted as segments: opening marks, the escaped text, closing mark. Only the
text of a loss role carries the flag. The machine checks the order of roles and marks the first turn it does not accept; the
turns are emitted all the same, so that the output always reads back.

Escaping: with the escape character E, ``E`` in a text becomes ``E0``, and every control string gets ``E1`` after its first
character, so an escaped text holds no control string. Removing ``E1`` and turning ``E0`` into ``E`` undoes it.

Defined cases: null texts and roles are empty; a null ``conv_id`` is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    turn_open: str = "<|turn|>"
    text_open: str = "<|text|>"
    turn_close: str = "</s>\n"
    #: Strings that never stand in an escaped text; the marks above are among them or begin with one.
    controls: tuple[str, ...] = ("<|turn|>", "<|text|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state -> role -> next state; a role that isn't there is out of order.
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"assistant": "assistant"},
        }
    )
    accepting: frozenset[str] = frozenset({"assistant"})
    escape: str = chr(0x241B)

    def hide(self, text: str) -> str:
        text = text.replace(self.escape, self.escape + "0")
        for c in self.controls:
            if c in text:
                text = text.replace(c, c[0] + self.escape + "1" + c[1:])
        return text

    def show(self, text: str) -> str:
        return re.sub(self.escape + "([01])", lambda m: self.escape if m[1] == "0" else "", text)


DEFAULT = Template()
SEGMENTS = "conv_id long, n int, segment int, text string, loss boolean, accepted boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, first_refused int, complete boolean"


def format_chat(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Segments of every conversation, consecutive and in order within a partition."""

    def run(batches):
        import pyarrow as pa

        conv, n, state = object(), 0, "start"
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != conv:
                    conv, n, state = conv_id, 0, "start"
                following = template.machine.get(state, {}).get(role)
                state = following or "refused"
                out += [
                    (conv_id, n, 0, template.turn_open + template.hide(role) + template.text_open, False, bool(following)),
                    (conv_id, n, 1, template.hide(text), role in template.loss_roles, bool(following)),
                    (conv_id, n, 2, template.turn_close, False, bool(following)),
                ]
                n += 1
            if out:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                    names=["conv_id", "n", "segment", "text", "loss", "accepted"],
                )

    empty = F.lit("")
    turns = rows.select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return turns.mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row a conversation, parsed from the formatted text: turns, digests and the text under the loss mask."""
    mark = re.compile(
        re.escape(template.turn_open) + "(.*?)" + re.escape(template.text_open) + "(.*?)" + re.escape(template.turn_close), re.S
    )

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "first_refused", "complete"]
        current = None

        def close():
            role = current["role"]
            complete = current["refused"] is None and role in template.accepting
            return (current["conv"], current["n"], current["turns"].hexdigest(), current["chars"], current["loss"].hexdigest(), current["size"], current["refused"], complete)

        def pack(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            out = []
            for conv_id, text, loss, accepted in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "accepted")), strict=True):
                if current is None or current["conv"] != conv_id:
                    if current is not None:
                        out.append(close())
                    current = {"conv": conv_id, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0, "text": [], "role": None, "refused": None}
                current["size"] += len(text)
                if loss:
                    plain = template.show(text)
                    current["chars"] += len(plain)
                    current["loss"].update(plain.encode())
                current["text"].append(text)
                if text == template.turn_close:  # an escaped text never equals it
                    found = mark.fullmatch("".join(current["text"]))
                    if not found:
                        raise ValueError(f"conversation {conv_id}: a turn does not read back")
                    role, plain = map(template.show, found.groups())
                    current["turns"].update(f"{role}\n{plain}\n".encode())
                    if not accepted and current["refused"] is None:
                        current["refused"] = current["n"]
                    current["n"] += 1
                    current["role"], current["text"] = role, []
            if out:
                yield pack(out)
        if current is not None:
            yield pack([close()])

    return segments.mapInArrow(run, DIGESTS)
