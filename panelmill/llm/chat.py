"""Chat formatting with a template that is only ever called, never looked into.

A template renders a list of (role, text) to one string. Successive prefixes of a conversation are rendered and
consecutive outputs compared: what the new output adds is the new turn's span. Two more renderings, whose last text
is one of two marker characters, show where in the span the text itself lies. An output that does not begin with
the one before is a template that rewrites history, and the turn says so.

A conversation streams through one task in order. A template that declares itself `append_only` renders every turn
by itself, so only the last turns are held and a conversation's length does not matter; whether dropping older turns
changes the turn is still checked when it happens. Any other template gets the true whole prefix for every turn, at
a cost that grows with the square of the conversation: whether it looks back or rewrites history can only be seen so.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

CONTEXT_TURNS = 16
_MARKS = ("\ue000", "\ue001")
_BATCH_CHARS = 1 << 22


class InstructionTemplate:
    """User turns between [INST] marks, assistant turns up to </s>, other roles by name.

    No control string can occur inside a text: every < and [ of a text is followed by one backslash more, which
    reading back removes again.
    """

    #: a list's output is that of its turns, each alone, joined
    append_only = True
    _ESCAPE = re.compile(r"[<\[]")
    _UNESCAPE = re.compile(r"([<\[])\\")

    def escape(self, text: str) -> str:
        return self._ESCAPE.sub(lambda mark: mark[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._UNESCAPE.sub(r"\1", text)

    def __call__(self, turns: list[Turn]) -> str:
        out = []
        for role, text in turns:
            body = self.escape(text)
            if role == "user":
                out.append(f"<s>[INST] {body} [/INST]")
            elif role == "assistant":
                out.append(f" {body} </s>")
            else:
                out.append(f"<s>[ROLE] {self.escape(role)} [SAYS] {body} [/ROLE]")
        return "".join(out)

    def read(self, rendered: str) -> list[Turn]:
        """The turns of a rendered conversation or stretch of one."""
        turns, at = [], 0
        while at < len(rendered):
            if rendered.startswith("<s>[INST] ", at):
                role, begin, close = "user", at + 10, " [/INST]"
            elif rendered.startswith("<s>[ROLE] ", at):
                says = rendered.index(" [SAYS] ", at)
                role, begin, close = self.unescape(rendered[at + 10 : says]), says + 8, " [/ROLE]"
            elif rendered[at] == " ":
                role, begin, close = "assistant", at + 1, " </s>"
            else:
                raise ValueError(f"no turn begins at character {at}")
            end = rendered.index(close, begin)
            turns.append((role, self.unescape(rendered[begin:end])))
            at = end + len(close)
        return turns


def _common(one: str, other: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(one), len(other))
    while low < high:
        middle = (low + high + 1) // 2
        if one[low:middle] == other[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Renderer:
    """Spans of the turns of one conversation, turn by turn."""

    def __init__(self, template: Template, context_turns: int = CONTEXT_TURNS) -> None:
        self._template, self._most = template, context_turns
        self._turns: list[Turn] = []
        self._before = template([])
        self._started = False
        self._looks_back = not getattr(template, "append_only", False)

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        """(span, where the text begins in it, where it ends, whether earlier output changed)."""
        if len(self._turns) >= 2 * self._most and not self._looks_back:
            short = self._turns[-self._most :]
            context = self._template(short)
            now, then = (self._template(turns + [(role, text)]) for turns in (self._turns, short))
            if now[len(self._before) :] == then[len(context) :]:
                self._turns, self._before = short, context
            else:
                self._looks_back = True
        self._turns.append((role, text))
        after = self._template(self._turns)
        keeps = after.startswith(self._before)
        # what the template puts before the first turn belongs to the first span
        cut = (len(self._before) if self._started else 0) if keeps else _common(self._before, after)
        probes = [self._template([*self._turns[:-1], (role, mark)]) for mark in _MARKS]
        begin = _common(*probes)
        end = len(after) - (len(probes[0]) - begin - 1)
        self._before, self._started = after, True
        return after[cut:], max(begin - cut, 0), max(end - cut, 0), not keeps


def format_conversations(
    conversations: DataFrame,
    template: Template,
    loss_roles: tuple[str, ...] = ("assistant",),
    context_turns: int = CONTEXT_TURNS,
) -> DataFrame:
    """One row per turn: conv_id, position (from 0), formatted, text_start, text_end, loss, rewrites_history.

    The `formatted` values of a conversation, joined in order, are the rendered conversation; `text_start` and
    `text_end` bound the turn's text in it, and `loss` says whether it is trained on. A conversation's rows come one
    after the other, in order, in one partition.

    Turns are ordered by turn, then role and text, nulls first; equal rows are turns of their own. A null role or
    text is empty; rows with a null conv_id form one conversation. An empty table gives an empty result; other
    columns are ignored.
    """

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renderer, current, position = None, None, 0
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            size = 0
            for conv, role, text in zip(*(batch.column(i) for i in range(3))):
                conv, role, text = conv.as_py(), role.as_py() or "", text.as_py() or ""
                if renderer is None or conv != current:
                    renderer, current, position = Renderer(template, context_turns), conv, 0
                span, begin, end, rewrites = renderer.add(role, text)
                for column, value in zip(columns, (conv, position, span, begin, end, role in loss_roles, rewrites)):
                    column.append(value)
                position += 1
                size += len(span)
                if size > _BATCH_CHARS:
                    yield _turn_batch(columns, batch.column(0).type)
                    columns, size = [[] for _ in range(7)], 0
            yield _turn_batch(columns, batch.column(0).type)

    rows = conversations.select("conv_id", F.col("role").cast("string"), F.col("text").cast("string"), "turn")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(
        render,
        f"conv_id {kind}, position long, formatted string, text_start long, text_end long, loss boolean, "
        "rewrites_history boolean",
    )


def _turn_batch(columns: list[list], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    names = ["conv_id", "position", "formatted", "text_start", "text_end", "loss", "rewrites_history"]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)


def read_back(formatted: DataFrame, template: InstructionTemplate) -> DataFrame:
    """One row per conversation of what `format_conversations` gave, from its output alone: conv_id, n_turns,
    turns_sha256 (role and text, each ended by a line feed), loss_chars and loss_sha256 (the unescaped text that is
    trained on), formatted_chars."""
    import hashlib

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        kind: pa.DataType = pa.int64()

        def result(states: list[list]) -> pa.RecordBatch:
            rows = [(s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]) for s in states]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            kind, done = batch.column(0).type, []
            for conv, formatted, begin, end, loss in zip(*(batch.column(i) for i in range(5))):
                conv, formatted = conv.as_py(), formatted.as_py()
                if state is None or conv != state[0]:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in template.read(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if loss.as_py():
                    trained = template.unescape(formatted[begin.as_py() : end.as_py()])
                    state[3] += len(trained)
                    state[4].update(trained.encode())
                state[5] += len(formatted)
            yield result(done)
        if state is not None:
            yield result([state])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "text_start", "text_end", "loss").mapInArrow(
        read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
