"""Chat formatting into budgeted windows.

Turns of a conversation stream through one task in turn order (rows shuffled by conversation, sorted within the
partition), so that memory holds one window, not one conversation.  Prefix sums of turn tokens choose spans of whole
turns: a window ends before the turn that would pass the budget.  A turn's tokens are those of its formatted text, marks
included, by the given tokenizer (byte BPE; without one, words and single signs are counted), so that empty turns fill a window
too.  Every window repeats the conversation's system turn (its first turn, if it is one) and up to `history` tokens of the turns
before its first new one; repeated turns carry no loss.  History gives way to a new turn that needs the room.  A system turn is
whole in the first window; where it takes more than half of the budget, later windows repeat the start of it that fits into
half.  So a window holds at most `budget` tokens, unless its only new turn is too long for that: such a turn stands alone, whole,
after the system turn.

Template of a turn: "### Role:\\n" + escaped text + "</turn>\\n".  Inside texts "\\", "### " and "</turn>" become
"\\\\", "\\#" and "\\t", so that no text can open or close a turn and every text is read back exactly.

Turn order: turn (nulls first), then role, then text.  A null text or role is empty; a null conversation id is a
conversation of its own.  Repeated rows are repeated turns.  An empty table gives no windows.  Only conv_id, turn, role and
text are read: further columns, whatever their names, play no part.  A text of any length is formatted whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import kept, shuffle_parts
from tessera.llm.packing import ByteBpe

END = "</turn>"
_ESCAPES = (("\\", "\\\\"), ("### ", "\\#"), (END, "\\t"))
_BACK = {"\\\\": "\\", "\\#": "### ", "\\t": END}
_ESCAPED = re.compile(r"\\[\\#t]")
_TURN = re.compile(r"### ((?:\\[\\#tn]|[^\\\n])*):\n((?:\\[\\#t]|[^\\])*?)</turn>\n")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    for plain, coded in _ESCAPES:
        text = text.replace(plain, coded)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[0]], text)


def _title(role: str) -> str:
    known = {"user": "User", "assistant": "Assistant", "system": "System"}
    return known.get(role) or "=" + escape(role).replace("\n", "\\n")


def _role(title: str) -> str:
    known = {"User": "user", "Assistant": "assistant", "System": "system"}
    if title in known:
        return known[title]
    return re.sub(r"\\[\\#tn]", lambda m: "\n" if m[0] == "\\n" else _BACK[m[0]], title[1:])


def count_signs(text: str) -> int:
    """Words and single signs: a count for uses without a vocabulary."""
    return len(_TOKEN.findall(text))


def token_counter(tokenizer: str | None, ranks: str | None) -> Callable[[str], int]:
    if tokenizer is None:
        return count_signs
    bpe = ByteBpe(tokenizer, ranks)
    return lambda text: len(bpe(text)) // 4


def _formatted(role: str, text: str) -> tuple[str, str]:
    return f"### {_title(role)}:\n", escape(text)


class Formatter:
    """Takes one conversation's turns in order, yields (formatted, loss spans, repeated turns) windows."""

    def __init__(self, budget: int, history: int, target_role: str, count: Callable[[str], int] = count_signs):
        self.budget, self.history, self.target, self.count = budget, history, target_role, count
        self.system: tuple[str, str, int] | None = None
        self.recent: deque[tuple[str, str, int]] = deque()  # turns that may be repeated, and their tokens in all
        self.fresh: list[tuple[str, str, int]] = []
        self.kept = self.used = 0
        self.first = True

    def _tokens(self, role: str, text: str) -> int:
        head, body = _formatted(role, text)
        return self.count(head + body + END + "\n")

    def _start_of(self, role: str, text: str, tokens: int) -> tuple[str, str, int]:
        """The turn, or as much of its start as half of the budget holds."""
        half = self.budget // 2
        while tokens > half and text:
            text = text[: min(len(text) - 1, len(text) * half // tokens)]
            tokens = self._tokens(role, text)
        return role, text, tokens

    def _give_way(self, room: int) -> None:
        while self.recent and self.kept > room:
            self.kept -= self.recent.popleft()[2]

    def add(self, role: str, text: str) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
        turn = (role, text, self._tokens(role, text))
        base = self.system[2] if self.system else 0
        if self.fresh and base + self.kept + self.used + turn[2] > self.budget:
            yield self._window()
            base = self.system[2] if self.system else 0
        if not self.fresh:
            self._give_way(self.budget - base - turn[2])
        self.fresh.append(turn)
        self.used += turn[2]

    def end(self) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
        if self.fresh:
            yield self._window()

    def _window(self) -> tuple[str, list[tuple[int, int]], int]:
        again = ([self.system] if self.system else []) + list(self.recent)
        out, at, spans = [], 0, []
        for k, (role, text, _) in enumerate(again + self.fresh):
            head, body = _formatted(role, text)
            out += [head, body, END, "\n"]
            if k >= len(again) and role == self.target:
                spans.append((at + len(head), at + len(head) + len(body)))
            at += len(head) + len(body) + len(END) + 1
        if self.first and self.fresh[0][0] == "system":
            self.system = self._start_of(*self.fresh.pop(0))
        self.first = False
        self.recent.extend(self.fresh)
        self.kept += sum(t[2] for t in self.fresh)
        self._give_way(self.history)
        self.fresh, self.used = [], 0
        return "".join(out), spans, len(again)


def read_back(formatted: str, repeated: int) -> list[tuple[str, str]]:
    """The window's new turns, from its text alone."""
    turns = [(_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]
    return turns[repeated:]


def _ordered(chats: DataFrame) -> DataFrame:
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition(shuffle_parts(chats.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _windows(batches: Iterator[pa.RecordBatch], budget: int, history: int, target: str, count: Callable[[str], int]):
    """(conversation, window) in order; (conversation, None) at a conversation's end."""
    now, form = None, None
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            conv, role, text = (part.column(part.schema.names.index(x)).to_pylist() for x in ("conv_id", "role", "text"))
            for c, r, t in zip(conv, role, text, strict=True):
                if form is None or c != now:
                    if form is not None:
                        for w in form.end():
                            yield now, w
                        yield now, None
                    now, form = c, Formatter(budget, history, target, count)
                for w in form.add(r, t):
                    yield c, w
    if form is not None:
        for w in form.end():
            yield now, w
        yield now, None


def format_windows(chats: DataFrame, budget: int = 1024, history: int = 256, target_role: str = "assistant", tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss_spans (code points, end exclusive), repeated_turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, k = [], 0
        count = kept("chat", (tokenizer, ranks), lambda: token_counter(tokenizer, ranks))
        for conv, w in _windows(batches, budget, history, target_role, count):
            if w is None:
                k = 0
                continue
            rows.append({"conv_id": conv, "window": k, "formatted": w[0], "loss_spans": [{"start": s, "end": e} for s, e in w[1]], "repeated_turns": w[2]})
            k += 1
            if len(rows) >= 256:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=kind)

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kind = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(span)), ("repeated_turns", pa.int64())])
    return _ordered(chats).mapInArrow(run, "conv_id long, window long, formatted string, loss_spans array<struct<start:long,end:long>>, repeated_turns long")


def window_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from the windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    Only windows are shuffled; hashes run over them in order, one window in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        now, state = None, None

        def close() -> None:
            n, turns, lost, loss, chars, count = state
            out.append({"conv_id": now, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": lost, "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "n_windows": count})

        for b in batches:
            conv, formatted, spans, again = (b.column(b.schema.names.index(x)) for x in ("conv_id", "formatted", "loss_spans", "repeated_turns"))
            for i in range(b.num_rows):
                c, text = conv[i].as_py(), formatted[i].as_py()
                if state is None or c != now:
                    if state is not None:
                        close()
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in read_back(text, again[i].as_py()):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in spans[i].as_py():
                    said = unescape(text[s["start"] : s["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out.clear()
        if state is not None:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
    ordered = windows.repartition(shuffle_parts(windows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
