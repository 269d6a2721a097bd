"""Chat formatting in budgeted windows.

Turns stream in order of their conversation.  Running sums of turn tokens decide where a window
ends: always between turns.  Each later window starts with the system turn and as much of the
preceding turns as the history budget allows; these repeats are not trained on again.  Where the
system turn and one new turn exceed the budget together, the window holds these two and nothing
else: both stay whole, and the window is larger than the budget.

One task holds a window and a short history at a time, never a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import packed

BUDGET, HISTORY = 1024, 128
#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>")
_ANY = "|".join(map(re.escape, CONTROL))
_PLAIN = re.compile(rf"\\|{_ANY}")
_ESCAPED = re.compile(rf"\\(\\|{_ANY})")
_MARK = re.compile(rf"\\(?:\\|{_ANY})|({_ANY})")
_TOKEN = re.compile(r"\w+|[^\w\s]")

WINDOW = "window int, n_repeated int, n_turns int, n_tokens bigint, formatted string, loss array<struct<begin:int,end:int>>"


def escape(text: str) -> str:
    r"""A backslash before each backslash and control string; ``unescape`` undoes it exactly."""
    return _PLAIN.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where its escaped text begins and ends in it."""
    body = escape(text)
    head, tail = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}.get(role) or (f"<<ROLE>>{escape(role)}<<TEXT>>", " </s>")
    return head + body + tail, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, read back from its marks."""
    marks = [(m.start(), m.end(), m[1]) for m in _MARK.finditer(formatted) if m[1]]
    out, at, k = [], 0, 0
    while at < len(formatted):
        kind = marks[k][2] if marks[k][0] == at else ""
        if kind == "<<SYS>>":
            out.append(("system", unescape(formatted[marks[k][1] + 1 : marks[k + 1][0] - 1])))
            at, k = marks[k + 1][1] + 1, k + 2
        elif kind == "<s>":
            out.append(("user", unescape(formatted[marks[k + 1][1] + 1 : marks[k + 2][0] - 1])))
            at, k = marks[k + 2][1], k + 3
        elif kind == "<<ROLE>>":
            out.append((unescape(formatted[marks[k][1] : marks[k + 1][0]]), unescape(formatted[marks[k + 1][1] : marks[k + 2][0] - 1])))
            at, k = marks[k + 2][1], k + 3
        else:
            out.append(("assistant", unescape(formatted[at + 1 : marks[k][0] - 1])))
            at, k = marks[k][1], k + 1
    return out


def counter(tokenizer: str | None = None) -> Callable[[str], int]:
    """Tokens of a text: words and signs, or those of a tokenizer file."""
    if tokenizer is None:
        return lambda text: sum(1 for _ in _TOKEN.finditer(text))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def windows(turns: Iterator[tuple[str, str]], budget: int, history: int, count: Callable[[str], int]) -> Iterator[tuple[int, int, int, str, list[dict]]]:
    """(repeated turns, turns, tokens, text, loss spans) of each window of one conversation."""
    system: tuple[str, str, int] | None = None
    past: deque[tuple[str, str, int]] = deque()
    past_sum = 0
    now: list[tuple[str, str, int]] = []
    begun, total, repeated = 0, 0, 0  # running sum at the window's start and now

    def close() -> tuple[int, int, int, str, list[dict]]:
        text, length, loss = [], 0, []
        for k, (role, body, _) in enumerate(now):
            part, a, b = render(role, body)
            if role == "assistant" and k >= repeated:
                loss.append({"begin": length + a, "end": length + b})
            text.append(part)
            length += len(part)
        return repeated, len(now), total - begun, "".join(text), loss

    for role, body in turns:
        n = count(body)
        if len(now) > repeated and total - begun + n > budget:
            yield close()
            head = [system] if system else []
            now = [*head, *(x for x in past if x is not system)]
            while len(now) > len(head) and sum(x[2] for x in now) + n > budget:  # other repeats give way to new turns
                del now[len(head)]
            repeated, begun = len(now), total - sum(x[2] for x in now)
        turn = (role, body, n)
        now.append(turn)
        total += n
        past.append(turn)
        past_sum += n
        while past and past_sum > history:
            past_sum -= past.popleft()[2]
        if role == "system" and system is None:
            system = turn
    if now:
        yield close()


def format_conversations(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a window: ``conv_col`` and ``WINDOW``, in order within each partition.

    Null texts and roles are empty.  Turns go by ``turn_col`` (null first), ties by role, then text;
    repeated rows are repeated turns.  A null conversation is one of its own.  Texts of any length
    stay whole.  Other columns are not read.  Equal rows, equal windows.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    rows = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(role_col, F.lit("")).alias("r"), F.coalesce(text_col, F.lit("")).alias("x"))
    rows = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")
    arrow = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for conv, turns in _runs(batches):
            for k, (repeated, n, tokens, text, loss) in enumerate(windows(turns, budget, history, count)):
                yield pa.RecordBatch.from_arrays([conv, *(pa.array([v], t) for v, t in ((k, pa.int32()), (repeated, pa.int32()), (n, pa.int32()), (tokens, pa.int64()), (text, pa.string()), (loss, arrow)))], ["c", "window", "n_repeated", "n_turns", "n_tokens", "formatted", "loss"])

    return packed(rows, run, f"`{conv_col}` {kind}, {WINDOW}")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Iterator[tuple]]]:
    """(key as an array of one, the rows' other values) of runs of equal first columns; rows are read as they are asked for."""
    stream = ((key, b, i, values) for b in batches for i, (key, *values) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)))
    waiting = next(stream, None)

    def of(key) -> Iterator[tuple]:
        nonlocal waiting
        while waiting is not None and waiting[0] == key:
            values, waiting = waiting[3], None
            yield tuple(values)
            waiting = next(stream, None)

    while waiting is not None:
        key, b, i = waiting[:3]
        mine = of(key)
        yield b.column(0).slice(i, 1), mine
        for _ in mine:
            pass


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What ``format_conversations`` holds, read back from its text and loss spans, one row a conversation."""
    kind = formatted.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in _runs(batches):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for repeated, text, spans in rows:
                chars += len(text)
                for role, body in parse(text)[repeated:]:
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for s in spans:
                    body = unescape(text[s["begin"] : s["end"]])
                    loss.update(body.encode())
                    loss_chars += len(body)
            yield pa.RecordBatch.from_arrays([conv, *(pa.array([v]) for v in (n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))], ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.select(conv_col, "n_repeated", "formatted", "loss")
    return packed(rows, run, f"`{conv_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
