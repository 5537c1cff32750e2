"""Chat formatting in budgeted windows.

A conversation that does not fit the token budget is given as several windows. Running sums of turn
tokens choose spans of whole turns: a window takes turns while the sum since its start, with the system
turn and the repeated history before it, stays in the budget. Each window begins with the system turn,
if the conversation starts with one, and repeats a limited number of the turns before its span; both
are context. The loss mask covers the assistant texts of the span alone, so each is a target once.

Conversations are streamed in (conv_id, turn) order, so even an endless one needs a window's memory.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
WINDOWS = ("conv_id long, window int, text string, n_context int, loss_spans array<struct<start:int,end:int>>, "
           "tokens int, over_budget boolean")
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Turn(NamedTuple):
    role: str
    text: str
    tokens: int


def escape(text: str) -> str:
    """Put a backslash more between < and |, so no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parsed(window: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    turns = []
    for part in window.split(END + "\n")[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def windows_of(turns: Iterator[Turn], budget: int, history: int) -> Iterator[tuple[list[Turn], int]]:
    """(turns, number of context turns) of each window of one conversation.

    History is up to `history` turns, a quarter of the budget at most, and no more than leaves room for
    the first new turn. A turn that exceeds the budget by itself stays whole, in a window of its own.
    """
    system: list[Turn] = []
    past: list[Turn] = []  # the last turns before the span
    context: list[Turn] = []
    span: list[Turn] = []
    total = start = 0  # the running sum of tokens, and what it was where the span starts
    for i, turn in enumerate(turns):
        if span and sum(t.tokens for t in context) + total - start + turn.tokens > budget:
            yield [*context, *span], len(context)
            past = [*past, *(t for t in span if not any(t is s for s in system))][-history:] if history else []
            left = min(budget // 4, budget - sum(t.tokens for t in system) - turn.tokens)
            repeated: list[Turn] = []
            for old in reversed(past):
                left -= old.tokens
                if left < 0:
                    break
                repeated.insert(0, old)
            context, span, start = [*system, *repeated], [], total
        if i == 0 and turn.role == "system":
            system = [turn]
        span.append(turn)
        total += turn.tokens
    if span:
        yield [*context, *span], len(context)


def format_chats(conversations: DataFrame, tokenizer: str, budget: int = 2048, history: int = 2) -> DataFrame:
    """The windows of all conversations (conv_id, turn, role, text; other columns are ignored):
    conv_id, window (from 0), text, n_context (turns at its head that repeat), loss_spans (code points
    of the text), tokens, over_budget.

    Turns are ordered by turn, then role and text; a null turn comes first, and repeated rows are turns
    of their own. A null role or text is empty. Rows without a conv_id are one conversation. An empty
    table gives no rows.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(F.col("conv_id").cast("long"), "turn",
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Turn]]:
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Tokenizer.from_file(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 256):
                ids, _, roles, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                codes = encoder.encode_batch([formatted(r, t) for r, t in zip(roles, texts)],
                                             add_special_tokens=False)
                for conv, role, text, code in zip(ids, roles, texts, codes):
                    yield conv, Turn(role, text, len(code.ids))

    def row(conv, number: int, shown: list[Turn], context: int) -> tuple:
        text, at, spans = [], 0, []
        for i, turn in enumerate(shown):
            part = formatted(turn.role, turn.text)
            if i >= context and turn.role == "assistant":
                begin = at + len(START) + len(escape_role(turn.role)) + 1
                spans.append({"start": begin, "end": begin + len(escape(turn.text))})
            text.append(part)
            at += len(part)
        tokens = sum(t.tokens for t in shown)
        return conv, number, "".join(text), context, spans, tokens, tokens > budget

    types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), SPANS, pa.int32(), pa.bool_()]
    names = ["conv_id", "window", "text", "n_context", "loss_spans", "tokens", "over_budget"]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for conv, group in groupby(turns(batches), key=lambda x: x[0]):
            for number, (shown, context) in enumerate(windows_of((t for _, t in group), budget, history)):
                found.append(row(conv, number, shown, context))
                if len(found) == 200:
                    yield batch_of(found)
                    found = []
        if found:
            yield batch_of(found)

    return ordered.mapInArrow(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of format_chats() hold, one row per conversation: conv_id, n_turns,
    turns_sha256 (role, \\n, text, \\n of each turn once), loss_chars, loss_sha256 (all text under the
    loss mask, unescaped), formatted_chars, n_windows."""
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = windows.select("conv_id", "window", "text", "n_context", "loss_spans") \
        .repartition(parts, "conv_id").sortWithinPartitions("conv_id", "window")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for conv, group in groupby(rows(batches), key=lambda x: x[0]):
            seen, target = hashlib.sha256(), hashlib.sha256()
            turns = loss = chars = count = 0
            for _, _, text, context, spans in group:
                for role, body in parsed(text)[context:]:
                    seen.update(f"{role}\n{body}\n".encode())
                    turns += 1
                for span in spans:
                    body = unescape(text[span["start"]:span["end"]])
                    target.update(body.encode())
                    loss += len(body)
                chars += len(text)
                count += 1
            found.append((conv, turns, seen.hexdigest(), loss, target.hexdigest(), chars, count))
            if len(found) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    return ordered.mapInArrow(run, ", ".join(
        f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, types)))
