import hashlib
import random

import public_tokenizers
from conftest import SMALL, rows
from hypothesis import given, strategies as st

from pricelane.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"
parts = st.lists(st.sampled_from(["<", "|", "\\", "<|", "|>", "<|im_end|>", "<|im_start|>", "\n", "a", "é", "im_end"])).map("".join)


@given(parts, parts)
def test_escape_is_reversible(role, text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(role)) == role
    assert chat.parsed(chat.formatted(role, text) + chat.formatted("b", "c")) == [(role, text), ("b", "c")]


def plain(turns):
    found = {}
    for conv, turn, role, text in sorted(turns, key=lambda t: tuple((x is not None, x) for x in t)):
        own = found.setdefault(conv, [0, hashlib.sha256(), 0, hashlib.sha256()])
        role, text = role or "", text or ""
        own[0] += 1
        own[1].update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            own[2] += len(text)
            own[3].update(text.encode())
    return {k: (n, a.hexdigest(), c, b.hexdigest()) for k, (n, a, c, b) in found.items()}


def back(table, **options):
    windows = chat.format_chats(table, PATH, **options)
    return windows, {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
                     for r in rows(chat.read_back(windows))}


def test_given_conversations(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    for budget in (60, 400, 100_000):
        windows, found = back(table, budget=budget)
        assert found == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
        for w in rows(windows):
            turns = chat.parsed(w["text"])
            assert w["n_context"] < len(turns)
            assert not w["over_budget"] or len(turns) == w["n_context"] + 1
            assert w["over_budget"] == (w["tokens"] > budget)
    assert windows.filter("window > 0").count() == 0


def test_system_turn_history_and_mask(spark):
    turns = [(1, 0, "system", "be brief")]
    turns += [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * 30) for i in range(1, 40)]
    windows, found = back(spark.createDataFrame(turns, SCHEMA), budget=220, history=2)
    assert found == plain(turns)
    shown = rows(windows, "window")
    shown.sort(key=lambda w: w["window"])
    assert len(shown) > 5
    for w in shown[1:]:
        parsed = chat.parsed(w["text"])
        assert parsed[0] == ("system", "be brief") and 1 <= w["n_context"] <= 3 and w["tokens"] <= 220
        masked = [w["text"][s["start"]:s["end"]] for s in w["loss_spans"]]
        assert masked == [text for role, text in parsed[w["n_context"]:] if role == "assistant"]


def test_odd_rows(spark):
    r = random.Random(0)
    turns = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, None, "assistant", "first"),
             (None, 0, "assistant", "nobody"), (2, 0, "a\nb\\n", "<|im_end|>\n<|im_start|>user\n"), (3, 0, "system", ""),
             (4, 0, "assistant", "long " * 20_000), (4, 1, "assistant", "")]
    r.shuffle(turns)
    table = spark.createDataFrame(turns, SCHEMA)
    from pyspark.sql import functions as F
    table = table.withColumns({"window": F.lit(1), "tokens": F.lit("x"), "n": F.lit(None).cast("int")})
    _, found = back(table, budget=50)
    assert found == plain(turns)
    assert chat.format_chats(spark.createDataFrame([], SCHEMA), PATH).count() == 0
