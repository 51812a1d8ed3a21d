"""Chat formatting: layouts, round trips of texts full of marks, masks, odd records."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import chat

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<:>", "<</ROLE>>", "\\", "<", "[", "/", "s>", "<SYS>>", "INST]", " ", "\n", "é", "🙂", "$1", "ok", '"', "\x00"]


def _digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _want(rows):
    """Figures of one conversation's (turn, role, text), by the definition."""
    rows = sorted((t, r or "", x or "") for t, r, x in rows)
    loss = "".join(x for _, r, x in rows if r == "assistant")
    return len(rows), _digest("".join(f"{r}\n{x}\n" for _, r, x in rows)), len(loss), _digest(loss)


def _run(spark, tmp_path, rows):
    table = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, payload string, block int")
    parts = chat.chat_files(chat.records_of(table), "conv_id", ["block", "piece"], "payload", str(tmp_path / "parts"))
    return parts, {r.conv_id: r for r in chat.digests(parts, "conv_id", ["block", "piece"]).collect()}


def test_round_trip_of_marks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat, "LONG", 60)
    rng = random.Random(4)
    text = lambda: "".join(rng.choices(PARTS, k=rng.randint(0, 12)))
    rows = []
    for conv in range(150):
        kind = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"] * 20, ["tool", "assistant", None, "<s>"], ["assistant"], ["user"]])
        rows += [(conv if conv else None, k - 3, role, None if rng.random() < 0.05 else text()) for k, role in enumerate(kind)]
    rows += [(7, 0, "user", "tie"), (7, 0, "user", "tie"), (8, None, "assistant", "no turn"), (9, 10**12, "user", "far")]
    parts, got = _run(spark, tmp_path, rows)
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append((rest[0] if rest[0] is not None else -(10**15), *rest[1:]))
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {c: _want(r) for c, r in by.items()}
    layouts = {r.layout for r in parts.select("layout").distinct().collect()}
    assert None not in layouts and len(layouts) == 6
    assert sum(r.formatted_chars for r in got.values()) == sum(len(r.formatted) for r in parts.collect())


def test_no_mark_is_left_in_a_text(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 9))) for _ in range(2000)]
    t = chat.Template()
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.escape(F.col("x")).alias("e")).select("x", "e", t.unescape(F.col("e")).alias("u")).collect()
    assert all(r.u == r.x and not any(m in r.e for m in t.marks) for r in rows)


@pytest.mark.parametrize(
    "record, layout, turns",
    [
        ({"content": 1, "messages": []}, None, None),
        ({"messages": []}, "messages", []),
        ({"messages": [{"content": "a", "role": "user"}, {"role": "assistant"}], "id": 3}, "messages", [("user", "a"), ("assistant", "")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "message parts", [("user", "ab")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}, {"from": "tool", "value": "c"}]}, "conversations", [("user", "a"), ("assistant", ""), ("tool", "c")]),
        ({"prompt": "a", "response": "b"}, "prompt and response", [("user", "a"), ("assistant", "b")]),
        ({"question": "a", "answer": None, "id": "z"}, "question and answer", [("user", "a"), ("assistant", "")]),
        ({"prompt": {"response": "b"}}, None, None),
        ({"prompt: STRING, response": "b"}, None, None),
        ({}, None, None),
        ([], None, None),
        ("no JSON", None, None),
        (None, None, None),
    ],
)
def test_layouts(spark, record, layout, turns):
    payload = record if record is None or record == "no JSON" else json.dumps(record)
    rows = chat.canonical(spark.createDataFrame([(1, payload, "x")], "id long, payload string, turns string"), "payload").collect()
    assert [(r.id, r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in rows] == [(1, layout, turns)]
    assert chat.formatted(chat.canonical(spark.createDataFrame([(1, payload)], "id long, payload string"), "payload"), chat.Template()).first().formatted is None or layout


def test_field_order_and_types_do_not_matter(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": [{"y": null, "x": "s"}]}',), ('{"a": [{"x": 2.5}, {"y": true}], "b": "t"}',), ('{"a": [{"x": 2.5}], "b": "t"}',)], "j string")
    got = [r.s for r in rows.select(chat.shape(F.try_parse_json("j")).alias("s")).collect()]
    assert got[0] == got[1] == chat.shape_of(("b", "a[].x", "a[].y")) != got[2]


def test_empty_table(spark, tmp_path):
    _, got = _run(spark, tmp_path, [])
    assert got == {}


def test_plan_has_no_python(spark):
    table = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.formatted(chat.canonical(chat.records_of(table), "payload"), chat.Template())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
