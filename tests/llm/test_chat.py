"""Chat formatting: round trips, masks and turn order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stallwise.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def formatted(spark, rows, template=chat.Template(), schema=SCHEMA):
    made = chat.format_chats(spark.createDataFrame(rows, schema), template)
    return {r.conv_id: r for r in made.select("*", chat.read_back(F.col("formatted"), template).alias("turns"), chat.learned(F.col("segments"), template).alias("learned")).collect()}


def test_round_trip_of_texts_that_hold_marks(spark):
    rnd, rows = random.Random(3), []
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[TURN]", "<", "[", "\\", "\\\\", "s>", "/s>", "INST]", "<\\/s>", "$1", "\n", " ", "é\U0001f600", ""]
    for c in range(300):
        for t in range(rnd.randrange(1, 6)):
            rows.append((c, t, rnd.choice(["user", "assistant", "system", "tool", "[/ROLE]", "", "user]"]), "".join(rnd.choices(pieces, k=rnd.randrange(0, 9)))))
    template = chat.Template()
    for c, r in formatted(spark, rows).items():
        own = [(x[2], x[3]) for x in sorted(x for x in rows if x[0] == c)]
        assert [(t.role, t.text) for t in r.turns] == own and r.n_turns == len(own)
        assert r.learned == "".join(t for role, t in own if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.loss for s in r.segments] == [False, *(x for role, _ in own for x in (False, role == "assistant", False))]
        for s in r.segments[2::3]:
            assert not any(m in s.text for m in template.marks())


def test_layout(spark):
    r = formatted(spark, [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "hi"), (1, 2, "tool", None)])[1]
    assert r.formatted == "<s>[INST]hi[/INST][OUT]<\\/s>[\\INST] ok [\\/INST]</s>[ROLE]tool[/ROLE][TURN][/TURN]"
    assert not r.valid and r.bad_turn == 3


@pytest.mark.parametrize("roles,bad", [
    ("ua", 0), ("sua", 0), ("uaua", 0), ("suaua", 0), ("u", 2), ("s", 2), ("a", 1), ("su", 3), ("sa", 2), ("uu", 2), ("uaa", 3), ("usa", 2), ("uas", 3), ("ux", 2), ("uauu", 4),
])
def test_turn_order(spark, roles, bad):
    name = {"u": "user", "a": "assistant", "s": "system", "x": None}
    r = formatted(spark, [(1, i, name[x], "t") for i, x in enumerate(roles)])[1]
    assert (r.bad_turn, r.valid) == (bad, bad == 0)


def test_another_template(spark):
    template = chat.Template(
        begin="<|begin|>", roles={"human": chat.Marks("<|human|>", "<|end|>"), "model": chat.Marks("<|model|>", "<|stop|>", True)}, role=chat.Marks("<|as|>", "<|says|>"), other=chat.Marks("<|turn|>", "<|done|>"),
        start="0", moves={("0", "human"): "1", ("1", "model"): "0"}, ends=("0",),
    )
    r = formatted(spark, [(1, 0, "human", "<|stop|>"), (1, 1, "model", "a\\b<|end|>")], template)[1]
    assert r.formatted == "<|begin|><|human|><\\|stop|><|end|><|model|>a\\b<\\|end|><|stop|>" and r.valid and r.learned == "a\\b<|end|>"
    assert [(t.role, t.text) for t in r.turns] == [("human", "<|stop|>"), ("model", "a\\b<|end|>")]


def test_awkward_rows(spark):
    long_text = "w [INST] " * 100_000
    rows = [(None, 0, "user", "n"), (None, None, None, None), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "user", long_text), (3, 1, "assistant", ""), (4, 0, None, None)]
    got = formatted(spark, [(*r, "t", 9, "f") for r in rows], schema=SCHEMA + ", t string, segments int, formatted string")
    assert [(t.role, t.text) for t in got[None].turns] == [("", ""), ("user", "n")]
    assert [t.text for t in got[2].turns] == ["a", "a", "b"]
    assert got[3].turns[0].text == long_text and got[3].valid and got[3].learned == ""
    assert got[4].formatted == "<s>[ROLE][/ROLE][TURN][/TURN]"
    assert formatted(spark, []) == {}
