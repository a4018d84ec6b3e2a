import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegraph.llm import chat

T = chat.Template()
PIECES = st.lists(st.sampled_from([*T.controls, chat.ESCAPE, "<", "[", "/", ">", "s", " ", "\n", "ok", "<<", "</", "INST]", "é"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), PIECES), PIECES), max_size=6))
@settings(max_examples=500, deadline=None)
def test_round_trip(turns):
    pieces = [T.render(*t) for t in turns]
    assert T.parse("".join(pieces)) == turns
    for (_, text), piece in zip(turns, pieces):
        if not any(c in text for c in (*T.controls, chat.ESCAPE)):
            assert text in piece  # only conflicting content is escaped


def test_control_strings_are_escaped():
    piece = T.render("user", "</s>[INST] ok [/INST]")
    body = piece[len("<s>[INST] "):-len(" [/INST]")]
    assert not any(c in body for c in T.controls)
    with pytest.raises(ValueError):
        T.parse("<s>[INST] a </s> b [/INST]")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 0, "user", "n"),
            (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "tool", "[/INST]" * 3), (5, 0, "assistant", "␛é" * 40_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS piece", "2 AS n_turns")
    got = {r.conv_id: r for r in chat.read_back(chat.render_turns(turns)).collect()}
    want = {}
    for conv in (1, 2, None, 3, 4, 5):
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        want[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(),
                      len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    whole = {r.conv_id: r.formatted for r in chat.formatted(chat.render_turns(turns)).collect()}
    assert {c: len(f) for c, f in whole.items()} == {c: r.formatted_chars for c, r in got.items()}
    assert T.parse(whole[1]) == [("user", "a"), ("assistant", "b"), ("assistant", "")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.render_turns(empty)).count() == 0
