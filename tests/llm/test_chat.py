import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle_check import compare, connect
from panelweave.llm import chat
from panelweave.llm.queries import ORACLES, QUERIES

T = chat.Template()
TEXT = st.lists(st.sampled_from([*T.control, "\\", "<", "|", "a", "é", "\n", " ", "[", "s>", "😀", "|end|>", "user"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=4))
def test_rendering_is_reversible(turns):
    rendered, _ = T.render(turns)
    assert T.parse(rendered) == turns
    ids, offsets = chat.encode(rendered, T)
    assert chat.decode(ids.tolist(), T) == rendered


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), TEXT), min_size=1, max_size=5))
def test_mask_covers_the_trained_text_exactly(turns):
    rendered, spans = T.render(turns)
    ids, offsets = chat.encode(rendered, T)
    mask = chat.loss_mask(offsets, [s for s, (r, _) in zip(spans, turns) if r == "assistant"])
    parts = chat.decode(ids[mask].tolist(), T).split(T.end)[:-1]
    assert [T.unescape(p) for p in parts] == [t for r, t in turns if r == "assistant"]
    slow = [any(a < e and s < b for a, b in [s for s, (r, _) in zip(spans, turns) if r == "assistant"]) for s, e in offsets.tolist()]
    assert mask.tolist() == slow


def test_unsafe_templates_are_refused():
    for bad in (dict(turn="<"), dict(end="a\\b"), dict(turn="|>x", reserved=("<|>",))):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_long_conversations_in_pieces(spark, monkeypatch):
    rows = [(i % 3 if i % 5 else 0, i, "assistant" if i % 2 else "user", f"turn {i} é") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "PIECE", 60)
    for r in chat.read_back(chat.format_pieces(df)).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_query(spark):
    con = connect("/root/testdata/sf0.001")
    assert compare(spark, con, QUERIES["op2_chat_format"], ORACLES["op2_chat_format"], "/root/testdata/sf0.001")[0]


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, part int, rendered string"
    rows = [(None, None, None, None, 1, "x"), (1, None, "assistant", None, 1, "x"), (1, 0, "user", "", 1, "x"), (1, 0, "user", "", 1, "x"), (2, 0, "assistant", "lang " * 100_000, 1, "x")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_pieces(spark.createDataFrame(rows, schema))).collect()}
    assert got[None].n_turns == 1 and got[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert got[1].n_turns == 3 and got[1].loss_chars == 0
    assert got[2].loss_chars == 500_000
    assert chat.read_back(chat.format_pieces(spark.createDataFrame([], schema))).count() == 0
    assert np.array_equal(chat.loss_mask(np.zeros((0, 2), np.int64), []), np.zeros(0, bool))
