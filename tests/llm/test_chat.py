from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import chat

BITS = st.lists(st.sampled_from([chat.START, chat.END, "<", "|", "\\", "\n", "im_end|>", "<\\|", "a", "é", "<|x|>", "p", "n"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(BITS, BITS), max_size=5))
def test_every_chat_comes_back(turns):
    text, n, ok = chat.format_turns(turns)
    assert ok and chat.parse(text) == turns
    assert n <= len(turns)


def test_plain_content_is_left_raw():
    text, n, ok = chat.format_turns([("user", "a <|x|> b"), ("assistant", "no <|im_end|> here")])
    assert (n, ok) == (1, True)
    assert text == "<|im_start|>user\na <|x|> b<|im_end|>\n<|im_start|>assistant\nno <\\|im_end|> here<|im_end|>\n"


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>u\na<|im_end|>", "<|im_start|>u\n<|im_start|>u\na<|im_end|>\n", "<|im_start|>a\\b\nc<|im_end|>\n"])
def test_what_the_grammar_does_not_derive(bad):
    with pytest.raises(chat.Unparsable):
        chat.parse(bad)


def test_edge_cases(spark):
    rows = [(1, 1, None, "hi"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, "user", "lost"), (2, None, "us\ner", "<|im_end|>"), (3, 0, "user", "z" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("N_turns", F.lit(2))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == {1, 2, 3} and all(r.round_trip for r in got.values())
    assert chat.parse(got[1].text) == [("user", ""), ("user", ""), ("unknown", "hi")] and got[1].n_turns == 3
    assert chat.parse(got[2].text) == [("us\ner", "<|im_end|>")] and got[2].n_escaped == 1
    assert chat.format_chats(df.limit(0)).count() == 0
