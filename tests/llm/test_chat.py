import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat

nasty = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<\\|", "<|", "|>", "\\", "\n", "n", "<", "a", "<\\n", "é", "assistant"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(nasty, nasty), max_size=4))
def test_any_turns_come_back(turns):
    formatted = chat.formatted_text(chat.render(r, t) for r, t in turns)
    parsed = list(chat.parse(formatted))
    assert [(r, t) for r, t, _, _ in parsed] == turns
    for (_, text), (_, _, start, end) in zip(turns, parsed, strict=True):
        assert chat.unescape_text(formatted[start:end]) == text


def test_plain_text_is_not_changed():
    assert chat.render("user", "a < b | c <|x|>") == "<|im_start|>user\na < b | c <|x|><|im_end|>\n"


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\nabc", "<|im_start|>user\nabc<|im_end|>", "<|im_start|>u\na<|im_start|>b<|im_end|>\n"])
def test_other_text_is_refused(bad):
    with pytest.raises(chat.Grammar):
        list(chat.parse(bad))


def test_digests_of_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é<|im_end|>"), (2, 1, None, None), (2, None, "assistant", "first"), (None, 0, "user", "x"), (1, 2, "assistant", "b"), (1, 2, "assistant", "b")]
    turns = chat.conflicting(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {-1, 1, 2, None}
    one = got[1]
    assert one.n_turns == 4 and one.turns_sha256 == sha("user\nhi\nassistant\né<|im_end|>\nassistant\nb\nassistant\nb\n")
    assert one.loss_chars == 13 and one.loss_sha256 == sha("é<|im_end|>bb")
    assert got[2].turns_sha256 == sha("assistant\nfirst\n\n\n")
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == sha("<|im_end|><|im_start|>assistant ok")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty)).count() == 0
