"""Every conversation id is one of its own, null too."""

from quillspark.llm import chat


def test_the_least_id_and_none_are_two_conversations(spark):
    rows = [(-(2**63), 0, "user", "a"), (None, 0, "user", "b"), (None, 1, "assistant", "c"), (0, 0, "user", "d"), (2**63 - 1, 0, "user", "e")]
    done = chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in done.collect()} == {-(2**63): (1, 0), None: (2, 1), 0: (1, 0), 2**63 - 1: (1, 0)}
