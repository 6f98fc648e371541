"""Collapse of snapshots on small logs."""

from evalspark.llm import chat


def test_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", "bye")
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [c], 6: [("User", "hi"), ("assistant", "other")], 7: [(None, None)]}
    rows = [(k, i, r, t, "x") for k, turns in logs.items() for i, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "lost", "x"), (3, 1, *b, "repeated row"), (8, None, "user", "first", "x"), (8, 0, "user", "second", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, full string")
    out = {r.conv_id: (r.n_turns, r.copies, r.text) for r in chat.collapse(turns).collect()}
    assert out == {
        3: (3, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello <im_end><|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"),
        5: (1, 1, "<|im_start|>user\nbye<|im_end|>\n"),
        6: (2, 1, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"),
        7: (1, 1, "<|im_start|>unknown\n<|im_end|>\n"),
        8: (2, 1, "<|im_start|>user\nfirst<|im_end|>\n<|im_start|>user\nsecond<|im_end|>\n")}
    assert chat.collapse(turns.limit(0)).count() == 0


def test_long_conversation(spark):
    turns = spark.range(40_000).selectExpr("id % 2 as conv_id", "id div 2 as turn", "'user' as role", "cast(id div 2 as string) as text")
    turns = turns.where("conv_id = 0 or turn < 15000")
    assert [(r.conv_id, r.n_turns) for r in chat.collapse(turns).collect()] == [(0, 20_000)]
