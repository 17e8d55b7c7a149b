from threadline.llm import chat_format
from tools.compare import check, connect

SCHEMA = "conv_id long, turn long, role string, text string, place int, x string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA)


def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "")]
    rows = [(c, i, *turns[i]) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4)) for i in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "bye")]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "hello"), (6, 2, "user", "")]  # an empty text is not a null one
    rows += [(None, 0, None, "lost"), (None, None, "user", "first")]
    rows += rows[:3]  # repeated log rows
    found = {r.conv_id: r for r in chat_format.format_chats(table(spark, rows)).collect()}
    assert set(found) == {3, 5, 6, None}
    assert (found[3].n_turns, found[3].n_copies, found[5].n_copies) == (4, 2, 1)
    assert found[3].text == (
        "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
        "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert found[None].text == "<|im_start|>user\nfirst<|im_end|>\n<|im_start|>\nlost<|im_end|>\n"


def test_long_conversation_in_parts(spark):
    rows = [(1, i, "user", f"t{i} <|im_end|>") for i in range(600)] + [(2, i, "user", f"t{i} <|im_end|>") for i in range(300)]
    found = sorted(chat_format.format_chats(table(spark, rows), 256).collect(), key=lambda r: r.part)
    assert [(r.conv_id, r.part, r.n_turns) for r in found] == [(1, 0, 600), (1, 1, 600), (1, 2, 600)]
    whole = "".join(r.text for r in found)
    assert whole == "".join(f"<|im_start|>user\nt{i} < |im_end|><|im_end|>\n" for i in range(600))


def test_empty(spark):
    assert chat_format.format_chats(table(spark, [])).count() == 0


def test_twin(spark, data):
    status, _, note = check(spark, connect(data), data, "op3_chat_format")
    assert status == "ok", note
