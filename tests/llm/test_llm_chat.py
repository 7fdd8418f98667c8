from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from trustframe.llm import chat_format

ODD = ["<|im_end|>", "<\\|", "<\\\\|x", "<|<|", "a<", "|im_start|>", "\\n", "\n", "", None, "<|part|>", "é\U0001f600", "<\\"]


def rows(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (
        kind, text, ref, width, height, seconds, pages
    )
    made = [
        (1, i, "user" if i % 2 else "assistant", [part("text", a), part("text", b)]) for i, (a, b) in enumerate((a, b) for a in ODD for b in ODD)
    ]
    made += [
        (2, 0, "us\\n\ner<|x", [part("image", ref="r1", width=57, height=28), part("text", "mid"), part("audio", ref="r2", seconds=1.5)]),
        (2, 1, "assistant", [part("document", ref="r3", pages=2), part("hologram", ref="r4"), part(None)]),
        (3, None, None, None),
        (3, 5, "assistant", []),
        (3, 5, "assistant", []),
        (None, 0, "user", [part("text", "no id")]),
    ]
    return spark.createDataFrame(made, f"conv_id long, turn long, role string, parts array<{chat_format.PART_TYPE}>")


def test_texts_and_roles_come_back_and_control_strings_are_the_templates_own(spark):
    frame = rows(spark)
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(frame.withColumn("rows", F.lit("extra")))).collect()}
    for conv, found in back.items():
        source = [r for r in frame.collect() if r.conv_id == conv]
        assert len(found.turns) == len(source)
        assert found.formatted.count("<|im_start|>") == found.formatted.count("<|im_end|>") == len(source)
    turns = back[1].turns
    for turn, source in zip(turns, [r for r in frame.collect() if r.conv_id == 1]):
        assert (turn.role, turn.text) == (source.role, "".join(p.text or "" for p in source.parts))
    assert back[1].loss_text == "".join(t.text for t in turns if t.role == "assistant")
    assert back[2].turns[0].role == "us\\n\ner<|x"
    assert [(a.turn_no, a.number, a.type, a.ref, a.tokens) for a in back[2].attachments] == [
        (0, 1, "image", "r1", 3), (0, 3, "audio", "r2", 38), (1, 1, "document", "r3", 1024), (1, 2, "hologram", "r4", 0), (1, 3, None, None, 0),
    ]
    assert [t.role for t in back[3].turns] == ["", "assistant", "assistant"]


def test_loss_spans_are_code_points_of_the_output(spark):
    for r in chat_format.format_conversations(rows(spark)).collect():
        cut = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert all(r.formatted[: s.start].endswith("<|im_start|>assistant\n") for s in r.loss_spans)
        assert all(r.formatted[s.start + s.length :].startswith("<|im_end|>\n") for s in r.loss_spans), cut


def test_planted_conversation(spark):
    found = chat_format.chat_query(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = chat_format.PLANTED
    assert found.n_turns == 2 and found.loss_chars == len(text)
    assert found.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert found.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_empty_table(spark):
    assert chat_format.format_conversations(rows(spark).limit(0)).count() == 0
