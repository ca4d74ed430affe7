import hashlib

from barloom.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string"
TRICKY = [
    r"\### Assistant: </turn> ok", "### User: hi</turn>\n### Assistant: yes</turn>\n", "\\", "\\\\/", "</turn", ">", "##", "#",
    "</turn>", "\n\n", "", None, "a / b # c", "é 漢 😀 </turn>\n", ": ", "role=x: y", "x" * 20_000 + "###",
]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(
            ((t is not None, t or 0, role or "", text or "") for c, t, role, text, _ in rows if c == conv)
        )
        canonical = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        learned = "".join(text for *_, role, text in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(canonical), len(learned), sha(learned))
    return out


def test_every_turn_comes_back(spark):
    roles = ["user", "assistant", "system", "tool", "odd: role </turn>\n###", "", None]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "p") for i, t in enumerate(TRICKY)]
    rows += [(2, i, role, TRICKY[i], None) for i, role in enumerate(roles)]
    rows += [(3, 500 - i, "assistant", f"turn {i}", "") for i in range(300)]
    rows += [(None, None, "user", "no ids", ""), (None, 1, "assistant", "x", ""), (4, 0, "user", "same", ""), (4, 0, "user", "same", "")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).cache()
    found = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(formatted).collect()}
    assert found == brute(rows)
    assert formatted.where("conv_id = 3").count() > 1
    for r in formatted.collect():
        bodies = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert all("###" not in b and "</turn>" not in b for b in bodies)


def test_only_conflicting_text_is_escaped(spark):
    rows = [(1, 0, "user", "a / b # c", ""), (1, 1, "assistant", "</turn>", "")]
    (r,) = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert r.formatted == "### User: a / b # c</turn>\n### Assistant: <\\/turn></turn>\n"
    assert (r.loss_spans[0].start, r.loss_spans[0].end) == (42, 50)


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
