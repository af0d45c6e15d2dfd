import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat

RECORDS = [
    ("messages", {"messages": [{"role": "user", "content": "a<|end|>\n"}, {"role": "assistant", "content": "<\\|turn|> [\\\\INST] <|turn|"}]}),
    ("conversations", {"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": ""}]}),
    ("prompt", {"prompt": "p", "response": "</s>[INST] ok [/INST]"}),
    ("completion", {"prompt": "p", "completion": "c"}),
    ("instruction", {"instruction": "i", "input": "", "output": "😀<s>"}),
    ("messages", {"messages": []}),
    ("nested", {"dialog": {"system": "s", "turns": [{"speaker": "user", "text": "<"}, {"speaker": "assistant", "text": "[INST][INST]<<|end|>"}]}}),
    (None, {"odd": 1}), (None, {"messages": [{"role": "user"}]}),
]


def test_layouts_and_round_trip(spark):
    rows = [(i, json.dumps(r)) for i, (_, r) in enumerate(RECORDS)] + [(100, "no json"), (101, None), (102, "")]
    made = chat.canonical(spark.createDataFrame(rows, "id long, record string"))
    turns = {r.id: r for r in made.collect()}
    assert [turns[i].layout for i in range(len(RECORDS))] == [name for name, _ in RECORDS]
    assert [t.role for t in turns[1].turns] == ["user", "assistant"] and [t.role for t in turns[6].turns] == ["system", "user", "assistant"]
    assert turns[100].layout is None and turns[100].turns == [] and turns[101].turns == []
    for r in chat.parsed(chat.formatted(made, "id")).collect():
        assert r.turns == turns[r.id].turns
        assert r.loss_text == "".join(t.text for t in turns[r.id].turns if t.role == "assistant")
        for s in r.loss:
            assert not set(r.formatted[s.start:s.start + s.length].split("\n")) & {"<|turn|>assistant"}


def test_rows_per_turn(spark):
    rows = [(1, 1, "assistant", "A"), (1, 0, "user", None), (2, 0, None, "no role"), (2, 0, None, "no role"), (3, 0, "system", "S"), (3, 1, "user", "U"), (3, 2, "assistant", "x" * 100_000),
            (None, None, "a\nb", "odd role"), (4, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.parsed(chat.formatted(chat.canonical(chat.records_of_rows(df)), "conv_id")).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", ""), ("assistant", "A")] and [(t.role, t.text) for t in back[2].turns] == [("", "no role")] * 2
    assert back[3].loss_text == "x" * 100_000 and [(t.role, t.text) for t in back[None].turns] == [("a\nb", "odd role")] and back[4].loss_text == ""
    assert chat.records_of_rows(df.limit(0)).count() == 0


def test_query_hashes(spark):
    import duckdb

    from tidemark.llm import queries

    sf, want = "/root/testdata/sf0.001", {}
    for c, _, role, text in sorted(duckdb.sql(f"SELECT conv_id, turn, coalesce(role, ''), coalesce(text, '') FROM '{sf}/conversations.parquet'").fetchall()):
        want.setdefault(c, []).append((role, text))
    want[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = queries.op4_chat_format(spark, sf).collect()
    assert {r.conv_id for r in got} == set(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        loss = "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(want[r.conv_id]), sha("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id])), len(loss), sha(loss))
        assert r.formatted_chars >= len(loss)


@pytest.mark.parametrize("size", [6, 24])
def test_conversations_beyond_a_variant(spark, size):
    """Texts of 6 MB fit a variant, longer ones are read from the record's text; every layout comes back whole."""
    piece = 'wörd "quoted" \\ back\n'
    times = (size << 20) // len(piece.encode())
    records = [
        {"messages": [{"role": "user", "content": "@"}, {"role": "assistant", "content": "yes"}]}, {"prompt": "p", "response": "@"},
        {"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "@"}]}, {"dialog": {"system": "s", "turns": [{"speaker": "user", "text": "@"}]}},
        {"instruction": "i", "input": "@", "output": None}, {"messages": [{"role": "user", "content": "@", "name": "n"}]}, {"unknown": "@"},
    ]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, shape string").repartition(len(records))
    long = F.repeat(F.lit(json.dumps(piece)[1:-1]), times)
    rows = rows.select("id", F.concat(F.substring_index("shape", "@", 1), long, F.substring_index("shape", "@", -1)).alias("record"))
    turn = lambda t: F.struct(t["role"].alias("role"), F.length(t["text"]).alias("n"), F.sha2(t["text"], 256).alias("sha"))
    got = {r.id: r for r in chat.canonical(rows).select("id", "layout", F.transform("turns", turn).alias("turns")).collect()}
    sha = hashlib.sha256((piece * times).encode()).hexdigest()
    seen = lambda i: [(t.role, "long" if (t.n, t.sha) == (len(piece) * times, sha) else t.n) for t in got[i].turns]
    assert [got[i].layout for i in range(7)] == ["messages", "prompt", "conversations", "nested", "instruction", None, None]
    assert seen(0) == [("user", "long"), ("assistant", 3)] and seen(1) == [("user", 1), ("assistant", "long")] and seen(2) == [("user", 1), ("assistant", "long")]
    assert seen(3) == [("system", 1), ("user", "long")] and seen(4) == [("system", 1), ("user", "long"), ("assistant", 0)] and seen(5) == seen(6) == []
