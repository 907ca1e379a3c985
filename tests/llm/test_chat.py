import random

import duckdb
from pyspark.sql import functions as F

from tidewire.llm import chat_format as chat

EVENTS = "conv_id int, seq int, message int, kind string, role string, text string"


def render(spark, events):
    return chat.render(chat.fold(spark.createDataFrame(events, EVENTS)))


def test_fold(spark):
    events = [
        (1, 0, 0, "message", "user", "first"), (1, 5, 0, "edit", None, "edited"),
        (1, 1, 1, "message", "assistant", ""), (1, 2, 1, "delta", None, "wrong"), (1, 3, 1, "regenerate", None, None),
        (1, 7, 1, "delta", None, "lo"), (1, 6, 1, "delta", None, "hel"),
        (2, 0, 0, "delta", None, "no role"), (None, None, None, "message", None, None)]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns]
           for r in render(spark, events).select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("user", "edited"), ("assistant", "hello")], 2: [("", "no role")], None: [("", "")]}


def test_texts_come_back_as_they_were(spark):
    r = random.Random(1)
    pieces = ["<|im_end|>", "<|im_start|>", "\n", "\\", "<", "|", "\\|", "<\\|", "\\n", "n", "é", "assistant", ">", "<|", ""]
    events, want = [], {}
    for c in range(200):
        turns = [("".join(r.choices(pieces, k=r.randint(0, 3))) if c % 2 else r.choice(["user", "assistant"]),
                  "".join(r.choices(pieces, k=r.randint(0, 6)))) for _ in range(r.randint(1, 4))]
        want[c] = turns
        events += [(c, k, k, "message", role, text) for k, (role, text) in enumerate(turns)]
    out = render(spark, events).select("*", chat.parsed(F.col("formatted")).alias("turns")).collect()
    assert {x.conv_id: [(t.role, t.text) for t in x.turns] for x in out} == want
    for x in out:
        assert "".join(s.text for s in x.segments) == x.formatted
        learned = [s.text for s in x.segments if s.loss]
        assert len(learned) == sum(role == "assistant" for role, _ in want[x.conv_id])


def test_repeated_and_null_rows_are_messages(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (1, None, "system", "s"), (None, 0, None, None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[-1].n_turns) == (4, 0, 1, 2)


def test_a_text_said_again_at_another_turn_is_another_message(spark, tmp_path):
    rows = [(1, 0, "user", "ok"), (1, 1, "assistant", "yes"), (1, 2, "user", "ok"), (1, 3, "assistant", ""), (1, 4, "user", ""),
            (1, 5, "assistant", "yes"), (1, 6, "assistant", ""), (1, 7, "user", None), (1, 8, "user", None), (1, 8, "user", "ok"),
            (1, None, "user", "ok"), (2, 0, "user", "ok"), (None, 0, None, "x"), (None, 1, None, "x")]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(chat.ORACLE)
    df = chat.query(spark, str(tmp_path)).select([d[0] for d in want.description])
    got = {r.conv_id: tuple(r) for r in df.collect()}
    assert got == {r[0]: r for r in want.fetchall()}
    assert (got[1][1], got[1][3], got[None][1]) == (11, 6, 2)


def test_empty_log(spark):
    assert render(spark, []).count() == 0


def test_native(spark):
    plan = chat.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
