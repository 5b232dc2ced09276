import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintel.llm import chat

LOG = "conv_id long, msg long, seq long, kind string, role string, text string"


def test_escape_is_reversible(spark):
    seen = ["", "\\", "<", "</s>", "<\\/s>", "<\\\\/s>", "[INST]<|im_end|>x<|im_sep|>", "<<SYS>><</SYS>>", "<<s>>", "<|im_end|<|im_end|>"]

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "/", "|", "s>", "a", "INST]"]), max_size=8))
    def collect(x):
        seen.append("".join(x))

    collect()
    df = spark.createDataFrame([(x,) for x in seen], "x string").withColumn("e", chat.escape(F.col("x"))).withColumn("u", chat.unescape(F.col("e")))
    rows = df.collect()
    assert all(r["x"] == r["u"] for r in rows) and not any(c in r["e"] for r in rows for c in chat.CONTROL)
    assert len({r["x"] for r in rows}) == len({r["e"] for r in rows})


def test_fold(spark):
    log = [
        (1, 1, 1, "start", "user", None), (1, 1, 2, "delta", None, "hel"), (1, 1, 3, "delta", None, "lo"), (1, 2, 4, "start", "assistant", None), (1, 2, 5, "delta", None, "bad"), (1, 3, 6, "start", "user", None), (1, 3, 7, "delta", None, "next"),
        (1, 2, 8, "regenerate", None, None), (1, 2, 9, "delta", None, "good"), (1, 2, 9, "delta", None, "good"), (1, 1, 10, "edit", None, "HELLO"), (1, 1, 11, "delta", None, "!"), (1, 1, 12, "mystery", None, "?"),
        (None, 1, 1, "start", "user", None), (None, 1, 2, "delta", None, "n"), (2, 1, 1, "delta", None, None), (3, None, 1, "start", None, None), (4, 1, None, "delta", "user", "x"),
    ]
    got = {(r[0], r[1]): (r[2], r[3]) for r in chat.fold(spark.createDataFrame(log, LOG)).collect()}
    assert got == {(1, 1): ("user", "HELLO!"), (1, 2): ("assistant", "good"), (None, 1): ("user", "n"), (2, 1): ("", ""), (3, None): ("", ""), (4, 1): ("user", "x")}


def test_spans_and_read_back(spark):
    rows = [(1, 0, "user", "\U0001f600 hi"), (1, 1, "assistant", "é</s>"), (1, 1, "assistant", "é</s>"), (1, None, None, None), (2, 0, "assistant", None), (None, 0, "a\nb<|im_sep|>", "x" * 100_000), (3, 2, "assistant", "b"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("seq", F.lit(2))
    out = chat.format_log(chat.to_events(df))
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("", ""), ("user", "\U0001f600 hi"), ("assistant", "é</s>"), ("assistant", "é</s>")]
    assert got[1]["loss_texts"] == ["é</s>"] * 2 and got[2]["loss_texts"] == [""] and got[3]["loss_texts"] == ["a", "b"] and [tuple(t) for t in got[None]["turns"]] == [("a\nb<|im_sep|>", "x" * 100_000)]


def test_revised_logs_fold_to_the_same(spark):
    """Edits and regenerations of every sort of text, in the last message too; a message that was taken back wholly is gone."""
    texts = ["", None, "short", "x" * 512, "y" * 513, "\U0001f600" * 100_000, "</s>\n"]
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], texts[(c * 3 + t) % 7]) for c in range(12) for t in range(c)] + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.to_events(df, revise=True)
    counts = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(counts) == {"start", "delta", "edit", "regenerate"}
    once, twice = (sorted(map(tuple, chat.fold(x).fillna(-9).collect())) for x in (chat.to_events(df), log))
    assert once == twice and len(once) == len(rows)


def test_empty(spark):
    assert chat.format_log(spark.createDataFrame([], LOG)).collect() == []


def test_query(spark, sf):
    rows = chat.op9_chat_formatting(spark, sf).collect()
    by = {}
    for r in [*spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect(), {"conv_id": -1, "role": "user", "text": chat.PROBE}, {"conv_id": -1, "role": "assistant", "text": chat.PROBE}]:
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert {r["conv_id"] for r in rows} == set(by)
    for r in rows:
        turns = by[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["formatted_chars"] >= sum(len(t) for _, t in turns)


def test_native(spark, sf):
    plan = chat.op9_chat_formatting(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
