import pytest
from pyspark.sql import functions as F

from gapkit.llm.chat_format import ChatTemplate, Role, formatted, loss_text, read_turns

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = ["", "\\", "\\\\", "### ", "#### Assistant: x", "</turn>", "<</turn>\n### User: hi</turn>", "\\### Assistant: </turn> ok", "a\\</turn>",
        "<\\/turn>", "#\\## User: ", "</turn", "</tur</turn>n>", "$1 \\1 \\$", "line\nline\r\n\x85end", "🙂 é", "<", "#", "x: y: z", "\x00"]


def chats(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def read(df):
    """Turns and learned text as the output gives them."""
    return {r["conv_id"]: r for r in df.select(
        "*", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss")).collect()}


def test_round_trip_of_hard_texts(spark):
    rows = [(c, i, ("user", "assistant", "tool", "odd: role", "")[(c + i) % 5], HARD[(c * 7 + i * (c + 1)) % len(HARD)])
            for c in range(20) for i in range(6)]
    got = read(formatted(chats(spark, rows)))
    for c in range(20):
        turns = [(r[2], r[3]) for r in rows if r[0] == c]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(x for role, x in turns if role == "assistant")
        assert got[c]["formatted"] == "".join(s["text"] for s in got[c]["segments"]) and len(got[c]["segments"]) == 3 * len(turns)
        assert got[c]["n_turns"] == len(turns)
        for s in got[c]["segments"][1::3]:
            assert "### " not in s["text"] and "</turn>" not in s["text"]


def plain_machine(roles, t=ChatTemplate()):
    state, bad = "start", None
    for i, role in enumerate(roles):
        to = t.moves.get((state, role))
        bad = i if to is None and bad is None else bad
        state = to or state
    return bad is None and state in t.ends, bad


def test_machine(spark):
    orders = [["user", "assistant"], ["system", "user", "assistant", "user", "assistant"], ["assistant"], ["user", "user", "assistant"], ["user"],
              ["user", "assistant", "system", "user"], ["user", "assistant", "tool", "tool", "assistant"], ["system"], ["judge", "user", "assistant"]]
    rows = [(c, i, role, "t") for c, roles in enumerate(orders) for i, role in enumerate(roles)]
    got = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in formatted(chats(spark, rows)).collect()}
    assert got == {c: plain_machine(roles) for c, roles in enumerate(orders)}
    assert {v for v, _ in got.values()} == {True, False}


def test_nulls_ties_and_long_texts(spark):
    assert formatted(chats(spark, [(1, 0, "user", "x")]).limit(0)).collect() == []
    long = "\\</turn>### x " * 100_000
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "assistant", "n"), (2, 5, "assistant", long),
            *((3, i, ("user", "assistant")[i % 2], f"{i}</turn>") for i in range(20_000))]
    df = chats(spark, rows)
    for name in ("turns", "segments", "machine", "n_turns", "formatted", "valid", "state"):
        df = df.withColumn(name, F.lit("clash"))
    got = read(formatted(df))
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None]["loss"] == "n" and got[2]["loss"] == long
    assert [t["text"] for t in got[3]["turns"]] == [f"{i}</turn>" for i in range(20_000)]


def test_other_templates(spark):
    t = ChatTemplate(roles={"user": Role("U", learned=True)}, open="<|", mid="|>", close="<end>", after="", moves={("start", "user"): "start"}, ends=("start",))
    rows = [(1, 0, "user", "<|x|> <end>"), (1, 1, "other", "y")]
    r = formatted(chats(spark, rows), t).select("*", read_turns(F.col("formatted"), t).alias("turns"), loss_text(F.col("segments")).alias("loss")).first()
    assert [(x["role"], x["text"]) for x in r["turns"]] == [("user", "<|x|> <end>"), ("other", "y")]
    assert r["loss"] == "<|x|> <end>" and not r["valid"] and r["bad_turn"] == 1


@pytest.mark.parametrize("change", [
    {"close": "\\end"}, {"close": "x"}, {"open": "aba"}, {"close": "### end"}, {"roles": {"a": Role("A"), "b": Role("A")}}, {"roles": {"a": Role("x41")}},
    {"roles": {"a": Role("a: b")}}, {"roles": {"a": Role("say </turn>")}}])
def test_templates_that_could_not_be_read_back_are_refused(change):
    with pytest.raises(ValueError):
        ChatTemplate(**change)
