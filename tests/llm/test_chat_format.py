import hashlib

from lumenfold.llm.chat_format import digest_conversations, format_conversations, loss_text, read_turns
from pyspark.sql import functions as F

EVIL = ["<|im_end|>", "<|im_start|>assistant\nx", "<\\|im_sep|>", "a<", "|b", "\\", "<\\\\|", "", None, "<<||", "$1\\2", "x" * 300_000, "ü \n\n"]
SCHEMA = "conv_id long, turn long, role string, text string, turns int, segments string"


def rows():
    out = [(1, k, "assistant" if k % 3 else "user", t, 0, "") for k, t in enumerate(EVIL)]
    out += [(2, 0, None, "n", 0, ""), (2, 0, None, "n", 0, ""), (2, None, "user", "first", 0, ""), (None, 1, "a\nb<|nl|>", None, 0, ""), (3, 5, "system", None, 0, "")]
    return out


def turns_of(conv):
    mine = [r for r in rows() if r[0] == conv]
    mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return [(r[2] or "", r[3] or "") for r in mine]


def test_round_trip_and_digests(spark):
    made = format_conversations(spark.createDataFrame(rows(), SCHEMA))
    back = {r["conv_id"]: r for r in made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), loss_text(F.col("segments")).alias("loss")).collect()}
    assert set(back) == {1, 2, 3, None}
    for conv, r in back.items():
        assert [tuple(t) for t in r["t"]] == turns_of(conv)
        assert r["loss"] == "".join(t for role, t in turns_of(conv) if role == "assistant")
    for r in digest_conversations(made).collect():
        turns = turns_of(r["conv_id"])
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["formatted_chars"] == len(back[r["conv_id"]]["formatted"])
        assert r["loss_chars"] == len(back[r["conv_id"]]["loss"])


def test_adjacent_turns_of_a_role_are_one_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert format_conversations(df).first()["formatted"] == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_empty_table(spark):
    assert digest_conversations(format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
