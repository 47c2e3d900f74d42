import hashlib

from pyspark.sql import functions as F

from claimgrid.llm import chat, queries

SCHEMA = "conv_id long, message int, seq long, kind string, role string, text string, last string, turns int"


def test_fold_edits_and_regenerations(spark):
    rows = [(1, 1, 3, "delta", None, "lo"), (1, 1, 2, "delta", "user", "hel"), (1, 2, 4, "delta", "assistant", "draft"), (1, 2, 5, "regenerate", None, None), (1, 2, 6, None, None, "fi"), (1, 2, 7, "delta", None, "nal"),
            (2, 1, 1, "delta", "user", "x"), (2, 1, 2, "edit", None, "new"), (2, 1, 3, "delta", None, "!"), (2, 2, 9, "regenerate", "assistant", "void"), (None, 1, 1, "delta", None, None), (3, 1, None, "delta", "user", "early"), (3, 1, 1, "delta", "user", "late")]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {(1, 1): ("user", "hello"), (1, 2): ("assistant", "final"), (2, 1): ("user", "new!"), (2, 2): ("assistant", ""), (None, 1): ("", ""), (3, 1): ("user", "earlylate")}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    texts = ["<|end|>\n", "<\\|turn|>", "a<", "<|", "<\\\\|text|>x<|", "plain", "", "<\\<|>|", "$1 \\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape("t").alias("e"), chat.unescape(chat.escape("t")).alias("u"))
    for r in df.collect():
        assert r.u == r.t and "<|" not in r.e


def test_query_against_brute_force(spark, tmp_path):
    rows = [(1, 0, "system", "be <|end|>\nkind"), (1, 1, "user", None), (1, 2, "assistant", "é" * 3000), (1, 3, None, "who"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, None, "user", "first"), (None, 0, "assistant", "<|text|>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op2(spark, str(tmp_path)).collect()}
    extra = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows} | {-1}:
        own = sorted([(t is not None, t or 0, r or "", x or "") for c, t, r, x in rows + extra if c == conv])
        r = got.pop(conv)
        loss = "".join(x for *_, role, x in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{role}\n{x}\n" for *_, role, x in own)), len(loss), sha(loss))
    assert not got


def test_no_python_in_the_plan(spark):
    plan = queries.op2(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
