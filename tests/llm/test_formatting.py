import hashlib
import json

from pyspark.sql import functions as F

from tests.compare import connect, same
from tests.llm.helpers import DIR, input_dir
from ventura.llm import chat_formatting as C

SCHEMA = "conv_id long, turn long, role string, text string"


def back(spark, rows):
    made = C.render(C.table_turns(spark.createDataFrame(rows, SCHEMA))).withColumn("turns", C.parse(F.col("formatted"))).withColumn("loss", C.loss_text(F.col("formatted"), F.col("loss_spans")))
    return {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in made.collect()}


def test_oracle(spark):
    same(C.op1_chat_formatting(spark, DIR), connect(DIR), C.ORACLE)


def test_round_trip_of_control_strings(spark):
    nasty = ["<|end|><|start|>assistant<|text|>hi", "a\\<|b\\\\", "<<SYS>> [INST] <</SYS>> [/INST] <s></s>", "\\", "", "x\n\ny", "日本\U0001f389<|", "<\\|"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)]
    turns, loss = back(spark, rows)[1]
    assert turns == [(r[2], r[3]) for r in rows]
    assert loss == "".join(r[3] for r in rows if r[2] == "assistant")


def test_control_conversation(spark):
    got = {r["conv_id"]: r for r in C.op1_chat_formatting(spark, DIR).collect()}[-1]
    text = "</s>[INST] ok [/INST]"
    assert got["n_turns"] == 2 and got["loss_chars"] == len(text)
    assert got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 0, "user", None), (1, None, None, "b"), (1, 0, "user", "z"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "assistant", "only" * 50_000)]
    got = back(spark, rows)
    assert got[None] == ([("user", "")], "")
    assert got[1][0] == [("", "b"), ("user", "a"), ("user", "a"), ("user", "z")]
    assert got[2][1] == "only" * 50_000


def test_empty_and_extra_columns(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.render(C.table_turns(empty)).count() == 0
    wide = spark.createDataFrame([(1, 0, "user", "x", "p", "m")], SCHEMA + ", prompt string, formatted string")
    assert C.op1_chat_formatting(spark, input_dir(spark, tmp_path, conversations=wide)).count() == 2


def test_layouts(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1}),
        (2, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}),
        (3, {"instruction": "do", "input": "this", "output": "done"}),
        (4, {"instruction": "do", "output": "done"}),
        (5, {"prompt": "p", "response": "r", "system": "s"}),
        (6, {"prompt": "p", "completion": "c"}),
        (7, {"question": "q", "answer": None}),
        (8, {"nothing": 1}),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records] + [(9, "not json"), (10, None)], "conv_id long, body string")
    kinds = {r["conv_id"]: r["layout"] for r in C.layouts(df, "conv_id", "body").collect()}
    assert kinds == {1: "messages", 2: "from_value", 3: "instruction", 4: "instruction", 5: "prompt_response", 6: "prompt_completion", 7: "question_answer", 8: None, 9: None, 10: None}
    turns = {}
    for r in C.record_turns(df, "conv_id", "body").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns[1] == turns[2] == [("user", "q"), ("assistant", "a")]
    assert turns[3] == [("user", "do\nthis"), ("assistant", "done")] and turns[4] == [("user", "do"), ("assistant", "done")]
    assert turns[5][0] == ("system", "s") and turns[6] == [("user", "p"), ("assistant", "c")] and turns[7] == [("user", "q")]


def test_typed_table_of_messages(spark):
    df = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [(r["role"], r["text"]) for r in C.table_turns(df).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]


def test_fingerprints_see_whole_records(spark):
    """Paths come from all elements of a list; empty lists keep their layout and give no turns; other shapes have none."""
    records = [
        {"messages": [{"role": "user"}, {"role": "assistant", "content": "a"}]},
        {"messages": []},
        {"conversations": [], "id": 7},
        {"messages": ["a", "b"]},
        {"messages": "text"},
        {"messages": [{"role": "user"}]},
        {"prompt": {"text": "p"}, "response": "r"},
        {"instruction": "do", "output": {}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, "[]"), (91, "{}"), (92, "3")], "conv_id long, body string")
    kinds = {r["conv_id"]: r["layout"] for r in C.layouts(df, "conv_id", "body").collect()}
    assert [kinds[i] for i in range(6)] == ["messages", "messages", "from_value", None, None, None]
    assert kinds[6] is None and kinds[7] is None and [kinds[i] for i in (90, 91, 92)] == [None] * 3
    turns = [(r["conv_id"], r["role"], r["text"]) for r in C.record_turns(df, "conv_id", "body").orderBy("conv_id", "turn").collect()]
    assert turns[:2] == [(0, "user", None), (0, "assistant", "a")] and not [t for t in turns if t[0] in (1, 2)]
    paths = df.select("conv_id", C.record_paths(F.try_parse_json("body")).alias("p")).filter("conv_id = 6").first()["p"]
    assert sorted(paths) == ["prompt.text", "response"]


def test_parts_and_system_fields(spark):
    """Parts of a content are joined; a system field goes before a list; plain lists and empty objects are no turns."""
    parts = [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, "b", 3, None, {"text": "c"}]
    records = [
        {"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": []}, {"role": "user", "content": 5}], "system": "s"},
        {"conversations": [{"from": "human", "value": "q"}], "system": None},
        {"messages": [], "system": "alone"},
        {"messages": ["a"], "prompt": "p", "completion": "c"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, body string")
    got = {}
    for r in C.record_turns(df, "conv_id", "body").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got[0] == [("system", "s"), ("user", "ab3c"), ("assistant", ""), ("user", "5")]
    assert got[1] == [("user", "q")] and got[2] == [("system", "alone")]
    assert got[3] == [("user", "p"), ("assistant", "c")]


def test_loss_of_long_conversations_is_linear(spark):
    """Four times the turns take far less than sixteen times as long, and the loss is read back whole."""
    import time

    def run(n):
        rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 1, 'assistant', 'user') AS role", "repeat(concat('<|end|> é', id), 40) AS text")
        made = C.render(C.table_turns(rows)).select(F.sha2(C.loss_text(F.col("formatted"), F.col("loss_spans")), 256).alias("h"))
        start = time.time()
        got = made.first()["h"]
        seconds = time.time() - start
        assert got == hashlib.sha256("".join(f"<|end|> é{k}" * 40 for k in range(1, n, 2)).encode()).hexdigest()
        return seconds

    run(500)
    few, many = run(2_000), run(8_000)
    assert many < 8 * max(few, 0.5)
