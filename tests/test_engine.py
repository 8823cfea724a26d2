import gzip
import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import text, tools
from corvane.operators import agent, chat, chunks, context, evaluate, retrieve, roles, store
from corvane.sources import readers, sinks


def test_white_space_is_pythons(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, t string").select("c", F.size(text.tokens(F.col("t"))).alias("n")).collect()
    assert {r.c for r in rows if r.n == 2} == {c for c in points if chr(c).isspace()}


def test_chunk_edges(spark):
    docs = spark.createDataFrame([(1, ""), (2, "abc"), (3, "abcd"), (4, "a😀bc"), (5, None), (6, "a\nb\nc")], "doc_id long, text string")
    got = {}
    for r in chunks.chunk(docs, 3).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {2: ["abc"], 3: ["abc", "d"], 4: ["a😀b", "c"], 6: ["a\nb", "\nc"]}
    with pytest.raises(ValueError):
        chunks.chunk(docs, 0)


def test_min_len_and_hooks(spark):
    rows = [(1, "  " + "a" * 19 + " "), (2, "b" * 20), (3, "c" * 19 + " "), (4, "d" * 19 + "\x1c")]
    df = spark.createDataFrame([(str(i), i, 0, t) for i, t in rows], "id string, doc_id long, seq int, text string")
    assert [r.doc_id for r in chunks.min_len(df).collect()] == [2]
    assert chunks.apply_filter(df, lambda t: F.when(t.startswith("b"), F.upper(t))).first().text == "B" * 20
    assert chunks.augment(df, lambda t: F.array(t, t)).count() == 8


def test_upsert_topk_store(spark, tmp_path):
    w = spark.createDataFrame([("x", "old", 1), ("y", "y1", 2), ("x", "new", 3)], "id string, text string, wseq long")
    assert [tuple(r) for r in store.upsert(w).orderBy("pos").collect()] == [("x", "new", 1), ("y", "y1", 2)]
    c = spark.createDataFrame([(1, 0, "x"), (2, 0, "x"), (3, 0, "y")], "doc_id long, seq int, text string")
    assert [(r.doc_id, r.score) for r in store.topk_single(c, "x", 3).collect()] == [(1, 1), (2, 1), (3, 0)]
    assert store.topk_single(c, "x", 0).count() == 0 and [r.doc_id for r in store.topk_single(c, "", 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        store.topk_single(c, "x", -1)
    s = store.ChunkStore(spark, str(tmp_path / "s"))
    s.add(w)
    s.add(spark.createDataFrame([("y", "y2", 1), ("z", "z1", 2)], "id string, text string, wseq long"))
    assert [(r.id, r.text) for r in s.all().collect()] == [("x", "new"), ("y", "y2"), ("z", "z1")]


def test_batch_topk_plans_agree(spark):
    c = spark.createDataFrame([(i, s, t) for i, s, t in [(1, 0, "a b c"), (1, 1, "b"), (2, 0, "c c d"), (3, 0, ""), (4, 0, "e")]], "doc_id long, seq int, text string").withColumn("id", F.concat("doc_id", F.lit("#"), "seq"))
    t = spark.createDataFrame([(1, "a b"), (2, "zzz"), (3, "c d e"), (4, "")], "item_id long, text string")
    a, b = (sorted(map(tuple, f(t, c, 3).collect())) for f in (retrieve.topk_batch, retrieve.topk_batch_cross))
    assert a == b and len(a) == 12
    ctx = {r.item_id: r.context for r in context.assemble(retrieve.with_text(retrieve.topk_batch(t, c, 2), c), t).collect()}
    assert ctx[1] == "[CHUNK 1#0 | doc=1]\na b c\n\n[CHUNK 1#1 | doc=1]\nb"
    none = c.where("false")
    assert {r.context for r in context.assemble(retrieve.with_text(retrieve.topk_batch(t, none, 2), none), t).collect()} == {""}


def test_sentences_and_loop(spark):
    t = spark.createDataFrame([(1, "Do a. Then b.. c . ", "ctx"), (2, "...", "ctx")], "item_id long, text string, context string")
    assert [r[0] for r in t.orderBy("item_id").select(text.sentences(F.col("text"))).collect()] == [["Do a", "Then b", "c"], []]
    never = agent.length_critic(10**6)
    r = {x.item_id: x for x in agent.run(t, agent.Loop(critic=never)).collect()}
    assert r[1].iters == 3 and len(r[1].final_context) == 3 + 3 * 35 and r[2].output is None
    assert agent.run(t, agent.Loop(critic=never, loop_until_accepted=False)).first().iters == 1
    assert agent.run(t, agent.Loop(max_iterations=0)).first().output == ""
    v = spark.createDataFrame([("",), ("a" * 10,), ("a" * 11,)], "x string").select(agent.length_critic()(F.col("x"), F.col("x")).alias("v"))
    assert [r.v.accepted for r in v.collect()] == [False, False, True]


def test_roles(spark):
    t = spark.createDataFrame([(3, "T"), (0, "T")], "item_id long, text string")
    r = {x.item_id: x for x in roles.run(t, roles.Roles(roles.injected_scores(F.col("item_id")))).collect()}
    assert r[3].iters == 1 and r[3].solution == "Solution for task description 'Describtion of task 'T'' based on '' feedback."
    assert r[0].iters == 3 and "'fb2_2' feedback" in r[0].solution


def test_jsonl(spark, tmp_path):
    row = {"prompt": "p", "reference_code": "1", "metadata": {"library": "n", "perturbation_type": "o"}, "code_context": "def test_execution(c): assert c == 1"}

    def path(name, *lines):
        with gzip.open(tmp_path / f"{name}.jsonl.gz", "wt") as f:
            f.write("\n".join(lines))
        return str(tmp_path / f"{name}.jsonl.gz")

    tasks = readers.read_tasks(spark, path("a", json.dumps(row | {"extra": 1})), 2)
    out = evaluate.evaluate(tasks, lambda x: x["reference_code"], timeout=20).collect()
    assert [(r.library, r.result, r.score) for r in out] == [("n", "passed", 1)]
    for bad in (json.dumps({k: v for k, v in row.items() if k != "code_context"}), "{"):
        with pytest.raises(Exception):
            readers.read_tasks(spark, path("b", bad)).collect()


def test_execute_labels():
    run = lambda p: evaluate.execute(p, 1)
    assert run("x=1") == "passed" and run('assert 1==2, "no"') == "failed: no" and run("import sys; sys.exit(0)") == "failed: 0"
    assert run("while True: pass") == "timed out" and run("import os; os.kill(os.getpid(), 9)") == "timed out"


def test_summary(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), (None, "x", 1)], "library string, perturbation_type string, score int")
    got = {(r.level, r.key): (r.n, r.mean) for r in evaluate.summary(rows).collect()}
    assert got == {(0, None): (3, 2 / 3), (1, "a"): (2, 0.5), (2, "x"): (2, 1.0), (2, "y"): (1, 0.0)}
    assert [tuple(r) for r in evaluate.summary(rows.where("false")).collect()] == [(0, None, 0, None)]
    assert "0.667" in sinks.summary_text(evaluate.summary(rows))


def test_tools(spark):
    for e, v in {"7/2": "3.5", "4/2": "2.0", "7//2": "3", "-7//2": "-4", "2**3": "8", "2**-1": "0.5", "1/0": "Error: division by zero", "10**20": "1" + "0" * 20}.items():
        assert tools.calculate(e) == v
    assert tools.calculate("9**9**9").startswith("Error: ") and tools.calculate("()").startswith("Error: ")
    rows = spark.createDataFrame([("1+2",), ("",), ("5 % 2",), ("1+2\n",), ("math.sqrt(4)",), (None,)], "e string")
    assert [r[0] for r in rows.select(tools.allowed(F.col("e"))).collect()] == [True, True, False, False, False, None]
    assert rows.select(tools.calculator(F.col("e"))).collect()[2][0] == tools.INVALID
    tools.register(spark)
    assert spark.sql("select calculator('2*3'), weather('now')").first() == ("6", tools.WEATHER) and tools.tool_list(spark) == ["calculator", "weather"]
    assert spark.createDataFrame([("a",)], "e string").select(tools.model_call(lambda: str.upper)(F.col("e"))).first()[0] == "A"


def test_chat(spark):
    c = spark.createDataFrame([(1, k, "u", "TERMINATE \n" if k == 3 else None if k == 4 else "TERMINATE.") for k in range(12)], "conv_id long, turn long, role string, text string")
    assert chat.rounds(c).count() == 10 and [r.turn for r in chat.ends(c).where("is_end").collect()] == [3]
    assert chat.until_end(c).count() == 4 and chat.last_message(c).first().turn == 11


def test_stream(spark, tmp_path):
    from corvane.streaming.ingest import ingest

    spark.createDataFrame([(1, "x" * 600)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    s = store.ChunkStore(spark, str(tmp_path / "s"))
    q = ingest(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")), s, str(tmp_path / "c"))
    q.awaitTermination(60)
    assert s.all().count() == 2


def test_topk_plan_is_native(spark):
    c = spark.createDataFrame([(1, 0, "a")], "doc_id long, seq int, text string")
    t = spark.createDataFrame([(1, "a")], "item_id long, text string")
    plan = retrieve.topk_batch(t, c, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_store_keeps_what_is_there(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id string, text string, wseq long")
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        store.ChunkStore(spark, path).all()
    assert store.ChunkStore(spark, path).add(rows(("x", "x1", 1), ("y", "y1", 2)), batch="b-0")
    again = store.ChunkStore(spark, path)
    assert again.add(rows(("z", "z1", 1), ("x", "x2", 2)), batch="b-1") and not again.add(rows(("x", "lost", 1)), batch="b-1")
    (tmp_path / "s" / "add-00000009-b-2").mkdir()  # an add that was never finished
    want = [("x", "x2"), ("y", "y1"), ("z", "z1")]
    for compact in (False, True, False):
        if compact:
            again.compact()
        assert [(r.id, r.text) for r in store.ChunkStore(spark, path).all().collect()] == want
    assert store.ChunkStore(spark, path).add(rows(("y", "y2", 5)), batch="b-2")
    assert [(r.id, r.text) for r in again.all().collect()] == [("x", "x2"), ("y", "y2"), ("z", "z1")]
    assert [r.id for r in again.query("y2", 1).collect()] == ["y"]


def test_stream_replays_and_order(spark, tmp_path):
    from corvane.streaming.ingest import ingest

    docs = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = store.ChunkStore(spark, str(tmp_path / "s"))

    def turn():
        ingest(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")), s, str(tmp_path / "c")).awaitTermination(60)
        return [(r.id, r.text[0]) for r in s.all().collect()]

    docs((9, "a" * 1100), (3, "b" * 30))
    assert turn() == [("3#0", "b"), ("9#0", "a"), ("9#1", "a"), ("9#2", "a")]
    docs((1, "c" * 30), (3, "d" * 30))
    want = [("3#0", "d"), ("9#0", "a"), ("9#1", "a"), ("9#2", "a"), ("1#0", "c")]
    assert turn() == want
    for name in ("commits/1", "commits/.1.crc"):  # the batch was added, but the stream did not get to know
        (tmp_path / "c" / name).unlink()
    s = store.ChunkStore(spark, str(tmp_path / "s"))
    assert turn() == want and len([x for x in (tmp_path / "s").iterdir()]) == 2


def test_topk_of_string_ids(spark):
    c = spark.createDataFrame([("b", 0, "x y"), ("a", 0, "z"), ("a", 1, "x")], "doc_id string, seq int, text string")
    t = spark.createDataFrame([("t", "x y"), ("u", "q")], "item_id string, text string")
    got = sorted(map(tuple, retrieve.topk_batch(t, c, 3).collect()))
    assert got == [("t", 1, "b", 0, 2), ("t", 2, "a", 1, 1), ("t", 3, "a", 0, 0), ("u", 1, "a", 0, 0), ("u", 2, "a", 1, 0), ("u", 3, "b", 0, 0)]
    assert got == sorted(map(tuple, retrieve.topk_batch_cross(t, c, 3).collect()))


def test_calculator_says_what_python_says(spark):
    for e in ("1+", "2(3)", "2(3", "", "1 2", "01", "0**-1", "1.5//0", "((", "  3+4", "-()", "2()", "3 .5", "2.0**5000", "(-8)**0.5"):
        try:
            want = str(eval(e))
        except Exception as x:
            want = f"Error: {x}"
        assert tools.calculate(e) == want, e


def test_model_call_retries_one_error(spark):
    rows = spark.createDataFrame([("a",), (None,)], "e string")

    def failing(times, error):
        class Client:
            left = times

            def __call__(self, text):
                if self.left:
                    self.left -= 1
                    raise error
                return text * 2

        return Client

    call = lambda *a, **k: rows.select(tools.model_call(failing(*a), first_wait=0.0, **k)(F.col("e"))).collect()
    assert [r[0] for r in call(2, KeyError, tries=3, retry_on=(KeyError,))] == ["aa", None]
    for tries, error in ((2, KeyError), (3, ValueError)):
        with pytest.raises(Exception):
            call(2, error, tries=tries, retry_on=(KeyError,))


def test_small_parts(spark, tmp_path):
    assert readers.configured({"CONNECTION": "local", "VLLM_HOST": "h", "VLLM_PORT": "8", "VLLM_PATH": "/v1"}) == "http://h:8/v1"
    with pytest.raises(ValueError):
        readers.configured({})
    row = {"prompt": "p", "reference_code": "1", "metadata": {"library": "n"}, "code_context": "c"}
    lines = spark.createDataFrame([(json.dumps(row),)], "value string")
    tasks = readers.parse_tasks(lines)
    assert tasks.first().metadata == {"library": "n"}
    with pytest.raises(Exception):
        evaluate.evaluate(tasks, lambda t: t["prompt"]).collect()  # no perturbation_type
    assert chunks.compatible(tasks, tasks.select("prompt").schema) and not chunks.compatible(tasks.select("prompt"), tasks.schema)
    sinks.write_text("a\n", str(tmp_path / "t"))
    assert (tmp_path / "t").read_text() == "a\n"
    clash = spark.createDataFrame([("1", "t", 1, 2)], "id string, text string, k int, x int")
    assert [tuple(r) for r in chunks.augment(clash, lambda t: F.array(t, F.upper(t))).collect()] == [("1.0", "t", 1, 2), ("1.1", "T", 1, 2)]


def test_converse(spark):
    seeds = spark.createDataFrame([(1, "go"), (2, "no TERMINATE")], "conv_id long, text string")
    agents = [("P", lambda h: F.concat(F.lit("p"), F.size(h).cast("string"))), ("C", lambda h: F.when(F.size(h) > 3, F.lit("TERMINATE")).otherwise(F.lit("c")))]
    got = [tuple(r) for r in chat.converse(seeds, agents).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "User_Proxy", "go"), (1, 1, "P", "p1"), (1, 2, "C", "c"), (1, 3, "P", "p3"), (1, 4, "C", "TERMINATE"), (2, 0, "User_Proxy", "no TERMINATE")]
    assert chat.converse(seeds, agents, most=1).count() == 2
