"""Loops with Python clients: who is called how often, and the same results as with built-in columns."""

import collections
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corvane.functions import tools
from corvane.operators import agent, chat, roles


def logged(path, f):
    """A client that notes each call in a file of the test."""

    def client():
        def call(*values):
            with open(path, "a") as log:
                log.write(json.dumps([v if isinstance(v, str) else [str(x) for x in v] if hasattr(v, "__len__") else str(v) for v in values]) + "\n")
            return f(*values)

        return call

    return tools.model_call(client, tries=1)


def calls(path):
    return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []


def tasks(spark, n=30):
    return spark.createDataFrame([(k, f"Do task {k}. Well.", "ctx", "kept") for k in range(n)], "item_id long, text string, context string, output string").repartition(4)


def test_only_open_tasks_are_sent_again(spark, tmp_path):
    log = tmp_path / "log"

    def student(prompt, context):
        need = int(prompt.split()[2]) % 3
        return f"a long answer to {prompt}" if context.count("CRITIC_FEEDBACK") >= need else "no"

    rows = {r.item_id: r for r in agent.run(tasks(spark), agent.Loop(student=logged(log, student))).collect()}
    assert all(r.iters == k % 3 + 1 and r.output == f"a long answer to Do task {k}\nWell" for k, r in rows.items())
    assert len(calls(log)) == sum(r.iters for r in rows.values()) == 60
    assert all(r.final_context.count(agent.FEEDBACK_HEAD) == k % 3 for k, r in rows.items())


@pytest.mark.parametrize("until", [True, False])
def test_a_python_critic_gives_what_a_column_gives(spark, tmp_path, until):
    @F.pandas_udf(StructType([StructField("accepted", IntegerType()), StructField("feedback", StringType())]))
    def judge(output: pd.Series, context: pd.Series) -> pd.DataFrame:
        ok = output.str.len() > 48
        return pd.DataFrame({"accepted": ok.astype("int32"), "feedback": [None if x else agent.TOO_SHORT for x in ok]})

    def critic(output, context):
        v = judge(output, context)
        return F.struct((v["accepted"] == 1).alias("accepted"), v["feedback"].alias("feedback"))

    t = tasks(spark)
    key = lambda df: sorted((r.item_id, r.output, r.iters, r.final_context) for r in df.collect())
    native = agent.Loop(critic=agent.length_critic(48), loop_until_accepted=until)
    assert not agent.calls_python(t, native.critic(F.col("text"), F.col("context"))) and agent.calls_python(t, critic(F.col("text"), F.col("context")))
    assert key(agent.run(t, agent.Loop(critic=critic, loop_until_accepted=until))) == key(agent.run(t, native))


def test_a_task_without_sentence_and_no_task(spark, tmp_path):
    log = tmp_path / "log"
    t = spark.createDataFrame([(1, "...", "c"), (2, "Go.", "c")], "item_id long, text string, context string")
    loop = agent.Loop(student=logged(log, lambda p, c: "x" * 20))
    assert {r.item_id: r.output for r in agent.run(t, loop).collect()} == {1: None, 2: "x" * 20}
    assert calls(log) == [["Go", "c"]]
    assert agent.run(t.where("false"), loop).count() == 0


def test_roles_take_turns(spark, tmp_path):
    logs = {n: tmp_path / n for n in ("aligner", "scholar", "solver")}
    scores = StructType([StructField("scores", ArrayType(IntegerType())), StructField("feedback", ArrayType(StringType()))])

    @F.pandas_udf(scores)
    def judge(solution: pd.Series, item: pd.Series) -> pd.DataFrame:
        good = ["fb" in s and s.count("fb") >= i % 3 or i % 3 == 0 for s, i in zip(solution, item, strict=True)]
        return pd.DataFrame({"scores": [[5] * 4 if g else [5, 5, 5, 4] for g in good], "feedback": [[f"fb{s.count('fb') + 1}"] * 4 for s in solution]})

    team = roles.Roles(
        critic=lambda solution, research: judge(solution, F.col("item_id")),
        aligner=logged(logs["aligner"], lambda d, f: f"aligned({f})"),
        scholar=logged(logs["scholar"], lambda d, f: f"found({f})"),
        solver=lambda description, aligned_info, research, feedback: logged(logs["solver"], lambda *x: f"{x[0]}+{x[1]}+{x[2]}")(aligned_info, research, feedback),
    )
    rows = {r.item_id: r for r in roles.run(tasks(spark, 9), team).collect()}
    assert {k: r.iters for k, r in rows.items()} == {k: 1 if k % 3 == 0 else 2 for k in range(9)}
    assert rows[3].solution == "aligned()+found()+" and rows[4].solution == "aligned(fb1)+found(fb1)+fb1" and rows[4].output == "kept"
    assert all(len(calls(p)) == sum(r.iters for r in rows.values()) for p in logs.values())
    assert {r.iters for r in roles.by_rounds(tasks(spark, 3), roles.Roles(critic=team.critic, max_iterations=0)).collect()} == {0}


def test_ten_rounds_of_two_python_agents(spark, tmp_path):
    logs = [tmp_path / "p", tmp_path / "c"]
    seeds = spark.createDataFrame([(1, "go"), (1, "go"), (None, "so"), (2, "no TERMINATE"), (3, "end at 4")], "conv_id long, text string")
    agents = [("P", logged(logs[0], lambda h: f"p{len(h)}")), ("C", logged(logs[1], lambda h: "TERMINATE" if h[0].startswith("end") and len(h) >= 4 else f"c{len(h)}"))]
    rows = [tuple(r) for r in chat.converse(seeds, agents).collect()]
    long = [(k, "User_Proxy" if k == 0 else "P" if k % 2 else "C", "pc"[1 - k % 2] + str(k)) for k in range(1, 10)]
    for conv, seed in ((1, "go"), (None, "so")):
        own = sorted(r[1:] for r in rows if r[0] == conv)
        assert own == sorted([(0, "User_Proxy", seed), *long] * (2 if conv == 1 else 1))
    assert [r for r in rows if r[0] == 2] == [(2, 0, "User_Proxy", "no TERMINATE")] and max(r[1] for r in rows if r[0] == 3) == 4
    assert [len(calls(p)) for p in logs] == [3 * 5 + 2, 3 * 4 + 2]


def test_speakers_by_rule_and_windows(spark, tmp_path):
    log = tmp_path / "log"
    seeds = spark.createDataFrame([(1, "ask B"), (2, "ask nobody")], "conv_id long, text string")
    agents = [("A", logged(log, lambda h: "ask B")), ("B", lambda h: F.when(F.size(h) > 1, F.lit("ask A")).otherwise(F.lit("none before")))]
    chosen = lambda role, text: F.regexp_extract(text, "ask (.*)", 1)
    rows = [tuple(r) for r in chat.by_rounds(seeds, agents, most=6, window=2, speaker=chosen).orderBy("conv_id", "turn").collect()]
    assert [r[2:] for r in rows if r[0] == 1] == [("User_Proxy", "ask B"), ("B", "none before")] and len([r for r in rows if r[0] == 2]) == 1
    seeds = spark.createDataFrame([(1, "ask A")], "conv_id long, text string")
    rows = [r.role for r in chat.by_rounds(seeds, agents, most=6, window=2, speaker=chosen).orderBy("turn").collect()]
    assert rows == ["User_Proxy", "A", "B", "A", "B", "A"] and all(len(c[0]) <= 2 for c in calls(log))


class Server(ThreadingHTTPServer):
    """Answers every request, notes when it came, and refuses the first ``busy`` with a delay."""

    def __init__(self, busy=0, delay="0"):
        self.times, self.left = [], busy

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                top = self.server
                top.times.append(time.monotonic())
                refuse, top.left = top.left > 0, top.left - 1
                self.send_response(429 if refuse else 200)
                if refuse:
                    self.send_header("Retry-After", delay)
                self.end_headers()
                self.wfile.write(self.rfile.read(int(self.headers["Content-Length"])).upper())

            def log_message(self, *_):
                pass

        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()


def asks(port):
    def client():
        import urllib.error
        import urllib.request

        def ask(text):
            try:
                return urllib.request.urlopen(f"http://127.0.0.1:{port}", text.encode(), timeout=10).read().decode()
            except urllib.error.HTTPError as e:
                error = OSError("busy")
                error.retry_after = float(e.headers["Retry-After"])
                raise error from e

        return ask

    return client


def test_calls_stay_within_the_budget(spark):
    server = Server()
    try:
        rows = spark.range(60).repartition(4).select(F.col("id").cast("string").alias("t"))
        call = tools.model_call(asks(server.server_port), tries=1, per_second=20)
        assert rows.select(call(F.concat(F.lit("x"), "t")).alias("a")).where("a like 'X%'").count() == 60
    finally:
        server.shutdown()
    assert len(server.times) == 60
    t = sorted(server.times)
    # each of 4 workers begins at once, so a second may have 4 more
    assert max(collections.Counter(int(x - t[0]) for x in t).values()) <= 24 and t[-1] - t[0] >= 2.5


def test_the_servers_own_delay_counts(spark):
    server = Server(busy=1, delay="1.5")
    try:
        rows = spark.createDataFrame([("a",), (None,)], "t string").coalesce(1)
        assert [r[0] for r in rows.select(tools.model_call(asks(server.server_port), tries=2, first_wait=30.0, retry_on=(OSError,))(F.col("t"))).collect()] == ["A", None]
    finally:
        server.shutdown()
    assert len(server.times) == 2 and 1.4 < server.times[1] - server.times[0] < 5
    with pytest.raises(ValueError):
        tools.model_call(asks(1), per_second=0)
