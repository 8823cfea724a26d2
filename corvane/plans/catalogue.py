"""The query catalogue: each query over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corvane.functions import tables, tools
from corvane.functions.text import sentences, strip
from corvane.operators import agent, chat, context, evaluate, retrieve, roles, store
from corvane.operators.chunks import EXAMPLE_WIDTH, Block, apply_filter, augment, chunk, connect, min_len
from corvane.sources.readers import address_column, endpoint_column, numbered_lines, read_numbered_tasks, read_tasks, spread, table
from corvane.sources.shared import folder
from corvane.sources.sinks import write_summary, write_tasks

K, TASK = 10, "the of and thing er"
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


_WS = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CHUNKS = f"c AS (SELECT doc_id, i AS seq, substring(text, i * {EXAMPLE_WIDTH} + 1, {EXAMPLE_WIDTH}) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / {EXAMPLE_WIDTH}.0) AS BIGINT))) AS i FROM documents))"
_TOKENS = f"t AS (SELECT doc_id, seq, list_distinct(list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '')) AS toks FROM c)"
_ASKED = f"q AS (SELECT item_id, text, list_distinct(list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '')) AS toks FROM benchmark)"
_TOP = f"top AS (SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, seq) AS rk, doc_id, seq, score FROM (SELECT item_id, doc_id, seq, CAST(len(list_intersect(t.toks, q.toks)) AS BIGINT) AS score FROM t, q)) WHERE rk <= {K})"
_RANKED = f"WITH {_CHUNKS}, {_TOKENS}, {_ASKED}, {_TOP}"
_CONTEXT = "ctx AS (SELECT item_id, string_agg('[CHUNK ' || doc_id || '#' || seq || ' | doc=' || doc_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rk) AS context FROM top JOIN c USING (doc_id, seq) GROUP BY item_id)"
_STEPS = f"s AS (SELECT item_id, list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS steps FROM benchmark)"
_OUTPUT = "'EXECUTION_RESULT:' || chr(10) || 'Prompt:' || chr(10) || array_to_string(steps, chr(10)) || chr(10) || '---' || chr(10) || 'Context-snippet: ' || substring(context, 1, 200)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), EXAMPLE_WIDTH)


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.topk_batch(_tasks(spark, sf_dir), _chunks(spark, sf_dir), K)


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.assemble(retrieve.with_text(_topk(spark, sf_dir), _chunks(spark, sf_dir)), _tasks(spark, sf_dir))


def _loop(spark: SparkSession, sf_dir: str, loop: agent.Loop) -> DataFrame:
    return agent.run(_contexts(spark, sf_dir).join(_tasks(spark, sf_dir), "item_id"), loop)


@query("SELECT doc_id, source, length(text) AS n_len FROM documents")
def scan_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("bigint").alias("n_len"))


@query(f"WITH {_CHUNKS} SELECT doc_id, seq, text FROM c")
def chunk_fixed(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", F.col("seq").cast("bigint").alias("seq"), "text")


@query(f"WITH {_CHUNKS} SELECT * FROM (SELECT doc_id, seq, CAST(length(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) AS BIGINT) AS n_stripped FROM c) WHERE n_stripped >= 20")
def filter_min_len(spark, sf_dir):
    return min_len(_chunks(spark, sf_dir)).select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.length(strip(F.col("text"))).cast("bigint").alias("n_stripped"))


def _stored(spark, sf_dir):
    writes = table(spark, sf_dir, "conversations").select(F.col("role").alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("wseq"), "text")
    return store.upsert(writes)


@query("SELECT role AS id, arg_max(text, conv_id * 1000 + turn) AS text, min(conv_id * 1000 + turn) AS pos FROM conversations GROUP BY role")
def store_upsert(spark, sf_dir):
    return _stored(spark, sf_dir)


@query("SELECT role AS id, min(conv_id * 1000 + turn) AS pos FROM conversations GROUP BY role ORDER BY pos")
def all_chunks(spark, sf_dir):
    return _stored(spark, sf_dir).orderBy("pos").select("id", "pos")


@query(f"WITH {_CHUNKS}, {_TOKENS} SELECT row_number() OVER (ORDER BY score DESC, doc_id, seq) AS rk, * FROM (SELECT doc_id, seq, CAST(len(list_intersect(toks, string_split('{TASK}', ' '))) AS BIGINT) AS score FROM t ORDER BY score DESC, doc_id, seq LIMIT {K})")
def topk_single(spark, sf_dir):
    top = store.topk_single(_chunks(spark, sf_dir), TASK, K).select("doc_id", "seq", "score")
    # k rows: their rank is their place in the sorted list
    rows = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "seq"))).alias("a")).select(F.posexplode("a").alias("rk", "x"))
    return rows.select((F.col("rk") + 1).cast("bigint").alias("rk"), "x.doc_id", F.col("x.seq").cast("bigint").alias("seq"), (-F.col("x.s")).alias("score"))


@query(f"{_RANKED} SELECT item_id, rk, doc_id, seq, score FROM top")
def topk_batch(spark, sf_dir):
    return _topk(spark, sf_dir).withColumn("seq", F.col("seq").cast("bigint"))


@query(f"{_RANKED} SELECT item_id, rk, doc_id, seq, score FROM top")
def topk_pruned(spark, sf_dir):
    """The index that reads common tokens only to complete scores, whatever the size."""
    return retrieve.topk_batch(_tasks(spark, sf_dir), _chunks(spark, sf_dir), K, prune=True).withColumn("seq", F.col("seq").cast("bigint"))


@query(f"{_RANKED} SELECT item_id, rk, doc_id, seq, score FROM top")
def topk_batch_cross(spark, sf_dir):
    return retrieve.topk_batch_cross(_tasks(spark, sf_dir), _chunks(spark, sf_dir), K).withColumn("seq", F.col("seq").cast("bigint"))


@query(f"{_RANKED} SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY length(text) DESC, rk) AS rk, doc_id, seq, CAST(length(text) AS BIGINT) AS n_len FROM top JOIN c USING (doc_id, seq)) WHERE rk <= 5")
def rerank(spark, sf_dir):
    rows = retrieve.with_text(_topk(spark, sf_dir), _chunks(spark, sf_dir))
    return retrieve.rerank(rows, F.length("text"), 5).select("item_id", F.col("new_rk").alias("rk"), "doc_id", F.col("seq").cast("bigint").alias("seq"), F.length("text").cast("bigint").alias("n_len"))


@query(f"{_RANKED}, {_CONTEXT} SELECT item_id, context FROM ctx")
def context_assemble(spark, sf_dir):
    return _contexts(spark, sf_dir)


@query(f"WITH {_STEPS} SELECT item_id, CAST(i - 1 AS BIGINT) AS seq, steps[i] AS step FROM (SELECT item_id, steps, unnest(range(1, len(steps) + 1)) AS i FROM s)")
def plan_sentences(spark, sf_dir):
    return _tasks(spark, sf_dir).select("item_id", F.posexplode(sentences(F.col("text"))).alias("seq", "step")).withColumn("seq", F.col("seq").cast("bigint"))


@query("SELECT conv_id, turn, coalesce(length(text) > 60, false) AS accepted, CASE WHEN length(text) > 60 THEN NULL ELSE 'output too short' END AS feedback FROM conversations")
def critic_accept(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", agent.length_critic(60)(text, text).alias("v")).select("conv_id", "turn", "v.accepted", "v.feedback")


@query(f"{_RANKED}, {_CONTEXT}, {_STEPS} SELECT item_id, {_OUTPUT} AS output, length(context) AS context_len FROM ctx JOIN s USING (item_id)")
def agent_run(spark, sf_dir):
    return _loop(spark, sf_dir, agent.Loop()).select("item_id", "output", F.length("final_context").cast("bigint").alias("context_len"))


@query(f"{_RANKED}, {_CONTEXT}, {_STEPS} SELECT item_id, output, CASE WHEN length(output) > 500 THEN 1 ELSE 3 END::BIGINT AS iters, length(context) + CASE WHEN length(output) > 500 THEN 0 ELSE 3 * 35 END AS context_len FROM (SELECT item_id, context, {_OUTPUT} AS output FROM ctx JOIN s USING (item_id))")
def agent_loop_reject(spark, sf_dir):
    return _loop(spark, sf_dir, agent.Loop(critic=agent.length_critic(500))).select("item_id", "output", "iters", F.length("final_context").cast("bigint").alias("context_len"))


@query(f"{_RANKED}, {_CONTEXT}, {_STEPS} SELECT item_id, output, 1::BIGINT AS iters, length(context) + CASE WHEN length(output) > 500 THEN 0 ELSE 35 END AS context_len FROM (SELECT item_id, context, {_OUTPUT} AS output FROM ctx JOIN s USING (item_id))")
def agent_loop_once(spark, sf_dir):
    return _loop(spark, sf_dir, agent.Loop(critic=agent.length_critic(500), loop_until_accepted=False)).select("item_id", "output", "iters", F.length("final_context").cast("bigint").alias("context_len"))


_FIRST = "CASE WHEN (item_id + 1) % 4 = 0 THEN 1 WHEN (item_id + 2) % 4 = 0 THEN 2 ELSE 3 END"


@query(f"SELECT item_id, 'Solution for task description ''Describtion of task ''' || text || '''''' || ' based on ''' || CASE WHEN {_FIRST} = 1 THEN '' ELSE 'fb' || ({_FIRST} - 1) || '_2' END || ''' feedback.' AS solution, CAST({_FIRST} AS BIGINT) AS iters FROM benchmark")
def roles_run(spark, sf_dir):
    return roles.run(_tasks(spark, sf_dir), roles.Roles(roles.injected_scores(F.col("item_id")))).select("item_id", "solution", "iters")


@query("SELECT item_id, ctx || chr(10) || 'code = ' || item_id || chr(10) || 'test_execution(code)' || chr(10) || CASE WHEN contains(ctx, 'test_string(') THEN 'test_string(code)' || chr(10) ELSE chr(10) END AS program FROM (SELECT item_id, text || CASE WHEN item_id % 2 = 0 THEN ' test_string(' ELSE '' END AS ctx FROM benchmark)")
def program_assemble(spark, sf_dir):
    ctx = F.concat("text", F.when(F.col("item_id") % 2 == 0, F.lit(" test_string(")).otherwise(F.lit("")))
    return _tasks(spark, sf_dir).select("item_id", evaluate.assemble(ctx, F.col("item_id").cast("string")).alias("program"))


@query("SELECT doc_id, quality, CASE WHEN quality = 1 THEN 'passed' ELSE 'failed: ' END AS result, CAST(quality AS INTEGER) AS score FROM labels WHERE quality IS NOT NULL")
def eval_execute(spark, sf_dir):
    """A program per row of labels, each really run."""
    rows = spread(table(spark, sf_dir, "labels")).where(F.col("quality").isNotNull()).select("doc_id", "quality")
    rows = rows.withColumn("program", F.concat(F.lit("assert 1 == "), F.col("quality").cast("string")))
    return evaluate.run_programs(rows, 20).select("doc_id", "quality", "result", "score")


_JUDGED = "(SELECT CAST(item_id % 3 = item_id % 2 AS INTEGER) AS score, 'library ' || (item_id % 4) AS library, 'kind ' || (item_id % 3) AS kind FROM benchmark)"


@query(f"SELECT CAST(CASE grouping(library, kind) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS level, coalesce(library, kind) AS key, count(score) AS n, avg(score) AS mean FROM {_JUDGED} GROUP BY GROUPING SETS ((), (library), (kind))")
def eval_end_to_end(spark, sf_dir):
    """Tasks as a JSON-lines file, read again; an answer, a program and its run for each; the summary."""
    item = F.col("item_id")
    kinds = F.create_map(F.lit("library"), F.concat(F.lit("library "), (item % 4).cast("string")), F.lit("perturbation_type"), F.concat(F.lit("kind "), (item % 3).cast("string")))
    check = F.concat(F.lit("def test_execution(code):\n    assert code == "), (item % 2).cast("string"))
    tasks = _tasks(spark, sf_dir).select(F.col("text").alias("prompt"), (item % 3).cast("string").alias("reference_code"), kinds.alias("metadata"), check.alias("code_context"))
    path = folder(spark, "tasks")
    write_tasks(tasks, path)
    rows = read_tasks(spark, path, spark.sparkContext.defaultParallelism)
    return evaluate.summary(evaluate.evaluate(rows, lambda answer: answer, lambda task: task["reference_code"], timeout=20))


def _scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("library"), F.col("lang").alias("perturbation_type"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("library", "perturbation_type", F.col("quality").alias("score"))


_JOINED = "(SELECT quality AS score, source AS library, lang AS kind FROM labels JOIN documents USING (doc_id))"


@query(f"SELECT count(score) AS n, avg(score) AS mean FROM {_JOINED}")
def eval_overall(spark, sf_dir):
    return evaluate.overall(_scores(spark, sf_dir))


@query(f"SELECT library, count(score) AS n, avg(score) AS mean FROM {_JOINED} WHERE library IS NOT NULL GROUP BY library")
def eval_by_library(spark, sf_dir):
    return evaluate.by(_scores(spark, sf_dir), "library")


@query(f"SELECT kind, count(score) AS n, avg(score) AS mean FROM {_JOINED} WHERE kind IS NOT NULL GROUP BY kind")
def eval_by_kind(spark, sf_dir):
    return evaluate.by(_scores(spark, sf_dir), "perturbation_type").withColumnRenamed("perturbation_type", "kind")


@query(f"SELECT CAST(CASE grouping(library, kind) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS level, coalesce(library, kind) AS key, count(score) AS n, avg(score) AS mean FROM {_JOINED} GROUP BY GROUPING SETS ((), (library), (kind))")
def eval_summary(spark, sf_dir):
    return evaluate.summary(_scores(spark, sf_dir))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 4")
def chat_rounds(spark, sf_dir):
    return chat.rounds(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn")


@query(f"SELECT conv_id, turn, ends_with(regexp_replace(coalesce(text, ''), '{_WS}+$', ''), 'TERMINATE') AS is_end FROM conversations")
def chat_terminate(spark, sf_dir):
    return chat.ends(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def chat_last_message(spark, sf_dir):
    return chat.last_message(table(spark, sf_dir, "conversations"))


@query("SELECT o_orderkey, CAST((o_orderkey % 97) * ((o_custkey % 13) + 2) - 5 AS VARCHAR) AS result FROM orders")
def tool_calculator(spark, sf_dir):
    text = F.concat((F.col("o_orderkey") % 97).cast("string"), F.lit("*("), (F.col("o_custkey") % 13).cast("string"), F.lit("+2) - 5"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tools.calculator(text).alias("result"))


@query("SELECT event_id, 'The weather is GOOD!' AS result FROM events")
def tool_weather(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tools.weather(F.col("event_type")).alias("result"))


class Busy(Exception):
    """What the stub client raises at the first try of each text."""


class _Stub:
    def __init__(self):
        self._tried = set()

    def __call__(self, text: str) -> str:
        if text not in self._tried:
            self._tried.add(text)
            raise Busy
        return f"echo: {text}"


@query("SELECT conv_id, turn, 'echo: ' || text AS answer FROM conversations")
def model_call_retry(spark, sf_dir):
    """Every message goes to a stub model, which fails at the first try."""
    call = tools.model_call(_Stub, tries=2, first_wait=0.0, retry_on=(Busy,))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", call(F.col("text")).alias("answer"))


@query("""SELECT item_id AS conv_id, CAST(k AS BIGINT) AS turn, CASE WHEN k = 0 THEN 'User_Proxy' WHEN k % 2 = 1 THEN 'Planner' ELSE 'Critic' END AS role,
 CASE WHEN k = 0 THEN text WHEN k % 2 = 1 THEN 'Plan ' || k ELSE 'Critique ' || k || CASE WHEN k >= item_id % 9 THEN ' TERMINATE' ELSE '' END END AS text
FROM (SELECT item_id, text, unnest(range(10)) AS k FROM benchmark) WHERE k <= greatest(2, item_id % 9 + item_id % 9 % 2)""")
def chat_converse(spark, sf_dir):
    """A planner and a critic in turn, after a seed, until the critic ends it or ten messages are said."""
    agents = [
        ("Planner", lambda heard: F.concat(F.lit("Plan "), F.size(heard).cast("string"))),
        ("Critic", lambda heard: F.concat(F.lit("Critique "), F.size(heard).cast("string"), F.when(F.size(heard) >= F.col("conv_id") % 9, F.lit(" TERMINATE")).otherwise(F.lit("")))),
    ]
    return chat.converse(_tasks(spark, sf_dir).select(F.col("item_id").alias("conv_id"), "text"), agents)


class _Student:
    """Says too little until the critic has asked often enough."""

    def __call__(self, prompt: str, context: str) -> str:
        asked = context.count(agent.FEEDBACK_HEAD)
        return f"answer to {len(prompt)} characters" if asked >= len(prompt) % 3 else "no"


@query(f"{_RANKED}, {_CONTEXT}, {_STEPS} SELECT item_id, 'answer to ' || n || ' characters' AS output, CAST(n % 3 + 1 AS BIGINT) AS iters, length(context) + 35 * (n % 3) AS context_len FROM (SELECT item_id, context, length(array_to_string(steps, chr(10))) AS n FROM ctx JOIN s USING (item_id))")
def agent_run_client(spark, sf_dir):
    """A student that is a model's client and needs one to three rounds."""
    student = tools.model_call(_Student, tries=1)
    return _loop(spark, sf_dir, agent.Loop(student=student)).select("item_id", "output", "iters", F.length("final_context").cast("bigint").alias("context_len"))


def _says(template: str):
    return tools.model_call(lambda: lambda description, feedback: template % (description, feedback), tries=1)


@F.pandas_udf(StructType([StructField("scores", ArrayType(IntegerType())), StructField("feedback", ArrayType(StringType()))]))
def _scored(item: pd.Series, iteration: pd.Series) -> pd.DataFrame:
    good = [(i + k) % 4 == 0 for i, k in zip(item, iteration, strict=True)]
    return pd.DataFrame({"scores": [[5 if g else 3] * 4 for g in good], "feedback": [[f"fb{k}_{n}" for n in range(4)] for k in iteration]})


@query(_sql["roles_run"])
def roles_run_client(spark, sf_dir):
    """Roles and a critic that are Python clients: the same as roles_run."""
    clients = roles.Roles(lambda i: _scored(F.col("item_id"), i), _says(roles.ALIGN), _says(roles.RESEARCH), _says(roles.SOLVE))
    return roles.run(_tasks(spark, sf_dir), clients).select("item_id", "solution", "iters")


@query(_sql["chat_converse"])
def chat_converse_client(spark, sf_dir):
    """A planner and a critic that are Python clients: the same as chat_converse."""
    plan = tools.model_call(lambda: lambda heard: f"Plan {len(heard)}", tries=1)
    critique = tools.model_call(lambda: lambda heard, item: f"Critique {len(heard)}{' TERMINATE' if len(heard) >= item % 9 else ''}", tries=1)
    seeds = _tasks(spark, sf_dir).select(F.col("item_id").alias("conv_id"), "text")
    return chat.converse(seeds, [("Planner", plan), ("Critic", lambda heard: critique(heard, F.col("conv_id")))])


@query("""SELECT role AS id, arg_max(text, w) AS text, row_number() OVER (ORDER BY min(w)) AS place
FROM (SELECT role, text, conv_id % 2 * 1000000000000 + conv_id * 1000 + turn AS w FROM conversations) GROUP BY role""")
def store_reopen(spark, sf_dir):
    """Two adds to a store at a path, the second of them by another store object, read by a third."""
    writes = table(spark, sf_dir, "conversations").select(F.col("role").alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("wseq"), "text", (F.col("conv_id") % 2).alias("part"))
    path = folder(spark, "store")
    for part in (0, 1):
        store.ChunkStore(spark, path).add(writes.where(F.col("part") == part).drop("part"), batch=f"part{part}")
    rows = store.ChunkStore(spark, path).all()
    return rows.select("id", "text", F.row_number().over(Window.orderBy("pos")).cast("bigint").alias("place"))


@query(f"SELECT row_number() OVER (ORDER BY score DESC, w) AS rk, id, score FROM (SELECT conv_id || '#' || turn AS id, conv_id * 1000 + turn AS w, CAST(len(list_intersect(list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> ''), string_split('{TASK}', ' '))) AS BIGINT) AS score FROM conversations ORDER BY score DESC, w LIMIT {K})")
def store_index(spark, sf_dir):
    """Messages in three adds, all of them written with another text first, and a query by the store's own index."""
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string")).alias("id"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("wseq"), (F.col("turn") % 2).alias("part"))
    stored = store.ChunkStore(spark, folder(spark, "store"))
    stored.add(turns.withColumn("text", F.lit(TASK)).drop("part"))
    for part in (0, 1):
        stored.add(turns.where(F.col("part") == part).drop("part"))
    rows = stored.query(TASK, K)
    return rows.select(F.row_number().over(Window.orderBy(F.desc("score"), "pos")).cast("bigint").alias("rk"), "id", "score")


def _by_function(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables.register(spark, EXAMPLE_WIDTH)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spark.sql(f"SELECT d.doc_id, CAST(c.seq AS BIGINT) AS seq, c.part AS text FROM {{docs}} d, LATERAL {name}(d.text, {EXAMPLE_WIDTH}) c", docs=docs)


@query(_sql["chunk_fixed"])
def chunk_udtf(spark, sf_dir):
    """The same chunks by a Python table function in SQL."""
    return _by_function(spark, sf_dir, "chunk_text")


@query(_sql["chunk_fixed"])
def chunk_sql_function(spark, sf_dir):
    """The same chunks by a table function of built-in functions."""
    return _by_function(spark, sf_dir, "chunk_rows")


_WORDS = f"list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '')"


@query(f"""SELECT conv_id, turn, CAST(i AS BIGINT) AS seq, CASE i WHEN 0 THEN text WHEN 1 THEN array_to_string(w[:len(w) // 2], ' ') ELSE array_to_string(w[len(w) // 2 + 1:], ' ') END AS part
FROM (SELECT conv_id, turn, text, w, unnest(range(CASE WHEN len(w) < 2 THEN 1 ELSE 3 END)) AS i FROM (SELECT conv_id, turn, text, {_WORDS} AS w FROM conversations WHERE text IS NOT NULL))""")
def augment_udtf(spark, sf_dir):
    """Messages with their halves by a Python table function in SQL."""
    tables.register(spark)
    turns = table(spark, sf_dir, "conversations")
    return spark.sql("SELECT t.conv_id, t.turn, CAST(a.seq AS BIGINT) AS seq, a.part FROM {turns} t, LATERAL augment_text(t.text) a", turns=turns)


@query("SELECT CAST(row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) AS BIGINT) AS line, item_id % 3 AS part, text AS prompt FROM benchmark")
def task_lines(spark, sf_dir):
    """Tasks as JSON lines in three files, read again with the file and line of each."""
    path, item = folder(spark, "lines"), F.col("item_id")
    tasks = _tasks(spark, sf_dir).select((item % 3).alias("part"), "item_id", F.struct(F.col("text").alias("prompt"), F.lit("1").alias("reference_code"), F.create_map(F.lit("library"), F.lit("l")).alias("metadata"), F.lit("c").alias("code_context")).alias("x"))
    tasks.select("part", "item_id", F.to_json("x").alias("value")).repartition(3, "part").sortWithinPartitions("part", "item_id").select("part", "value").write.partitionBy("part").text(path)
    rows = read_numbered_tasks(spark, f"{path}/part=*")
    return rows.select("line", F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint").alias("part"), "prompt")


_KEPT = "(SELECT doc_id, seq, replace(text, 'the', 'THE') AS text FROM c WHERE length(text) >= 100)"


def _rule(text: Column) -> Column:
    """A filter that rewrites what it keeps."""
    return F.when(F.length(text) >= 100, F.replace(text, F.lit("the"), F.lit("THE")))


def _parts(text: Column) -> Column:
    """A chunk and its first half."""
    return F.array(text, F.left(text, F.floor(F.length(text) / 2).cast("int")))


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(seq AS BIGINT) AS seq, text FROM {_KEPT}")
def filter_hook(spark, sf_dir):
    """Chunks through a filter that drops some and rewrites the others."""
    return apply_filter(_chunks(spark, sf_dir), _rule).select("doc_id", F.col("seq").cast("bigint").alias("seq"), "text")


_HALVES = "SELECT doc_id || '#' || seq || '.' || k AS id, CASE k WHEN 0 THEN text ELSE text[:length(text) // 2] END AS text"


@query(f"WITH {_CHUNKS} {_HALVES} FROM (SELECT doc_id, seq, text, unnest(range(2)) AS k FROM c)")
def augment_chunks(spark, sf_dir):
    """Each chunk and its first half, as chunks of their own."""
    return augment(_chunks(spark, sf_dir), _parts).select("id", "text")


@query(f"WITH {_CHUNKS} {_HALVES} FROM (SELECT doc_id, seq, text, unnest(range(2)) AS k FROM {_KEPT})")
def connected_blocks(spark, sf_dir):
    """Chunks, filter and augmentation as blocks, whose columns are compared when they are connected."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = Block("chunks", docs.schema, lambda d: chunk(d, EXAMPLE_WIDTH))
    takes = chunk(docs.limit(0), EXAMPLE_WIDTH).schema
    blocks = [cut, Block("filter", takes, lambda c: apply_filter(c, _rule)), Block("augmentation", takes, lambda c: augment(c, _parts))]
    return connect(docs, *blocks).select("id", "text")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'http://' || replace(s_name, '#', '-') || ':' || (8000 + s_nationkey) || '/v1' ELSE 'http://localhost:' || (9000 + s_nationkey) || '/v1' END AS url FROM supplier")
def service_addresses(spark, sf_dir):
    """The address of each supplier's service, by its mode of connection."""
    remote = address_column(F.replace("s_name", F.lit("#"), F.lit("-")), F.col("s_nationkey") + 8000, F.lit("/v1"))
    local = address_column(F.lit("localhost"), F.col("s_nationkey") + 9000, F.lit("/v1"))
    mode = F.when(F.col("s_suppkey") % 3 == 0, F.lit("remote")).otherwise(F.lit("local"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", endpoint_column(mode, remote, local).alias("url"))


@query("SELECT c_custkey, tool, CASE tool WHEN 'weather' THEN 'The weather is GOOD!' ELSE CAST(c_custkey * 2 + c_nationkey AS VARCHAR) END AS result FROM customer, (SELECT unnest(['calculator', 'weather']) AS tool)")
def tools_found(spark, sf_dir):
    """Every tool that the session's catalogue lists, called by its name for every customer."""
    tools.register(spark)
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit("*2+"), F.col("c_nationkey").cast("string")).alias("expression"))
    found = tools.tool_list(spark)
    answers = asked.select("c_custkey", *[F.expr(f"{name}(expression)").alias(name) for name in found])
    return answers.select("c_custkey", F.inline(F.array(*[F.struct(F.lit(name).alias("tool"), F.col(name).alias("result")) for name in found])))


@query(f"""WITH s AS ({_sql["eval_summary"]}),
r AS (SELECT level, 1 AS part, coalesce(key, 'score') AS k, CAST(n AS VARCHAR) AS n, coalesce(printf('%.3f', mean), '') AS m FROM s WHERE level = 0 OR key IS NOT NULL UNION ALL SELECT * FROM (VALUES (0, 0, 'all', 'count', 'mean'), (1, 0, 'library', 'count', 'mean'), (2, 0, 'kind', 'count', 'mean'))),
w AS (SELECT *, max(length(k)) OVER b AS wk, max(length(n)) OVER b AS wn, max(length(m)) OVER b AS wm FROM r WINDOW b AS (PARTITION BY level))
SELECT row_number() OVER (ORDER BY level, part, k) AS line, rtrim(rpad(k, CAST(wk AS INTEGER), ' ') || '  ' || lpad(n, CAST(wn AS INTEGER), ' ') || '  ' || lpad(m, CAST(wm AS INTEGER), ' ')) AS text FROM w""")
def summary_file(spark, sf_dir):
    """The summary's three blocks of text, written as a file and read again by its lines."""
    path = folder(spark, "summary")
    write_summary(evaluate.summary(_scores(spark, sf_dir)), path)
    return numbered_lines(spark, path).select("line", F.col("value").alias("text"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed: ' WHEN 2 THEN 'failed: [Errno 24] Too many open files: ''/dev/null''' ELSE 'failed: [Errno 27] File too large' END AS result, CAST(doc_id % 4 = 0 AS INTEGER) AS score FROM labels")
def eval_guarded(spark, sf_dir):
    """A program per row of labels: every fourth is modest, the others want too much memory, too many files or too large a file."""
    write = "f = open('f', 'wb', 0)\nwhile True:\n    f.write(bytes(1 << 16))"
    wants = [F.lit(p) for p in ("assert True", "x = bytearray(1 << 40)", "x = [open('/dev/null') for _ in range(200)]", write)]
    rows = spread(table(spark, sf_dir, "labels").select("doc_id")).withColumn("program", F.get(F.array(*wants), (F.col("doc_id") % 4).cast("int")))
    limits = evaluate.Limits(memory=1 << 30, file=100_000, files=64)
    return evaluate.run_programs(rows, 20, limits=limits).select("doc_id", "result", "score")
