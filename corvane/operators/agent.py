"""A bounded plan, execute and critique loop: one column expression, or a table for each round.

With built-in columns the loop is a fold over the rounds within a row. Spark allows no Python
function in such a fold, so a student or critic that is one (a model's client) makes the loop go
round by round: each round writes a table of the rows that it judged, and only rows that are not done
are sent to the workers again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import sentences
from corvane.sources.shared import dropped, written

#: Fixed texts and numbers of the loop.
FEEDBACK_HEAD, TOO_SHORT = "\n\nCRITIC_FEEDBACK:\n", "output too short"
ITERATIONS, DEPTH, SNIPPET, ACCEPT_OVER = 3, 10, 200, 10


def echo_student(prompt: Column, context: Column) -> Column:
    return F.concat(F.lit("EXECUTION_RESULT:\nPrompt:\n"), prompt, F.lit("\n---\nContext-snippet: "), F.substring(context, 1, SNIPPET))


def length_critic(over: int = ACCEPT_OVER) -> Callable[[Column, Column], Column]:
    """struct<accepted, feedback>: longer than ``over`` is accepted."""

    def critic(output: Column, context: Column) -> Column:
        ok = F.coalesce(F.length(output) > over, F.lit(False))
        return F.struct(ok.alias("accepted"), F.when(~ok, F.lit(TOO_SHORT)).alias("feedback"))

    return critic


@dataclass(frozen=True)
class Loop:
    planner: Callable[[Column], Column] = sentences
    student: Callable[[Column, Column], Column] = echo_student
    critic: Callable[[Column, Column], Column] = length_critic()
    max_iterations: int = ITERATIONS
    loop_until_accepted: bool = True


def calls_python(rows: DataFrame, *columns: Column) -> bool:
    """Whether any of the columns, made of ``rows``, holds a Python function."""
    made = rows.select(*columns)._jdf.queryExecution().analyzed().expressions()
    return any('.PythonUDF"' in made.apply(i).toJSON() for i in range(made.size()))


def _with_feedback(context: Column, verdict: Column) -> Column:
    none = verdict["accepted"] | verdict["feedback"].isNull() | (verdict["feedback"] == "")
    return F.when(none, context).otherwise(F.concat(context, F.lit(FEEDBACK_HEAD), verdict["feedback"]))


def run(rows: DataFrame, loop: Loop = Loop()) -> DataFrame:
    """Adds output, iters and final_context to rows of (task text, context).

    A task without a sentence has a null output. Feedback is appended to the context, never to
    the prompt; the last output stands if none is accepted; no iteration gives ''. Students and
    critics that are Python functions are called by rounds.
    """
    steps = loop.planner(F.col("text"))
    prompt = F.when(F.size(steps) > 0, F.array_join(steps, "\n"))
    if loop.max_iterations < 1:
        return rows.withColumn("output", F.when(prompt.isNotNull() | F.lit(True), F.lit(""))).withColumn("iters", F.lit(0).cast("bigint")).withColumn("final_context", F.col("context"))
    rows, context = rows.withColumn("_prompt", prompt), F.col("context")
    python = calls_python(rows, loop.student(F.col("_prompt"), context), loop.critic(F.lit(""), context))
    out = (by_rounds if python else _fold)(rows, loop)
    return out.withColumn("output", F.when(F.col("_prompt").isNotNull(), F.coalesce("output", F.lit("")))).drop("_prompt")


def _fold(rows: DataFrame, loop: Loop) -> DataFrame:
    zero = F.struct(F.col("context").alias("context"), F.lit(None).cast("string").alias("output"), F.lit(0).cast("bigint").alias("iters"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        output = loop.student(F.col("_prompt"), s["context"])
        verdict = loop.critic(output, s["context"])
        after = F.struct(_with_feedback(s["context"], verdict).alias("context"), output.alias("output"), (s["iters"] + 1).alias("iters"), (verdict["accepted"] | F.lit(not loop.loop_until_accepted)).alias("done"))
        return F.when(s["done"], s).otherwise(after)

    state = F.aggregate(F.array(*[F.lit(i) for i in range(loop.max_iterations)]), zero, step)
    return rows.withColumn("_s", state).withColumn("output", F.col("_s.output")).withColumn("iters", F.col("_s.iters")).withColumn("final_context", F.col("_s.context")).drop("_s")


def by_rounds(rows: DataFrame, loop: Loop) -> DataFrame:
    """The loop over rows with ``_prompt``, a round at a time.

    A round is two tables: the student's answers of the rows that are open, and these with the critic's
    verdict. What a task has written is not asked again, in later rounds or if an executor is
    lost after it. Ends as soon as no row is open, after ``max_iterations`` rounds at most.
    """
    done, still = [], rows.withColumn("final_context", F.col("context"))
    for k in range(1, loop.max_iterations + 1):
        said = written(still.withColumn("output", loop.student(F.col("_prompt"), F.col("final_context"))), f"answers-{k}")
        judged = said.withColumn("_v", loop.critic(F.col("output"), F.col("final_context")))
        ended = F.coalesce(F.col("_v.accepted"), F.lit(False)) | F.lit(not loop.loop_until_accepted)
        after = written(judged.withColumns({"final_context": _with_feedback(F.col("final_context"), F.col("_v")), "iters": F.lit(k).cast("bigint"), "_done": ended}).drop("_v"), f"round-{k}")
        dropped(said)
        still = after.where("not _done").drop("_done")
        done.append(after.where("_done").drop("_done"))
        if k == loop.max_iterations or still.isEmpty():
            break
    out = still
    for d in done:
        out = out.unionByName(d)
    return out
