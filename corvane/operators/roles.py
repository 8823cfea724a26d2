"""A multi-role refinement loop with injected roles and critics: one column expression, or a table for each role's turn.

As in agent.py, roles that are Python functions (a model's clients) take their turns by rounds: each turn
is one table of the rows that are open, with one batched call of the role.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.agent import calls_python
from corvane.sources.shared import dropped, written

#: Fixed texts: what each role says of a task description and its feedback.
DESCRIBE = "Describtion of task '%s'"
ALIGN = "Aligned task description '%s' based on '%s' feedback."
RESEARCH = "Research results for task description '%s' based on '%s' feedback."
SOLVE = "Solution for task description '%s' based on '%s' feedback."
PLAN = ("aligner", "scholar", "solver")
FULL_SCORE, ITERATIONS = 5, 3


def says(template: str) -> Callable[[Column, Column], Column]:
    a, b, c = template.split("%s")
    return lambda description, feedback: F.concat(F.lit(a), description, F.lit(b), feedback, F.lit(c))


#: What each role makes, in the state's columns.
MAKES = {"aligner": "aligned_info", "scholar": "research", "solver": "solution"}


@dataclass(frozen=True)
class Roles:
    """critic: iteration (from 1) to struct<scores array<int>, feedback array<string>>, each 4 wide; or, of
    other parameters, what they name of iteration, solution, research and aligned_info.

    A role of two parameters gets the description and its feedback, one of others what they name of
    description, context, aligned_info, research, solution and feedback.
    """

    critic: Callable[..., Column]
    aligner: Callable[..., Column] = says(ALIGN)
    scholar: Callable[..., Column] = says(RESEARCH)
    solver: Callable[..., Column] = says(SOLVE)
    plan: tuple[str, ...] = PLAN
    max_iterations: int = ITERATIONS


def _called(f: Callable[..., Column], first: tuple[str, ...], known: dict[str, Column]) -> Column:
    names = tuple(inspect.signature(f).parameters)
    return f(*[known[n] for n in (first if len(names) == len(first) else names)])


def _description(text_col: str) -> Column:
    a, b = DESCRIBE.split("%s")
    return F.concat(F.lit(a), F.col(text_col), F.lit(b))


def _turn(roles: Roles, name: str, description: Column, state: dict[str, Column]) -> Column:
    known = {**{c: state[c] for c in MAKES.values()}, "description": description, "context": F.lit(""), "feedback": state["feedback"][PLAN.index(name)]}
    return _called(getattr(roles, name), ("description", "feedback"), known)


def run(tasks: DataFrame, roles: Roles, text_col: str = "text") -> DataFrame:
    """Adds aligned_info, research, solution and iters. Accepted scores end the loop and are not kept; no iteration gives null.

    The roles of the plan take their turns in the order of PLAN. Python functions among the roles and
    critics are called by rounds.
    """
    state = {c: F.lit("") for c in MAKES.values()} | {"feedback": F.array(*[F.lit("")] * 3), "iteration": F.lit(1)}
    asked = [*[_turn(roles, n, _description(text_col), state) for n in PLAN if n in roles.plan], _called(roles.critic, ("iteration",), state)]
    return (by_rounds if calls_python(tasks, *asked) else _fold)(tasks, roles, text_col)


def _fold(tasks: DataFrame, roles: Roles, text_col: str) -> DataFrame:
    description, null = _description(text_col), F.lit(None).cast("string")
    zero = F.struct(*[null.alias(c) for c in MAKES.values()], F.array(*[F.lit("")] * 3).alias("feedback"), F.lit(0).cast("bigint").alias("iters"), F.lit(False).alias("done"))

    def step(s: Column, i: Column) -> Column:
        now = {c: s[c] for c in (*MAKES.values(), "feedback")}
        for name in PLAN:
            if name in roles.plan:
                now[MAKES[name]] = _turn(roles, name, description, now)
        seen = _called(roles.critic, ("iteration",), now | {"iteration": i})
        done = F.array_min(seen["scores"]) >= FULL_SCORE
        after = F.struct(*[now[c].alias(c) for c in MAKES.values()], F.when(done, s["feedback"]).otherwise(seen["feedback"]).alias("feedback"), (s["iters"] + 1).alias("iters"), done.alias("done"))
        return F.when(s["done"], s).otherwise(after)

    turns = F.array(*[F.lit(i) for i in range(1, roles.max_iterations + 1)]) if roles.max_iterations > 0 else F.array().cast("array<int>")
    out = tasks.withColumn("_s", F.aggregate(turns, zero, step))
    return out.select(*tasks.columns, *[f"_s.{c}" for c in MAKES.values()], "_s.iters")


def by_rounds(tasks: DataFrame, roles: Roles, text_col: str = "text") -> DataFrame:
    """The loop a round at a time: a written table for each role's turn and one for the critic's, of the open rows alone."""
    if roles.max_iterations < 1:
        null = F.lit(None).cast("string")
        return tasks.select("*", *[null.alias(c) for c in MAKES.values()], F.lit(0).cast("bigint").alias("iters"))
    own = [c for c in tasks.columns if c not in (*MAKES.values(), "iters")]
    still = tasks.select(F.struct(*own).alias("_row"), _description(text_col).alias("_description"), *[F.lit(None).cast("string").alias(c) for c in MAKES.values()], F.array(*[F.lit("")] * 3).alias("feedback"))
    done = []
    for k in range(1, roles.max_iterations + 1):
        for name in PLAN:
            if name in roles.plan:
                last, now = still, {c: F.col(c) for c in (*MAKES.values(), "feedback")}
                # the row's own columns stand beside, so that a role's function may name them
                still = written(_beside(still, own).withColumn(MAKES[name], _turn(roles, name, F.col("_description"), now)).drop(*own), f"{name}-{k}")
                if hasattr(last, "_written_at"):
                    dropped(last)
        known = {c: F.col(c) for c in MAKES.values()} | {"iteration": F.lit(k)}
        seen = _beside(still, own).withColumn("_v", _called(roles.critic, ("iteration",), known)).drop(*own)
        ended = F.coalesce(F.array_min("_v.scores") >= FULL_SCORE, F.lit(False))
        after = written(seen.withColumns({"feedback": F.when(ended, F.col("feedback")).otherwise(F.col("_v.feedback")), "iters": F.lit(k).cast("bigint"), "_done": ended}).drop("_v"), f"critic-{k}")
        if hasattr(still, "_written_at"):
            dropped(still)
        done.append(after.where("_done"))
        still = after.where("not _done")
        if k == roles.max_iterations or still.isEmpty():
            break
        still = still.drop("_done", "iters")
    out = still
    for d in done:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.select("_row.*", *MAKES.values(), "iters")


def _beside(state: DataFrame, own: list[str]) -> DataFrame:
    return state.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], "*")


def injected_scores(key: Column, period: int = 4) -> Callable[[Column], Column]:
    """A repeatable critic: all 5 when key + iteration is a multiple of ``period``, else all 3."""

    def critic(i: Column) -> Column:
        score = F.when(F.pmod(key + i, F.lit(period)) == 0, 5).otherwise(3)
        return F.struct(F.array(*[score] * 4).alias("scores"), F.array(*[F.concat(F.lit("fb"), i.cast("string"), F.lit(f"_{k}")) for k in range(4)]).alias("feedback"))

    return critic
