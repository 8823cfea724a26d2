"""Rules over conversations(conv_id, turn, role, text), and group conversations of agents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import ends_with_stop_word
from corvane.operators.agent import calls_python
from corvane.sources.shared import dropped, written

ROUNDS = 10


def rounds(turns: DataFrame, most: int = ROUNDS) -> DataFrame:
    """The first ``most`` turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def until_end(turns: DataFrame) -> DataFrame:
    """Turns up to the first that ends the conversation, it included."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("_e", F.coalesce(F.max(ends_with_stop_word(F.col("text")).cast("int")).over(w), F.lit(0))).where(F.col("_e") == 0).drop("_e")


def ends(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", ends_with_stop_word(F.col("text")).alias("is_end"))


def last_message(turns: DataFrame) -> DataFrame:
    out = turns.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("m"))
    return out.select("conv_id", "m.*")


def converse(seeds: DataFrame, agents: list[tuple[str, Callable[[Column], Column]]], opener: str = "User_Proxy", most: int = ROUNDS) -> DataFrame:
    """Conversations (conv_id, turn, role, text) from seeds(conv_id, text): the opener says the seed, then agents reply in turn.

    An agent makes its reply of the array of texts so far. A conversation ends with the first
    message that ends in the stop word, or after ``most`` messages. Agents that are Python functions
    reply by rounds.
    """
    if not agents:
        raise ValueError("a conversation needs an agent")
    python = calls_python(seeds, *[reply(F.array("text")) for _, reply in agents])
    return (by_rounds if python else _fold)(seeds, agents, opener, most)


def _fold(seeds: DataFrame, agents: list[tuple[str, Callable[[Column], Column]]], opener: str, most: int) -> DataFrame:
    said = F.array(F.struct(F.lit(opener).alias("role"), F.col("text").alias("text")))

    def step(s: Column, k: Column) -> Column:
        heard = F.transform(s, lambda m: m["text"])
        turn = F.pmod(k, F.lit(len(agents)))
        message = F.struct(F.lit(agents[0][0]).alias("role"), agents[0][1](heard).alias("text"))
        for i, (name, reply) in list(enumerate(agents))[1:]:
            message = F.when(turn == i, F.struct(F.lit(name).alias("role"), reply(heard).alias("text"))).otherwise(message)
        return F.when(ends_with_stop_word(F.element_at(heard, -1)), s).otherwise(F.concat(s, F.array(message)))

    if most > 1:
        said = F.aggregate(F.sequence(F.lit(0), F.lit(most - 2)), said.cast("array<struct<role:string,text:string>>"), step)
    return seeds.select("conv_id", F.posexplode(said).alias("turn", "m")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.text").where(F.lit(most > 0))


def by_rounds(seeds: DataFrame, agents: list[tuple[str, Callable[[Column], Column]]], opener: str = "User_Proxy", most: int = ROUNDS, window: int = 0, speaker: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The same with a written table of messages for each turn, in which each open conversation has one row.

    The speaker of a turn comes from a join of the open conversations with the table of agents: by
    default by their place in turn, or by the name that ``speaker`` makes of the last role and text (a name
    that no agent has ends the conversation). Its agent alone gets the conversation, with the
    texts of the last ``window`` messages (0: all). Repeated and null conv_ids are conversations of
    their own.
    """
    spark = seeds.sparkSession
    if most < 1:
        return seeds.select("conv_id", F.lit(0).cast("bigint").alias("turn"), F.lit(opener).alias("role"), "text").where("false")
    first = seeds.select(F.monotonically_increasing_id().alias("_conv"), "conv_id", F.lit(0).cast("bigint").alias("turn"), F.lit(opener).alias("role"), "text")
    turns = [written(first, "turn-0")]
    names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(agents)], "_place int, _name string")
    for k in range(1, most):
        last = turns[-1].where(~ends_with_stop_word(F.col("text")))
        chosen = speaker(F.col("role"), F.col("text")) if speaker else None
        due = (chosen == F.col("_name")) if speaker else F.pmod(F.col("turn"), F.lit(len(agents))) == F.col("_place")
        # as many rows as agents
        due = last.join(F.broadcast(names), due).select("_conv", "conv_id", F.col("_name").alias("role"))
        before = turns[-window:] if window else turns
        heard = before[0]
        for t in before[1:]:
            heard = heard.unionByName(t)
        heard = heard.groupBy("_conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"]).alias("_heard"))
        waiting = written(due.join(heard, "_conv"), f"waiting-{k}")
        said = [waiting.where(F.col("role") == n).select("_conv", "conv_id", F.lit(k).cast("bigint").alias("turn"), "role", reply(F.col("_heard")).alias("text")) for n, reply in dict(agents).items()]
        for s in said[1:]:
            said[0] = said[0].unionByName(s)
        turns.append(written(said[0], f"turn-{k}"))
        dropped(waiting)
        if turns[-1].isEmpty():
            break
    out = turns[0]
    for t in turns[1:]:
        out = out.unionByName(t)
    return out.drop("_conv")
