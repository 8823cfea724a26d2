"""Tools as column functions: calculator, weather, and injected model calls with bounded retry."""

from __future__ import annotations

import ast
import operator
import time
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the tools' answers.
INVALID = "Error: Invalid characters in expression."
WEATHER = "The weather is GOOD!"
#: A power whose result would need more bits is refused.
MAX_BITS = 4096

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv}


def allowed(c: Column) -> Column:
    """Whether every character is a digit, an operator, a bracket, a point or a space."""
    return c.rlike(r"^[0-9+\-*/(). ]*\z")


def _value(node: ast.AST):
    match node:
        case ast.Expression(body=body):
            return _value(body)
        case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
            return v
        case ast.Tuple(elts=[]):
            return ()
        case ast.Call(func=f):  # a number followed by a bracket
            raise TypeError(f"'{type(_value(f)).__name__}' object is not callable")
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_value(x)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return +_value(x)
        case ast.BinOp(op=ast.Pow(), left=a, right=b):
            a, b = _value(a), _value(b)
            if isinstance(a, int) and isinstance(b, int) and b > 0 and a.bit_length() * b > MAX_BITS:
                raise ValueError("power too large")
            return a**b
        case ast.BinOp(op=op, left=a, right=b) if type(op) in _BINARY:
            return _BINARY[type(op)](_value(a), _value(b))
    raise ValueError("unsupported expression")


def calculate(expression: str | None) -> str | None:
    """The value of an arithmetic expression as Python prints it, or a text that begins with 'Error: '."""
    if expression is None:
        return None
    if not set(expression) <= set("0123456789+-*/(). "):
        return INVALID
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)  # of calls and subscripts of numbers
            tree = ast.parse(expression.lstrip(" "), "<string>", "eval")
        value = _value(tree)
        if value == ():
            raise ValueError("unsupported expression")
        return str(value)
    except (SyntaxError, ArithmeticError, ValueError, TypeError, RecursionError, MemoryError) as e:
        return f"Error: {e}"


@F.pandas_udf(StringType())
def _calculate(s: pd.Series) -> pd.Series:
    return s.map(calculate)


def calculator(c: Column) -> Column:
    """Only expressions of allowed characters reach Python."""
    return F.when(allowed(c), _calculate(F.when(allowed(c), c))).when(c.isNotNull(), F.lit(INVALID))


def weather(c: Column) -> Column:
    return F.lit(WEATHER)


def register(spark: SparkSession) -> None:
    """Makes calculator and weather SQL functions."""
    spark.udf.register("calculator", _calculate)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION weather(x STRING) RETURNS STRING RETURN '{WEATHER}'")


def tool_list(spark: SparkSession) -> list[str]:
    return sorted(f.name for f in spark.catalog.listFunctions() if f.isTemporary and f.name in ("calculator", "weather"))


class Pace:
    """Keeps calls at least ``gap`` seconds apart, for all who share it."""

    def __init__(self, gap: float):
        self._gap, self._next = gap, 0.0

    def wait(self) -> None:
        now = time.monotonic()
        begin = max(now, self._next)
        self._next = begin + self._gap
        if begin > now:
            time.sleep(begin - now)

    def hold(self, seconds: float) -> None:
        """No call for so long."""
        self._next = max(self._next, time.monotonic() + seconds)


#: One for each budget in a worker: batches and calls of one task after the other keep one pace.
_paces: dict[float, Pace] = {}


def _pace(gap: float) -> Pace:
    return _paces.setdefault(gap, Pace(gap))


def model_call(
    client: Callable[[], Callable[..., str]], tries: int = 5, first_wait: float = 1.0, retry_on: tuple = (Exception,), per_second: float | None = None, slots: int | None = None, most_wait: float = 60.0
) -> Callable[..., Column]:
    """A column function that sends each row's values to a client made once per batch, with bounded retries.

    Waits between tries grow as powers of two, or are what the error says in ``retry_after`` (seconds), ``most_wait`` at
    most. A null first value is not sent and gives null. With ``per_second``, the calls of the whole cluster stay
    under so many a second: each of ``slots`` (the tasks that can run at once; by default the cores that
    Spark has now) has an equal share and keeps it by pauses. The function is not deterministic to Spark, so no
    plan sends a row twice.
    """
    if tries < 1 or (per_second is not None and per_second <= 0):
        raise ValueError("tries and per_second must be positive")
    if per_second is not None and slots is None:
        slots = SparkSession.active().sparkContext.defaultParallelism
    gap = slots / per_second if per_second else 0.0

    @F.pandas_udf(StringType())
    def call(first: pd.Series, *rest: pd.Series) -> pd.Series:
        ask, pace = client(), _pace(gap)

        def one(*values):
            if values[0] is None:
                return None
            for k in range(tries):
                pace.wait()
                try:
                    return ask(*values)
                except retry_on as e:
                    if k == tries - 1:
                        raise
                    after = getattr(e, "retry_after", None)
                    wait = min(most_wait, first_wait * 2**k if after is None else float(after))
                    if after is None or not gap:
                        time.sleep(wait)
                    else:  # the server's own delay holds for all calls of this worker
                        pace.hold(wait)

        return pd.Series([one(*v) for v in zip(first, *rest, strict=True)], dtype=object)

    return call.asNondeterministic()
