"""Evaluation of generated programs: assembly, isolated runs, scores and summaries.

Programs are run as they are, in child processes of a Python worker, with a temporary working
folder, no standard streams, a time limit and, if asked for, limits of what they use. When a program ends, or has
gone beyond a limit, all processes that it has begun are killed, wherever they have put themselves. That is
isolation against accidents, not against malice: run it only on programs, or hosts, that you trust. Turn
speculative execution off.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import select
import signal
import subprocess
import sys
import tempfile
import threading
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds for a program, and labels.
TIMEOUT, PASSED, TIMED_OUT, FAILED = 120.0, "passed", "timed out", "failed: "


@dataclass(frozen=True)
class Limits:
    """What a program may use; 0 is no limit. Beyond memory, file and files the program gets an error of its own;
    cpu counts as timed out; beyond processes and disk it is stopped and fails.

    memory: bytes of address space. cpu: seconds. file: bytes of one file. files: open files. processes: those of the
    program at once, it included. disk: bytes in its working folder.
    """

    memory: int = 0
    cpu: int = 0
    file: int = 0
    files: int = 0
    processes: int = 0
    disk: int = 0


# The child is a keeper: it forks each program that it is sent, looks after it, and adopts and kills what it leaves behind.
_CHILD = """
import ctypes, json, os, resource, signal, sys, time
timeout, limits = float(sys.argv[1]), json.loads(sys.argv[2])
asked, answers, null = os.dup(0), os.dup(1), os.open(os.devnull, os.O_RDWR)
for standard in (0, 1, 2):
    os.dup2(null, standard)
os.close(null)
libc = ctypes.CDLL(None)
libc.prctl(36, 1, 0, 0, 0)  # orphans below become children of this process
libc.prctl(1, signal.SIGTERM, 0, 0, 0)  # the end of the worker ends this process
signal.pthread_sigmask(signal.SIG_BLOCK, {signal.SIGCHLD})  # waited for

def program(text, label, cwd):
    class OutOfTime(Exception): pass
    def ring(*_): raise OutOfTime
    signal.signal(signal.SIGTERM, signal.SIG_DFL)
    signal.pthread_sigmask(signal.SIG_UNBLOCK, {signal.SIGCHLD})
    os.close(asked)
    os.close(answers)
    os.chdir(cwd)
    to, me = os.open(label, os.O_WRONLY | os.O_CREAT | os.O_TRUNC), os.getpid()
    for kind, name in ((resource.RLIMIT_AS, "memory"), (resource.RLIMIT_CPU, "cpu"), (resource.RLIMIT_FSIZE, "file"), (resource.RLIMIT_NOFILE, "files")):
        if limits[name]:
            resource.setrlimit(kind, (limits[name], limits[name]))
    signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, timeout)
    try:
        exec(text, {})
        said = "passed"
    except OutOfTime:
        said = "timed out"
    except BaseException as e:
        said = "failed: " + str(e)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
    if os.getpid() == me:  # not a copy of the program that came back from a fork
        os.write(to, said.encode("utf-8", "replace"))

def below():
    children = {}
    for x in os.listdir("/proc"):
        if x.isdigit():
            try:
                stat = open(f"/proc/{x}/stat").read().rpartition(")")[2].split()
            except OSError:
                continue
            if stat[0] != "Z":
                children.setdefault(int(stat[1]), []).append(int(x))
    found, todo = [], [os.getpid()]
    while todo:
        own = children.get(todo.pop(), [])
        found += own
        todo += own
    return found

def size(top):
    total = 0
    for d, _, names in os.walk(top):
        for n in names:
            try:
                total += os.lstat(os.path.join(d, n)).st_blocks * 512
            except OSError:
                pass
    return total

def stop(*_):
    raise SystemExit

signal.signal(signal.SIGTERM, stop)

def reaped():
    '''Takes in children that have ended; whether others are left. Without a child there is nothing below.'''
    try:
        while os.waitpid(-1, os.WNOHANG)[0]:
            pass
    except ChildProcessError:
        return False
    return True

def keep(text, label, cwd):
    pid, why, begun = os.fork(), None, time.monotonic()
    if not pid:
        try:
            program(text, label, cwd)
        finally:
            os._exit(0)
    try:
        while os.waitpid(pid, os.WNOHANG) == (0, 0) and (left := begun + timeout + 1 - time.monotonic()) > 0:
            if limits["processes"] and len(below()) > limits["processes"]:
                why = "failed: too many processes"
            elif limits["disk"] and size(cwd) > limits["disk"]:
                why = "failed: too much disk"
            if why:
                break
            # until a child ends; what is counted from outside is looked at in between
            signal.sigtimedwait({signal.SIGCHLD}, min(left, 0.01) if limits["processes"] or limits["disk"] else left)
    finally:
        signal.signal(signal.SIGTERM, signal.SIG_IGN)
        while reaped():
            for p in below():
                try:
                    os.kill(p, signal.SIGKILL)
                except OSError:
                    pass
            signal.sigtimedwait({signal.SIGCHLD}, 0.01)
        if why:
            open(label, "w").write(why)
    signal.signal(signal.SIGTERM, stop)

for line in os.fdopen(asked, "rb"):
    keep(*json.loads(line))
    os.write(answers, b".")
os._exit(0)
"""


class Keeper:
    """A child process that runs programs, one after the other, each in a fresh copy of it. It starts with the first, and again
    if a program has ended it."""

    def __init__(self, timeout: float = TIMEOUT, limits: Limits | None = None):
        self._timeout, self._limits, self._child = timeout, json.dumps(asdict(limits or Limits())), None

    def run(self, program: str) -> str:
        """The label of one program. A program that leaves no label (killed, crashed, out of CPU time) counts as timed out."""
        with tempfile.TemporaryDirectory() as top:
            label, cwd = Path(top, "label"), Path(top, "cwd")
            cwd.mkdir()
            if not self._answered(json.dumps([program, str(label), str(cwd)])):
                self.close()
            return (label.read_text(encoding="utf-8") if label.exists() else "") or TIMED_OUT

    def _answered(self, line: str) -> bool:
        if self._child is None:
            self._child = subprocess.Popen([sys.executable, "-c", _CHILD, str(self._timeout), self._limits], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, start_new_session=True)
        answer = select.poll()
        answer.register(self._child.stdout, select.POLLIN)
        try:
            self._child.stdin.write(line.encode() + b"\n")
            self._child.stdin.flush()
            return bool(answer.poll(1000 * (self._timeout + 30))) and self._child.stdout.read(1) == b"."
        except BrokenPipeError:
            return False

    def close(self) -> None:
        if self._child is not None:
            child, self._child = self._child, None
            with contextlib.suppress(ProcessLookupError):
                os.killpg(child.pid, signal.SIGKILL)
            child.stdout.close()
            with contextlib.suppress(BrokenPipeError):
                child.stdin.close()
            child.wait()


def execute(program: str, timeout: float = TIMEOUT, memory: int = 0, limits: Limits | None = None) -> str:
    """The label of one program, in a keeper of its own."""
    with contextlib.closing(Keeper(timeout, limits or Limits(memory=memory))) as keeper:
        return keeper.run(program)


def _once(journal: str | None, key: str, run: Callable[[], str]) -> str:
    """The label that the journal has for a run, or what ``run`` says now, noted there."""
    if not journal:
        return run()
    note = Path(journal, hashlib.sha256(key.encode()).hexdigest())
    if note.exists():
        return note.read_text(encoding="utf-8")
    said = run()
    part = note.with_name(f"{note.name}.{uuid.uuid4().hex}")
    part.write_text(said, encoding="utf-8")
    os.replace(part, note)  # whole or not at all
    return said


def assemble(context: Column, answer: Column, quote: bool = False) -> Column:
    """A test program: context, the answer as a value (as source text if ``quote``), and the calls of its checks."""
    value = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(answer, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"')) if quote else answer
    second = F.when(F.contains(context, F.lit("test_string(")), F.lit("test_string(code)\n")).otherwise(F.lit("\n"))
    return F.concat(context, F.lit("\ncode = "), value, F.lit("\ntest_execution(code)\n"), second)


#: Programs that a task runs at once, and rows of results that it hands on together.
PROCESSES, ROWS = 4, 64


def run_programs(rows: DataFrame, timeout: float = TIMEOUT, memory: int = 0, column: str = "program", limits: Limits | None = None, processes: int = PROCESSES, journal: str | None = None, key: str | None = None) -> DataFrame:
    """Adds result, passed and score (0 or 1).

    Each task keeps ``processes`` programs running, one row to a process: as one ends, the next row begins,
    whatever the batch. A process is a copy of the task's keepers, of which there are as many: Python starts for them alone. With ``journal``, a folder that all workers can open, a run is noted there under
    its ``key`` column (by default the program) and its limits, and a task that is repeated takes what is noted.
    """

    def labels(programs: Iterator[tuple[str, str]], pool: ThreadPoolExecutor, own: threading.local) -> Iterator[str]:
        running: deque = deque()
        for program, name in programs:
            running.append(pool.submit(_once, journal, f"{timeout} {limits} {memory} {name}", lambda p=program: own.keeper.run(p)))
            if len(running) >= 2 * processes:
                yield running.popleft().result()
        while running:
            yield running.popleft().result()

    def batches(frames):
        kept: deque = deque()

        def programs():
            for frame in frames:
                names = frame[key or column].astype(str)
                for at in range(0, len(frame), ROWS):
                    kept.append(frame.iloc[at : at + ROWS])
                    yield from zip(frame[column].iloc[at : at + ROWS], names.iloc[at : at + ROWS], strict=True)

        own = threading.local()  # each of the pool's threads has a keeper
        with contextlib.ExitStack() as keepers:

            def begin():
                own.keeper = keepers.enter_context(contextlib.closing(Keeper(timeout, limits or Limits(memory=memory))))

            with ThreadPoolExecutor(processes, initializer=begin) as pool:
                found: list[str] = []
                for label in labels(programs(), pool, own):
                    found.append(label)
                    if len(found) == len(kept[0]):
                        yield kept.popleft().assign(result=found)
                        found = []

    if processes < 1:
        raise ValueError("processes must be at least 1")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "result") + ", result string"
    out = rows.drop("result").mapInPandas(batches, schema)
    return out.withColumn("passed", F.col("result") == PASSED).withColumn("score", F.col("passed").cast("int"))


def _metadata(key: str) -> Column:
    m = F.col("metadata")
    return F.when(F.map_contains_key(m, key), m[key]).otherwise(F.raise_error(F.lit(f"missing key: {key}")))


def evaluate(tasks: DataFrame, method: Callable[[Column], Column], preprocess: Callable[[Column], Column] | None = None, timeout: float = TIMEOUT, quote: bool = False) -> DataFrame:
    """One result row per task. method: the task (a struct of its columns, or what ``preprocess`` makes of that) to the answer's text."""
    task = F.struct(*tasks.columns)
    answer = method(preprocess(task) if preprocess else task)
    rows = tasks.select(_metadata("library").alias("library"), _metadata("perturbation_type").alias("perturbation_type"), assemble(F.col("code_context"), answer, quote).alias("program"))
    return run_programs(rows, timeout).drop("program")


def overall(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("score").alias("n"), F.avg("score").alias("mean"))


def by(rows: DataFrame, key: str) -> DataFrame:
    """Count and mean of each key, in the order of keys."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("score").alias("n"), F.avg("score").alias("mean")).orderBy(key)


def summary(rows: DataFrame, library: str = "library", kind: str = "perturbation_type") -> DataFrame:
    """level 0 (overall), 1 (library), 2 (kind), key, n, mean, in the order of levels and keys.

    The rows are read once. Null keys only count overall; no rows give n = 0 and a null mean.
    """
    rows = rows.select(F.col(library).alias("a"), F.col(kind).alias("b"), "score")
    # a row without keys and score: without it, an empty input would have no overall row
    rows = rows.unionByName(rows.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))
    sets = rows.groupingSets([[], ["a"], ["b"]], "a", "b").agg(F.grouping_id().alias("g"), F.count("score").alias("n"), F.avg("score").alias("mean"))
    # grouping_id has a bit for each column that a row does not group by
    out = sets.select(F.when(F.col("g") == 3, 0).when(F.col("g") == 1, 1).otherwise(2).cast("bigint").alias("level"), F.coalesce(F.when(F.col("g") == 1, F.col("a")), F.when(F.col("g") == 2, F.col("b"))).alias("key"), "n", "mean")
    return out.where((F.col("level") == 0) | F.col("key").isNotNull()).orderBy("level", "key")
