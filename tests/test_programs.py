"""Program runs: as many at once as asked for, labels by limits, and nothing left behind."""

import contextlib
import subprocess
import time
import uuid

import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluate
from corvane.operators.evaluate import Limits, execute


def alive(mark):
    """Processes that have the mark among their arguments, zombies apart."""
    out = subprocess.run(["ps", "-eo", "stat,args"], capture_output=True, text=True).stdout
    return [x for x in out.splitlines() if mark in x and not x.startswith("Z") and " ps " not in x]


def test_sleeping_programs_run_side_by_side(spark):
    rows = spark.range(64).repartition(4).withColumn("program", F.lit("import time; time.sleep(1)"))
    evaluate.run_programs(rows.limit(4), 20).collect()  # workers are up
    begun = time.time()
    assert [r.result for r in evaluate.run_programs(rows, 20).collect()] == ["passed"] * 64
    assert time.time() - begun < 10


def test_rows_keep_their_results(spark):
    """Over several slices of a batch, with slow ones between."""
    rows = spark.range(150).coalesce(1).withColumn("program", F.concat(F.lit("import time; time.sleep(0.3 if "), "id", F.lit(" % 40 == 0 else 0); assert "), "id", F.lit(" % 3, "), "id"))
    got = {r.id: r.result for r in evaluate.run_programs(rows, 20).collect()}
    assert got == {k: "passed" if k % 3 else f"failed: {k}" for k in range(150)}
    assert evaluate.run_programs(rows.where("false"), 20).count() == 0
    with pytest.raises(ValueError):
        evaluate.run_programs(rows, processes=0)


def test_a_repeated_task_takes_what_is_noted(spark, tmp_path):
    (tmp_path / "journal").mkdir()
    program = f"open({str(tmp_path / 'ran')!r}, 'a').write('x')"
    rows = spark.range(6).coalesce(1).withColumn("program", F.lit(program))
    for _ in range(2):
        assert evaluate.run_programs(rows, 20, journal=str(tmp_path / "journal"), key="id").where("passed").count() == 6
    assert (tmp_path / "ran").read_text() == "x" * 6


@pytest.mark.parametrize(
    "program,limits,label",
    [
        ("while True: pass", Limits(cpu=1), "timed out"),
        ("x = bytearray(1 << 31)", Limits(memory=1 << 29), "failed: "),
        ("open('f', 'wb').write(bytes(1 << 22))", Limits(file=1 << 20), "failed: [Errno 27] File too large"),
        ("k = [open('/dev/null') for _ in range(99)]", Limits(files=32), "failed: [Errno 24]"),
        ("import time\nfor k in range(500):\n open(f'f{k}', 'wb').write(bytes(1 << 20)); time.sleep(0.01)", Limits(disk=8 << 20), "failed: too much disk"),
        ("import os, time\nfor _ in range(30):\n if not os.fork(): time.sleep(30)\ntime.sleep(30)", Limits(processes=8), "failed: too many processes"),
        ("x = 1", Limits(memory=1 << 30, cpu=5, file=1 << 20, files=64, processes=4, disk=1 << 20), "passed"),
        ("import os\nif not os.fork(): raise ValueError('of the copy')\nos.wait()", None, "passed"),
    ],
)
def test_limits_give_labels(program, limits, label):
    begun = time.time()
    assert execute(program, 20, limits=limits).startswith(label) and time.time() - begun < 15


@pytest.mark.parametrize("end", ["", "while True: pass", "import os; os.kill(os.getpid(), 9)"])
def test_no_child_survives(end):
    mark = uuid.uuid4().hex
    # one stays in the group, one leaves its session, one is orphaned in a session of its own
    program = f"""
import subprocess, sys
sleep = [sys.executable, '-c', 'import time; time.sleep(60)', {mark!r}]
subprocess.Popen(sleep)
subprocess.Popen(sleep, start_new_session=True)
subprocess.run([sys.executable, '-c', f'import subprocess; subprocess.Popen({{sleep!r}}, start_new_session=True)'])
{end}
"""
    assert execute(program, 3) == ("passed" if not end else "timed out")
    assert alive(mark) == []


def test_keepers_serve_many_programs(spark, tmp_path):
    """Python starts once for each keeper, not for each program."""
    rows = spark.range(120).repartition(2).withColumn("program", F.lit(f"import os; open({str(tmp_path / 'parents')!r}, 'a').write(f'{{os.getppid()}} '); x = 1"))
    assert evaluate.run_programs(rows, 20).where("passed").count() == 120
    parents = (tmp_path / "parents").read_text().split()
    assert len(parents) == 120 and len(set(parents)) <= 2 * evaluate.PROCESSES


def test_programs_of_a_keeper_know_nothing_of_each_other(spark):
    """What one changes, leaves in its folder or does to its keeper is not seen by the next."""
    spoil = ["import builtins; builtins.spoilt = open('spoilt', 'w')", "import os, signal; os.kill(os.getppid(), signal.SIGKILL); import time; time.sleep(9)", "import os; os.environ['spoilt'] = '1'; os.chdir('/'); os._exit(3)", "import sys; sys.modules['json'] = None; raise ValueError('a')"]
    look = "import builtins, json, os\nassert not hasattr(builtins, 'spoilt') and os.listdir() == [] and 'spoilt' not in os.environ and os.read(0, 1) == b''"
    programs = [p for s in spoil for p in (s, look, look)]
    rows = spark.createDataFrame(list(enumerate(programs)), "id long, program string").coalesce(1)
    got = [r.result for r in evaluate.run_programs(rows, 20, processes=1).orderBy("id").collect()]
    assert got == ["passed"] * 3 + ["timed out", "passed", "passed"] * 2 + ["failed: a", "passed", "passed"]


def test_large_programs_and_labels():
    text = "x" * 300_000 + "\u00e9\n"
    with contextlib.closing(evaluate.Keeper(20)) as keeper:
        assert keeper.run(f"raise ValueError({text!r})") == f"failed: {text}" and keeper.run("assert True") == "passed"


def test_the_end_of_a_program_is_seen_at_once():
    """no pause before the keeper looks again, and no walk through all processes where none are left."""
    limits = Limits(memory=1 << 30, file=100_000, files=64)
    with contextlib.closing(evaluate.Keeper(20, limits)) as keeper:
        took = []
        for _ in range(100):
            begun = time.perf_counter()
            assert keeper.run("assert True") == "passed"
            took.append(time.perf_counter() - begun)
    assert min(took) < 0.01
