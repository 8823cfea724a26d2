from corvane.operators import evaluate
from corvane.plans import catalogue


def test_eval_execute_runs_a_program_per_row(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, q) for k, q in enumerate([1, 1, 0, None, 1, 0])], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    ran, run = [], evaluate.run_programs

    def seen(rows, *a):
        ran.append(rows.count())
        return run(rows, *a)

    monkeypatch.setattr(evaluate, "run_programs", seen)
    got = catalogue.queries()["eval_execute"](spark, str(tmp_path)).collect()
    want = [(k, q, "passed" if q else "failed: ", q) for k, q in [(0, 1), (1, 1), (2, 0), (4, 1), (5, 0)]]
    assert ran == [5] and sorted(map(tuple, got)) == want


def test_summary_runs_each_program_once(spark, tmp_path):
    mark = f"open({str(tmp_path / 'ran')!r}, 'a').write('x')"
    row = [("p", "1", {"library": "l", "perturbation_type": None}, f"{mark}\ndef test_execution(c): assert c == 2")]
    tasks = spark.createDataFrame(row, "prompt string, reference_code string, metadata map<string,string>, code_context string")
    rows = evaluate.evaluate(tasks, lambda x: x, lambda t: (t["reference_code"].cast("int") + 1).cast("string"), timeout=20)
    got = [tuple(r) for r in evaluate.summary(rows).collect()]
    assert got == [(0, None, 1, 1.0), (1, "l", 1, 1.0)] and (tmp_path / "ran").read_text() == "x"
