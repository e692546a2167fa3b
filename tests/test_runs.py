"""Outputs, runs and their files on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from gridlogic.functions import algebra, graph, outputs
from gridlogic.functions.vocab import aliases_for
from gridlogic.operators import dashboard, evaluation, external, runs, sampling, tasks, training
from gridlogic.operators.hold import held
from gridlogic.sources import documents, files


def many(spark, values, column):
    return [r.o for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column.alias("o")).collect()]


def test_grids_and_answers_in_outputs(spark):
    texts = ['{"ascii": {"grid": "g"}}', '{"ascii": {"grid": "", "simple": "s"}}', '{"ascii": "a"}', '{"ascii": {"grid": ""}, "simple": "d"}', '{"ascii": {"grid": 5}, "answer": " x "}', "[1]", "3", "no json {", "", None]
    assert many(spark, texts, outputs.grid_of(F.col("v"))) == ["g", "s", "a", "d", None, None, None, None, None, None]
    assert many(spark, texts, outputs.answer_of(F.col("v"))) == ["", "", "", "", "x", "[1]", "3", "no json {", "", None]


def test_directions_and_messages(spark):
    said = {"North-West": "top-left", "bottom right": "bottom-right", "lower_east": "bottom-right", "higherwest": "top-left", "Same Spot!": "same spot", "stacked": "overlap", "aligned vertically": "same column", "nowhere": "nowhere", "": "", None: ""}
    assert many(spark, said, outputs.canonical_direction(F.col("v"))) == list(said.values())
    assert many(spark, ["reset reason: x", "Connection refused", "connection refused", None], outputs.retriable(F.col("v"))) == [True, True, False, False]
    entry = outputs.reasoning_entry(F.lit('a"b\\'), F.col("v"), F.lit(False))
    got = many(spark, ['{"content": "c", "usage": {"n": [1]}, "other": 2}', "{}", None, "x"], entry)
    assert json.loads(got[0])["test_id"] == 'a"b\\' and json.loads(got[0])["usage"] == {"n": [1]} and len(json.loads(got[0])) == 9 and got[1:] == [None, None, None]


def test_run_folders(spark, tmp_path):
    root = f"file://{tmp_path}/m"
    with pytest.raises(FileNotFoundError):
        runs.evaluation_dir(spark, root)
    files.write_file(spark, f"{root}/task_c_evaluation.json", "{}")
    assert runs.evaluation_dir(spark, root) == root
    files.write_file(spark, f"{root}/evaluation/x", "")
    assert runs.evaluation_dir(spark, root) == f"{root}/evaluation"
    files.write_file(spark, f"{root}/outputs/evaluation/x", "")
    assert runs.evaluation_dir(spark, root) == f"{root}/outputs/evaluation"
    assert runs.dataset_path(spark, root) == runs.DEFAULT_DATASET
    files.write_file(spark, f"{root}/run_config.json", '{"args": {"dataset": "here.jsonl"}}')
    assert runs.dataset_path(spark, root) == "here.jsonl"


GRID = "+--+\n|B |\n+--+\n|A |\n+--+"
CASE = {"id": "1", "description": "B is above A.", "query_relation": "Where is B relative to A?", "query_type": "full", "label": "above", "ascii": {"grid": GRID, "simple": "B\nA"}, "num_components": 2}


def write_rows(spark, path, rows):
    files.write_file(spark, path, "".join(json.dumps(r) + "\n" for r in rows))


def test_a_whole_run_is_evaluated(spark, tmp_path):
    root = f"file://{tmp_path}/a run (v1)+x"
    write_rows(spark, f"{root}/data.jsonl", [CASE])
    good = {"A": {"ascii": {"grid": GRID}}, "B": {"description": "B is above A."}, "C": {"answer": "It is north."}, "E": {"answer": "above", "ascii": {"grid": GRID}}, "G": {"answer": "above", "ascii": {"grid": GRID}}}
    for task, output in good.items():
        rows = [{"test_id": "1", "model_output": output}, {"test_id": "1", "model_output": "{}"}, {"test_id": "missing", "model_output": json.dumps(output)}, {"test_id": None, "model_output": None}]
        write_rows(spark, f"{root}/{'g/h' if task == 'G' else '.'}/task_{task}_results.jsonl", rows)
    got = {(r.task, r.path): (r.total_samples, r.correct_count, r.accuracy) for r in evaluation.evaluate_folder(spark, root, f"{root}/data.jsonl").collect()}
    assert got == {("a", "."): (4, 1, 0.25), ("b", "."): (4, 2, 0.5), ("c", "."): (4, 1, 0.25), ("e", "."): (4, 1, 1.0), ("g", "g/h"): (4, 1, 1.0)}  # B: no description states nothing wrong; E and G: of the one that is evaluated
    folder = tmp_path / "a run (v1)+x/outputs/evaluation"
    assert sorted(p.name for p in folder.glob("*.json")) == ["_documents.json", "_summary_documents.json", "evaluation_summary.json", "task_a_evaluation.json", "task_b_evaluation.json", "task_c_evaluation.json", "task_e_evaluation.json", "task_g_g_h_evaluation.json"]
    e = json.loads((folder / "task_e_evaluation.json").read_text())
    assert e["breakdown"]["skip_reasons"] == {"model_error": 2, "not_in_dataset": 1, "no_ascii": 0} and e["breakdown"]["error_mapping"]["correct_ascii_correct_answer"] == 1
    assert e["breakdown"]["by_ascii_accuracy"]["[0.75, 1]"]["avg_num_components"] == 2 and e["breakdown"]["by_ascii_accuracy"]["[0, 0.25)"]["total"] == 0
    assert [r["test_id"] for r in e["individual_results"]] == ["1", "1", "missing", None] and e["individual_results"][0]["evaluation"]["correct"] is True
    assert e["individual_results"][1] == {"test_id": "1", "status": "skipped", "reason": "missing answer"}
    c = json.loads((folder / "task_c_evaluation.json").read_text())
    assert c["summary"]["macro_f1"] == 1.0 and c["breakdown"]["confusion_matrix"] == {"expected_above_predicted_above": 1, "expected_above_predicted_": 1} and c["breakdown"]["by_direction"] == {"above": {"correct": 1, "total": 2}}
    assert c["breakdown"]["classification_metrics_by_query_type"]["full"]["per_class"]["above"]["support"] == 1
    summary = json.loads((folder / "evaluation_summary.json").read_text())
    assert list(summary["tasks"]) == ["a", "b", "c", "e", "g:g/h"] and summary["tasks"]["g:g/h"]["evaluated"] == 1 and summary["run_id"] == "unknown"
    assert evaluation.evaluate_folder(spark, root, f"{root}/data.jsonl", tasks=("H",)).isEmpty()
    assert files.evaluated_runs(spark, f"file://{tmp_path}") == ["a run (v1)+x"]
    assert [r.run for r in files.discover_runs(files.read_results(spark, f"file://{tmp_path}"), f"file://{tmp_path}").collect()] == ["a run (v1)+x"]


def test_results_keep_the_order_of_their_lines(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    write_rows(spark, f"{root}/data.jsonl", [CASE])
    files.write_file(spark, f"{root}/task_c_results.jsonl", "".join(f'{{"test_id": "{(i * 7919) % 5000}", "model_output": "no"}}\n\n' for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits of one file
    try:
        evaluation.evaluate_folder(spark, root, f"{root}/data.jsonl")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    read = json.loads((tmp_path / "run/outputs/evaluation/task_c_evaluation.json").read_text())
    assert [r["test_id"] for r in read["individual_results"]] == [str((i * 7919) % 5000) for i in range(5000)]


def test_the_last_file_of_a_name_stays(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    write_rows(spark, f"{root}/data.jsonl", [CASE])
    for path, n in (("task_c.jsonl", 1), ("task_c_results.jsonl", 2), ("x/y/task_d.jsonl", 3), ("x_y/task_d.jsonl", 4)):
        write_rows(spark, f"{root}/{path}", [{"test_id": "1", "model_output": '{"answer": "above"}'}] * n)
    got = {(r.task, r.path): r.total_samples for r in evaluation.evaluate_folder(spark, root, f"{root}/data.jsonl").collect()}
    assert got == {("c", "."): 2, ("d", "x_y"): 4}


def leaves(spark, rows):
    return spark.createDataFrame([(d, [(p, at, name, line) for p, at, name, line in path], v) for d, path, v in rows], documents.LEAF)


def test_documents_of_leaves(spark, tmp_path):
    f = lambda at, name: (None, at, name, None)
    e = lambda at, line=0, part="p": (part, at, None, line)
    rows = [
        ("d 1%.json", [f(1, "b"), f(0, 'q"\\')], "1"), ("d 1%.json", [f(1, "b"), f(0, "r"), e(0), f(0, "deep")], '"x"'), ("d 1%.json", [f(0, "a")], "null"), ("d 1%.json", [f(1, "b"), f(0, "r"), e(1), f(0, "deep")], "[]"),
        ("d 1%.json", [f(2, "list"), e(10)], '{"i":1}'), ("d 1%.json", [f(2, "list"), e(9, 5)], '{"i":0}'), ("d 1%.json", [f(2, "list"), e(0, 0, "q")], '"last\\n"'),
        ("array.json", [e(0), e(0)], "1"), ("array.json", [e(0), e(1)], "2"), ("array.json", [e(1)], "3"), ("one.json", [f(0, "")], "true"),
    ]
    folder = f"file://{tmp_path}/docs"
    files.write_file(spark, f"{folder}/one.json", "old")
    files.write_file(spark, f"{folder}/kept.json", "kept")
    assert documents.write_documents(leaves(spark, rows), folder) == ["array.json", "d 1%.json", "one.json"]
    read = lambda name: json.loads((tmp_path / "docs" / name).read_text())
    assert read("d 1%.json") == {"a": None, "b": {'q"\\': 1, "r": [{"deep": "x"}, {"deep": []}]}, "list": [{"i": 0}, {"i": 1}, "last\n"]}
    assert list(read("d 1%.json")) == ["a", "b", "list"] and read("array.json") == [[1, 2], 3] and read("one.json") == {"": True}
    assert read("_documents.json") == ["array.json", "d 1%.json", "one.json"] and (tmp_path / "docs/kept.json").read_text() == "kept"
    assert not list((tmp_path / "docs").glob(".staged*"))
    assert documents.write_documents(leaves(spark, []), f"file://{tmp_path}/none") == []


def test_a_failing_write_changes_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/docs"
    files.write_file(spark, f"{folder}/one.json", "old")
    bad = leaves(spark, [("one.json", [(None, 0, "a", None)], "1")] * 3).withColumn("value", F.expr("CASE WHEN rand() >= 0 THEN raise_error('broken') ELSE value END"))
    with pytest.raises(Exception, match="broken"):
        documents.write_documents(bad, folder)
    assert (tmp_path / "docs/one.json").read_text() == "old" and not (tmp_path / "docs/_documents.json").exists()


def test_which_files_stand_for_a_task():
    names = ["task_c_evaluation.json", "task_c_x_evaluation.json", "task_d_b_evaluation.json", "task_d_a_evaluation.json", "task_e_p_answer_first_9_evaluation.json", "task_e_q_answer_first_evaluation.json", "task_g_evaluation.json", "evaluation_summary.json", "task_z_evaluation.json"]
    got = {c.task: c.files for c in documents.choose(names)}
    assert got == {"c": (names[0],), "d": (names[3], names[2]), "e_answer_first": (names[4],), "g": (names[6],)}
    assert documents.choose(names, ["a", "e_ascii_first"]) == []
    with pytest.raises(ValueError, match="several"):
        documents.choose(names, ["e_answer_first"], strict=True)


def test_merged_documents_keep_the_first_ones_head(spark, tmp_path):
    folder = f"file://{tmp_path}/e [1]"
    doc = lambda n, right, ids: json.dumps({"task": "d", "run_id": "r", "summary": {"total_samples": n, "correct_count": right, "accuracy": right / n}, "breakdown": {}, "individual_results": [{"test_id": i} for i in ids]}, indent=2)
    files.write_file(spark, f"{folder}/task_d_b_evaluation.json", doc(4, 1, "yz"))
    files.write_file(spark, f"{folder}/task_d_a_evaluation.json", doc(2, 2, "x"))
    files.write_file(spark, f"{folder}/task_g_evaluation.json", '{"summary": {}}')
    heads, rows = documents.load_evaluations(spark, folder)
    assert {r.task: (r.files, r.total_samples, r.correct_count, r.accuracy) for r in heads.collect()} == {"d": (2, 3, 2.0, 1.0), "g": (1, None, None, None)}
    assert [(r.task, json.loads(r.result)["test_id"]) for r in rows.orderBy("task", "file", "position").collect()] == [("d", "x"), ("d", "y"), ("d", "z")]
    strict = documents.load_evaluations(spark, folder, ["d"], strict=True)[0].first()
    assert (strict.total_samples, strict.correct_count, strict.accuracy) == (6, 3.0, 0.5)
    assert documents.load_evaluations(spark, f"file://{tmp_path}/none")[1].isEmpty()


def test_two_turns_use_what_was_generated(spark):
    cases = spark.createDataFrame([("1", "d", "q", ("s", "truth", "p"))], "id string, description string, query_relation string, ascii struct<simple:string,grid:string,panel:string>")
    made = spark.createDataFrame([("1", "made")], "id string, grid string")
    assert "made" in training.two_turns(cases, made).first().messages[2].content and "truth" in training.two_turns(cases).first().messages[2].content


def test_backfill_without_a_path(spark):
    rows = [("1", "B is above A.", "Where is B relative to A?", "x"), ("2", "nothing", "Where is B relative to A?", "x"), ("3", "B is above A.", "what?", "x"), ("4", "B is above A. D is left of C.", "Where is D relative to A?", "x")]
    got = training.backfilled(spark.createDataFrame(rows, "id string, description string, query_relation string, label string"))
    assert got.columns == ["id", "description", "query_relation", "label", "reasoning_steps"]
    assert [r.reasoning_steps for r in got.orderBy("id").collect()] == ["B is above A.", "", "", ""]


def test_external_questions(spark):
    questions = spark.createDataFrame([(1, "s", "q1"), (2, "s", "q2")], "ord int, story string, question string")
    queries = spark.createDataFrame([(1, "a", "q1"), (2, "b", "q2")], "ord int, query_id string, text string")
    answers = spark.createDataFrame([("b", ["x"])], "query_id string, reference_answers array<string>")
    assert [(r.ord, r.query_id) for r in external.questions_with_answers(questions, queries, answers).collect()] == [(2, "b")]
    wrong = external.questions_with_answers(questions, queries.withColumn("text", F.lit("?")), answers)
    with pytest.raises(Exception, match="do not agree"):
        wrong.collect()
    step = external.stepgame_rows(spark.createDataFrame([(7, "q", ["left"], "c")], "ord int, question string, targets array<string>, context string")).first()
    assert step.id == "step-7" and step.target == ["left"]


def test_merged_evaluations_and_batches(spark):
    merged = dashboard.merged_evaluations(spark.createDataFrame([("c", "p", 10, 4), ("c", "q", 30, 26)], "task string, path string, n long, correct long")).first()
    assert tuple(merged) == ("c", 2, 40, 30, 0.75)
    sizes = sampling.batches(spark.range(1000).withColumnRenamed("id", "k"), "k", 64).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in sizes) == [1000 % 64] + [64] * 15
    order = [r.v for r in spark.createDataFrame([(v,) for v in ("10", "b", "9", "a")], "v string").orderBy(*sampling.numeric_order(F.col("v"))).collect()]
    assert order == ["9", "10", "a", "b"]


def test_dispatch_and_aliases():
    assert tasks.scorer("c") is tasks.direction_rows and tasks.scorer("G") is tasks.consistency_rows
    with pytest.raises(ValueError):
        tasks.scorer("x")
    assert set(aliases_for("vertical")) == {"above", "below", "same level"} and set(aliases_for("horizontal")) == {"left", "right", "same column"}
    assert "same level" not in aliases_for("full") and len(aliases_for("full")) > 8


def test_components_of_a_dense_graph(spark):
    size = 12  # the shortest paths of such a mesh are beyond number
    cell = lambda x, y: f"n{x:02d}{y:02d}"
    stated = [(cell(x + 1, y), cell(x, y), "right") for x in range(size - 1) for y in range(size)] + [(cell(x, y + 1), cell(x, y), "below") for x in range(size) for y in range(size - 1)] + [("zb", "za", "left")]
    df = spark.createDataFrame([(stated,)], "stated array<struct<obj1:string,obj2:string,dir:string>>")
    names = sorted({n for a, b, _ in stated for n in (a, b)} | {"alone"})
    got = held(df, g=graph.edges(F.col("stated"))).select(graph.components(F.array(*map(F.lit, names)), F.col("g")).alias("c")).first().c
    assert {p.node: p.root for p in got} == {n: "alone" if n == "alone" else "za" if n in ("za", "zb") else cell(0, 0) for n in names}


def test_validity_and_conflicts(spark):
    assert many(spark, ["above", "upper-left", "north", None], algebra.is_direction(F.col("v"))) == [True, True, False, False]
    assert many(spark, ["below", "above", "left", None], algebra.conflicts(F.lit("above"), F.col("v"))) == [True, False, False, False]


def test_large_documents_are_pieces(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/run"
    write_rows(spark, f"{root}/data.jsonl", [CASE])
    given = [str((i * 7919) % 3000) for i in range(3000)]
    write_rows(spark, f"{root}/task_c_results.jsonl", [{"test_id": "1" if i % 10 == 0 else t, "model_output": '{"answer": "above"}'} for i, t in enumerate(given)])
    write_rows(spark, f"{root}/task_d_results.jsonl", [{"test_id": "1", "model_output": '{"answer": "left"}'}] * 3)
    monkeypatch.setattr(documents, "PIECE", 500)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits of one file
    try:
        for _ in range(2):  # a folder is replaced as a file is
            evaluation.evaluate_folder(spark, root, f"{root}/data.jsonl")
        folder = tmp_path / "run/outputs/evaluation"
        parts = sorted((folder / "task_c_evaluation.json").glob("part-*"))
        assert 3 < len(parts) < 7 and (folder / "task_d_evaluation.json").is_file()
        whole = json.loads("".join(p.read_text() for p in parts))
        heads, rows = documents.load_evaluations(spark, f"file://{folder}")
        found = {r.task: r for r in heads.collect()}
        read = [(r.position, json.loads(r.result)) for r in rows.where("task = 'c'").orderBy("position").collect()]
        assert rows.where("task = 'd'").count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["test_id"] for r in whole["individual_results"]] == ["1" if i % 10 == 0 else t for i, t in enumerate(given)]
    assert read == list(enumerate(whole["individual_results"]))
    assert json.loads(found["c"].summary) == whole["summary"] and json.loads(found["c"].breakdown) == whole["breakdown"] and found["c"].total_samples == 3000 and whole["metadata"] == {}
    assert {p.name for p in folder.glob(".*")} <= {"._documents.json.crc"} or not list(folder.glob(".staged*"))


def test_a_long_list_is_written_and_read_as_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "PIECE", 6)
    long, short, folder = "task_c_n+1 %é_evaluation.json", "task_d_evaluation.json", f"file://{tmp_path}/docs"
    fields = [(d, [(None, at, name, None)], v) for d in (long, short) for at, name, v in ((0, "task", '"c"'), (1, "run_id", '"r"'), (3, "summary", '{"total_samples":9}'), (6, "metadata", "{}"))]
    given = [(long, part, block, line) for part, block, n in (("b", 0, 7), ("a", 10, 5), ("a", 9, 5), ("c", 0, 1)) for line in range(n)] + [(short, "a", 0, line) for line in range(2)]
    rows = spark.createDataFrame([(*r, json.dumps({"at": r[1:]})) for r in reversed(given)], "document string, part string, block long, line long, value string").repartition(3)
    assert documents.write_documents(leaves(spark, fields), folder, rows=rows, listed=(5, "individual_results")) == sorted([long, short])
    parts = sorted((tmp_path / "docs" / long).glob("part-*"))
    assert [p.name for p in parts] == [f"part-{i:05d}" for i in range(len(parts))] and len(parts) > 3 and (tmp_path / "docs" / short).is_file()
    whole = json.loads("".join(p.read_text() for p in parts))
    want = [{"at": list(r[1:])} for r in sorted(given) if r[0] == long]
    assert list(whole) == ["task", "run_id", "summary", "individual_results", "metadata"] and whole["individual_results"] == want
    heads, results = documents.read_evaluations(spark, folder, [long, short])
    assert {(r.name, r.run_id, r.summary, r.rows) for r in heads.collect()} == {(d, "r", '{"total_samples":9}', n) for d, n in ((long, len(want)), (short, 2))}
    assert [(r.position, json.loads(r.result)) for r in results.where(F.col("name") == long).orderBy("position").collect()] == list(enumerate(want))
