"""Metrics, sampling, files, training rows, generation and streaming on small tables."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlogic.functions import graph
from gridlogic.operators import balance, dashboard, generate, metrics, sampling, tasks, training
from gridlogic.operators.hold import held
from gridlogic.sources import files
from gridlogic.streaming import resume


def test_metrics_by_hand(spark):
    pairs = [("above", "above")] * 2 + [("above", "below"), ("below", "below"), ("below", "zzz"), ("above", ""), ("above", None)]
    per = metrics.class_metrics(metrics.confusion(spark.createDataFrame(pairs, "truth string, predicted string")))
    got = {r.label: (r.tp, r.fp, r.fn, r.support) for r in per.collect()}
    assert got == {"above": (2, 0, 1, 3), "below": (1, 1, 1, 2), "zzz": (0, 1, 0, 0)}
    a = metrics.averages(per).first()
    assert [round(a[c], 5) for c in ("macro_precision", "macro_recall", "macro_f1", "micro_precision", "micro_recall", "micro_f1", "weighted_f1")] == [0.75, 0.58333, 0.65, 0.6, 0.6, 0.6, 0.68]
    empty = metrics.averages(metrics.class_metrics(metrics.confusion(spark.createDataFrame([], "truth string, predicted string")))).first()
    assert set(empty) == {0.0}


def test_every_bucket_and_error_is_there(spark):
    rows = spark.createDataFrame([("[0, 0.25)", True, False, 0.1)], "bucket string, consistent boolean, answer_ok boolean, accuracy double")
    got = {r.bucket: r.total for r in metrics.bucket_summary(rows).collect()}
    assert len(got) == 4 and sum(got.values()) == 1
    assert {r.n for r in metrics.error_summary(spark.createDataFrame([], "kind string")).collect()} == {0}


def test_splits_are_exact_and_stable(spark):
    rows = spark.range(103).withColumnRenamed("id", "k")
    got = {r.split: r["count"] for r in sampling.split_rows(rows, "k", (8, 1, 1), 3).groupBy("split").count().collect()}
    assert got == {"train": 82, "val": 10, "test": 11}
    assert sampling.split_rows(rows.limit(0), "k", (8, 1, 1), 3).count() == 0
    assert sampling.first_per_label(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "l string, o int"), "l", 0, F.col("o")).count() == 1


def test_scorers():
    assert tasks.scorer("e") is tasks.consistency_rows and tasks.scorer("H") is tasks.direction_rows
    with pytest.raises(ValueError):
        tasks.scorer("Z")


def test_missing_results_count_as_errors(spark):
    dataset = spark.createDataFrame([(1, "left", "full"), (2, "above", "vertical")], "id long, label string, query_type string")
    results = spark.createDataFrame([(1, "to the left"), (2, None), (9, "left")], "test_id long, answer string")
    got = {r.test_id: (r.correct, r.error) for r in tasks.direction_rows(results, dataset).collect()}
    assert got == {1: (True, None), 2: (False, "no answer"), 9: (False, "not found in dataset")}
    grids = spark.createDataFrame([(1, "A\nB"), (2, None), (3, "B\nA")], "test_id long, grid string")
    told = spark.createDataFrame([(1, "A is above B."), (2, "A is above B."), (3, "A is above B.")], "id long, description string")
    rows = tasks.layout_rows(grids, told)
    assert {r.test_id: r.correct for r in rows.collect()} == {1: True, 2: False, 3: False}
    assert round(tasks.instance_summary(rows).first().accuracy, 4) == 0.3333


def test_files(spark, tmp_path):
    rows = [{"id": "a", "label": "x"}, {"id": "b", "label": "left"}, {"id": "a", "label": "y"}]
    source = tmp_path / "d.jsonl"
    source.write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    assert files.read_jsonl(spark, str(source)).count() >= 3
    assert {r.id: r.label for r in files.read_index(spark, str(source)).collect()} == {"a": "y", "b": "left"}
    files.copy_without(spark, str(source), str(tmp_path / "out"), spark.createDataFrame([("a",)], "id string"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [json.dumps(rows[1])]
    run = tmp_path / "runs" / "m1" / "C"
    run.mkdir(parents=True)
    (run / "task_c_results.jsonl").write_text(json.dumps({"test_id": "1", "model_output": {"answer": "left"}}) + "\n")
    found = files.read_results(spark, f"{tmp_path}/runs").collect()
    assert [(r.task, r.test_id, json.loads(r.model_output)) for r in found] == [("C", "1", {"answer": "left"})]
    assert [r.run for r in files.discover_runs(files.read_results(spark, f"{tmp_path}/runs"), f"{tmp_path}/runs").collect()] == ["m1"]
    names = ["task_c_evaluation.json", "task_e_x_ascii_first_evaluation.json", "task_g_answer_first_evaluation"]
    assert [r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select(files.task_of(F.col("n")).alias("t")).collect()] == ["c", "e_ascii_first", "g_answer_first"]
    with pytest.raises(TypeError):
        files.RunConfig.from_json('{"nonsense": 1}')
    assert files.RunConfig.from_json(files.RunConfig(seed=7).to_json()).seed == 7


def test_results_are_appended_once_over_restarts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    add = lambda name, ids: (source / name).write_text("".join(json.dumps({"test_id": i, "model_output": "{}"}) + "\n" for i in ids))
    for name, ids in (("1.json", ["a", "b", "a"]), ("2.json", ["b", "c"])):
        add(name, ids)
        resume.append_once(resume.read_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = resume.read_target(spark, str(tmp_path / "out"))
    assert sorted(r.test_id for r in got.collect()) == ["a", "b", "c"]
    cases = spark.createDataFrame([("a",), ("d",)], "test_id string")
    assert [r.test_id for r in sampling.pending(cases, got).collect()] == ["d"]


def test_another_checkpoint_keeps_what_is_there(spark, tmp_path):
    target, expected = str(tmp_path / "out"), {}
    for batch in range(10):
        source = tmp_path / f"in{batch % 2}"
        source.mkdir(exist_ok=True)
        rows = [{"test_id": f"t{i}", "model_output": f"{batch}"} for i in range(batch * 30, batch * 30 + 60)]
        (source / f"{batch}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        for r in rows:
            expected.setdefault(r["test_id"], r["model_output"])
        resume.append_once(resume.read_stream(spark, str(source)), target, str(tmp_path / f"state{batch % 2}")).awaitTermination()
    assert {r.test_id: r.model_output for r in resume.read_target(spark, target).collect()} == expected
    assert resume.read_target(spark, target).count() == len(expected) == 330


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    target, schema = str(tmp_path / "out"), "test_id string, model_output string"
    for n in range(3):
        rows = [(f"k{n}-{i}", "x") for i in range(2000)]
        assert resume.append_rows(spark.createDataFrame(rows, schema), target, f"c{n}") == 2000
    files_in = lambda buckets: [r.f for r in resume.known_keys(spark, target, "test_id", "string", buckets).select("*", F.input_file_name().alias("f")).select("f").distinct().collect()]
    everything = files_in(list(range(resume.BUCKETS)))
    assert len(everything) > 2.9 * resume.BUCKETS  # each commit's keys fill all buckets, or all but a few
    one = spark.createDataFrame([("k1-7",)], "k string").select(resume.bucket(F.col("k"), resume.BUCKETS).alias("b")).first().b
    few = files_in([one])
    assert len(few) == 3 and all(f"bucket={one}/" in f for f in few)
    plan = resume.known_keys(spark, target, "test_id", "string", [one])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert resume.append_rows(spark.createDataFrame([("k1-7", "again"), ("new", "b"), ("new", "a"), (None, "c"), (None, "d")], schema), target, "c3") == 2
    resume.merge_keys(spark, target)
    assert len(files_in([one])) == 1 and len(files_in(list(range(resume.BUCKETS)))) <= resume.BUCKETS
    assert resume.append_rows(spark.createDataFrame([("k2-9", "again"), ("new", "b"), (None, "e"), ("newer", "a")], schema), target, "c4") == 1
    got = resume.read_target(spark, target, schema)
    assert got.count() == 6003 and {r.model_output for r in got.where("test_id = 'new' or test_id is null").collect()} == {"a", "c"}


def test_a_commit_that_did_not_end_is_not_there(spark, tmp_path):
    target, schema = str(tmp_path / "out"), "test_id string, model_output string"
    resume.append_rows(spark.createDataFrame([("a", "1")], schema), target, "c0")
    resume.append_rows(spark.createDataFrame([("b", "1")], schema), target, "c1")
    (tmp_path / "out/commits/c1").unlink()  # as if the driver had stopped before the marker
    assert [r.test_id for r in resume.read_target(spark, target, schema).collect()] == ["a"]
    resume.append_rows(spark.createDataFrame([("b", "2"), ("a", "2")], schema), target, "other")
    resume.append_rows(spark.createDataFrame([("b", "1"), ("c", "1")], schema), target, "c1")  # run again, it replaces itself
    assert resume.append_rows(spark.createDataFrame([("z", "1")], schema), target, "c1") == 0
    assert sorted(tuple(r)[:2] for r in resume.read_target(spark, target, schema).collect()) == [("a", "1"), ("b", "2"), ("c", "1")]
    assert resume.append_rows(spark.createDataFrame([], schema), target, "none") == 0


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    for name, n in (("a b%.txt", 1000), ("c.txt", 3), ("empty.txt", 0)):
        (tmp_path / name).write_text("".join(f"{i}\n" if i % 10 else "\n" for i in range(n)))
    lines = files.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    got = lines.collect()
    assert len(got) == 1003 and all(r.value == (str(r.ord) if r.ord % 10 else "") for r in got)
    assert {r.file.rsplit("/", 1)[1] for r in got} == {"a b%.txt", "c.txt"}


def test_reading_modes(spark, tmp_path, small_splits):
    rows = ['{"id": "1", "n": 5}', "", '{"id": "2"', "   ", '{"id": "3", "n": "x"}', "[1]", "null", '{"other": 1}'] * 40
    (tmp_path / "x.jsonl").write_text("\n".join(rows))
    path, schema = str(tmp_path / "x.jsonl"), "id string, n int"
    read = lambda **how: files.checked_jsonl(spark, path, schema, **how)
    assert read(bad="nulls").count() == 6 * 40
    good = read(bad="drop").collect()
    assert len(good) % 40 == 0 and {(r.id, r.n) for r in good} >= {("1", 5), (None, None)}
    with pytest.raises(Exception, match=r"a bad line: .*x.jsonl, line \d+"):
        read().where("id = '2'").count()
    with pytest.raises(Exception, match="a blank line"):
        read(blanks="fail", bad="nulls").count()
    with pytest.raises(ValueError):
        read(blanks="maybe")
    assert files.quarantine(spark, path, str(tmp_path / "bad"), schema).count() == len(good)
    bad = spark.read.schema("file string, line long, value string").json(str(tmp_path / "bad")).collect()
    assert len(bad) + len(good) == 6 * 40 and all(rows[r.line - 1] == r.value for r in bad) and '{"id": "2"' in {r.value for r in bad}


def test_stories_over_spans(spark):
    text = [f"{1 + i % 7} {'Where?' + chr(9) + 'n,e' if i % 7 == 6 else f'fact {i}.'}" for i in range(700)]
    lines = spark.createDataFrame([(f, i, t) for f in ("a", "b") for i, t in enumerate(text)], "file string, ord long, value string")
    whole = sorted(map(tuple, files.babi_stories(lines).collect()))
    assert whole == sorted(map(tuple, files.babi_stories(lines, span=10).collect())) and len(whole) == 200
    assert whole[1] == ("a", 13, " ".join(f"fact {i}." for i in range(7, 13)), "Where?", "north east")


def test_generated_rows_answer_themselves(spark):
    rows = generate.balanced_dataset(spark.range(40), seed=5)
    rows = rows.cache()
    got = rows.collect()
    assert Counter(r.num_components for r in got) == {k: n for k, n in generate.quotas(40).items() if n}
    assert all(r.description.endswith(".") and r.query_relation.endswith("?") and r.label for r in got)
    assert all(r.num_relations >= r.num_components - 1 and r.ambiguous_stages <= r.num_relations for r in got)
    assert all(r.ambiguous_stages < r.num_relations for r in got if r.has_unique_layout) and any(r.has_unique_layout for r in got)
    assert sum(generate.quotas(1000).values()) == 1000
    made = training.training_dataset(rows, "a-random-format").collect()
    assert {r.ascii_format for r in made} <= set(training.VIEWS) and len(made) == len(got)
    mixed = training.training_dataset(rows, "MIXED", max_samples=10).count()
    assert mixed == 10
    with pytest.raises(ValueError):
        training.training_dataset(rows, "MIXED")
    shots = rows.orderBy("id").limit(2)
    talk = training.conversations(rows, shots, "E", ["grid", "simple", "grid"]).first().messages
    assert [m.role for m in talk] == ["system", "user", "assistant", "user", "assistant", "user"] and "ascii" in talk[2].content
    two = training.two_turns(rows).first().messages
    assert [m.role for m in two] == ["system", "user", "assistant", "user"] and json.loads(two[2].content)["ascii"]["grid"]
    rows.unpersist()
    with pytest.raises(ValueError):
        generate.add_relation([], "A", "A", "above")
    with pytest.raises(ValueError):
        generate.add_relation([], "A", "B", "Above")


def test_questions_follow_from_what_is_stated(spark):
    stated = {
        1: [("A", "B", "above"), ("C", "B", "above")],  # of A and C the column follows, the level does not
        2: [("A", "B", "above"), ("C", "B", "below")],
        3: [("A", "B", "left")],
    }
    cells = {i: [(k, *xy) for k, xy in sorted(generate.place(s).items())] for i, s in stated.items()}
    made = spark.createDataFrame([(i + 10 * k, len(cells[i]), stated[i], cells[i]) for i in stated for k in range(40)], generate.STRUCTURES)
    asked = {}
    for r in generate.questions(made, 5).collect():
        asked.setdefault(r.id % 10, set()).add((r.obj1, r.obj2, r.query_type))
    both = {(a, b, t) for a, b in ("AB", "BC") for t in generate.QUERY_TYPES}
    assert asked == {1: both | {("A", "C", "horizontal")}, 2: both | {("A", "C", t) for t in generate.QUERY_TYPES}, 3: {("A", "B", t) for t in generate.QUERY_TYPES}}
    got = generate.instances(made, 5).where("id like '%1'").collect()
    assert len(got) == 40 and {r.label for r in got if "A" in r.query_relation and "C" in r.query_relation} == {"same column"}


def test_cells_take_turns_until_the_quota_is_full(spark):
    rows = spark.createDataFrame([(i, "x" if i < 90 else "y", "a" if i < 60 else "b" if i < 87 else "c") for i in range(100)], "id long, s string, cell string")
    got = sampling.even_selection(rows, "s", {"x": 21, "y": 20, "z": 5}, ["cell"], "id", 1).collect()
    per = {(s, c): sum(r.s == s and r.cell == c for r in got) for s in "xy" for c in "abc"}
    assert per == {("x", "a"): 9, ("x", "b"): 9, ("x", "c"): 3, ("y", "a"): 0, ("y", "b"): 0, ("y", "c"): 10}
    assert sorted(r["__k"] for r in got if r.s == "x") == list(range(1, 22))


def test_a_balanced_dataset_has_all_rows_and_even_strata(spark):
    got = generate.balanced_dataset(spark.range(60), seed=42).collect()
    by = lambda c, rows=got: {v: sum(r[c] == v for r in rows) for v in {r[c] for r in rows}}
    assert by("num_components") == generate.quotas(60)
    assert by("query_type").keys() == set(generate.QUERY_TYPES) and min(by("query_type").values()) >= 14
    large = [r for r in got if r.num_components > 3]
    assert by("terminology_used", large).keys() == set(generate.TERMINOLOGIES) and min(by("terminology_used", large).values()) >= 4
    assert 0.3 < sum(r.is_directly_stated for r in got) / 60 < 0.7


def test_prompts_carry_the_sections_of_their_task():
    for task, sections in training.SECTIONS.items():
        full, short = training.system_prompt(task), training.system_prompt(task, detailed=False)
        for key, texts in sections.items():
            for text in [texts] if isinstance(texts, str) else texts:
                assert text in full and (text in short or key in ("title", "objective"))
    assert training.SECTIONS.keys() == training.TASKS.keys()
    assert "If the two evidence sources disagree, follow the ASCII diagram." in training.system_prompt("F")
    assert "Turn 2: Use the provided ground truth ASCII diagram" in training.system_prompt("H") and "you generated in Turn 1" in training.system_prompt("G")
    assert "Direction Notes" not in training.system_prompt("B") and "Rendering" not in training.system_prompt("F") and "Rendering" in training.system_prompt("A")
    assert "- panel:" in training.system_prompt("F", names=["panel"]) and "Formats" not in training.system_prompt("C")
    assert "draw ASCII that matches" in training.system_prompt("E") and "before finalizing" in training.system_prompt("E", ascii_order="ascii_first")


def test_run_summaries(spark):
    rows = spark.createDataFrame([("base", "C", True), ("base", "C", False), ("tuned", "C", True), ("tuned", "D", True)], "run string, task string, correct boolean")
    summary = dashboard.run_summary(rows)
    assert {r.task: (r.base, r.tuned) for r in dashboard.base_vs_tuned(summary, "base", "tuned").collect()} == {"C": (0.5, 1.0), "D": (0.0, 1.0)}
    assert {r.run: r.tasks for r in dashboard.dashboard(summary).collect()} == {"base": "C", "tuned": "C,D"}


def test_several_marginals_at_once(spark):
    targets = {"a": {0: 0.1, 1: 0.3, 2: 0.6}, "b": {"x": 0.5, "y": 0.5}, "c": {True: 0.25, False: 0.75}, "d": {k: 1.0 for k in range(5)}}
    rows = spark.range(20_000).select(F.col("id"), (F.xxhash64("id") % 4).cast("int").alias("a0"), F.when(F.xxhash64("id", F.lit(1)) % 3 == 0, "x").otherwise("y").alias("b"), (F.xxhash64("id", F.lit(2)) % 2 == 0).alias("c"), F.abs(F.xxhash64("id", F.lit(3)) % 6).cast("int").alias("d"))
    rows = rows.withColumn("a", F.abs("a0"))
    got = balance.balanced(rows, targets, 1003, "id").collect()
    assert len(got) == 1003 == len({r.id for r in got})
    for c, own in targets.items():
        counts = Counter(r[c] for r in got)
        assert set(counts) == set(own) and all(abs(counts[v] - 1003 * share / sum(own.values())) <= 1 for v, share in own.items())
    assert sorted(r.id for r in got) == sorted(r.id for r in balance.balanced(rows.repartition(7), targets, 1003, "id").collect())
    assert sorted(r.id for r in got) != sorted(r.id for r in balance.balanced(rows, targets, 1003, "id", seed=1).collect())


def test_marginals_that_candidates_cannot_meet(spark):
    rows = spark.createDataFrame([(i, i % 2, "x") for i in range(10)] + [(99, 0, "y"), (100, 7, "x"), (101, None, "x")], "id long, a int, b string")
    got = balance.balanced(rows, {"a": {0: 0.5, 1: 0.5}, "b": {"x": 0.5, "y": 0.5}}, 6, "id").collect()
    assert len({r.id for r in got}) == len(got) == 6 and Counter(r.b for r in got)["y"] == 1 and {r.a for r in got} == {0, 1}
    assert balance.balanced(rows, {"a": {5: 1.0}}, 3, "id").isEmpty() and balance.balanced(rows.where("false"), {"a": {0: 1.0}}, 3, "id").isEmpty()
    assert balance.balanced(rows, {"a": {0: 1.0}}, 100, "id").count() == 6
    with pytest.raises(ValueError):
        balance.balanced(rows, {c: dict.fromkeys(range(1000), 1.0) for c in ("a", "id")}, 3, "id")
    assert balance.largest_remainder(np.array([1.0, 1.0, 1.0]), 10).tolist() == [4, 3, 3]


def lattice(spark, size):
    cell = lambda x, y: f"n{x:02d}{y:02d}"
    stated = [(cell(x + 1, y), cell(x, y), "right") for x in range(size - 1) for y in range(size)] + [(cell(x, y + 1), cell(x, y), "below") for x in range(size) for y in range(size - 1)]
    df = spark.createDataFrame([(stated,)], "stated array<struct<obj1:string,obj2:string,dir:string>>")
    return held(df, g=graph.edges(F.col("stated")))


def test_paths_of_a_lattice_are_counted_not_listed(spark):
    from math import comb

    own = held(lattice(spark, 6), p=graph.shortest_paths(F.col("g")))
    found = {(r.src, r.node): r for r in own.select(F.inline("p")).collect()}
    assert len(found) == 36 * 36
    for (a, b), r in found.items():
        dx, dy = abs(int(a[1:3]) - int(b[1:3])), abs(int(a[3:]) - int(b[3:]))
        assert (r.dist, int(r.n), len(r.dirs)) == (dx + dy, comb(dx + dy, dx), dx + dy)
        assert r.vertical == [("none" if dy == 0 else "other" if b[3:] > a[3:] else "one")] and r.horizontal == [("none" if dx == 0 else "other" if b[1:3] > a[1:3] else "one")]
    one = held(lattice(spark, 6), p=graph.shortest_paths_from(F.col("g"), F.lit("n0203"))).select(F.inline("p")).collect()
    assert {(r.src, r.node): r for r in one} == {k: v for k, v in found.items() if k[0] == "n0203"}
    assert held(lattice(spark, 2), p=graph.shortest_paths_from(F.col("g"), F.lit("nowhere"))).select(F.size("p").alias("n")).first().n == 0


def brute_paths(edges, names):
    """{(src, node): list of (dirs, nodes)}, in the order of a search that keeps all shortest paths."""
    out = {}
    for s in names:
        level, seen = [((), (s,))], {s}
        out[s, s] = level[:]
        while level:
            new = [((*dirs, d), (*nodes, dst)) for dirs, nodes in level for src, dst, d in edges if src == nodes[-1] and dst not in seen]
            seen |= {nodes[-1] for _, nodes in new}
            for dirs, nodes in new:
                out.setdefault((s, nodes[-1]), []).append((dirs, nodes))
            level = new
    return out


def test_paths_against_listing(spark):
    import random

    rng = random.Random(5)
    dirs = ["above", "below", "left", "right", "upper-left", "upper-right", "lower-left", "lower-right"]
    scenes = []
    for i in range(12):
        names = "abcdefg"[: rng.randint(2, 7)]
        scenes.append((i, [(*rng.sample(names, 2), rng.choice(dirs)) for _ in range(rng.randint(1, 10))]))
    df = spark.createDataFrame(scenes, "i int, stated array<struct<obj1:string,obj2:string,dir:string>>")
    own = held(df, g=graph.edges(F.col("stated")))
    own = held(own, p=graph.shortest_paths(F.col("g")), c=graph.cuts(F.col("g")))
    names = graph.nodes(F.col("g"))
    all_pairs = F.flatten(F.transform(names, lambda a: F.transform(names, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = own.select("i", "g", "p", "c", F.inline(all_pairs))
    flags = pairs.select("i", "a", "b", *(graph.axis_unique(F.col("g"), F.col("p"), F.col("a"), F.col("b"), x, cut).alias(f"{x}{k}") for x in graph.AXES for k, cut in ((0, None), (1, F.col("c")))))
    for r in flags.collect():
        assert r.vertical0 == r.vertical1 and r.horizontal0 == r.horizontal1, r
    for r in own.select("i", "g", "p").collect():
        want = brute_paths([(e.src, e.dst, e.dir) for e in r.g], sorted({e.src for e in r.g}))
        assert {(p.src, p.node): int(p.n) for p in r.p} == {k: len(v) for k, v in want.items()}
        assert {(p.src, p.node): (tuple(p.dirs), tuple(p.nodes)) for p in r.p} == {k: v[0] for k, v in want.items()}
        for p in r.p:
            for axis, one, other in (("vertical", ("above", "upper-left", "upper-right"), ("below", "lower-left", "lower-right")), ("horizontal", ("left", "upper-left", "lower-left"), ("right", "upper-right", "lower-right"))):
                nets = {("both" if any(d in one for d in ds) and any(d in other for d in ds) else "one" if any(d in one for d in ds) else "other" if any(d in other for d in ds) else "none") for ds, _ in want[p.src, p.node]}
                assert set(p[axis]) == nets and len(p[axis]) == len(nets)


def test_what_follows_from_statements_is_made_once(spark):
    from gridlogic.operators.hold import once_each

    rows = spark.createDataFrame([(i, [i % 3]) for i in range(300)] + [(300, None)], "i int, k array<int>")
    given = []

    def make(keys):
        given.append(sorted(map(str, (r.k for r in keys.collect()))))
        return keys.where("k[0] < 2").withColumn("double", F.col("k")[0] * 2)

    got = once_each(rows, "k", make)
    assert given == [["None", "[0]", "[1]", "[2]"]] and sorted((r.i, r.double) for r in got.collect()) == [(i, i % 3 * 2) for i in range(300) if i % 3 < 2]


def test_inferred_pairs_are_not_looked_up(spark):
    own = held(lattice(spark, 6), p=graph.shortest_paths(F.col("g")))
    told = own.select(graph.all_inferred(F.col("p")).alias("t"))
    pairs = [(r.obj1, r.obj2) for r in told.first().t]
    assert len(pairs) == 36 * 35 and pairs == sorted(pairs)
    # one filter over the entries, not one more for each of them
    assert str(told._jdf.queryExecution().optimizedPlan()).count("filter(p") == 1


def test_candidates_are_dealt_over_as_many_tasks_as_they_ask_for(spark):
    from gridlogic.operators.generate import dealt

    assert dealt(spark.range(40_000), 40_000).rdd.getNumPartitions() == 40


def test_reasons_for_skipping_need_no_parsing(spark):
    from gridlogic.operators import tasks

    results = spark.createDataFrame([(1, "e", "a", "g"), (2, None, "", "g"), (3, None, "a", "g"), (4, None, "a", ""), (5, None, "a", "g")], "test_id long, error string, answer string, grid string")
    own = tasks.skips(results, spark.createDataFrame([(1,), (2,), (4,), (5,)], "id long"))
    assert {r.test_id: r.skipped for r in own.collect()} == {1: "model error", 2: "missing answer", 3: "test_id not found in dataset", 4: "no ASCII grid in model output", 5: None}
    assert "Generate" not in own._jdf.queryExecution().optimizedPlan().toString()
