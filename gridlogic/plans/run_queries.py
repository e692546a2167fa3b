"""Queries of model outputs, filters, runs and the files that they are kept in. What is written goes to a new folder that executors share, and is read back."""

from __future__ import annotations

import gzip
import io
import tarfile

from pyspark.sql import functions as F

from gridlogic.functions import graph as G
from gridlogic.functions import outputs as O
from gridlogic.functions import text as X
from gridlogic.operators import metrics as M
from gridlogic.operators import runs as R
from gridlogic.operators import sampling as S
from gridlogic.operators import training as N
from gridlogic.operators.generate import pair_options
from gridlogic.plans.flow_queries import HASH, RUNS
from gridlogic.plans.flow_queries import runs as run_rows
from gridlogic.plans.graph_queries import INFERRED, UNIQUE
from gridlogic.plans.registry import ORACLES, query
from gridlogic.plans.scenes import by_graph, quoted
from gridlogic.plans.score_queries import INSTANCES, instances
from gridlogic.plans.text_queries import ASKED, asked, described, held
from gridlogic.session import scratch, table
from gridlogic.sources import files as S_


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'G' || c_name WHEN 1 THEN 'S' || c_name WHEN 2 THEN 'A' || c_name WHEN 3 THEN 'D' || c_name END AS grid,
CASE c_custkey % 6 WHEN 3 THEN 'above' WHEN 5 THEN 'plain ' || c_name ELSE '' END AS answer FROM customer""")
def output_fields(spark, sf_dir):
    """Grids and answers in outputs of six shapes."""
    k, name = F.col("c_custkey") % 6, F.col("c_name")
    shapes = ('{"ascii": {"grid": "G%s", "simple": "x"}}', '{"ascii": {"grid": "", "simple": "S%s"}}', '{"ascii": "A%s", "grid": "x"}', '{"grid": "D%s", "answer": " above "}', '{"other": "%s"}', " plain %s\n")
    text = F
    for i, shape in enumerate(shapes):
        text = text.when(k == i, F.replace(F.lit(shape), F.lit("%s"), name))
    own = table(spark, sf_dir, "customer").select("c_custkey", text.alias("output"))
    return own.select("c_custkey", O.grid_of(F.col("output")).alias("grid"), O.answer_of(F.col("output")).alias("answer"))


_SPELT = (("Top-Left!", "top-left"), ("north_east", "top-right"), ("upwards", "above"), ("  To the  LEFT.", "left"), ("same  place", "same spot"), ("overlapping", "overlap"), ("under east", "bottom-right"), ("somewhere, else", "somewhere else"), ("same_row", "same row"), ("overlap", "same spot"), ("", ""))


@query(f"SELECT p_partkey, spelt, name FROM part JOIN (VALUES {', '.join(f'({i}, {quoted(a)}, {quoted(b)})' for i, (a, b) in enumerate(_SPELT))}) AS v(i, spelt, name) ON i = p_partkey % {len(_SPELT)}")
def canonical_directions(spark, sf_dir):
    """X12."""
    spelt = F.element_at(F.array(*(F.lit(a) for a, _ in _SPELT)), (F.col("p_partkey") % len(_SPELT) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", spelt.alias("spelt")).withColumn("name", O.canonical_direction(F.col("spelt")))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'Could not identify entities to rephrase.' ELSE 'What''s the position of ' || chr((65 + s_suppkey % 26)::INTEGER) || ' to ' || chr((97 + s_suppkey % 7)::INTEGER) || '?' END AS question FROM supplier")
def rephrased_queries(spark, sf_dir):
    """X13."""
    k = F.col("s_suppkey")
    said = F.when(k % 4 == 0, "Where is it?").otherwise(F.concat(F.lit("What is the relationship BETWEEN "), F.char(65 + k % 26), F.lit("  and "), F.char(97 + k % 7), F.lit("?")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", O.rephrased_query(said).alias("question"))


@query("""SELECT event_id, event_id % 3 = 0 AS again, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN '{"test_id":"t' || event_id || '","turn1":"' || event_type || '","turn2":null,"error":null}'
ELSE '{"test_id":"t' || event_id || '","content":"' || event_type || '","reasoning":null,"reasoning_content":null,"role":"assistant","refusal":null,"finish_reason":null,"usage":{"total_tokens":' || user_id || '},"error":null}' END AS entry FROM events""")
def call_messages(spark, sf_dir):
    """Which calls are made again, and what is kept of their messages."""
    e, kind = F.col("event_id"), F.col("event_type")
    error = F.when(e % 3 == 0, F.concat(F.lit("call 7: transport failure, "), kind)).when(e % 3 == 1, "bad request")
    flat = F.concat(F.lit('{"role": "assistant", "content": "'), kind, F.lit('", "dropped": 1, "usage": {"total_tokens": '), F.col("user_id").cast("string"), F.lit("}}"))
    metadata = F.when(e % 5 == 0, "{}").when(e % 2 == 0, F.concat(F.lit('{"turn1": "'), kind, F.lit('"}'))).otherwise(flat)
    own = table(spark, sf_dir, "events").select("event_id", O.retriable(error).alias("again"), metadata.alias("metadata"))
    return own.select("event_id", "again", O.reasoning_entry(F.concat(F.lit("t"), e.cast("string")), F.col("metadata"), e % 2 == 0).alias("entry"))


@query(f"WITH {ASKED} SELECT scene_id, kind, label FROM answered WHERE label NOT IN ('same level', 'same column') AND (kind = 'full' OR scene_id % 2 = 0)")
def filtered_cases(spark, sf_dir):
    """Full questions, and others of even scenes; only labels that are directions."""
    from gridlogic.functions.score import answer_from_layout

    own = held(asked(spark, sf_dir), label=answer_from_layout(F.col("layout"), F.col("asked.obj1"), F.col("asked.obj2"), F.col("kind"))).select("scene_id", F.col("kind").alias("query_type"), "label")
    kept = R.without_alike(R.full_queries(own).unionByName(own.where("query_type <> 'full' and scene_id % 2 = 0")))
    return kept.withColumnRenamed("query_type", "kind")


@query(f"WITH {RUNS} SELECT run, task, n FROM summary WHERE task IN ('click', 'view')")
def task_subset(spark, sf_dir):
    """P5."""
    return R.only_tasks(run_rows(spark, sf_dir), "CLICK", "View").select("run", "task", "n")


@query(f"WITH {INSTANCES} " + " UNION ALL ".join(f"SELECT '{c}' AS category, '{f}' AS factor, " + (f"CASE WHEN {f} THEN 'True' ELSE 'False' END" if f == "has_unique_layout" else f"{f}::VARCHAR") + f" AS value, id, correct FROM instances WHERE {f} IS NOT NULL AND id % 13 <> 0" for c, f in M.task_factors("A")))
def factor_members(spark, sf_dir):
    """Results with a dataset row, in the groups of task A's factors."""
    dataset = instances(spark, sf_dir)
    results = dataset.select((F.col("id") + F.when(F.col("id") % 13 == 0, 10**9).otherwise(0)).alias("test_id"), "correct")
    return M.factor_members(M.factor_rows(results, dataset.drop("correct")), M.task_factors("A"))


_range = lambda f: f"SELECT '{f}' AS factor, count({f}) AS n, min({f})::DOUBLE AS least, max({f})::DOUBLE AS most, avg({f}) AS mean FROM instances"


@query(f"WITH {INSTANCES} " + " UNION ALL ".join(map(_range, ("num_components", "num_relations", "ambiguous_stages"))))
def numeric_summaries(spark, sf_dir):
    """Least, most and mean."""
    return M.numeric_summary(instances(spark, sf_dir), "num_components", "num_relations", "ambiguous_stages")


@query(f"SELECT id, (row_number() OVER (ORDER BY {HASH('id', 5)}, id) - 1) // 64 AS batch FROM (SELECT o_orderkey AS id FROM orders)")
def batch_numbers(spark, sf_dir):
    """O20."""
    return S.batches(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 64, seed=5)


@query(f"WITH RECURSIVE {UNIQUE} SELECT scene_id, obj1, obj2, concat_ws(',', CASE WHEN vertical AND horizontal THEN 'full' END, CASE WHEN vertical THEN 'vertical' END, CASE WHEN horizontal THEN 'horizontal' END) AS types FROM flags WHERE obj1 < obj2 AND (vertical OR horizontal)")
def query_pairs(spark, sf_dir):
    """All pairs with the types of question that the stated relations determine."""
    layout = F.transform(G.nodes(F.col("graph")), lambda n: F.struct(n.alias("obj")))  # a scene's statements name all of its objects
    options = lambda own: pair_options(held(own, layout=layout)).select("stated", "options")
    return by_graph(spark, sf_dir, options).select("scene_id", F.inline("options")).withColumn("types", F.array_join("types", ","))


_CHAINS = ORACLES["reasoning_chains"].removeprefix("WITH RECURSIVE ")


@query(f"WITH RECURSIVE chains AS (WITH RECURSIVE {_CHAINS}), {INFERRED}, ends AS (SELECT scene_id, max(obj) AS obj1, min(obj) AS obj2 FROM pos GROUP BY scene_id HAVING count(*) > 1) SELECT scene_id AS id, coalesce(chain, '') AS reasoning_steps FROM ends LEFT JOIN chains USING (scene_id, obj1, obj2)")
def reasoning_backfill(spark, sf_dir):
    """Reasoning made anew from description and question."""
    own = described(spark, sf_dir)
    first, last = F.get("layout", F.lit(0))["obj"], F.element_at("layout", -1)["obj"]
    rows = own.select(F.col("scene_id").alias("id"), "description", X.query_text(last, first, F.lit("full")).alias("query_relation"), F.lit("?").alias("label"), F.lit("old").alias("reasoning_steps"))
    return N.backfilled(rows).select("id", "reasoning_steps")


#: Evaluation files by supplier: path, and what they hold.
_FILES = """files AS (SELECT 'r/' || s_suppkey || '/task_' || CASE s_suppkey % 4 WHEN 0 THEN 'e_E_grid_answer_first_9' WHEN 1 THEN 'e_x_ascii_first' WHEN 2 THEN 'd' ELSE 'g_answer_first' END || '_evaluation.json' AS path,
CASE s_suppkey % 4 WHEN 0 THEN 'e_answer_first' WHEN 1 THEN 'e_ascii_first' WHEN 2 THEN 'd' ELSE 'g_answer_first' END AS task, CASE WHEN s_suppkey % 3 <> 0 THEN '{"macro_f1":' || s_suppkey || '}' END AS metrics,
CASE WHEN s_suppkey % 5 <> 0 THEN 'b' || s_suppkey END AS by_ascii_accuracy, CASE WHEN s_suppkey % 7 <> 0 THEN 'm' || s_suppkey END AS error_mapping FROM supplier)"""


def evaluation_files(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, "e_E_grid_answer_first_9").when(k % 4 == 1, "e_x_ascii_first").when(k % 4 == 2, "d").otherwise("g_answer_first")
    text = lambda before, after, n: F.when(k % n != 0, F.concat(F.lit(before), k.cast("string"), F.lit(after)))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("r/"), k.cast("string"), F.lit("/task_"), name, F.lit("_evaluation.json")).alias("path"), text('{"macro_f1":', "}", 3).alias("metrics"), text("b", "", 5).alias("by_ascii_accuracy"), text("m", "", 7).alias("error_mapping"))


@query(f"WITH {_FILES} SELECT task, max(path) AS path, max_by(metrics, path) AS metrics FROM files WHERE metrics IS NOT NULL GROUP BY task")
def last_file_metrics(spark, sf_dir):
    """A18."""
    return R.last_metrics(evaluation_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT * FROM (SELECT task AS variant, 'by_ascii_accuracy' AS kind, by_ascii_accuracy AS content FROM files UNION ALL SELECT task, 'error_mapping', error_mapping FROM files) WHERE content IS NOT NULL AND variant LIKE 'e_%'")
def consistency_breakdowns(spark, sf_dir):
    """A19."""
    return R.consistency_breakdowns(evaluation_files(spark, sf_dir))


@query("""SELECT CASE p_partkey % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'e_ascii_first' ELSE 'a' END AS task, CASE p_partkey % 4 WHEN 0 THEN 'combined' WHEN 1 THEN 'vertical' ELSE 'factor' END AS kind,
'm/' || p_partkey || '/' || CASE p_partkey % 4 WHEN 0 THEN 'task_c_confusion_matrix' WHEN 1 THEN 'task_e_ascii_first_confusion_matrix_vertical' ELSE 'a_num_components' END || '.png' AS path FROM part WHERE p_partkey % 4 < 3""")
def plots(spark, sf_dir):
    """A20."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "task_c_confusion_matrix").when(k % 4 == 1, "task_e_ascii_first_confusion_matrix_vertical").when(k % 4 == 2, "a_num_components").otherwise("task_c_confusion_matrix_other")
    return R.plot_index(table(spark, sf_dir, "part").select(F.concat(F.lit("m/"), k.cast("string"), F.lit("/"), name, F.lit(".png")).alias("path")))


@query(f"""WITH {RUNS}, parts AS (SELECT run, '{{' || string_agg('"' || task || '":"' || n || '"', ',' ORDER BY task) || '}}' AS factors FROM summary WHERE run <> 'run_1' GROUP BY run)
SELECT run, string_agg(task, ',' ORDER BY task) AS tasks, avg(accuracy) AS mean_accuracy, coalesce(any_value(p.factors), '{{}}') AS factors, '{{}}' AS buckets, '{{"correct":"' || sum(correct)::BIGINT || '"}}' AS metrics FROM summary LEFT JOIN parts p USING (run) GROUP BY run""")
def model_reports(spark, sf_dir):
    """J17, S20."""
    own = run_rows(spark, sf_dir)
    factors = own.where("run <> 'run_1'").select("run", F.col("task").alias("key"), F.col("n").cast("string").alias("content"))
    metrics = own.groupBy("run").agg(F.sum("correct").cast("string").alias("content")).select("run", F.lit("correct").alias("key"), "content")
    return R.model_report(own, factors, factors.where("false"), metrics)


@query("SELECT c_custkey, c_name, c_acctbal, c_custkey % 2 = 0 AS even FROM customer")
def jsonl_scan(spark, sf_dir):
    """Written as JSON lines and read back."""
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") % 2 == 0).alias("even"))
    S_.write_jsonl(own, path := scratch(spark, "rows.jsonl"))
    return S_.read_jsonl(spark, path, "c_custkey long, c_name string, c_acctbal double, even boolean")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def jsonl_index(spark, sf_dir):
    """Of lines with one id the last, over files that were written in the order of their names."""
    own = table(spark, sf_dir, "events").select("user_id", "event_id").orderBy("event_id")
    S_.write_jsonl(own, path := scratch(spark, "events.jsonl"))
    return S_.read_index(spark, path, "user_id long, event_id long", "user_id")


@query("SELECT n_nationkey, n_name FROM nation")
def json_array_scan(spark, sf_dir):
    """A pretty JSON array, one file."""
    rows = table(spark, sf_dir, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), {"pretty": "true"}).alias("j")).first().j
    S_.write_file(spark, path := f"{scratch(spark, 'arrays')}/nations.json", rows)
    return S_.read_json_array(spark, path, "n_nationkey int, n_name string")


@query("SELECT p_partkey, p_name FROM part")
def tsv_scan(spark, sf_dir):
    """S4."""
    table(spark, sf_dir, "part").select("p_partkey", "p_name").write.option("sep", "\t").option("header", True).csv(path := scratch(spark, "parts.tsv"))
    return S_.read_tsv(spark, path, "p_partkey long, p_name string")


@query("SELECT event_type || ': ' || count(*) AS line FROM events GROUP BY event_type")
def text_report(spark, sf_dir):
    """S18."""
    S_.write_text(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.concat("event_type", F.lit(": "), F.col("n").cast("string")).alias("value")), path := scratch(spark, "stats.txt"))
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def held_out_copy(spark, sf_dir):
    """Lines as they are, without the held-out ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.length("text").alias("n"))
    S_.write_jsonl(docs, source := scratch(spark, "docs.jsonl"))
    held_out = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    S_.copy_without(spark, source, target := scratch(spark, "kept.jsonl"), held_out)
    return S_.read_jsonl(spark, target, "id string").select(F.col("id").cast("long").alias("doc_id"))


@query("SELECT n_name || '.txt' AS member, n_name || ' of ' || r_name AS text FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0")
def tar_members(spark, sf_dir):
    """Members of a packed archive by their names."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name").collect()  # 25 of them
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w") as archive:
        for r in rows:
            data = f"{r.n_name} of {r.r_name}".encode()
            entry = tarfile.TarInfo(f"{r.n_name}.{'txt' if r.n_nationkey % 2 == 0 else 'bin'}")
            entry.size = len(data)
            archive.addfile(entry, io.BytesIO(data))
    S_.write_file(spark, path := f"{scratch(spark, 'archives')}/a.tar.gz", gzip.compress(packed.getvalue()))
    return S_.read_tar(spark, path, r"\.txt$").select("member", "text")


@query("SELECT 'run_' || (event_id % 2) AS run, CASE WHEN event_id % 3 = 0 THEN 'C' ELSE 'E' END AS task, count(*) AS n FROM events GROUP BY ALL")
def results_found(spark, sf_dir):
    """Result files below a folder, by their names."""
    root = scratch(spark, "results (v1)+x")
    own = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("test_id"), F.col("event_type").alias("model_output"))
    for run in (0, 1):
        for task in ("c", "e"):
            some = own.where((F.col("event_id") % 2 == run) & ((F.col("event_id") % 3 == 0) == F.lit(task == "c")))
            S_.write_jsonl(some.select("test_id", "model_output"), f"{root}/run_{run}/task_{task}_results.jsonl")
    found = S_.read_results(spark, root)
    named = found.withColumn("run", F.regexp_extract("path", r"/(run_\d+)/", 1))
    kept = named.join(S_.discover_runs(found, root), "run", "left_semi")
    return kept.groupBy("run", "task").agg(F.count(F.lit(1)).alias("n"))
