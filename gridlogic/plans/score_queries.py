"""Queries of scoring, metrics, factors and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlogic.functions import layout as L
from gridlogic.functions.score import BUCKETS, ERRORS
from gridlogic.operators import metrics as M
from gridlogic.operators import tasks as T
from gridlogic.plans.registry import query
from gridlogic.plans.scenes import held, horiz, quoted, rel, stated_scenes, vert
from gridlogic.plans.text_queries import ASKED, DESCRIBED, asked, described, legacy
from gridlogic.session import table

#: What a model answers: right but for every fifth scene, nothing in every seventh, and a result that has no scene for every eleventh.
RESULTS = ASKED + """, results AS (
  SELECT scene_id + CASE WHEN scene_id % 11 = 0 THEN 100000000 ELSE 0 END AS test_id,
         CASE WHEN scene_id % 7 = 0 THEN NULL WHEN scene_id % 5 = 0 THEN 'Above!' ELSE 'It is ' || label END AS answer FROM answered
), scored AS (
  SELECT r.test_id, a.kind AS query_type, a.label AS truth, CASE WHEN r.answer = 'Above!' THEN 'above' ELSE substr(r.answer, 7) END AS predicted,
         coalesce(CASE WHEN r.answer = 'Above!' THEN 'above' ELSE substr(r.answer, 7) END = a.label, FALSE) AS correct,
         CASE WHEN a.scene_id IS NULL THEN 'not found in dataset' WHEN r.answer IS NULL THEN 'no answer' END AS error
  FROM results r LEFT JOIN answered a ON a.scene_id = r.test_id
)"""


def direction(spark, sf_dir):
    own = asked(spark, sf_dir)
    from gridlogic.functions.score import answer_from_layout

    dataset = held(own, label=answer_from_layout(F.col("layout"), F.col("asked.obj1"), F.col("asked.obj2"), F.col("kind"))).select(F.col("scene_id").alias("id"), "label", F.col("kind").alias("query_type"))
    answer = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, "Above!").otherwise(F.concat(F.lit("It is "), F.col("label")))
    results = dataset.select((F.col("id") + F.when(F.col("id") % 11 == 0, 100000000).otherwise(0)).alias("test_id"), answer.alias("answer"))
    return T.direction_rows(results, dataset)


@query(f"WITH {RESULTS} SELECT * FROM scored")
def direction_task(spark, sf_dir):
    """Tasks C, D, F, H."""
    return direction(spark, sf_dir)


@query(f"WITH {RESULTS} SELECT query_type, count(*) FILTER (WHERE correct) AS correct, count(*) AS total, count(*) FILTER (WHERE correct) * 1.0::DOUBLE / count(*) AS accuracy FROM scored GROUP BY query_type")
def direction_by_query_type(spark, sf_dir):
    """A1."""
    return M.group_accuracy(direction(spark, sf_dir), "query_type")


@query(f"WITH {RESULTS} SELECT coalesce(query_type, '?') AS query_type, truth, predicted, count(*) AS n FROM scored WHERE error IS NULL GROUP BY ALL UNION ALL SELECT 'all', truth, predicted, count(*) FROM scored WHERE error IS NULL GROUP BY truth, predicted")
def direction_confusion(spark, sf_dir):
    """A2: by query type and over all."""
    return M.confusion_levels(direction(spark, sf_dir), "query_type")


#: Ship status as a prediction of return status.
PREDICTED = """guesses AS (
  SELECT l_returnflag AS truth, CASE WHEN l_linenumber % 7 = 0 THEN '' WHEN l_linenumber % 4 = 0 THEN l_linestatus ELSE l_returnflag END AS predicted FROM lineitem
), counts AS (SELECT truth, predicted, count(*) AS n FROM guesses WHERE truth IS NOT NULL AND predicted <> '' GROUP BY ALL
), labels_seen AS (SELECT truth AS label FROM counts UNION SELECT predicted FROM counts
), classes AS (
  SELECT label, coalesce(sum(n) FILTER (WHERE truth = label AND predicted = label), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (WHERE truth <> label AND predicted = label), 0)::BIGINT AS fp, coalesce(sum(n) FILTER (WHERE truth = label AND predicted <> label), 0)::BIGINT AS fn
  FROM labels_seen, counts GROUP BY label
), rated AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp * 1.0::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp * 1.0::DOUBLE / (tp + fn) END AS recall, tp + fn AS support FROM classes
), metric AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rated
)"""


def guesses(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("truth"), F.when(n % 7 == 0, "").when(n % 4 == 0, F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("predicted"))


@query(f"WITH {PREDICTED} SELECT truth, predicted, n, 'expected_' || truth || '_predicted_' || predicted AS key FROM counts")
def confusion_matrix(spark, sf_dir):
    """A2, X19."""
    from gridlogic.functions.text import confusion_key

    return M.confusion(guesses(spark, sf_dir)).withColumn("key", confusion_key(F.col("truth"), F.col("predicted")))


@query(f"WITH {PREDICTED} SELECT label, tp, fp, fn, precision, recall, f1, support FROM metric")
def class_metrics(spark, sf_dir):
    """A3."""
    return M.class_metrics(M.confusion(guesses(spark, sf_dir)))


@query(f"""WITH {PREDICTED} SELECT avg(precision) FILTER (WHERE support > 0) AS macro_precision, avg(recall) FILTER (WHERE support > 0) AS macro_recall, avg(f1) FILTER (WHERE support > 0) AS macro_f1,
sum(tp)::DOUBLE / sum(tp + fp) AS micro_precision, sum(tp)::DOUBLE / sum(tp + fn) AS micro_recall, sum(f1 * support)::DOUBLE / sum(support) AS weighted_f1,
2 * (sum(tp)::DOUBLE / sum(tp + fp)) * (sum(tp)::DOUBLE / sum(tp + fn)) / (sum(tp)::DOUBLE / sum(tp + fp) + sum(tp)::DOUBLE / sum(tp + fn)) AS micro_f1 FROM metric""")
def macro_micro_weighted(spark, sf_dir):
    """A4-A7."""
    return M.averages(M.class_metrics(M.confusion(guesses(spark, sf_dir))))


#: Instances from orders: components from the customer's key, flags from the order.
INSTANCES = """instances AS (
  SELECT o_orderkey AS id, (2 + o_custkey % 7)::INTEGER AS num_components, (1 + o_orderkey % 9)::INTEGER AS num_relations, (o_orderkey % 4)::INTEGER AS ambiguous_stages,
         CASE o_orderkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'vertical' ELSE 'horizontal' END AS query_type, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE lower(substr(o_orderpriority, 3)) END AS terminology_used,
         o_orderkey % 2 = 0 AS is_directly_stated, o_custkey % 3 <> 0 AS has_unique_layout, o_totalprice > 150000 AS correct, (o_orderkey % 101) / 100.0::DOUBLE AS score
  FROM orders
)"""


def instances(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), (2 + c % 7).cast("int").alias("num_components"), (1 + k % 9).cast("int").alias("num_relations"), (k % 4).cast("int").alias("ambiguous_stages"),
        F.when(k % 3 == 0, "full").when(k % 3 == 1, "vertical").otherwise("horizontal").alias("query_type"), F.when(k % 13 != 0, F.lower(F.substr("o_orderpriority", F.lit(3)))).alias("terminology_used"),
        (k % 2 == 0).alias("is_directly_stated"), (c % 3 != 0).alias("has_unique_layout"), (F.col("o_totalprice") > 150000).alias("correct"), ((k % 101) / F.lit(100.0)).alias("score"),
    )


def _factors(task: str, accuracy: str) -> str:
    one = lambda c, f: f"SELECT {quoted(c)} AS category, {quoted(f)} AS factor, " + (f"CASE WHEN {f} THEN 'True' ELSE 'False' END" if f in ("is_directly_stated", "has_unique_layout") else f"{f}::VARCHAR") + f" AS value, count(*) FILTER (WHERE correct) AS correct, count(*) AS total, {accuracy} AS accuracy FROM instances WHERE {f} IS NOT NULL GROUP BY {f}"
    return f"WITH {INSTANCES} " + " UNION ALL ".join(one(c, f) for c, f in M.task_factors(task))


@query(_factors("F", "count(*) FILTER (WHERE correct) * 1.0::DOUBLE / count(*)"))
def factor_accuracy(spark, sf_dir):
    """A8, A9, P11."""
    return M.factor_accuracy(instances(spark, sf_dir), M.task_factors("F"))


@query(_factors("A", "avg(score)"))
def factor_mean_accuracy(spark, sf_dir):
    """Tasks A and B go by the mean of their instances' accuracies."""
    return M.factor_accuracy(instances(spark, sf_dir), M.task_factors("A"), mean_of="score")


@query(f"WITH {INSTANCES} SELECT coalesce(instances.num_components, -1)::INTEGER AS num_components, count(*) AS n, count(*) FILTER (WHERE is_directly_stated) AS direct, count(*) FILTER (WHERE has_unique_layout) AS unique_layout, avg(num_relations) AS mean_relations, min(num_relations) AS min_relations, max(num_relations) AS max_relations FROM instances GROUP BY ROLLUP (instances.num_components)")
def dataset_stats(spark, sf_dir):
    """A14."""
    return M.dataset_stats(instances(spark, sf_dir))


_hist = lambda f: f"SELECT '{f}' AS factor, {f}::VARCHAR AS value, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM instances) AS percent FROM instances GROUP BY {f}"


@query(f"WITH {INSTANCES} " + " UNION ALL ".join(map(_hist, ("num_components", "query_type", "terminology_used"))))
def histograms(spark, sf_dir):
    """A15."""
    return M.histogram(instances(spark, sf_dir), "num_components", "query_type", "terminology_used")


@query(f"WITH {INSTANCES} SELECT terminology_used, n FROM (SELECT terminology_used, count(*) AS n FROM instances WHERE terminology_used IS NOT NULL GROUP BY 1) ORDER BY n DESC, terminology_used LIMIT 3")
def top_terminology(spark, sf_dir):
    """O3, O4."""
    return instances(spark, sf_dir).where("terminology_used is not null").groupBy("terminology_used").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "terminology_used").limit(3)


#: Consistency results: grids that are right, or turned upside down in every fourth scene; errors, missing answers and grids here and there.
CONSISTENCY = DESCRIBED + legacy("described").replace("SELECT * FROM (VALUES", "SELECT * FROM (VALUES") + f""", ends AS (
  SELECT scene_id, min(obj) AS o2, max(obj) AS o1 FROM pos GROUP BY scene_id HAVING count(*) > 1
), top AS (SELECT scene_id, max(y) AS h FROM pos GROUP BY scene_id
), cells AS (SELECT scene_id, lower(min(obj)) AS obj, x, y FROM pos GROUP BY scene_id, x, y
), model AS (
  SELECT c.scene_id, c.obj, c.x, CASE WHEN c.scene_id % 4 = 0 THEN h - c.y ELSE c.y END AS y FROM cells c JOIN top USING (scene_id)
), want AS (
  SELECT e.scene_id, CASE e.scene_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'vertical' ELSE 'horizontal' END AS kind, {rel("p.x", "p.y", "q.x", "q.y")} AS d, m.obj IS NOT NULL AND n.obj IS NOT NULL AS there, {rel("m.x", "m.y", "n.x", "n.y")} AS got
  FROM ends e JOIN pos p ON p.scene_id = e.scene_id AND p.obj = o1 JOIN pos q ON q.scene_id = e.scene_id AND q.obj = o2
  LEFT JOIN model m ON m.scene_id = e.scene_id AND m.obj = lower(o1) LEFT JOIN model n ON n.scene_id = e.scene_id AND n.obj = lower(o2)
), labelled AS (
  SELECT scene_id, there, CASE kind WHEN 'full' THEN d WHEN 'vertical' THEN {vert("d")} ELSE {horiz("d")} END AS label, CASE kind WHEN 'full' THEN got WHEN 'vertical' THEN {vert("got")} ELSE {horiz("got")} END AS seen FROM want
), checked AS (
  SELECT d.scene_id, count(*) AS n, count(*) FILTER (WHERE p.obj IS NOT NULL AND q.obj IS NOT NULL AND d.dir = {rel("p.x", "p.y", "q.x", "q.y")}) AS ok
  FROM parsed d LEFT JOIN model p ON p.scene_id = d.scene_id AND p.obj = d.obj1 LEFT JOIN model q ON q.scene_id = d.scene_id AND q.obj = d.obj2 WHERE d.dir IS NOT NULL GROUP BY d.scene_id
), rows_ AS (
  SELECT l.scene_id AS test_id, CASE WHEN l.scene_id % 17 = 0 THEN 'model error' WHEN l.scene_id % 19 = 0 THEN 'missing answer' WHEN l.scene_id % 29 = 0 THEN 'no ASCII grid in model output' END AS skipped,
         there AND seen = CASE WHEN l.scene_id % 5 = 0 THEN 'left' ELSE label END AS consistent, there AND seen = label AS ascii_ok, CASE WHEN l.scene_id % 5 = 0 THEN 'left' ELSE label END = label AS answer_ok, coalesce(ok * 1.0::DOUBLE / n, 0) AS accuracy
  FROM labelled l LEFT JOIN checked c USING (scene_id)
), kept AS (
  SELECT test_id, skipped, CASE WHEN skipped IS NULL THEN consistent END AS consistent, CASE WHEN skipped IS NULL THEN ascii_ok END AS ascii_ok, CASE WHEN skipped IS NULL THEN answer_ok END AS answer_ok, CASE WHEN skipped IS NULL THEN accuracy END AS accuracy,
         CASE WHEN skipped IS NOT NULL THEN NULL WHEN accuracy < 0.25 THEN '[0, 0.25)' WHEN accuracy < 0.5 THEN '[0.25, 0.5)' WHEN accuracy < 0.75 THEN '[0.5, 0.75)' ELSE '[0.75, 1]' END AS bucket,
         CASE WHEN skipped IS NOT NULL THEN NULL ELSE CASE WHEN ascii_ok THEN 'correct_ascii_' ELSE 'wrong_ascii_' END || CASE WHEN answer_ok THEN 'correct_answer' ELSE 'wrong_answer' END END AS kind FROM rows_
)"""


def labelled(own):
    """Rows (with scene_id and layout) as id, with question, kind and label."""
    from gridlogic.functions.score import answer_from_layout
    from gridlogic.functions.text import parse_query, query_text

    first, last = F.get("layout", F.lit(0))["obj"], F.element_at("layout", -1)["obj"]
    kind = F.element_at(F.array(F.lit("full"), F.lit("vertical"), F.lit("horizontal")), (F.col("scene_id") % 3 + 1).cast("int"))
    low = F.transform("layout", lambda o: F.struct(F.lower(o["obj"]).alias("obj"), o["x"].alias("x"), o["y"].alias("y")))
    own = held(own, low=low, question=query_text(last, first, kind), asked=parse_query(F.col("question")))
    return own.select(F.col("scene_id").alias("id"), *(c for c in own.columns if c not in ("scene_id", "low", "asked")), kind.alias("kind"), answer_from_layout(F.col("low"), F.col("asked.obj1"), F.col("asked.obj2"), kind).alias("label"))


def drawn(own):
    """Rows (with id and layout) with art: a grid that is right, or turned upside down in every fourth scene."""
    top = F.array_max(F.transform("layout", lambda o: o["y"]))
    y = lambda o: F.when(F.col("id") % 4 == 0, F.col("__top") - o["y"]).otherwise(o["y"]).cast("int")
    turned = F.transform("__cells", lambda o: F.struct(o["obj"].alias("obj"), o["x"].alias("x"), y(o).alias("y")))
    cells = F.filter("layout", lambda o, i: ~F.exists("layout", lambda q: (q["x"] == o["x"]) & (q["y"] == o["y"]) & (q["obj"] < o["obj"])))
    own = held(own, __top=top, __cells=cells, __turned=turned)
    return own.withColumn("art", L.render_grid(F.col("__turned"))).drop("__top", "__cells", "__turned")


def answered_scenes(spark, sf_dir):
    """(id, question, kind, description, label, art): questions with their labels, and grids that are right, or turned upside down in every fourth scene."""
    return drawn(labelled(described(spark, sf_dir))).select("id", "question", "kind", "description", "label", "art")


def consistency_tables(spark, sf_dir):
    """Results and dataset; each makes only what it has, as a held column is made whether or not it is read."""
    i = F.col("id")
    own = drawn(labelled(stated_scenes(spark, sf_dir).where(F.size("stated") > 0).select("scene_id", "layout")))
    results = own.select(i.alias("test_id"), F.when(i % 17 == 0, "timeout").alias("error"), F.when(i % 19 != 0, F.when(i % 5 == 0, "left").otherwise(F.col("label"))).alias("answer"), F.when(i % 29 != 0, F.col("art")).alias("grid"))
    return results, labelled(described(spark, sf_dir)).select("id", "question", "description", "label")


def consistency(spark, sf_dir):
    return T.consistency_rows(*consistency_tables(spark, sf_dir))


@query(f"WITH {CONSISTENCY} SELECT * FROM kept")
def consistency_task(spark, sf_dir):
    """Tasks E and G."""
    return consistency(spark, sf_dir)


@query(f"WITH {CONSISTENCY} SELECT count(*) FILTER (WHERE skipped IS NULL) AS evaluated, count(*) FILTER (WHERE skipped IS NOT NULL) AS skipped, avg(consistent::INTEGER) AS consistency, avg(answer_ok::INTEGER) AS answer_accuracy, avg(ascii_ok::INTEGER) AS ascii_accuracy, avg(accuracy) AS mean_accuracy FROM kept")
def consistency_rates(spark, sf_dir):
    """A13."""
    return T.consistency_summary(consistency(spark, sf_dir))


@query(f"WITH {CONSISTENCY}, b AS (SELECT bucket, count(*) AS total, count(*) FILTER (WHERE consistent) AS consistent, count(*) FILTER (WHERE answer_ok) AS answer_correct, avg(accuracy) AS mean_accuracy FROM kept WHERE bucket IS NOT NULL GROUP BY bucket) SELECT v.bucket, coalesce(total, 0) AS total, coalesce(consistent, 0) AS consistent, coalesce(answer_correct, 0) AS answer_correct, coalesce(mean_accuracy, 0) AS mean_accuracy, coalesce(consistent * 1.0::DOUBLE / total, 0) AS consistency_rate FROM (VALUES {', '.join(f'({quoted(x)})' for x in BUCKETS)}) AS v(bucket) LEFT JOIN b USING (bucket)")
def bucket_analysis(spark, sf_dir):
    """E10, A12."""
    return M.bucket_summary(consistency(spark, sf_dir).where("skipped is null"))


@query(f"WITH {CONSISTENCY}, e AS (SELECT kind, count(*) AS n FROM kept GROUP BY kind) SELECT v.kind, coalesce(n, 0) AS n FROM (VALUES {', '.join(f'({quoted(x)})' for x in ERRORS)}) AS v(kind) LEFT JOIN e USING (kind)")
def error_mapping(spark, sf_dir):
    """E11."""
    return M.error_summary(consistency(spark, sf_dir).where("skipped is null"))


@query(f"WITH {CONSISTENCY} SELECT skipped AS reason, count(*) AS n FROM kept WHERE skipped IS NOT NULL GROUP BY 1")
def skip_reasons(spark, sf_dir):
    """P10."""
    results, dataset = consistency_tables(spark, sf_dir)
    return T.skips(results, dataset.select("id")).where("skipped is not null").groupBy(F.col("skipped").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DESCRIBED}{legacy('described')}, cells AS (SELECT scene_id, lower(min(obj)) AS obj, x, y FROM pos GROUP BY scene_id, x, y), c AS (SELECT d.scene_id, count(*) AS n, count(*) FILTER (WHERE p.obj IS NOT NULL AND q.obj IS NOT NULL AND d.dir = {rel('p.x', 'p.y', 'q.x', 'q.y')}) AS ok FROM parsed d LEFT JOIN cells p ON p.scene_id = d.scene_id AND p.obj = d.obj1 LEFT JOIN cells q ON q.scene_id = d.scene_id AND q.obj = d.obj2 WHERE d.dir IS NOT NULL GROUP BY d.scene_id), v AS (SELECT scene_id, coalesce(ok = n, TRUE) AS correct, coalesce(ok, 0) AS ok, coalesce(n, 0) AS n FROM described LEFT JOIN c USING (scene_id)) SELECT count(*) AS n, avg(correct::INTEGER) AS accuracy, avg(CASE WHEN n = 0 THEN 0 ELSE ok * 1.0::DOUBLE / n END) AS average_instance_accuracy, sum(ok)::DOUBLE / sum(n) AS relation_accuracy FROM v")
def description_task(spark, sf_dir):
    """Task B, over all."""
    own = stated_scenes(spark, sf_dir).where(F.size("stated") > 0)
    dataset = own.select(F.col("scene_id").alias("id"), L.render_grid(F.col("layout")).alias("grid"))
    return T.instance_summary(T.description_rows(described(spark, sf_dir).select(F.col("scene_id").alias("test_id"), "description"), dataset))
