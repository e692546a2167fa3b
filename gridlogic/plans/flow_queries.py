"""Queries of selection, splits, external sets, summaries, training rows and quotas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlogic.functions import score as E
from gridlogic.operators import dashboard as D
from gridlogic.operators import external as X
from gridlogic.operators import metrics as M
from gridlogic.operators import sampling as S
from gridlogic.operators import training as N
from gridlogic.operators.balance import balanced
from gridlogic.plans import layout_queries  # noqa: F401  registers the renderings
from gridlogic.plans.registry import ORACLES, query
from gridlogic.plans.scenes import quoted, rel
from gridlogic.plans.score_queries import INSTANCES, instances
from gridlogic.plans.text_queries import DESCRIBED
from gridlogic.session import table

HASH = lambda k, seed: f"(({k} + {seed}) * 2654435761) % 4294967296"


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_per_key(spark, sf_dir):
    """Of one key the last row."""
    return S.keep_last(table(spark, sf_dir, "events"), "user_id", F.col("ts"), F.col("event_id")).select("event_id", "user_id", "event_type")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k = 1 ORDER BY doc_id LIMIT 5")
def few_shot_first_per_label(spark, sf_dir):
    """O5."""
    return S.first_per_label(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5, F.col("doc_id"))


@query(f"WITH {INSTANCES} SELECT id, query_type FROM instances WHERE has_unique_layout AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3) ORDER BY id LIMIT 1000")
def select_test_cases(spark, sf_dir):
    """O6, J5."""
    shots = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("id"))
    return S.select_cases(instances(spark, sf_dir).where("has_unique_layout").select("id", "query_type"), 1000, F.col("id"), without=shots)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def first_per_story(spark, sf_dir):
    """O7."""
    return S.first_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", F.col("o_orderkey"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)")
def held_out_split(spark, sf_dir):
    """J3, O13."""
    labels = table(spark, sf_dir, "labels")
    ids = labels.where("quality = 1").select("doc_id").union(labels.where("toxic = 1").select("doc_id")).distinct()
    return S.pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), ids, "doc_id")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0")
def resume_pending(spark, sf_dir):
    """J4, N17."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return S.pending(events, events.where("event_id % 3 = 0"), "event_id")


@query(f"WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY {HASH('o_orderkey', 42)}, o_orderkey) AS k FROM orders) SELECT id, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r, n")
def train_val_test_split(spark, sf_dir):
    """O8, O10."""
    return S.split_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", (0.8, 0.1, 0.1), 42)


@query(f"SELECT * FROM (SELECT p_partkey AS id, 'a' AS side FROM part ORDER BY {HASH('p_partkey', 8)}, p_partkey LIMIT 50) UNION ALL SELECT * FROM (SELECT s_suppkey, 'b' FROM supplier ORDER BY {HASH('s_suppkey', 9)}, s_suppkey LIMIT 50)")
def mixed_rows(spark, sf_dir):
    """O9, O11."""
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("a").alias("side"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("b").alias("side"))
    return S.mixed_half(a, b, 100, 7)


@query(f"WITH {INSTANCES}, r AS (SELECT id, num_components, row_number() OVER (PARTITION BY num_components ORDER BY {HASH('id', 42)}, id) AS k FROM instances) SELECT id, num_components FROM r JOIN (VALUES (2, 25), (3, 75), (4, 180), (5, 180), (6, 180), (7, 180), (8, 180)) AS q(c, n) ON c = num_components WHERE k <= n")
def quota_balance(spark, sf_dir):
    """A thousand instances in the shares of 2.5, 7.5 and five times 18 percent."""
    shares = {2: 25, 3: 75} | dict.fromkeys(range(4, 9), 180)
    return S.quota_selection(instances(spark, sf_dir).select("id", "num_components"), "num_components", shares, "id", 42)


#: Shares of five marginals, of a tenth of all instances.
MARGINALS = {
    "num_components": {2: 0.025, 3: 0.075} | dict.fromkeys(range(4, 9), 0.18), "is_directly_stated": {True: 0.5, False: 0.5}, "has_unique_layout": {True: 0.5, False: 0.5},
    "query_type": {"full": 0.4, "vertical": 0.3, "horizontal": 0.3}, "terminology_used": {"urgent": 0.1, "high": 0.2, "medium": 0.2, "low": 0.3, "not specified": 0.2},
}
_shares = " UNION ALL ".join(f"SELECT '{c}' AS factor, {quoted(str(v).lower() if isinstance(v, bool) else str(v))} AS value, {share}::DOUBLE AS share" for c, own in MARGINALS.items() for v, share in own.items())


@query(f"SELECT factor, value, TRUE AS met, (SELECT count(*) // 10 FROM orders) AS rows_taken, (SELECT count(*) // 10 FROM orders) AS instances FROM ({_shares})")
def balanced_marginals(spark, sf_dir):
    """A tenth of all instances, each of five marginals within one row of its share."""
    own = instances(spark, sf_dir)
    total = own.count() // 10
    taken = balanced(own, MARGINALS, total, "id").select("id", *(F.col(c).cast("string").alias(c) for c in MARGINALS))
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("factor"), F.col(c).alias("value")) for c in MARGINALS)))
    counts = taken.select("id", stacked.alias("f")).groupBy("f.factor", "f.value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("instances"))
    shares = [(c, str(v).lower() if isinstance(v, bool) else str(v), share) for c, marginal in MARGINALS.items() for v, share in marginal.items()]
    want = spark.createDataFrame(shares, "factor string, value string, share double")
    of_factor = Window.partitionBy("factor")
    return want.join(counts, ["factor", "value"], "left").select("factor", "value", (F.abs(F.col("n") - F.col("share") * total) <= 1).alias("met"), F.sum("n").over(of_factor).alias("rows_taken"), F.sum("instances").over(of_factor).alias("instances"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment < 'C' THEN 'above, left' WHEN c_mktsegment < 'I' THEN 'Above and to the left.' ELSE 'north' END AS prediction, CASE WHEN c_mktsegment < 'I' THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM customer")
def stepgame_score(spark, sf_dir):
    """X14, E12."""
    said = F.when(F.col("c_mktsegment") < "C", "above, left").when(F.col("c_mktsegment") < "I", "Above and to the left.").otherwise("north")
    return table(spark, sf_dir, "customer").select("c_custkey", said.alias("prediction")).withColumn("score", E.stepgame_score(F.col("prediction"), F.array(F.lit("left"), F.lit("above"))))


_W = {0: "south east", 1: "South West", 2: "east south", 3: "east"}


@query("WITH s AS (SELECT s_suppkey % 4 AS k, CASE s_suppkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM supplier) SELECT count(*) AS total, count(*) FILTER (WHERE score = 1) AS \"full\", count(*) FILTER (WHERE score = 0.5) AS half, count(*) FILTER (WHERE score = 0) AS wrong, avg(score) AS average, avg((score = 1)::INTEGER) AS exact FROM s")
def babi_score(spark, sf_dir):
    """E13, A21."""
    said = F
    for k, w in _W.items():
        said = said.when(F.col("s_suppkey") % 4 == k, w)
    return M.scored_summary(table(spark, sf_dir, "supplier").select(E.babi_score(said, F.lit("south east")).alias("score")))


@query("SELECT n_nationkey, n_nationkey % 3 <> 2 AS match FROM nation")
def spartqa_match(spark, sf_dir):
    """X15, E14."""
    k = F.col("n_nationkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("The "), "n_name", F.lit("."))).when(k % 3 == 1, "the second option").otherwise("something")
    question = F.concat(F.lit("Is it near the rock or "), F.lower("n_name"), F.lit("?"))
    return table(spark, sf_dir, "nation").select("n_nationkey", E.spartqa_match(said, F.array(F.concat(F.lit("a "), "n_name")), question).alias("match"))


@query("SELECT l_orderkey AS query_id, string_agg(p_type, '|' ORDER BY p_type) AS answers FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 3 > 0 GROUP BY l_orderkey")
def qrels_answers(spark, sf_dir):
    """J6."""
    qrels = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("score"))
    found = X.answers_by_query(qrels, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("text")))
    return found.select("query_id", F.array_join("reference_answers", "|").alias("answers"))


_lines = """lines AS (SELECT user_id % 50 AS file, event_id AS ord, (1 + event_id % 6)::INTEGER AS number, CASE WHEN event_id % 3 = 2 THEN 'Where from ' || event_type || '?' || chr(9) || CASE WHEN event_id % 2 = 0 THEN 'n,e' ELSE 's,w' END ELSE event_type || ' is here.' END AS text FROM events
), told AS (SELECT *, sum((number = 1)::INTEGER) OVER (PARTITION BY file ORDER BY ord) AS story FROM lines)"""


@query(f"WITH {_lines} SELECT q.file, q.ord, coalesce((SELECT string_agg(t.text, ' ' ORDER BY t.ord) FROM told t WHERE t.file = q.file AND t.story = q.story AND t.ord < q.ord AND NOT contains(t.text, chr(9))), '') AS passage, string_split(q.text, chr(9))[1] AS question, CASE WHEN q.text LIKE '%n,e' THEN 'north east' ELSE 'south west' END AS answer FROM told q WHERE contains(q.text, chr(9))")
def babi_stories(spark, sf_dir):
    """S6, O19."""
    from gridlogic.sources.files import babi_stories as parse

    e = F.col("event_id")
    text = F.when(e % 3 == 2, F.concat(F.lit("Where from "), "event_type", F.lit("?\t"), F.when(e % 2 == 0, "n,e").otherwise("s,w"))).otherwise(F.concat("event_type", F.lit(" is here.")))
    lines = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("file"), e.alias("ord"), F.concat((1 + e % 6).cast("string"), F.lit(" "), text).alias("value"))
    return parse(lines)


RUNS = """runs AS (SELECT 'run_' || (event_id % 3) AS run, event_type AS task, value > 50 AS correct FROM events
), summary AS (SELECT run, task, count(*) AS n, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE correct) * 1.0::DOUBLE / count(*) AS accuracy FROM runs GROUP BY ALL)"""


def runs(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.concat(F.lit("run_"), (F.col("event_id") % 3).cast("string")).alias("run"), F.col("event_type").alias("task"), (F.col("value") > 50).alias("correct"))
    return D.run_summary(own)


@query(f"WITH {RUNS} SELECT * FROM summary")
def run_summary(spark, sf_dir):
    """A16."""
    return runs(spark, sf_dir)


@query(f"WITH {RUNS} SELECT run, 'Run ' || right(run, 1) AS name, string_agg(task, ',' ORDER BY task) AS tasks, avg(accuracy) AS mean_accuracy FROM summary GROUP BY run")
def dashboard_metrics(spark, sf_dir):
    """A17."""
    return D.dashboard(runs(spark, sf_dir)).drop("metrics")


@query(f"WITH {RUNS} SELECT task, coalesce(a.accuracy, 0) AS base, coalesce(b.accuracy, 0) AS tuned, coalesce(b.accuracy, 0) - coalesce(a.accuracy, 0) AS gain FROM (SELECT * FROM summary WHERE run = 'run_0') a FULL JOIN (SELECT * FROM summary WHERE run = 'run_1') b USING (task)")
def base_vs_tuned(spark, sf_dir):
    """J16."""
    return D.base_vs_tuned(runs(spark, sf_dir), "run_0", "run_1")


@query("SELECT conv_id, count(*) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dump FROM conversations GROUP BY conv_id")
def message_rows(spark, sf_dir):
    """Messages of a conversation in order."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("dump"))


def training_instances(spark, sf_dir):
    """Scenes as instances."""
    from gridlogic.functions import layout as L
    from gridlogic.functions.text import query_text
    from gridlogic.plans.text_queries import described

    own = described(spark, sf_dir)
    first, last = F.get("layout", F.lit(0))["obj"], F.element_at("layout", -1)["obj"]
    art = F.struct(*(L.render(F.col("layout"), v).alias(v) for v in N.VIEWS))
    return own.select(F.col("scene_id").cast("string").alias("id"), "description", art.alias("ascii"), query_text(last, first, F.lit("full")).alias("query_relation"), L.direction_between(F.col("layout"), last, first).alias("label"), F.size("layout").alias("num_components"))


def _training() -> str:
    """SQL: (id, description, simple, grid, panel, question, label, num_components) as training_instances() has them."""
    arts = ", ".join(f"{v} AS ({ORACLES[f'ascii_render_{v}']})" for v in N.VIEWS)
    return f"""WITH {arts}, told AS (WITH {DESCRIBED} SELECT scene_id, description FROM described), spots AS (WITH {DESCRIBED} SELECT * FROM pos
), ends AS (SELECT scene_id, min(obj) AS first, max(obj) AS last, count(*) AS n FROM spots GROUP BY scene_id
), training AS (
  SELECT t.scene_id, t.scene_id::VARCHAR AS id, description, simple.art AS simple, grid.art AS grid, panel.art AS panel, 'Where is ' || last || ' relative to ' || first || '?' AS question,
         {rel("q.x", "q.y", "p.x", "p.y")} AS label, n::INTEGER AS num_components
  FROM told t JOIN ends e USING (scene_id) JOIN simple USING (scene_id) JOIN grid USING (scene_id) JOIN panel USING (scene_id)
  JOIN spots p ON p.scene_id = t.scene_id AND p.obj = first JOIN spots q ON q.scene_id = t.scene_id AND q.obj = last
)"""


@query(f"""{_training()}, styled AS (SELECT *, ['simple', 'grid', 'panel'][1 + ('0x' || substr(md5('42|' || id), 1, 13))::BIGINT % 3] AS style FROM training)
SELECT id AS record_id, description AS prompt, CASE style WHEN 'simple' THEN simple WHEN 'grid' THEN grid ELSE panel END AS completion, num_components, style AS ascii_format FROM styled""")
def training_rows(spark, sf_dir):
    """Description to layout, in a style by hash."""
    return N.training_dataset(training_instances(spark, sf_dir), "A-RANDOM-FORMAT")


_SAID = "'Description: ' || description || chr(10) || 'Layout:' || chr(10) || 'grid:' || chr(10) || rtrim(grid) || chr(10) || 'Question: ' || question"


@query(f"""{_training()}, shots AS (SELECT * FROM training ORDER BY scene_id LIMIT 3
), examples AS (SELECT flatten(list([{{'role': 'user', 'content': {_SAID}}}, {{'role': 'assistant', 'content': '{{"answer":"' || label || '"}}'}}] ORDER BY id)) AS examples FROM shots)
SELECT id, to_json(list_concat(list_concat([{{'role': 'system', 'content': {quoted(N.system_prompt("F", names=["grid"]))}}}], examples), [{{'role': 'user', 'content': {_SAID}}}]))::VARCHAR AS messages
FROM training, examples WHERE id NOT IN (SELECT id FROM shots)""")
def chat_prompts(spark, sf_dir):
    """Conversational prompts of task F with three examples."""
    own = training_instances(spark, sf_dir)
    shots = own.orderBy(F.col("id").cast("long")).limit(3)
    return N.conversations(S.pending(own, shots, "id"), shots, "F", ["grid"]).select("id", F.to_json("messages").alias("messages"))


@query()
def generated_instances(spark, sf_dir):
    """Structures generated from the suppliers' keys, described, queried and rendered, chosen by quotas; a row for each supplier."""
    from gridlogic.operators.generate import balanced_dataset

    own = balanced_dataset(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), seed=42)
    return own.select(*(c for c in own.columns if c != "ascii"), *(F.col(f"ascii.{v}").alias(f"ascii_{v}") for v in ("simple", "grid", "panel")))


@query("""WITH total AS (SELECT count(*) AS n FROM supplier), q AS (SELECT c, floor(n * s)::BIGINT AS base, row_number() OVER (ORDER BY s DESC, c) AS k, n FROM (VALUES (2, 0.025::DOUBLE), (3, 0.075::DOUBLE), (4, 0.18::DOUBLE), (5, 0.18::DOUBLE), (6, 0.18::DOUBLE), (7, 0.18::DOUBLE), (8, 0.18::DOUBLE)) AS v(c, s), total),
wanted AS (SELECT c, base + CASE WHEN k <= n - sum(base) OVER () THEN 1 ELSE 0 END AS n FROM q) SELECT c AS num_components, n::BIGINT AS n, (2 * n)::BIGINT AS ends FROM wanted WHERE n > 0""")
def generated_shares(spark, sf_dir):
    """The shares by components of a dataset generated from the suppliers' keys, all of its rows there, each asking about two objects by their names."""
    from gridlogic.functions.text import parse_query
    from gridlogic.operators.generate import balanced_dataset

    own = balanced_dataset(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), seed=7).select("num_components", parse_query(F.col("query_relation")).alias("q"), "label").where("label is not null")
    return own.groupBy("num_components").agg(F.count(F.lit(1)).alias("n"), (F.count("q.obj1") + F.count("q.obj2")).alias("ends"))
