"""Queries of text: describing relations, reading them back, labels, queries, outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlogic.functions import layout as L
from gridlogic.functions import score as E
from gridlogic.functions import text as X
from gridlogic.functions.vocab import ALIAS_LABEL, ALIASES_BY_LENGTH, GENERATED, PHRASES, POOLS
from gridlogic.plans.registry import query
from gridlogic.plans.scenes import SCENES, STATED, held, horiz, pool_rows, quoted, rel, scenes, stated_scenes, vert
from gridlogic.session import table

_POOL = {0: "spatial", 1: "cardinal", 2: "clock"}
#: The pool goes by scene_id mod 3, the phrase by scene_id plus the place of the statement.
DESCRIBED = STATED + ", said AS (" + " UNION ALL ".join(
    f"SELECT s.scene_id, s.ord, s.obj1, s.obj2, s.dir, s.obj1 || ' is ' || phrase || ' ' || s.obj2 AS sentence FROM stated s JOIN {pool_rows(name)} ON pool.dir = s.dir AND pool.i = (s.scene_id + s.ord) % pool.n WHERE s.scene_id % 3 = {k}"
    for k, name in _POOL.items()
) + """), described AS (SELECT scene_id, string_agg(sentence, '. ' ORDER BY ord) || '.' AS description FROM said GROUP BY scene_id)"""


def described(spark, sf_dir):
    """(scene_id, layout, stated, description)."""
    text = F
    for k, name in _POOL.items():
        text = text.when(F.col("scene_id") % 3 == k, X.describe(F.col("stated"), POOLS[name], F.col("scene_id")))
    return held(stated_scenes(spark, sf_dir).where(F.size("stated") > 0), description=text)


@query(f"WITH {DESCRIBED} SELECT scene_id, description FROM described")
def describe_scenes(spark, sf_dir):
    """X7."""
    return described(spark, sf_dir).select("scene_id", "description")


def _table(entries: dict[str, str], name: str) -> str:
    return f"(VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in entries.items())}) AS {name}(phrase, dir)"


def legacy(source: str) -> str:
    """SQL: relations read from (scene_id, description) of source, numbered by sentence and clause."""
    look = lambda p: f"coalesce((SELECT dir FROM vocabulary WHERE phrase = {p}), (SELECT dir FROM vocabulary WHERE phrase = {p} || ' of'), (SELECT dir FROM vocabulary WHERE phrase = {p} || ' from'))"
    return f""", vocabulary AS (SELECT * FROM {_table(PHRASES, 'v')}
), sentences AS (SELECT scene_id, s, trim(t[s]) AS sentence FROM (SELECT scene_id, regexp_split_to_array(description, '[.,]') AS t FROM {source}), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS s)
), clauses AS (
  SELECT scene_id, s, c, lower(regexp_extract(sentence, '^(\\w+)\\s+is\\s+', 1)) AS obj1, lower(trim(p[c])) AS part
  FROM (SELECT *, regexp_split_to_array(regexp_replace(sentence, '^(\\w+)\\s+is\\s+', ''), '\\s+and\\s+') AS p FROM sentences WHERE regexp_matches(sentence, '^\\w+\\s+is\\s+')), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS c)
), parted AS (
  SELECT *, regexp_extract(part, '^(.+?)\\s+(of|from|as)\\s+(\\w+)$', 1) AS p1, regexp_extract(part, '^(.+?)\\s+(\\w+)$', 1) AS p2, regexp_extract(part, '^(.+?)\\s+(\\w+)$', 2) AS obj2 FROM clauses
), parsed AS (
  SELECT scene_id, s, c, obj1, obj2, coalesce({look('p1')}, {look('p2')}) AS dir FROM parted WHERE obj2 <> ''
)"""


@query(f"WITH {DESCRIBED}{legacy('described')} SELECT scene_id, obj1, obj2, dir FROM parsed WHERE dir IS NOT NULL")
def description_parse_legacy(spark, sf_dir):
    """X1-X3."""
    return described(spark, sf_dir).select("scene_id", F.inline(X.parse_description(F.col("description"))))


@query(f"""WITH {DESCRIBED}, vocabulary AS (SELECT * FROM {_table(GENERATED, 'v')}), sentences AS (SELECT scene_id, trim(unnest(string_split(description, '.'))) AS t FROM described),
cut AS (SELECT scene_id, regexp_extract(t, '^(.*?) is (.*)\\s+(\\S+)$', 1) AS obj1, regexp_extract(t, '^(.*?) is (.*)\\s+(\\S+)$', 2) AS phrase, regexp_extract(t, '^(.*?) is (.*)\\s+(\\S+)$', 3) AS obj2 FROM sentences WHERE t <> '')
SELECT scene_id, obj1, obj2, dir FROM cut JOIN vocabulary USING (phrase)""")
def description_parse_whole(spark, sf_dir):
    """X4."""
    return described(spark, sf_dir).select("scene_id", F.inline(X.parse_whole(F.col("description"))))


@query(f"WITH {DESCRIBED} SELECT CASE scene_id % 3 WHEN 0 THEN 'spatial' WHEN 1 THEN 'cardinal' ELSE 'clock' END AS terminology, count(*) AS n FROM described GROUP BY 1")
def terminology(spark, sf_dir):
    """Which vocabulary a description uses."""
    return described(spark, sf_dir).select(X.terminology(F.col("description")).alias("terminology")).groupBy("terminology").agg(F.count(F.lit(1)).alias("n"))


#: Answers: an alias with text around it, by part.
_ANSWERS = {0: ("", "."), 1: ("The answer is ", "!"), 2: ("It is ", " from there"), 3: ("  ", " ;")}
_aliases = list(ALIAS_LABEL)
ANSWERS = f"""aliases AS (SELECT * FROM (VALUES {', '.join(f"({i}, {quoted(a)}, {quoted(ALIAS_LABEL[a])}, {ALIASES_BY_LENGTH.index(a)})" for i, a in enumerate(_aliases))}) AS v(i, alias, label, k)
), answers AS (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN alias || '.' WHEN 1 THEN 'The answer is ' || alias || '!' WHEN 2 THEN 'It is ' || alias || ' from there' ELSE '  ' || p_name || ' ;' END AS answer
  FROM part JOIN aliases ON i = p_partkey % {len(_aliases)}
), cleaned AS (
  SELECT p_partkey, answer, regexp_replace(lower(trim(answer)), '[.!?;:,]+$', '') AS text FROM answers
), inside AS (
  SELECT c.p_partkey, min_by(a.label, a.k) AS label FROM cleaned c JOIN aliases a ON contains(c.text, a.alias) AND regexp_matches(c.text, '\\b' || replace(a.alias, '-', '\\-') || '\\b') GROUP BY c.p_partkey
)"""


@query(f"WITH {ANSWERS} SELECT p_partkey, answer, coalesce(a.label, i.label, c.text) AS label FROM cleaned c LEFT JOIN aliases a ON a.alias = c.text LEFT JOIN inside i USING (p_partkey)")
def label_resolution(spark, sf_dir):
    """X6."""
    alias = F.element_at(F.array(*map(F.lit, _aliases)), (F.col("p_partkey") % len(_aliases) + 1).cast("int"))
    answer = F.when(F.col("p_partkey") % 4 == 3, F.concat(F.lit("  "), F.col("p_name"), F.lit(" ;")))
    for k in (0, 1, 2):
        answer = answer.when(F.col("p_partkey") % 4 == k, F.concat(F.lit(_ANSWERS[k][0]), alias, F.lit(_ANSWERS[k][1])))
    return held(table(spark, sf_dir, "part").select("p_partkey", "p_name"), answer=answer).select("p_partkey", "answer", X.resolve_label(F.col("answer")).alias("label"))


def asked(spark, sf_dir):
    """(scene_id, layout with lower-case names, kind, question, label): the last object as seen from the first."""
    own = scenes(spark, sf_dir).where(F.size("layout") > 1)
    first, last = F.get("layout", F.lit(0))["obj"], F.element_at("layout", -1)["obj"]
    kind = F.element_at(F.array(F.lit("full"), F.lit("vertical"), F.lit("horizontal")), (F.col("scene_id") % 3 + 1).cast("int"))
    low = F.transform("layout", lambda o: F.struct(F.lower(o["obj"]).alias("obj"), o["x"].alias("x"), o["y"].alias("y")))
    return held(own.select("scene_id", low.alias("layout"), kind.alias("kind"), X.query_text(last, first, kind).alias("question")), asked=X.parse_query(F.col("question")))


ASKED = SCENES + f""", ends AS (
  SELECT scene_id, min(obj) AS o2, max(obj) AS o1 FROM pos GROUP BY scene_id HAVING count(*) > 1
), asked AS (
  SELECT e.scene_id, lower(o1) AS obj1, lower(o2) AS obj2, CASE e.scene_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'vertical' ELSE 'horizontal' END AS kind,
         'Where is ' || o1 || CASE e.scene_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' vertically' ELSE ' horizontally' END || ' relative to ' || o2 || '?' AS question, {rel("p.x", "p.y", "q.x", "q.y")} AS dir
  FROM ends e JOIN pos p ON p.scene_id = e.scene_id AND p.obj = o1 JOIN pos q ON q.scene_id = e.scene_id AND q.obj = o2
), answered AS (
  SELECT *, CASE kind WHEN 'full' THEN dir WHEN 'vertical' THEN {vert("dir")} ELSE {horiz("dir")} END AS label FROM asked
)"""


@query(f"WITH {ASKED} SELECT scene_id, question, obj1, obj2, kind AS query_type, label FROM answered")
def query_eval(spark, sf_dir):
    """Vertical, horizontal and full questions answered from the layout."""
    own = asked(spark, sf_dir)
    return own.select("scene_id", "question", "asked.obj1", "asked.obj2", "asked.query_type", E.answer_from_layout(F.col("layout"), F.col("asked.obj1"), F.col("asked.obj2"), F.col("asked.query_type")).alias("label"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, CASE WHEN json_exists(props, '$.zz') THEN json_extract_string(props, '$.zz') ELSE '' END AS absent FROM events WHERE props IS NOT NULL")
def json_output_extract(spark, sf_dir):
    """P6, D9."""
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", X.json_field(F.col("props"), "k").alias("k"), X.json_field(F.col("props"), "zz").alias("absent"))


@query(r"SELECT s_suppkey, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(s_name, '[_-]', ' ', 'g'), '#', ' #', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS shown, regexp_replace(s_name || '/a b', '[/\\ ]', '_', 'g') AS folder, 'x' || regexp_replace('a... b.. c.', '\.\.+', '.', 'g') AS story FROM supplier")
def names_and_stories(spark, sf_dir):
    """P12-P14."""
    own = table(spark, sf_dir, "supplier")
    return own.select("s_suppkey", X.display_name(F.replace(F.col("s_name"), F.lit("#"), F.lit(" #"))).alias("shown"), X.model_folder(F.concat("s_name", F.lit("/a b"))).alias("folder"), F.concat(F.lit("x"), X.clean_story(F.lit("a... b.. c."))).alias("story"))


@query("SELECT c_custkey, CASE WHEN k < 26 THEN chr((65 + k)::INTEGER) ELSE chr((64 + k // 26)::INTEGER) || chr((65 + k % 26)::INTEGER) END AS name FROM (SELECT c_custkey, c_custkey % 700 AS k FROM customer)")
def component_names(spark, sf_dir):
    """X11."""
    return table(spark, sf_dir, "customer").select("c_custkey", X.component_name(F.col("c_custkey") % 700).alias("name"))


@query(f"WITH {DESCRIBED}{legacy('described')}, pos2 AS (SELECT scene_id, lower(min(obj)) AS obj, x, y FROM pos GROUP BY scene_id, x, y), checked AS (SELECT d.scene_id, d.obj1, d.obj2, p.obj IS NOT NULL AND q.obj IS NOT NULL AND d.dir = {rel('p.x', 'p.y', 'q.x', 'q.y')} AS ok FROM parsed d LEFT JOIN pos2 p ON p.scene_id = d.scene_id AND p.obj = d.obj1 LEFT JOIN pos2 q ON q.scene_id = d.scene_id AND q.obj = d.obj2 WHERE dir IS NOT NULL) SELECT d.scene_id, count(ok)::BIGINT AS total, coalesce(sum(ok::INTEGER), 0)::BIGINT AS correct_count FROM described d LEFT JOIN checked USING (scene_id) GROUP BY d.scene_id")
def ascii_task(spark, sf_dir):
    """E6/E3 on text: relations read from a description, checked on the rendered and reparsed grid."""
    own = held(described(spark, sf_dir), art=L.render_panel(F.col("layout")), parsed=L.parse_art(F.col("art")), model=L.compact(F.col("parsed")), read=X.parse_description(F.col("description")))
    v = own.select("scene_id", E.verify(F.col("read"), F.col("model")).alias("v"))
    return v.select("scene_id", "v.total", "v.correct_count")

