"""Queries of layouts: compaction, relations, rendering, parsing, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlogic.functions import algebra as R
from gridlogic.functions import layout as L
from gridlogic.functions import score as E
from gridlogic.plans.registry import query
from gridlogic.plans.scenes import SCENES, STATED, held, horiz, inv, rel, scenes, stated_scenes, sx, sy, vert
from gridlogic.session import table

PAIRS = SCENES + f""", pairs AS (
  SELECT a.scene_id, a.obj AS obj1, b.obj AS obj2, {rel("a.x", "a.y", "b.x", "b.y")} AS dir FROM pos a JOIN pos b ON a.scene_id = b.scene_id AND a.obj <> b.obj
)"""


@query(f"WITH {SCENES} SELECT scene_id, obj, x, y FROM pos")
def scene_compaction(spark, sf_dir):
    """L2, O18."""
    return scenes(spark, sf_dir).select("scene_id", F.inline("layout"))


def pair_rows(spark, sf_dir):
    return scenes(spark, sf_dir).select("scene_id", F.inline(L.all_relations(F.col("layout"))))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def scene_relations(spark, sf_dir):
    """L3, J9, R3."""
    return pair_rows(spark, sf_dir)


@query(f"WITH {PAIRS} SELECT dir, {vert('dir')} AS vertical, {horiz('dir')} AS horizontal, count(*) AS n FROM pairs GROUP BY ALL")
def relation_components(spark, sf_dir):
    """R4, R5."""
    return pair_rows(spark, sf_dir).groupBy("dir").agg(F.count(F.lit(1)).alias("n")).select("dir", R.vertical(F.col("dir")).alias("vertical"), R.horizontal(F.col("dir")).alias("horizontal"), "n")


@query(f"""WITH {SCENES}, ways AS (
  SELECT p.scene_id, p.obj AS obj1, q.obj AS obj2, {rel("p.x", "p.y", "q.x", "q.y")} AS dir, {rel("q.x", "q.y", "p.x", "p.y")} AS reverse FROM pos p JOIN pos q ON p.scene_id = q.scene_id AND p.obj <> q.obj
) SELECT scene_id, obj1, obj2, dir, {inv('dir')} AS inverse, reverse, {inv('dir')} = reverse AS agree FROM ways""")
def relation_inverse(spark, sf_dir):
    """The inverse against the relation the other way round; only pairs in one cell disagree."""
    own = scenes(spark, sf_dir).select("scene_id", "layout", F.inline(L.all_relations(F.col("layout"))))
    back = L.direction_between(F.col("layout"), F.col("obj2"), F.col("obj1"))
    return own.select("scene_id", "obj1", "obj2", "dir", R.inverse(F.col("dir")).alias("inverse"), back.alias("reverse"), (R.inverse(F.col("dir")) == back).alias("agree"))


_dx, _dy = f"{sx('a.dir')} + {sx('b.dir')}", f"{sy('a.dir')} + {sy('b.dir')}"


@query(f"""WITH {STATED}, e AS (SELECT scene_id, obj2 AS src, obj1 AS dst, dir FROM stated UNION ALL SELECT scene_id, obj1, obj2, {inv("dir")} FROM stated),
two AS (SELECT a.dir AS first, b.dir AS second, {_dx} AS dx, {_dy} AS dy, count(*) AS n FROM e a JOIN e b ON a.scene_id = b.scene_id AND a.dst = b.src AND a.src <> b.dst GROUP BY ALL)
SELECT first, second, CASE WHEN dx = 0 AND dy = 0 THEN NULL ELSE {rel("dx", "dy", "0", "0")} END AS composed, n FROM two""")
def relation_compose_2hop(spark, sf_dir):
    """What two steps compose to, over all pairs of adjoining edges."""
    from gridlogic.functions.graph import edges

    own = held(stated_scenes(spark, sf_dir), g=edges(F.col("stated")))
    two = F.flatten(F.transform("g", lambda a: F.transform(F.filter("g", lambda b: (b["src"] == a["dst"]) & (b["dst"] != a["src"])), lambda b: F.struct(a["dir"].alias("first"), b["dir"].alias("second")))))
    counts = own.select(F.inline(two)).groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("first", "second", R.compose(F.array("first", "second")).alias("composed"), "n")


@query("SELECT l_orderkey AS scene_id, chr((64 + l_linenumber)::INTEGER) AS obj, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_objects(spark, sf_dir):
    """L1: names that occur twice, which a parse rejects."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("l_orderkey").alias("scene_id"), F.char(F.col("l_linenumber") + 64).alias("obj"), "n")


CELLS = SCENES + """, size AS (SELECT scene_id, max(x) AS w, max(y) AS h FROM pos GROUP BY scene_id
), cells AS (
  SELECT s.scene_id, s.w, s.h, gy.y, gx.x, coalesce(min(p.obj), ' ') AS name
  FROM size s, LATERAL (SELECT unnest(range(0, s.h + 1)) AS y) gy, LATERAL (SELECT unnest(range(0, s.w + 1)) AS x) gx
  LEFT JOIN pos p ON p.scene_id = s.scene_id AND p.x = gx.x AND p.y = gy.y GROUP BY ALL
)"""


@query(f"WITH {CELLS}, lines AS (SELECT scene_id, y, rtrim(string_agg(name || '  ', '' ORDER BY x)) AS line FROM cells GROUP BY ALL) SELECT scene_id, string_agg(line, chr(10) ORDER BY y) AS art FROM lines GROUP BY scene_id")
def ascii_render_simple(spark, sf_dir):
    """L5."""
    return scenes(spark, sf_dir).select("scene_id", L.render_simple(F.col("layout")).alias("art"))


@query(f"WITH {CELLS}, lines AS (SELECT scene_id, w, y, '|' || string_agg(name || ' |', '' ORDER BY x) || chr(10) || '+' || repeat('--+', w + 1) AS line FROM cells GROUP BY scene_id, w, y) SELECT scene_id, '+' || repeat('--+', any_value(w) + 1) || chr(10) || string_agg(line, chr(10) ORDER BY y) AS art FROM lines GROUP BY scene_id")
def ascii_render_grid(spark, sf_dir):
    """L6."""
    return scenes(spark, sf_dir).select("scene_id", L.render_grid(F.col("layout")).alias("art"))


@query(f"WITH {CELLS}, lines AS (SELECT scene_id, w, y, '│ ' || string_agg(name || '  ', '' ORDER BY x) || '│' AS line FROM cells GROUP BY scene_id, w, y) SELECT scene_id, '┌' || repeat('─', 3 * (any_value(w) + 1) + 1) || '┐' || chr(10) || string_agg(line, chr(10) ORDER BY y) || chr(10) || '└' || repeat('─', 3 * (any_value(w) + 1) + 1) || '┘' AS art FROM lines GROUP BY scene_id")
def ascii_render_panel(spark, sf_dir):
    """L7."""
    return scenes(spark, sf_dir).select("scene_id", L.render_panel(F.col("layout")).alias("art"))


@query(f"WITH {SCENES} SELECT scene_id, lower(min(obj)) AS obj, x, y FROM pos GROUP BY scene_id, x, y")
def ascii_parse(spark, sf_dir):
    """L1, L2: a rendered grid read back and compacted."""
    read = held(scenes(spark, sf_dir), art=L.render_grid(F.col("layout")), parsed=L.parse_art(F.col("art")))
    return read.select("scene_id", F.inline(L.compact(F.col("parsed"))))


@query(f"WITH {SCENES}, a AS (SELECT scene_id, obj FROM pos WHERE ascii(obj) % 2 = 1), b AS (SELECT scene_id, obj FROM pos WHERE ascii(obj) % 3 = 1), f AS (SELECT scene_id, obj, a.obj IS NOT NULL AS ina, b.obj IS NOT NULL AS inb FROM a FULL JOIN b USING (scene_id, obj)) SELECT scene_id, coalesce(string_agg(obj, ',' ORDER BY obj) FILTER (WHERE ina AND NOT inb), '') AS missing, coalesce(string_agg(obj, ',' ORDER BY obj) FILTER (WHERE inb AND NOT ina), '') AS extra, (count(*) FILTER (WHERE ina AND inb))::BIGINT AS shared FROM f GROUP BY scene_id")
def object_mismatch(spark, sf_dir):
    """Objects of one layout and not the other, both ways."""
    own = scenes(spark, sf_dir).select("scene_id", L.objects(F.col("layout")).alias("names"))
    a = F.filter("names", lambda n: F.ascii(n) % 2 == 1)
    b = F.filter("names", lambda n: F.ascii(n) % 3 == 1)
    join = lambda c: F.array_join(F.array_sort(c), ",")
    out = own.select("scene_id", a.alias("a"), b.alias("b")).where((F.size("a") > 0) | (F.size("b") > 0))
    return out.select("scene_id", join(F.array_except("a", "b")).alias("missing"), join(F.array_except("b", "a")).alias("extra"), F.size(F.array_intersect("a", "b")).cast("long").alias("shared"))


MODEL = SCENES + f""", model AS (
  SELECT scene_id, obj, (dense_rank() OVER (PARTITION BY scene_id ORDER BY x) - 1)::INTEGER AS x, (dense_rank() OVER (PARTITION BY scene_id ORDER BY CASE WHEN obj = 'B' THEN -1 ELSE y END) - 1)::INTEGER AS y FROM raw
), compared AS (
  SELECT a.scene_id, {rel("a.x", "a.y", "b.x", "b.y")} = {rel("c.x", "c.y", "d.x", "d.y")} AS same
  FROM pos a JOIN pos b ON a.scene_id = b.scene_id AND a.obj <> b.obj JOIN model c ON c.scene_id = a.scene_id AND c.obj = a.obj JOIN model d ON d.scene_id = a.scene_id AND d.obj = b.obj
)"""


def model_layout():
    """A model's answer to a scene: B is moved above everything."""
    return L.compact(F.transform("raw", lambda o: F.struct(o["obj"].alias("obj"), o["x"].alias("x"), F.when(o["obj"] == "B", -1).otherwise(o["y"]).alias("y"))))


@query(f"WITH {MODEL}, s AS (SELECT scene_id, count(*) FILTER (WHERE same) AS ok, count(*) AS n FROM compared GROUP BY scene_id) SELECT p.scene_id, coalesce(ok, 0) = coalesce(n, 0) AS correct, coalesce(ok, 0)::BIGINT AS correct_count, coalesce(n, 0)::BIGINT AS total, coalesce(ok * 1.0::DOUBLE / n, 0) AS accuracy FROM (SELECT DISTINCT scene_id FROM pos) p LEFT JOIN s USING (scene_id)")
def grid_compare(spark, sf_dir):
    """E2, J10."""
    own = held(scenes(spark, sf_dir), model=model_layout())
    v = own.select("scene_id", E.compare_layouts(F.col("layout"), F.col("model")).alias("v"))
    return v.select("scene_id", "v.correct", "v.correct_count", "v.total", "v.accuracy")


CHECKED = STATED + f""", model AS (
  SELECT scene_id, obj, (dense_rank() OVER (PARTITION BY scene_id ORDER BY x) - 1)::INTEGER AS x, (dense_rank() OVER (PARTITION BY scene_id ORDER BY CASE WHEN obj = 'B' THEN -1 ELSE y END) - 1)::INTEGER AS y FROM raw WHERE obj <> 'F'
), checked AS (
  SELECT s.scene_id, s.obj1, s.obj2, coalesce(s.dir = {rel("p.x", "p.y", "q.x", "q.y")}, FALSE) AND p.obj IS NOT NULL AND q.obj IS NOT NULL AS ok, p.obj IS NULL OR q.obj IS NULL AS lost
  FROM stated s LEFT JOIN model p ON p.scene_id = s.scene_id AND p.obj = s.obj1 LEFT JOIN model q ON q.scene_id = s.scene_id AND q.obj = s.obj2
), verdict AS (
  SELECT scene_id, count(*) FILTER (WHERE ok) AS ok, count(*) AS n, bool_or(lost) AS lost FROM checked GROUP BY scene_id
), loose AS (
  SELECT m.scene_id, count(*) AS extra FROM model m WHERE NOT EXISTS (SELECT 1 FROM stated s WHERE s.scene_id = m.scene_id AND (s.obj1 = m.obj OR s.obj2 = m.obj)) GROUP BY m.scene_id
)"""


def checked_scenes(spark, sf_dir):
    """Stated relations against a layout in which B is moved and F is missing."""
    model = L.compact(F.filter(F.transform("raw", lambda o: F.struct(o["obj"].alias("obj"), o["x"].alias("x"), F.when(o["obj"] == "B", -1).otherwise(o["y"]).alias("y"))), lambda o: o["obj"] != "F"))
    return held(stated_scenes(spark, sf_dir), model=model)


def _verdicts(spark, sf_dir, mode):
    v = checked_scenes(spark, sf_dir).select("scene_id", E.verify(F.col("stated"), F.col("model"), mode).alias("v"))
    return v.select("scene_id", "v.correct", "v.correct_count", "v.total", "v.accuracy")


_FIELDS = "coalesce(ok, 0)::BIGINT AS correct_count, coalesce(n, 0)::BIGINT AS total, coalesce(ok * 1.0::DOUBLE / n, 0) AS accuracy FROM (SELECT DISTINCT scene_id FROM pos) p LEFT JOIN verdict USING (scene_id)"


@query(f"WITH {CHECKED} SELECT p.scene_id, coalesce(n, 0) > 0 AND ok = n AND NOT lost AND extra IS NULL AS correct, {_FIELDS} LEFT JOIN loose USING (scene_id)")
def verify_relations(spark, sf_dir):
    """The flagship."""
    return _verdicts(spark, sf_dir, "verify_ascii")


@query(f"WITH {CHECKED} SELECT p.scene_id, coalesce(ok = n AND NOT lost, TRUE) AS correct, {_FIELDS}")
def verify_description(spark, sf_dir):
    """Nothing stated is correct."""
    return _verdicts(spark, sf_dir, "verify_description")


@query(f"WITH {STATED} SELECT s.scene_id, bool_and(sign(p.x - q.x) = {sx('dir')} AND sign(p.y - q.y) = {sy('dir')}) AS valid, count(*) FILTER (WHERE sign(p.x - q.x) = {sx('dir')} AND sign(p.y - q.y) = {sy('dir')}) AS matching FROM stated s JOIN pos p ON p.scene_id = s.scene_id AND p.obj = obj1 JOIN pos q ON q.scene_id = s.scene_id AND q.obj = obj2 GROUP BY s.scene_id")
def geometric_validation(spark, sf_dir):
    """Stated relations hold on the layout; objects in one cell fail."""
    hold = F.transform("stated", lambda r: R.offset_matches(r["dir"], L.place(F.col("layout"), r["obj1"])["x"] - L.place(F.col("layout"), r["obj2"])["x"], L.place(F.col("layout"), r["obj1"])["y"] - L.place(F.col("layout"), r["obj2"])["y"]))
    own = stated_scenes(spark, sf_dir).where(F.size("stated") > 0).select("scene_id", hold.alias("h"))
    return own.select("scene_id", F.forall("h", lambda x: x).alias("valid"), F.size(F.filter("h", lambda x: x)).cast("long").alias("matching"))
