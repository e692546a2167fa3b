"""Queries of relation graphs: components, paths, inference, reasoning, uniqueness."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlogic.functions import graph as G
from gridlogic.functions.algebra import compose, horizontal, vertical
from gridlogic.functions.text import reasoning_chain
from gridlogic.functions.vocab import BASE, SPATIAL
from gridlogic.plans.registry import query
from gridlogic.plans.scenes import PATHS, STATED, by_graph, held, horiz, once_each, quoted, rel, stated_scenes, sx, sy, vert, with_paths

#: Objects of a scene fall apart where a statement of its chain is left out: every fourth place.
PARTS = STATED + """, kept AS (SELECT * FROM stated WHERE (scene_id + ord) % 4 <> 0
), e AS (SELECT scene_id, obj1 AS a, obj2 AS b FROM kept UNION SELECT scene_id, obj2, obj1 FROM kept
), reach AS (SELECT scene_id, obj AS node, obj AS other FROM pos UNION SELECT r.scene_id, r.node, e.b FROM reach r JOIN e ON e.scene_id = r.scene_id AND e.a = r.other
), parts AS (SELECT scene_id, node, min(other) AS root FROM reach GROUP BY scene_id, node
)"""


def parted(spark, sf_dir):
    kept = F.filter("stated", lambda r, i: (F.col("scene_id") + i) % 4 != 0)
    own = held(stated_scenes(spark, sf_dir), graph=G.edges(kept))
    return held(own, parts=G.components(F.transform("layout", lambda o: o["obj"]), F.col("graph")))


@query(f"WITH RECURSIVE {PARTS} SELECT scene_id, node, root FROM parts")
def connected_components(spark, sf_dir):
    """G1-G5."""
    return parted(spark, sf_dir).select("scene_id", F.inline("parts"))


@query(f"""WITH RECURSIVE {PARTS}, sizes AS (SELECT scene_id, root, count(*) AS k FROM parts GROUP BY ALL),
sums AS (SELECT scene_id, sum(k)::BIGINT AS n, count(*) AS c, sum(k * (k - 1) // 2)::BIGINT AS inside FROM sizes GROUP BY scene_id)
SELECT scene_id, n AS n_objects, c AS n_components, inside AS inferrable, n * (n - 1) // 2 AS total, n * (n - 1) // 2 - inside AS missing, c - 1 AS min_needed,
CASE WHEN n < 2 THEN 1.0 ELSE inside * 1.0::DOUBLE / (n * (n - 1) // 2) END::DOUBLE AS coverage FROM sums""")
def coverage(spark, sf_dir):
    """G12."""
    return parted(spark, sf_dir).select("scene_id", G.coverage(F.col("parts")).alias("c")).select("scene_id", "c.*")


@query(f"WITH RECURSIVE {PATHS} SELECT scene_id, src, node, dist, count(*) AS n_paths FROM paths GROUP BY ALL")
def shortest_paths(spark, sf_dir):
    """G8."""
    found = F.transform(F.filter("paths", lambda p: p["dist"] > 0), lambda p: F.struct(p["src"].alias("src"), p["node"].alias("node"), p["dist"].alias("dist"), p["n"].cast("long").alias("n_paths")))
    return by_graph(spark, sf_dir, lambda own: own.select("stated", found.alias("found"))).select("scene_id", F.inline("found"))


_sx = "list_sum(list_transform(dirs, lambda d: " + sx("d") + "))"
_sy = "list_sum(list_transform(dirs, lambda d: " + sy("d") + "))"
INFERRED = PATHS + f""", inferred AS (
  SELECT scene_id, node AS obj1, src AS obj2, CASE WHEN {_sx} = 0 AND {_sy} = 0 THEN NULL ELSE {rel(_sx, _sy, "0", "0")} END AS dir, dirs, nodes FROM first_paths
)"""


@query(f"WITH RECURSIVE {INFERRED} SELECT scene_id, obj1, obj2, dir, {vert('dir')} AS vertical, {horiz('dir')} AS horizontal FROM inferred")
def infer_relation(spark, sf_dir):
    """With the components that a vertical and a horizontal query get."""
    found = each_pair(lambda p: [compose(p["dirs"]).alias("dir")])
    own = by_graph(spark, sf_dir, lambda own: own.select("stated", found.alias("found"))).select("scene_id", F.inline("found"))
    return own.select("scene_id", "obj1", "obj2", "dir", vertical(F.col("dir")).alias("vertical"), horizontal(F.col("dir")).alias("horizontal"))


def each_pair(fields):
    """An array of (obj1, obj2, and fields of the pair's entry) for the ordered pairs of a graph's connected objects, each of which has one entry in paths."""
    return F.transform(F.filter("paths", lambda p: p["dist"] > 0), lambda p: F.struct(p["node"].alias("obj1"), p["src"].alias("obj2"), *fields(p)))


_phrases = "CASE {d} " + " ".join(f"WHEN {quoted(d)} THEN {quoted(SPATIAL[d][0])}" for d in BASE) + " END"
_phrase = lambda d: _phrases.replace("{d}", d)


@query(f"WITH RECURSIVE {INFERRED} SELECT scene_id, string_agg(obj1 || ' is ' || {_phrase('dir')} || ' ' || obj2, '. ' ORDER BY obj1, obj2) || '.' AS text FROM inferred WHERE dir IS NOT NULL GROUP BY scene_id")
def detailed_relations(spark, sf_dir):
    """G9, G10."""
    text = lambda own: held(own, told=G.all_inferred(F.col("paths"))).select("stated", G.relations_text(F.col("told")).alias("text"))
    return by_graph(spark, sf_dir, lambda own: text(own).where("text <> ''"))


def _prefix(n: str) -> str:
    s = lambda f: f"list_sum(list_transform(dirs[1:{n}], lambda d: {f('d')}))"
    return f"CASE WHEN {s(sx)} = 0 AND {s(sy)} = 0 THEN NULL ELSE {rel(s(sx), s(sy), '0', '0')} END"


@query(f"""WITH RECURSIVE {INFERRED}, hops AS (
  SELECT scene_id, obj1, obj2, dirs, nodes, len(dirs) AS n, unnest(range(0, len(dirs))) AS i FROM inferred
), told AS (
  SELECT *, nodes[i + 2] || ' is ' || {_phrase('dirs[i + 1]')} || ' ' || nodes[i + 1] AS fact, {_prefix('i')} AS before, {_prefix('i + 1')} AS now FROM hops
), said AS (
  SELECT *, CASE WHEN i >= 1 AND i < n - 1 AND before IS NOT NULL AND now IS NOT NULL
    THEN fact || '. Since ' || nodes[i + 1] || ' is ' || {_phrase('before')} || ' ' || nodes[1] || ' and ' || fact || ', ' || nodes[i + 2] || ' is ' || {_phrase('now')} || ' ' || nodes[1] ELSE fact END AS part FROM told
) SELECT scene_id, obj1, obj2, string_agg(part, '. ' ORDER BY i) || '.' AS chain FROM said GROUP BY scene_id, obj1, obj2""")
def reasoning_chains(spark, sf_dir):
    """G11."""
    found = each_pair(lambda p: [reasoning_chain(p).alias("chain")])
    return by_graph(spark, sf_dir, lambda own: own.select("stated", found.alias("found"))).select("scene_id", F.inline("found"))


def _net(part, one: str, other: str, neither: str) -> str:
    has = lambda c: f"list_contains(list_transform(dirs, lambda d: {part('d')}), '{c}')"
    return f"CASE WHEN {has(one)} AND {has(other)} THEN 'both' WHEN {has(one)} THEN '{one}' WHEN {has(other)} THEN '{other}' ELSE '{neither}' END"


#: Per ordered pair and axis: what all shortest paths say, and siblings that are neither linked nor reachable around the reference.
UNIQUE = PATHS + f""", around AS (
  SELECT e.scene_id, e.src AS start, x.barred, e.dst AS node FROM edges e JOIN (SELECT DISTINCT scene_id, src AS barred FROM edges) x ON x.scene_id = e.scene_id AND x.barred <> e.src AND x.barred <> e.dst
  UNION
  SELECT a.scene_id, a.start, a.barred, e.dst FROM around a JOIN edges e ON e.scene_id = a.scene_id AND e.src = a.node AND e.dst <> a.barred
), nets AS (
  SELECT scene_id, node AS obj1, src AS obj2, {_net(vert, 'above', 'below', 'same level')} AS v, {_net(horiz, 'left', 'right', 'same column')} AS h FROM paths
), agreed AS (
  SELECT scene_id, obj1, obj2, CASE WHEN count(DISTINCT v) = 1 AND min(v) <> 'both' THEN min(v) END AS v, CASE WHEN count(DISTINCT h) = 1 AND min(h) <> 'both' THEN min(h) END AS h FROM nets GROUP BY ALL
), loose AS (
  SELECT g.scene_id, g.obj1, g.obj2, coalesce(bool_or({vert('s.dir')} = g.v), FALSE) AS lv, coalesce(bool_or({horiz('s.dir')} = g.h), FALSE) AS lh
  FROM agreed g JOIN edges s ON s.scene_id = g.scene_id AND s.src = g.obj2 AND s.dst <> g.obj1
  WHERE NOT EXISTS (SELECT 1 FROM edges d WHERE d.scene_id = g.scene_id AND d.src = g.obj1 AND d.dst = s.dst)
    AND NOT EXISTS (SELECT 1 FROM around a WHERE a.scene_id = g.scene_id AND a.start = g.obj1 AND a.barred = g.obj2 AND a.node = s.dst)
  GROUP BY ALL
), flags AS (
  SELECT g.scene_id, g.obj1, g.obj2, d.src IS NOT NULL OR (g.v IS NOT NULL AND NOT coalesce(l.lv, FALSE)) AS vertical, d.src IS NOT NULL OR (g.h IS NOT NULL AND NOT coalesce(l.lh, FALSE)) AS horizontal
  FROM agreed g LEFT JOIN loose l USING (scene_id, obj1, obj2) LEFT JOIN (SELECT DISTINCT scene_id, src, dst FROM edges) d ON d.scene_id = g.scene_id AND d.src = g.obj2 AND d.dst = g.obj1
)"""


@query(f"WITH RECURSIVE {UNIQUE} SELECT scene_id, obj1, obj2, vertical, horizontal, vertical AND horizontal AS unique_full FROM flags")
def unique_relations(spark, sf_dir):
    """U1-U6."""
    flag = lambda p, axis: G.axis_unique(F.col("graph"), F.array(p), p["node"], p["src"], axis).alias(axis)
    found = each_pair(lambda p: [flag(p, "vertical"), flag(p, "horizontal")])
    own = by_graph(spark, sf_dir, lambda own: own.select("stated", found.alias("found"))).select("scene_id", F.inline("found"))
    return own.withColumn("unique_full", F.col("vertical") & F.col("horizontal"))


@query(f"WITH RECURSIVE {UNIQUE} SELECT scene_id, bool_and(vertical AND horizontal) AS layout_unique FROM flags WHERE obj1 < obj2 GROUP BY scene_id")
def layout_unique(spark, sf_dir):
    """U7."""
    return by_graph(spark, sf_dir, lambda own: own.select("stated", G.layout_unique(F.col("graph"), F.col("paths")).alias("layout_unique")))


def prefixes(sql: str) -> str:
    """SQL of a scene's prefixes as scenes of their own: scene_id * 16 + length."""
    return sql.replace("SELECT scene_id, obj2 AS src, obj1 AS dst, dir, ord FROM stated UNION ALL", "SELECT scene_id, obj2 AS src, obj1 AS dst, dir, ord FROM begun UNION ALL").replace("ord FROM stated\n), walks", "ord FROM begun\n), walks").replace(", edges AS (", ", lengths AS (SELECT scene_id, count(*) AS m FROM stated GROUP BY scene_id), begun AS (SELECT s.scene_id * 16 + k AS scene_id, s.obj1, s.obj2, s.dir, s.ord FROM stated s JOIN lengths USING (scene_id), LATERAL (SELECT unnest(range(1, m + 1)) AS k) WHERE s.ord < k), edges AS (", 1)


@query(f"WITH RECURSIVE {prefixes(UNIQUE)}, each AS (SELECT scene_id // 16 AS scene_id, scene_id % 16 AS k, bool_and(vertical AND horizontal) AS u FROM flags WHERE obj1 < obj2 GROUP BY 1, 2) SELECT scene_id, count(*) FILTER (WHERE NOT u) AS ambiguous_stages FROM each GROUP BY scene_id")
def ambiguous_stages(spark, sf_dir):
    """U8: how many prefixes of the statements leave the layout open."""
    def stages(own):
        begun = own.select(F.col("stated").alias("whole"), F.explode(F.transform(F.sequence(F.lit(1), F.size("stated")), lambda k: F.slice("stated", F.lit(1), k))).alias("stated"))
        flagged = once_each(begun, "stated", lambda some: with_paths(some).select("stated", G.layout_unique(F.col("graph"), F.col("paths")).alias("u")))
        return flagged.groupBy(F.col("whole").alias("stated")).agg(F.count_if(~F.col("u")).alias("ambiguous_stages"))

    rows = stated_scenes(spark, sf_dir).where(F.size("stated") > 0).select("scene_id", "stated")
    return once_each(rows, "stated", stages).drop("stated")
