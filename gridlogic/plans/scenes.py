"""Scenes made from orders: an order's lines are its objects, placed by quantity and discount; and the same in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.functions import graph as G
from gridlogic.functions import layout as L
from gridlogic.functions.algebra import relation
from gridlogic.functions.vocab import BASE, POOLS
from gridlogic.operators.hold import held, once_each
from gridlogic.session import table


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, raw, layout): of lines with one number the first by its other columns. One shuffle, by scene."""
    cells = ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cells).repartition("l_orderkey")
    first = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*cells)).alias("c"))
    obj = F.struct(F.char(F.col("l_linenumber") + 64).alias("obj"), F.col("c.l_quantity").cast("int").alias("x"), F.round(F.col("c.l_discount") * 100).cast("int").alias("y"))
    grouped = first.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(obj)).alias("raw"))
    return held(grouped.select(F.col("l_orderkey").alias("scene_id"), "raw"), layout=L.compact(F.col("raw")))


def stated(layout, scene_id):
    """Neighbours in the order of names, and in every third scene of three or more the last with the first: array of (obj1, obj2, dir)."""
    n = F.size(layout)
    said = lambda p, q: F.struct(p["obj"].alias("obj1"), q["obj"].alias("obj2"), relation(p, q).alias("dir"))
    at = lambda i: F.get(layout, i)
    chain = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: said(at(i + 1), at(i))))
    ring = F.when((n > 2) & (scene_id % 3 == 0), F.array(said(at(n - 1), at(F.lit(0)))))
    empty = F.array().cast("array<struct<obj1:string,obj2:string,dir:string>>")
    return F.concat(F.coalesce(chain, empty), F.coalesce(ring, empty))


def stated_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(scenes(spark, sf_dir), stated=stated(F.col("layout"), F.col("scene_id")))


def by_graph(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """(scene_id, and what make makes) of scenes that state something. make takes (stated, graph, paths), a row for each distinct list of statements, and keeps stated: scenes
    have few objects, so most state what others do, and whatever follows from the statements is made once for all of them."""
    rows = stated_scenes(spark, sf_dir).where(F.size("stated") > 0).select("scene_id", "stated")
    return once_each(rows, "stated", lambda own: make(with_paths(own))).drop("stated")


def with_paths(rows: DataFrame) -> DataFrame:
    """rows (with stated) with graph and paths."""
    return held(rows, graph=G.edges(F.col("stated")), paths=G.shortest_paths(F.col("graph")))


def rel(ax: str, ay: str, bx: str, by: str) -> str:
    """SQL: where a is as seen from b."""
    return f"CASE WHEN {ax} = {bx} THEN CASE WHEN {ay} > {by} THEN 'below' ELSE 'above' END WHEN {ay} = {by} THEN CASE WHEN {ax} > {bx} THEN 'right' ELSE 'left' END ELSE (CASE WHEN {ay} > {by} THEN 'lower' ELSE 'upper' END) || (CASE WHEN {ax} > {bx} THEN '-right' ELSE '-left' END) END"


def vert(d: str) -> str:
    return f"CASE WHEN {d} IN ('above', 'upper-left', 'upper-right') THEN 'above' WHEN {d} IN ('below', 'lower-left', 'lower-right') THEN 'below' ELSE 'same level' END"


def horiz(d: str) -> str:
    return f"CASE WHEN {d} IN ('left', 'upper-left', 'lower-left') THEN 'left' WHEN {d} IN ('right', 'upper-right', 'lower-right') THEN 'right' ELSE 'same column' END"


def inv(d: str) -> str:
    return f"CASE {d} WHEN 'above' THEN 'below' WHEN 'below' THEN 'above' WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' WHEN 'upper-left' THEN 'lower-right' WHEN 'upper-right' THEN 'lower-left' WHEN 'lower-left' THEN 'upper-right' WHEN 'lower-right' THEN 'upper-left' ELSE {d} END"


def sx(d: str) -> str:
    return f"(CASE WHEN {d} LIKE '%right' THEN 1 WHEN {d} LIKE '%left' THEN -1 ELSE 0 END)"


def sy(d: str) -> str:
    return f"(CASE WHEN {d} = 'below' OR {d} LIKE 'lower%' THEN 1 WHEN {d} = 'above' OR {d} LIKE 'upper%' THEN -1 ELSE 0 END)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pool_rows(name: str) -> str:
    """SQL: (dir, i, n, phrase) of a pool."""
    rows = ", ".join(f"({quoted(d)}, {i}, {len(POOLS[name][d])}, {quoted(p)})" for d in BASE for i, p in enumerate(POOLS[name][d]))
    return f"(VALUES {rows}) AS pool(dir, i, n, phrase)"


SCENES = """
raw AS (
  SELECT l_orderkey AS scene_id, chr((64 + l_linenumber)::INTEGER) AS obj, CAST(l_quantity AS INTEGER) AS x, CAST(round(l_discount * 100) AS INTEGER) AS y
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount, l_extendedprice) AS k FROM lineitem) WHERE k = 1
), pos AS (
  SELECT scene_id, obj, (dense_rank() OVER (PARTITION BY scene_id ORDER BY x) - 1)::INTEGER AS x, (dense_rank() OVER (PARTITION BY scene_id ORDER BY y) - 1)::INTEGER AS y FROM raw
)"""
STATED = SCENES + f""", near AS (
  SELECT scene_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY scene_id) AS n, obj AS o2, x AS x2, y AS y2, lead(obj) OVER w AS o1, lead(x) OVER w AS x1, lead(y) OVER w AS y1,
         first_value(obj) OVER w AS of, first_value(x) OVER w AS xf, first_value(y) OVER w AS yf
  FROM pos WINDOW w AS (PARTITION BY scene_id ORDER BY obj)
), stated AS (
  SELECT scene_id, k - 1 AS ord, o1 AS obj1, o2 AS obj2, {rel("x1", "y1", "x2", "y2")} AS dir FROM near WHERE o1 IS NOT NULL
  UNION ALL
  SELECT scene_id, n - 1, o2, of, {rel("x2", "y2", "xf", "yf")} FROM near WHERE k = n AND n > 2 AND scene_id % 3 = 0
)"""
#: Simple paths by growing them; a path is kept if none with the same ends is shorter.
PATHS = STATED + f""", edges AS (
  SELECT scene_id, obj2 AS src, obj1 AS dst, dir, ord FROM stated UNION ALL SELECT scene_id, obj1, obj2, {inv("dir")}, ord FROM stated
), walks AS (
  SELECT scene_id, src, dst AS node, 1 AS dist, [dir] AS dirs, [ord] AS ords, [src, dst] AS nodes FROM edges
  UNION ALL
  SELECT w.scene_id, w.src, e.dst, w.dist + 1, list_append(w.dirs, e.dir), list_append(w.ords, e.ord), list_append(w.nodes, e.dst)
  FROM walks w JOIN edges e ON e.scene_id = w.scene_id AND e.src = w.node WHERE NOT list_contains(w.nodes, e.dst)
), paths AS (
  SELECT * FROM (SELECT *, min(dist) OVER (PARTITION BY scene_id, src, node) AS least FROM walks) WHERE dist = least
), first_paths AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, src, node ORDER BY ords) AS k FROM paths) WHERE k = 1
)"""
