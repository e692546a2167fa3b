"""Relation graphs as columns: edges from stated relations, paths, components, inference, uniqueness.

A scene's graph has few nodes, so it stays in its row; all of these are expressions over array<struct<...>> columns and need no shuffle. Edges are
array<struct<src, dst, dir, ord>>: for a stated (obj1, obj2, dir), obj2 leads to obj1 by dir and obj1 to obj2 by its inverse, ord being the
place of the statement, which is also the order in which a search visits neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlogic.functions.algebra import bound, compose, horizontal, inverse, vertical
from gridlogic.functions.text import phrase

#: One entry for each pair: how far, the first shortest path, how many there are (null beyond 38 digits), and by axis the distinct nets of all of them.
PATHS = "array<struct<src:string,node:string,dist:int,dirs:array<string>,ords:array<int>,nodes:array<string>,n:decimal(38,0),vertical:array<string>,horizontal:array<string>>>"
AXES = {"vertical": (vertical, "above", "below", "same level"), "horizontal": (horizontal, "left", "right", "same column")}
#: What a path's steps on an axis come to: none, the one way, the other way, or both ways.
NONE, ONE, OTHER, BOTH = "none", "one", "other", "both"


def edges(stated: Column) -> Column:
    """D3: both directions of each stated relation (array of (obj1, obj2, dir))."""
    both = lambda r, i: F.array(F.struct(r["obj2"].alias("src"), r["obj1"].alias("dst"), r["dir"].alias("dir"), i.alias("ord")), F.struct(r["obj1"].alias("src"), r["obj2"].alias("dst"), inverse(r["dir"]).alias("dir"), i.alias("ord")))
    return F.flatten(F.transform(stated, both))


def nodes(graph: Column) -> Column:
    """G1."""
    return F.array_sort(F.array_distinct(F.transform(graph, lambda e: e["src"])))


def _net(state: Column, part: Column, axis: str) -> Column:
    """A path's net after one more step."""
    _, one, other, _ = AXES[axis]
    return F.when(part == one, F.when(state.isin(NONE, ONE), ONE).otherwise(BOTH)).when(part == other, F.when(state.isin(NONE, OTHER), OTHER).otherwise(BOTH)).otherwise(state)


def paths_from(graph: Column, src: Column, levels: Column) -> Column:
    """G8 from one node: a search by levels, an entry for each node that is reached; the node itself by an empty path.

    Paths are not listed: a node's entry is made of those of the nodes before it. Counts add up, nets are the distinct ones of four after the step, and the first path
    is the first predecessor's with the first edge, in the order in which a search visits neighbours. So a scene costs nodes x edges, however many paths it has.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    start = F.array(F.struct(src.alias("src"), src.alias("node"), F.lit(0).alias("dist"), none("string").alias("dirs"), none("int").alias("ords"), F.array(src).alias("nodes"), F.lit(1).cast("decimal(38,0)").alias("n"), F.array(F.lit(NONE)).alias("vertical"), F.array(F.lit(NONE)).alias("horizontal")))

    def grow(found, level):
        def further(p):
            fresh = F.filter(graph, lambda e: (e["src"] == p["node"]) & ~F.exists(found, lambda q: q["node"] == e["dst"]))
            return F.transform(fresh, lambda e: F.struct(e["dst"].alias("node"), p.alias("p"), e.alias("e")))

        def entry(own):
            first = F.get(own, F.lit(0))
            nets = lambda axis: F.array_distinct(F.flatten(F.transform(own, lambda x: F.transform(x["p"][axis], lambda state: _net(state, AXES[axis][0](x["e"]["dir"]), axis)))))
            count = F.aggregate(own, F.lit(0).cast("decimal(38,0)"), lambda n, x: F.try_add(n, x["p"]["n"]).cast("decimal(38,0)"))
            p, e = first["p"], first["e"]
            return F.struct(
                src.alias("src"), first["node"].alias("node"), level.alias("dist"), F.concat(p["dirs"], F.array(e["dir"])).alias("dirs"), F.concat(p["ords"], F.array(e["ord"])).alias("ords"),
                F.concat(p["nodes"], F.array(first["node"])).alias("nodes"), count.alias("n"), nets("vertical").alias("vertical"), nets("horizontal").alias("horizontal"),
            )

        steps = F.flatten(F.transform(F.filter(found, lambda p: p["dist"] == level - 1), further))
        merged = bound(steps, lambda c: F.transform(F.array_distinct(F.transform(c, lambda x: x["node"])), lambda n: bound(F.filter(c, lambda x: x["node"] == n), entry)))
        return F.concat(found, merged)

    return F.aggregate(levels, start.cast(PATHS), lambda found, level: grow(found, level).cast(PATHS))


def _levels(names: Column) -> Column:
    return F.when(F.size(names) > 1, F.sequence(F.lit(1), F.size(names) - 1)).otherwise(F.array().cast("array<int>"))


def shortest_paths(graph: Column) -> Column:
    """paths_from() each node."""
    return bound(nodes(graph), lambda names: F.flatten(F.transform(names, lambda n: paths_from(graph, n, _levels(names)))))


def shortest_paths_from(graph: Column, src: Column) -> Column:
    """paths_from() one node alone; empty if it has no edge."""
    return bound(nodes(graph), lambda names: F.when(F.array_contains(names, src), paths_from(graph, src, _levels(names))).otherwise(F.array().cast(PATHS)))


def path_between(graph: Column, src: Column, goal: Column) -> Column:
    """(node, dist, dirs, nodes) of the shortest path that a search in the order of statements finds first, without what else paths_from() keeps of each node; the search ends where
    goal is found. Null if there is none; the empty path from a node to itself."""
    kind = "array<struct<node:string,dist:int,dirs:array<string>,nodes:array<string>>>"
    start = F.array(F.struct(src.alias("node"), F.lit(0).alias("dist"), F.array().cast("array<string>").alias("dirs"), F.array(src).alias("nodes"))).cast(kind)
    has = lambda found, n: F.exists(found, lambda q: q["node"] == n)

    def grow(found, level):
        def further(p):
            fresh = F.filter(graph, lambda e: (e["src"] == p["node"]) & ~has(found, e["dst"]))
            return F.transform(fresh, lambda e: F.struct(e["dst"].alias("node"), level.alias("dist"), F.concat(p["dirs"], F.array(e["dir"])).alias("dirs"), F.concat(p["nodes"], F.array(e["dst"])).alias("nodes")))

        steps = F.flatten(F.transform(F.filter(found, lambda p: p["dist"] == level - 1), further))
        first = lambda c: F.transform(F.array_distinct(F.transform(c, lambda x: x["node"])), lambda n: F.get(F.filter(c, lambda x: x["node"] == n), F.lit(0)))
        return F.concat(found, bound(steps, first)).cast(kind)

    found = F.aggregate(_levels(nodes(graph)), start, lambda found, level: F.when(has(found, goal), found).otherwise(grow(found, level)))
    return F.get(F.filter(found, lambda p: p["node"] == goal), F.lit(0))


def first_path(paths: Column, src: Column, node: Column) -> Column:
    """The entry of a pair, with the shortest path that a search in the order of statements finds first; null if there is none."""
    return F.get(F.filter(paths, lambda p: (p["src"] == src) & (p["node"] == node)), F.lit(0))


def inferred(paths: Column, obj1: Column, obj2: Column) -> Column:
    """obj1 as seen from obj2 by composing the first shortest path; null if that cancels or there is none."""
    return compose(first_path(paths, obj2, obj1)["dirs"])


def get_relation(paths: Column, obj1: Column, obj2: Column, query_type: Column) -> Column:
    """The inferred relation or its component; where steps cancel, same level or same column for a component and null for full."""
    full = inferred(paths, obj1, obj2)
    there = first_path(paths, obj2, obj1).isNotNull()
    return F.when(there, F.when(query_type == "full", full).when(query_type == "vertical", vertical(full)).otherwise(horizontal(full)))


def all_inferred(paths: Column) -> Column:
    """Array of (obj1, obj2, dir) for all ordered pairs whose path composes, sorted. Each pair has one entry in paths, so none is looked up."""
    found = F.transform(F.filter(paths, lambda p: p["dist"] > 0), lambda p: F.struct(p["node"].alias("obj1"), p["src"].alias("obj2"), compose(p["dirs"]).alias("dir")))
    return F.array_sort(F.filter(found, lambda r: r["dir"].isNotNull()))


def relations_text(relations: Column) -> Column:
    """G10."""
    said = F.transform(relations, lambda r: F.concat(r["obj1"], F.lit(" is "), phrase(r["dir"]), F.lit(" "), r["obj2"]))
    return F.when(F.size(relations) > 0, F.concat(F.array_join(said, ". "), F.lit("."))).otherwise("")


def components(names: Column, graph: Column) -> Column:
    """Array of (node, root) for the names, root being the least name that a node reaches, itself without an edge. Edges join the classes of their ends one
    after another, so no path is made."""
    alone = F.transform(names, lambda n: F.struct(n.alias("node"), n.alias("root")))
    root = lambda found, n: F.get(F.filter(found, lambda p: p["node"] == n), F.lit(0))["root"]

    def join(found, e):
        # a lambda's variable holds both roots, so that they are looked up once an edge
        both = F.array(F.struct(root(found, e["src"]).alias("a"), root(found, e["dst"]).alias("b")))
        return F.flatten(F.transform(both, lambda r: F.transform(found, lambda p: F.struct(p["node"].alias("node"), F.when(p["root"] == F.greatest(r["a"], r["b"]), F.least(r["a"], r["b"])).otherwise(p["root"]).alias("root")))))

    return F.aggregate(graph, alone, join)


def coverage(parts: Column) -> Column:
    """(n_objects, n_components, inferrable, total, missing, min_needed, coverage) of components()."""
    n = F.size(parts)
    roots = F.array_distinct(F.transform(parts, lambda p: p["root"]))
    sizes = F.transform(roots, lambda r: F.size(F.filter(parts, lambda p: p["root"] == r)))
    inside = F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, k: acc + F.expr("0L") + (k * (k - 1) / 2).cast("long"))
    total = (n * (n - 1) / 2).cast("long")
    return F.struct(
        n.cast("long").alias("n_objects"), F.size(roots).cast("long").alias("n_components"), inside.alias("inferrable"), total.alias("total"), (total - inside).alias("missing"),
        F.greatest(F.size(roots) - 1, F.lit(0)).cast("long").alias("min_needed"), F.when(n < 2, 1.0).otherwise(inside / total).alias("coverage"),
    )


def reaches_without(graph: Column, start: Column, goal: Column, barred: Column, most: Column) -> Column:
    """Whether goal can be reached from start without going through barred."""
    step = lambda seen: F.array_union(seen, F.transform(F.filter(graph, lambda e: F.array_contains(seen, e["src"]) & (e["dst"] != barred)), lambda e: e["dst"]))
    return F.array_contains(F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.array(start), lambda seen, _: step(seen)), goal)


def agreed(paths: Column, src: Column, node: Column, axis: str) -> Column:
    """The component that all shortest paths have; null if one holds both opposites, or they differ, or there is none."""
    _, one, other, neither = AXES[axis]
    nets = first_path(paths, src, node)[axis]
    return bound(nets, lambda found: F.when(F.size(found) == 1, F.when(found[0] == ONE, one).when(found[0] == OTHER, other).when(found[0] == NONE, neither)))


def cuts(graph: Column) -> Column:
    """Array of (barred, parts): for each node the components() of what is left without it."""
    without = lambda b: F.filter(graph, lambda e: (e["src"] != b) & (e["dst"] != b) & (e["src"] < e["dst"]))
    return bound(nodes(graph), lambda names: F.transform(names, lambda b: F.struct(b.alias("barred"), components(F.filter(names, lambda n: n != b), without(b)).alias("parts"))))


def apart(cut: Column, barred: Column, a: Column, b: Column) -> Column:
    """Whether a and b hang together only through barred."""
    parts = F.get(F.filter(cut, lambda c: c["barred"] == barred), F.lit(0))["parts"]
    root = lambda found, n: F.get(F.filter(found, lambda p: p["node"] == n), F.lit(0))["root"]
    return bound(parts, lambda found: ~root(found, a).eqNullSafe(root(found, b)))


def axis_unique(graph: Column, paths: Column, obj1: Column, obj2: Column, axis: str, cut: Column | None = None) -> Column:
    """Whether obj1's component as seen from obj2 follows for any lengths of the stated steps; obj2 alone is the reference of clusters, so the order matters. cut: cuts() of
    the graph, where many pairs are asked for; without it, each pair searches for itself."""
    part = AXES[axis][0]
    names = nodes(graph)
    direct = lambda a, b: F.exists(graph, lambda e: (e["src"] == b) & (e["dst"] == a))

    def judged(component):
        siblings = F.filter(graph, lambda e: (e["src"] == obj2) & (e["dst"] != obj1) & (part(e["dir"]) == component))  # U2
        parted = (lambda e: apart(cut, obj2, obj1, e["dst"])) if cut is not None else (lambda e: ~reaches_without(graph, obj1, e["dst"], obj2, F.size(names)))
        loose = F.exists(siblings, lambda e: ~direct(obj1, e["dst"]) & parted(e))  # U3
        return F.when(component.isNull(), False).otherwise(~loose)

    known = F.exists(graph, lambda e: e["src"] == obj1) & F.exists(graph, lambda e: e["src"] == obj2)
    return F.when(~known, False).when(obj1 == obj2, True).when(direct(obj1, obj2), True).otherwise(bound(agreed(paths, obj2, obj1, axis), judged))


def unique(graph: Column, paths: Column, obj1: Column, obj2: Column, cut: Column | None = None) -> Column:
    """U6."""
    return axis_unique(graph, paths, obj1, obj2, "vertical", cut) & axis_unique(graph, paths, obj1, obj2, "horizontal", cut)


def layout_unique(graph: Column, paths: Column) -> Column:
    """Every pair, the lesser name first, is unique."""
    every = lambda cut: bound(nodes(graph), lambda names: F.forall(names, lambda a: F.forall(F.filter(names, lambda b: b > a), lambda b: unique(graph, paths, a, b, cut))))
    return bound(cuts(graph), every)
