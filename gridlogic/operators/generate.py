"""Generated layouts: random structures placed step by step, then described, queried and rendered by column functions, and chosen by quotas.

Placing is sequential within a layout, so it runs in Python, per id and seed, over Arrow batches; everything after it does not. Balance comes from quotas
over a pool of candidates instead of a feedback loop, so candidates are made in parallel.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.functions import graph as G
from gridlogic.functions import layout as L
from gridlogic.functions import text as X
from gridlogic.functions.algebra import component
from gridlogic.functions.vocab import BASE, INVERSE, POOLS, STEP
from gridlogic.operators.hold import held
from gridlogic.operators.sampling import even_selection
from gridlogic.session import scratch

#: Shares of layouts by number of components.
SHARES = {2: 0.025, 3: 0.075} | dict.fromkeys(range(4, 9), 0.18)
#: Cells that a name is pushed on at most when its place is taken; candidates made for each row wanted at first, and at most.
MOST_PUSHES, POOL, MOST_POOL = 100, 8, 1 << 16
TERMINOLOGIES = ("spatial", "cardinal", "clock", "spatial+cardinal", "spatial+clock", "cardinal+clock", "spatial+cardinal+clock")
QUERY_TYPES = ("full", "vertical", "horizontal")


def place(stated: list[tuple[str, str, str]]) -> dict[str, tuple[int, int]]:
    """L4: positions by a search from the node with most edges (the least name of equals), component after component; a taken cell is stepped
    over in the same direction. Dense columns and rows (L2)."""
    near: dict[str, list[tuple[str, str]]] = {}
    for obj1, obj2, d in stated:
        near.setdefault(obj2, []).append((obj1, d))
        near.setdefault(obj1, []).append((obj2, INVERSE.get(d, d)))
    at: dict[str, tuple[int, int]] = {}
    shift = 0
    while len(at) < len(near):
        start = min((n for n in near if n not in at), key=lambda n: (-len(near[n]), n))
        at[start] = (shift, 0)
        queue, taken = deque([start]), set(at.values())
        while queue:
            current = queue.popleft()
            for other, d in near[current]:
                if other in at:
                    continue
                dx, dy = STEP.get(d, (0, 0))
                x, y = at[current][0] + dx, at[current][1] + dy
                for _ in range(MOST_PUSHES):
                    if (x, y) not in taken:
                        break
                    x, y = x + dx, y + dy
                at[other] = (x, y)
                taken.add((x, y))
                queue.append(other)
        shift = max(x for x, _ in at.values()) + 2
    columns = {x: i for i, x in enumerate(sorted({x for x, _ in at.values()}))}
    rows = {y: i for i, y in enumerate(sorted({y for _, y in at.values()}))}
    return {n: (columns[x], rows[y]) for n, (x, y) in at.items()}


def holds(stated: list[tuple[str, str, str]], at: dict[str, tuple[int, int]]) -> bool:
    """Every stated relation points the right way."""
    sign = lambda n: (n > 0) - (n < 0)
    return all((sign(at[a][0] - at[b][0]), sign(at[a][1] - at[b][1])) == STEP[d] for a, b, d in stated)


def add_relation(stated: list[tuple[str, str, str]], obj1: str, obj2: str, direction: str) -> bool:
    """Append a relation if it is between two objects that none is stated for, and all still hold; ValueError for a wrong one."""
    if obj1 == obj2:
        raise ValueError("an object has no relation to itself")
    if direction not in STEP:
        raise ValueError(f"unknown direction: {direction}")
    if any({obj1, obj2} == {a, b} for a, b, _ in stated):
        return False
    stated.append((obj1, obj2, direction))
    if holds(stated, place(stated)):
        return True
    stated.pop()
    return False


def structure(rng: random.Random, n: int, relations: int) -> list[tuple[str, str, str]]:
    """Each object joins one that is there, then relations are added until there are enough or ten tries for each have failed."""
    names = [chr(65 + i) for i in range(n)]
    rng.shuffle(names)
    stated: list[tuple[str, str, str]] = []
    for i in range(1, n):
        for _ in range(30):
            if add_relation(stated, names[i], rng.choice(names[:i]), rng.choice(BASE)):
                break
        else:
            return []
    for _ in range(10 * max(0, relations - len(stated))):
        if len(stated) >= relations:
            break
        a, b = rng.sample(names, 2)
        add_relation(stated, a, b, rng.choice(BASE))
    return stated


STRUCTURES = "id long, num_components int, stated array<struct<obj1:string,obj2:string,dir:string>>, layout array<struct<obj:string,x:int,y:int>>"


def _structures(seed: int):
    relation = pa.list_(pa.struct([("obj1", pa.string()), ("obj2", pa.string()), ("dir", pa.string())]))
    cells = pa.list_(pa.struct([("obj", pa.string()), ("x", pa.int32()), ("y", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, all_stated, layouts = [], [], [], []
            for i in batch.column(0).to_pylist():
                rng = random.Random(f"{seed}:{i}")
                n = rng.choices(list(SHARES), weights=list(SHARES.values()))[0]
                most = n * (n - 1) // 2
                low, high = (0.7, 0.9) if rng.random() < 0.5 else (0.3, 0.5)  # N6: dense layouts tend to be unique
                stated = structure(rng, n, max(n - 1, round(most * rng.uniform(low, high))))
                if not stated:
                    continue  # P17
                at = place(stated)
                ids.append(i)
                sizes.append(n)
                all_stated.append([{"obj1": a, "obj2": b, "dir": d} for a, b, d in stated])
                layouts.append([{"obj": k, "x": x, "y": y} for k, (x, y) in sorted(at.items())])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(all_stated, relation), pa.array(layouts, cells)], names=["id", "num_components", "stated", "layout"])

    return run


def structures(ids: DataFrame, seed: int = 42) -> DataFrame:
    """(id, num_components, stated, layout) of ids (id long), each a seed, less those that found no structure."""
    return ids.select("id").mapInArrow(_structures(seed), STRUCTURES)


def pick(salt: str, n: Column, seed: int) -> Column:
    """A number under n, by the id's hash."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), n).cast("int")


def pair_options(rows: DataFrame) -> DataFrame:
    """Rows (with layout, graph, paths) and options: array of (obj1, obj2, types) of the pairs, the lesser name first, that have a unique full, vertical or
    horizontal relation."""
    names = F.transform("layout", lambda o: o["obj"])
    pairs = F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: b > a), lambda b: F.struct(a.alias("obj1"), b.alias("obj2")))))
    one = lambda p, axis: G.axis_unique(F.col("graph"), F.col("paths"), p["obj1"], p["obj2"], axis, F.col("__cut"))
    own = held(rows, __pairs=pairs, __cut=G.cuts(F.col("graph")))
    own = held(own, __judged=F.transform("__pairs", lambda p: F.struct(p["obj1"].alias("obj1"), p["obj2"].alias("obj2"), one(p, "vertical").alias("v"), one(p, "horizontal").alias("h"))))
    types = lambda p: F.array_compact(F.array(F.when(p["v"] & p["h"], "full"), F.when(p["v"], "vertical"), F.when(p["h"], "horizontal")))
    return held(own, options=F.filter(F.transform("__judged", lambda p: F.struct(p["obj1"].alias("obj1"), p["obj2"].alias("obj2"), types(p).alias("types"))), lambda p: F.size(p["types"]) > 0)).drop("__pairs", "__judged", "__cut")


def questions(structures_: DataFrame, seed: int = 42) -> DataFrame:
    """Structures with graph, paths and a question (obj1, obj2, query_type) that the stated relations determine: one of pair_options() by hash, of the type that the id's
    hash asks for if a pair has it. Structures without such a pair are left out."""
    own = pair_options(held(structures_, graph=G.edges(F.col("stated")), paths=G.shortest_paths(F.col("graph"))))
    own = held(own.where(F.size("options") > 0), wanted=F.element_at(F.array(*map(F.lit, QUERY_TYPES)), pick("type", F.lit(len(QUERY_TYPES)), seed) + 1))
    fitting = F.filter("options", lambda p: F.array_contains(p["types"], F.col("wanted")))
    own = held(own, fitting=F.when(F.size(fitting) > 0, fitting).otherwise(F.col("options")))
    own = held(own, question=F.get("fitting", pick("pair", F.size("fitting"), seed)))
    kinds = F.col("question.types")
    return own.select(*structures_.columns, "graph", "paths", "question.obj1", "question.obj2", F.when(F.array_contains(kinds, F.col("wanted")), F.col("wanted")).otherwise(F.get(kinds, pick("other", F.size(kinds), seed))).alias("query_type"))


def flagged(structures_: DataFrame, seed: int = 42) -> DataFrame:
    """questions() with label, is_directly_stated (J19) and has_unique_layout, by which rows are balanced; without graph and paths, which are wide."""
    own = questions(structures_, seed)
    own = held(own, label=G.get_relation(F.col("paths"), F.col("obj1"), F.col("obj2"), F.col("query_type")))
    direct = F.exists("graph", lambda e: (e["src"] == F.col("obj2")) & (e["dst"] == F.col("obj1")) & (component(e["dir"], F.col("query_type")) == F.col("label")))
    return held(own, is_directly_stated=direct, has_unique_layout=G.layout_unique(F.col("graph"), F.col("paths"))).drop("graph", "paths")


def describe(stated: Column, mode: Column, seed: Column) -> Column:
    """Sentences whose phrases come from the pools that a mode joins by +; each is used once before one is used again."""
    parts = F.split(mode, r"\+")

    def said(r, i):
        own, words = F.get(parts, F.pmod(seed + F.when(i < F.size(parts), i).otherwise(F.xxhash64(seed, i)), F.size(parts)).cast("int")), F
        for name, pool in POOLS.items():
            words = words.when(own == name, X.pick_phrase(r["dir"], pool, seed + i))
        return F.concat(r["obj1"], F.lit(" is "), words, F.lit(" "), r["obj2"])

    return F.concat(F.array_join(F.transform(stated, said), ". "), F.lit("."))


def modes(number: Column) -> Column:
    """A number's terminology, of those that the stated relations are enough for."""
    n = F.size("stated")
    return F.element_at(F.array(*map(F.lit, TERMINOLOGIES)), (F.pmod(number, F.when(n == 1, 3).when(n == 2, 6).otherwise(len(TERMINOLOGIES))) + 1).cast("int"))


def instances(structures_: DataFrame, seed: int = 42) -> DataFrame:
    """Dataset rows of structures, or of flagged() ones: description, question, label, flags, renderings and reasoning. A description's words are of
    the mode in the column terminology, if there is one, else of one by hash."""
    own = structures_ if "label" in structures_.columns else flagged(structures_, seed)
    own = own if "terminology" in own.columns else own.withColumn("terminology", modes(pick("words", F.lit(1 << 20), seed)))
    own = held(own, graph=G.edges(F.col("stated")), paths=G.shortest_paths(F.col("graph")))
    own = held(own, path=G.first_path(F.col("paths"), F.col("obj2"), F.col("obj1")), description=describe(F.col("stated"), F.col("terminology"), pick("phrase", F.lit(1 << 20), seed)))
    stages = F.size(F.filter("unique_at", lambda u: ~u))
    begun = F.transform(F.sequence(F.lit(1), F.size("stated")), lambda k: G.edges(F.slice("stated", F.lit(1), k)))
    own = held(own, begun=begun)
    own = held(own, unique_at=F.transform("begun", lambda g: G.layout_unique(g, G.shortest_paths(g))))
    return own.select(
        F.concat(F.lit("id-"), F.col("id").cast("string")).alias("id"), "description", X.query_text(F.col("obj1"), F.col("obj2"), F.col("query_type")).alias("query_relation"), "query_type", "label",
        X.reasoning_chain(F.col("path")).alias("reasoning_steps"), G.relations_text(G.all_inferred(F.col("paths"))).alias("detailed_relations"),
        F.struct(*(L.render(F.col("layout"), v).alias(v) for v in ("simple", "grid", "panel"))).alias("ascii"), X.terminology(F.col("description")).alias("terminology_used"),
        "num_components", F.size("stated").alias("num_relations"), "is_directly_stated", "has_unique_layout", stages.alias("ambiguous_stages"),
    )


def quotas(n: int) -> dict[int, int]:
    """Rows wanted of each number of components; what rounding leaves goes to the largest shares."""
    out = {k: int(n * s) for k, s in SHARES.items()}
    for k in sorted(SHARES, key=lambda k: (-SHARES[k], k))[: n - sum(out.values())]:
        out[k] += 1
    return out


def dealt(rows: DataFrame, n: int, each: int = 1000) -> DataFrame:
    """n rows over as many tasks as they ask for, and as many as the cluster runs at least: they are short, but each takes long, and without a number few tasks would be made of few bytes."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // each)), "id")


def balanced_dataset(ids: DataFrame, seed: int = 42) -> DataFrame:
    """As many rows as there are ids (id long, each once), in the shares of SHARES, from POOL candidates for each id, or twice as many as long as a share is not full. Candidates
    get their questions first, so none is lost later. Of each number of components, the query types, direct or not and unique layout or not take turns, so that they are even as far
    as candidates go; the terminologies take turns in what is chosen. Numbers of relations follow from the densities (N6) and have no quota."""
    spark, n, pool = ids.sparkSession, ids.count(), POOL
    while True:
        several = ids.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(pool - 1)), lambda k: F.col("id") * MOST_POOL + k)).alias("id"))
        own = flagged(structures(dealt(several, n * pool), seed), seed)
        even_selection(own, "num_components", quotas(n), ["query_type", "is_directly_stated", "has_unique_layout"], "id", seed).write.parquet(path := scratch(spark, "chosen"))
        chosen = spark.read.parquet(path)
        if chosen.count() == n:
            return instances(dealt(chosen, n, 100).withColumn("terminology", modes(F.col("__k") + F.col("num_components"))).drop("__k"), seed)
        if (pool := 2 * pool) > MOST_POOL:
            raise ValueError(f"{MOST_POOL} candidates an id do not fill the shares")
