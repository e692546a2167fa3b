"""Column functions against worked examples and plain Python."""

import itertools
import random

from pyspark.sql import functions as F

from gridlogic.functions import algebra as R
from gridlogic.functions import graph as G
from gridlogic.functions import layout as L
from gridlogic.functions import score as E
from gridlogic.functions import text as X
from gridlogic.functions.vocab import BASE, GENERATED, INVERSE, PHRASES, STEP, aliases_for
from gridlogic.operators.generate import holds, place
from gridlogic.operators.hold import held

STATED = "k int, stated array<struct<obj1:string,obj2:string,dir:string>>"


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression.alias("v")).first()["v"]


def many(spark, build, *columns, schema):
    rows = [(i, *r) for i, r in enumerate(columns[0])]
    return [r.v for r in spark.createDataFrame(rows, "i int, " + schema).orderBy("i").select(build.alias("v")).collect()]


def test_vocabulary():
    assert len(PHRASES) == 314 and len(GENERATED) == 173
    assert all(INVERSE[INVERSE[d]] == d and STEP[d] == tuple(-s for s in STEP[INVERSE[d]]) for d in BASE)
    assert list(aliases_for("vertical")) == ["above", "below", "same level"] and "same position" in aliases_for("full")


def test_relation_is_inverse_of_its_reverse(spark):
    offsets = [(x, y) for x in (-2, 0, 3) for y in (-1, 0, 2)]
    got = many(spark, F.struct(R.of_offset(F.col("x"), F.col("y")).alias("a"), R.inverse(R.of_offset(-F.col("x"), -F.col("y"))).alias("b")), offsets, schema="x int, y int")
    for (x, y), r in zip(offsets, got, strict=True):
        assert (r.a == r.b) == ((x, y) != (0, 0)), (x, y)
        if (x, y) != (0, 0):
            assert STEP[r.a] == ((x > 0) - (x < 0), (y > 0) - (y < 0))


def test_composition(spark):
    cases = [(["above", "right"], "upper-right"), (["above", "below"], None), (["upper-left", "right"], "above"), (["upper-left", "right", "right"], "upper-right"), (["upper-right", "lower-right"], "right"), ([], None), (["nowhere"], None), ([None], None)]
    assert many(spark, R.compose(F.col("d")), [(c,) for c, _ in cases], schema="d array<string>") == [w for _, w in cases]


def test_answers(spark):
    cases = {
        "Below.": "below", "The answer is upper left!": "upper-left", "north-east": "upper-right", "It is at 11 o'clock from B": "upper-left", "A is above and to the right of B": "upper-right",
        "directly over": "above", "same row": "same level", "horizontally aligned with B": "same level", "left and above": "above", "to the right of and above B": "right", "I do not know": "i do not know", "": "",
    }
    assert many(spark, X.resolve_label(F.col("t")), [(t,) for t in cases], schema="t string") == list(cases.values())


def test_descriptions(spark):
    cases = [
        ("A is above and to the left of B.", [("a", "b", "left")], [("a", "b", "upper-left")]), ("A is to the left of and above B.", [("a", "of", "left"), ("a", "b", "above")], [("a", "b", "upper-left")]),
        ("A is at 1:30 from B.", [("a", "b", "upper-right")], [("a", "b", "upper-right")]), ("B is below A, C is left of A.", [("b", "a", "below"), ("c", "a", "left")], []),
        ("A is north and to the west of B.", [("a", "b", "left")], []), ("A is on top of B.", [("a", "b", "above")], [("a", "b", "above")]),
        ("B is to the left and to the below of C.", [], [("b", "c", "lower-left")]), ("A is left of B and above C.", [("a", "b", "left"), ("a", "c", "above")], []), ("", [], []), ("nothing to read", [], []),
    ]
    got = many(spark, F.struct(X.parse_description(F.col("t")).alias("a"), X.parse_whole(F.col("t")).alias("b")), [(t,) for t, *_ in cases], schema="t string")
    for (t, legacy, whole), r in zip(cases, got, strict=True):
        assert [tuple(x) for x in r.a] == legacy, t
        assert [(x.obj1.lower(), x.obj2.lower(), x.dir) for x in r.b] == whole, t


def test_questions(spark):
    cases = [("Where is A relative to B?", ("a", "b", "full")), ("where is C vertically relative to D? now", ("c", "d", "vertical")), ("Where is E horizontally relative to F?", ("e", "f", "horizontal")), ("This is not a valid query", None)]
    got = many(spark, X.parse_query(F.col("t")), [(t,) for t, _ in cases], schema="t string")
    assert [r and tuple(r) for r in got] == [w for _, w in cases]


def test_outputs(spark):
    cases = [('{"answer": "left", "n": 1}', "left"), ('{"n": 1}', ""), ("not json", None), ("[1]", None), (None, None)]
    assert many(spark, X.json_field(F.col("t"), "answer"), [(t,) for t, _ in cases], schema="t string") == [w for _, w in cases]


def test_descriptions_against_a_grid(spark):
    model = L.compact(L.parse_art(F.lit("A\nB   C")))
    cases = [("A is above B. B is left of C. A is upper-left of C.", True, 3, 1.0), ("A is above B. B is left of C.", True, 2, 1.0), ("A is above B.", True, 1, 1.0), ("", True, 0, 0.0), ("A is below B.", False, 1, 0.0), ("Z is above A.", False, 1, 0.0)]
    got = many(spark, E.verify(X.parse_description(F.col("t")), model, "verify_description"), [(t,) for t, *_ in cases], schema="t string")
    assert [(r.correct, r.total, r.accuracy) for r in got] == [c[1:] for c in cases]
    strict = many(spark, E.verify(X.parse_description(F.col("t")), model, "verify_description", strict=True)["correct"], [("",)], schema="t string")
    assert strict == [False]


def test_bad_grids_are_not_correct(spark):
    said = X.parse_description(F.lit("A is above B. B is left of C."))
    for art, want in (("A\nB   C", True), ("", False), ("A   B\n\nA   C", False), ("A   B", False), ("A\nB   C\nZ   Y   X", False), ("C   B\nA", False), ("+--+--+\n|A |  |\n+--+--+\n|B |C |\n+--+--+", True)):
        assert one(spark, E.verify(said, L.compact(L.parse_art(F.lit(art))))["correct"]) is want, art
    assert one(spark, L.duplicates(L.parse_art(F.lit("A b\nB  a")))) == ["a", "b"]


def test_rendering_and_reading_are_inverse(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        cells = rng.sample(list(itertools.product(range(6), range(5))), rng.randrange(1, 9))
        rows.append((i, [(n, x, y) for n, (x, y) in zip("ABCDéFGH", cells, strict=False)]))
    df = held(spark.createDataFrame(rows, f"i int, raw {L.LAYOUT}"), layout=L.compact(F.col("raw")))
    for style in ("simple", "grid", "panel"):
        read = held(df, art=L.render(F.col("layout"), style), back=L.compact(L.parse_art(F.col("art"))))
        low = F.array_sort(F.transform("layout", lambda o: F.struct(F.lower(o["obj"]).alias("obj"), o["x"].alias("x"), o["y"].alias("y"))))
        assert read.where(~(low == F.array_sort("back"))).count() == 0, style
    v = df.select(E.compare_layouts(F.col("layout"), F.col("layout")).alias("v"), F.size("layout").alias("n")).collect()
    assert all(r.v.correct and r.v.accuracy == (1.0 if r.n > 1 else 0.0) for r in v)


def test_rendered_text(spark):
    layout = F.array(*(F.struct(F.lit(o).alias("obj"), F.lit(x).alias("x"), F.lit(y).alias("y")) for o, x, y in (("A", 0, 0), ("B", 1, 1), ("D", 2, 1), ("C", 1, 2))))
    assert one(spark, L.render_simple(layout)) == "A\n   B  D\n   C"
    assert one(spark, L.render_grid(layout)) == "+--+--+--+\n|A |  |  |\n+--+--+--+\n|  |B |D |\n+--+--+--+\n|  |C |  |\n+--+--+--+"
    assert one(spark, L.render_panel(layout)) == "┌──────────┐\n│ A        │\n│    B  D  │\n│    C     │\n└──────────┘"
    assert one(spark, L.render(F.array().cast(L.LAYOUT))) == "No objects to display"


def graphs(spark, cases):
    return held(spark.createDataFrame(list(enumerate(cases)), STATED), graph=G.edges(F.col("stated")), paths=G.shortest_paths(F.col("graph")))


# Stated relations, whether the layout is unique, and pairs with whether they are.
UNIQUENESS = [
    ("C left B, B left A", True, {"CA": True}), ("B upper-right A, C upper-right B", True, {"CA": True}), ("B lower-left C, A upper-right B", False, {"AC": False}),
    ("B left A, C above A, D above B", False, {"BC": True, "DA": False, "DC": False}), ("B left A, C left A", False, {"BC": False}), ("B left A, C left A, C left B", True, {"CB": True}),
    ("B upper-right A, C lower-left A, C lower-left B", True, {"CB": True}), ("B left A, C upper-right B", False, {"CA": False}), ("B left A, C left B, D left C", False, {"CA": True, "DA": True, "DB": False}),
    ("B left A, C above B, D above A, E left D", False, {"CA": False, "EA": False, "EB": False}), ("B upper-right A", True, {"BA": True}), ("A upper-right B, A upper-right C", False, {"BC": False}),
    ("B upper-right A, C above A", False, {"BC": False}), ("B left A, C right A, D above A", True, {"BC": True, "BD": True, "CD": True}),
]


def parsed(text):
    return [(a, b, d) for a, d, b in (x.split(" ") for x in text.split(", "))]


def test_uniqueness_table(spark):
    got = graphs(spark, [parsed(t) for t, *_ in UNIQUENESS]).select("k", "graph", "paths", G.layout_unique(F.col("graph"), F.col("paths")).alias("u"))
    assert [r.u for r in got.orderBy("k").collect()] == [u for _, u, _ in UNIQUENESS]
    asked = [(k, p[0], p[1], w) for k, (_, _, pairs) in enumerate(UNIQUENESS) for p, w in pairs.items()]
    pairs = spark.createDataFrame(asked, "k int, a string, b string, want boolean").join(got, "k")
    assert pairs.where(G.unique(F.col("graph"), F.col("paths"), F.col("a"), F.col("b")) != F.col("want")).count() == 0


def slow_paths(stated, src, node):
    near = {}
    for a, b, d in stated:
        near.setdefault(b, []).append((a, d))
        near.setdefault(a, []).append((b, INVERSE[d]))
    level, seen = [([], [src])], {src}
    while level:
        if found := [p for p in level if p[1][-1] == node]:
            return found
        level = [(ds + [d], ns + [o]) for ds, ns in level for o, d in near.get(ns[-1], []) if o not in seen]
        seen |= {ns[-1] for _, ns in level}
    return []


def test_paths_on_random_graphs(spark):
    rng, cases = random.Random(8), []
    for _ in range(60):
        names = "ABCDEFG"[: rng.randrange(2, 8)]
        pairs = [p for p in itertools.combinations(names, 2) if rng.random() < 0.4]
        cases.append([(a, b, rng.choice(BASE)) if rng.random() < 0.5 else (b, a, rng.choice(BASE)) for a, b in pairs])
    for r in graphs(spark, cases).where(F.size("stated") > 0).collect():
        by_pair = {(p.src, p.node): p for p in r.paths}  # an entry a pair: the first path, and how many there are
        assert len(by_pair) == len(r.paths)
        names = {n for a, b, _ in cases[r.k] for n in (a, b)}
        for a, b in itertools.product(names, names):
            listed, p = slow_paths(cases[r.k], a, b), by_pair.get((a, b))
            assert (p is not None) == bool(listed), (cases[r.k], a, b)
            if p is not None:
                assert (list(p.dirs), list(p.nodes)) == listed[0] and int(p.n) == len(listed), (cases[r.k], a, b)


def test_reasoning_chains(spark):
    chain = [("B", "A", "above"), ("C", "B", "right"), ("D", "C", "below"), ("E", "D", "left")]
    got = graphs(spark, [chain[:n] for n in range(1, 5)]).select("k", X.reasoning_chain(G.first_path(F.col("paths"), F.lit("A"), F.element_at(F.array(*map(F.lit, "BCDE")), F.col("k") + 1))).alias("t"))
    texts = [r.t for r in got.orderBy("k").collect()]
    assert texts[:2] == ["B is above A.", "B is above A. C is to the right of B."]
    assert texts[2] == "B is above A. C is to the right of B. Since B is above A and C is to the right of B, C is above and to the right of A. D is below C."
    assert texts[3].count("Since") == 2 and texts[3].endswith("E is to the left of D.")
    none = graphs(spark, [chain[:1]]).select(X.reasoning_chain(G.first_path(F.col("paths"), F.lit("A"), F.lit("X"))).alias("t")).first().t
    assert (none or "") == ""


def test_coverage(spark):
    df = graphs(spark, [[("B", "A", "above"), ("D", "C", "left")]])
    c = held(df, parts=G.components(F.array(*map(F.lit, "ABCDE")), F.col("graph"))).select(G.coverage(F.col("parts")).alias("c")).first().c
    assert tuple(c) == (5, 3, 2, 10, 8, 2, 0.2)


def test_external_scores(spark):
    target = F.array(F.lit("above"), F.lit("left"))
    assert [one(spark, E.stepgame_score(F.lit(p), t)) for p, t in (("above and to the left", target), ("Above.", target), ("north", F.array(F.lit("above"))))] == [1.0, 0.5, 0.0]
    assert [one(spark, E.babi_score(F.lit(p), F.lit(t))) for p, t in (("south east", "south east"), ("south west", "south east"), ("east south", "south east"), ("south", "south"))] == [1.0, 0.5, 0.0, 1.0]
    assert one(spark, E.spartqa_match(F.lit("The blue square."), F.array(F.lit("a blue square")), F.lit("?"))) is True
    assert one(spark, E.spartqa_match(F.lit("the second option"), F.array(F.lit("rock")), F.lit("Is it the tree or the rock?"))) is True


def test_placement():
    stated = [("B", "A", "above"), ("C", "B", "right"), ("D", "A", "above")]
    at = place(stated)
    assert len(set(at.values())) == 4 and min(x for x, _ in at.values()) == 0 and at["D"] != at["B"]
    assert holds(stated, at)
    assert place([]) == {} and not holds([("B", "A", "above"), ("A", "B", "above")], place([("B", "A", "above")]))


def test_terms_names_and_texts(spark):
    assert one(spark, X.terminology(F.lit("A is north of B. C is at 3 o'clock from B."))) == "cardinal+clock"
    assert [one(spark, X.component_name(F.lit(i))) for i in (0, 25, 26, 27, 52)] == ["A", "Z", "AA", "AB", "BA"]


def test_values_that_are_used_several_times_are_computed_once(spark):
    from gridlogic.functions import algebra, layout, score, text

    z, other = F.col("zzz"), F.col("other")
    made = {
        "terminology": (text.terminology(z), 1), "lookup": (text.lookup(z, {"a": "x", "b": "y"}), 1), "phrase": (text.phrase(z), 1), "reasoning_chain": (text.reasoning_chain(z), 1), "compose": (algebra.compose(z), 1),
        "compact": (layout.compact(z), 1), "direction_between": (layout.direction_between(z, other, other), 2), "compare_layouts": (score.compare_layouts(other, z), 3), "verify": (score.verify(other, z), 4),
        "answer_from_layout": (score.answer_from_layout(z, other, other, other), 2), "render_grid": (layout.render_grid(z), 5),
    }
    assert {k: n for k, (c, most) in made.items() if (n := str(c).count("zzz")) > most} == {}


def test_offset_codes_differ_where_directions_do(spark):
    from gridlogic.functions.algebra import of_offset, offset_code

    own = spark.range(25).selectExpr("cast(id div 5 as int) - 2 as x", "cast(id % 5 as int) - 2 as y")
    got = own.select(of_offset(F.col("x"), F.col("y")).alias("d"), offset_code(F.col("x"), F.col("y")).alias("c")).distinct().collect()
    assert len(got) == len({r.d for r in got}) == len({r.c for r in got}) == 8


def test_a_path_between_two_nodes_is_the_first_of_all(spark):
    import random

    from gridlogic.functions import graph

    rng, rows = random.Random(3), []
    for _ in range(60):
        names = "ABCDEF"[: rng.randint(2, 6)]
        stated = [(*rng.sample(names, 2), rng.choice(("above", "left", "lower-right"))) for _ in range(rng.randint(1, 7))]
        rows += [(stated, a, b) for a in names for b in names]
    own = spark.createDataFrame(rows, "stated array<struct<obj1:string,obj2:string,dir:string>>, a string, b string").withColumn("g", graph.edges(F.col("stated")))
    want = graph.first_path(graph.shortest_paths_from(F.col("g"), F.col("a")), F.col("a"), F.col("b"))
    got = own.select("a", "b", want["nodes"].alias("n"), want["dirs"].alias("d"), graph.path_between(F.col("g"), F.col("a"), F.col("b")).alias("p")).collect()
    assert all((r.n, r.d) == (r.p and r.p.nodes, r.p and r.p.dirs) for r in got if r.a != r.b)
    assert any(r.n is None for r in got) and any(r.n and len(r.n) > 3 for r in got)
