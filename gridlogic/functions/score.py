"""Verdicts on grids, descriptions and answers, each an expression on the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlogic.functions import layout as L
from gridlogic.functions.algebra import bound, component, offset_code, relation
from gridlogic.functions.text import resolve_label, strip


def label_correct(answer: Column, truth: Column) -> Column:
    """E1."""
    return F.coalesce(resolve_label(answer) == F.lower(truth), F.lit(False))


def _share(correct: Column, total: Column) -> Column:
    return F.when(total > 0, correct / total).otherwise(F.lit(0.0))


def compare_layouts(reference: Column, model: Column) -> Column:
    """(correct, correct_count, total, accuracy, missing, extra, error) of a compacted model layout against a reference: ordered
    pairs whose relation agrees; other objects on either side are an error. A layout of one object is correct with accuracy 0."""
    def counted(s):
        # each object beside its place in the model, found once; then pairs are numbers to compare
        beside = F.transform(reference, lambda o: F.struct(o.alias("p"), L.place(model, o["obj"]).alias("q")))
        code = lambda a, b, side: offset_code(a[side]["x"] - b[side]["x"], a[side]["y"] - b[side]["y"])
        agree = lambda a, b: (a["p"]["obj"] != b["p"]["obj"]) & a["q"].isNotNull() & b["q"].isNotNull() & (code(a, b, "p") == code(a, b, "q"))
        pairs = lambda own, test: F.aggregate(own, F.lit(0).cast("long"), lambda n, a: n + F.size(F.filter(own, lambda b: test(a, b))))
        same = bound(beside, lambda own: pairs(own, agree))
        total = pairs(reference, lambda a, b: a["obj"] != b["obj"])
        bad = s["twice"] | (F.size(s["missing"]) > 0) | (F.size(s["extra"]) > 0)
        zero = F.lit(0).cast("long")
        return F.struct(s["twice"].alias("twice"), bad.alias("bad"), F.when(bad, zero).otherwise(same).alias("same"), F.when(bad, zero).otherwise(total).alias("total"), s["missing"].alias("missing"), s["extra"].alias("extra"))

    def verdict(s):
        return F.struct(
            (~s["bad"] & (s["same"] == s["total"])).alias("correct"), s["same"].alias("correct_count"), s["total"].alias("total"), F.when(s["bad"], 0.0).otherwise(_share(s["same"], s["total"])).alias("accuracy"),
            s["missing"].alias("missing"), s["extra"].alias("extra"), F.when(s["twice"], "duplicate object").when(s["bad"], "object mismatch").alias("error"),
        )

    twice = (F.size(L.duplicates(reference)) > 0) | (F.size(L.duplicates(model)) > 0)
    names = F.struct(L.objects(reference).alias("own"), L.objects(model).alias("others"))
    apart = bound(names, lambda n: F.struct(F.array_except(n["own"], n["others"]).alias("missing"), F.array_except(n["others"], n["own"]).alias("extra"), twice.alias("twice")))
    return bound(bound(apart, counted), verdict)


def check_relations(stated: Column, model: Column) -> Column:
    """Array of (obj1, obj2, dir, ok, missing) for stated relations against a compacted layout; obj1 is looked for first."""
    def one(b):
        r, first, second = b["r"], b["p"], b["q"]
        lost = F.when(first.isNull(), r["obj1"]).when(second.isNull(), r["obj2"])
        ok = first.isNotNull() & second.isNotNull() & (r["obj1"] != r["obj2"]) & (relation(first, second) == r["dir"])
        return F.struct(r["obj1"].alias("obj1"), r["obj2"].alias("obj2"), r["dir"].alias("dir"), F.coalesce(ok, F.lit(False)).alias("ok"), lost.alias("missing"))

    placed = F.transform(stated, lambda r: F.struct(r.alias("r"), L.place(model, r["obj1"]).alias("p"), L.place(model, r["obj2"]).alias("q")))
    return F.transform(placed, one)


def verify(stated: Column, model: Column, mode: str = "verify_ascii", strict: bool = False) -> Column:
    """(correct, correct_count, total, accuracy, missing, extra) of a layout and the relations that a description states.

    verify_ascii also wants every object described and something stated; verify_description, that what is stated holds: nothing stated is correct with
    accuracy 0, unless strict. A duplicate object is never correct.
    """

    def counted(checked):
        ok = F.size(F.filter(checked, lambda r: r["ok"])).cast("long")
        missing = F.array_sort(F.array_distinct(F.filter(F.transform(checked, lambda r: r["missing"]), lambda m: m.isNotNull())))
        named = F.array_union(F.transform(stated, lambda r: r["obj1"]), F.transform(stated, lambda r: r["obj2"]))
        extra = F.array_sort(F.array_except(L.objects(model), named))
        return F.struct(ok.alias("ok"), F.size(stated).cast("long").alias("total"), missing.alias("missing"), extra.alias("extra"), (F.size(L.duplicates(model)) > 0).alias("twice"))

    def verdict(s):
        ok, total, twice = s["ok"], s["total"], s["twice"]
        correct = (ok == total) & (F.size(s["missing"]) == 0) & ~twice
        if mode == "verify_ascii":
            correct &= (total > 0) & (F.size(s["extra"]) == 0)
        elif strict:
            correct &= total > 0
        return F.struct(correct.alias("correct"), F.when(twice, F.lit(0).cast("long")).otherwise(ok).alias("correct_count"), total.alias("total"), F.when(twice, 0.0).otherwise(_share(ok, total)).alias("accuracy"), s["missing"].alias("missing"), s["extra"].alias("extra"))

    return bound(bound(check_relations(stated, model), counted), verdict)


def answer_from_layout(model: Column, obj1: Column, obj2: Column, query_type: Column) -> Column:
    """E5: what a compacted layout answers; null if an object is missing."""
    both = F.struct(L.place(model, obj1).alias("p"), L.place(model, obj2).alias("q"))
    said = lambda b: bound(F.when(obj1 != obj2, relation(b["p"], b["q"])), lambda d: component(d, query_type))
    return bound(both, lambda b: F.when(b["p"].isNotNull() & b["q"].isNotNull(), said(b)))


def query_correct(model: Column, query, reference: Column) -> Column:
    """E5: whether the layout's answer is the reference in lower case, without aliases. query: parse_query()."""
    return bound(query, lambda q: F.coalesce(answer_from_layout(model, q["obj1"], q["obj2"], q["query_type"]) == F.lower(reference), F.lit(False)))


# The names of accuracy buckets and of the four combinations of a right or wrong grid and answer.
BUCKETS = ("[0, 0.25)", "[0.25, 0.5)", "[0.5, 0.75)", "[0.75, 1]")
ERRORS = ("correct_ascii_correct_answer", "correct_ascii_wrong_answer", "wrong_ascii_correct_answer", "wrong_ascii_wrong_answer")


def bucket(accuracy: Column) -> Column:
    """E10."""
    return F.when(accuracy < 0.25, BUCKETS[0]).when(accuracy < 0.5, BUCKETS[1]).when(accuracy < 0.75, BUCKETS[2]).otherwise(BUCKETS[3])


def error_kind(ascii_ok: Column, answer_ok: Column) -> Column:
    """E11."""
    return F.when(ascii_ok & answer_ok, ERRORS[0]).when(ascii_ok, ERRORS[1]).when(answer_ok, ERRORS[2]).otherwise(ERRORS[3])


def skip_reason(error: Column, answer: Column, in_dataset: Column, grid: Column) -> Column:
    """P10: why a row is not evaluated, in this order; null if it is."""
    return F.when(error.isNotNull(), "model error").when(F.coalesce(answer, F.lit("")) == "", "missing answer").when(~in_dataset, "test_id not found in dataset").when(F.coalesce(grid, F.lit("")) == "", "no ASCII grid in model output")


def stepgame_directions(text: Column) -> Column:
    """The plain directions among the words of an answer."""
    cleaned = F.regexp_replace(F.lower(strip(text)), r"\.+$", "")
    for old, new in (("to the ", ""), (" of", ""), (" and ", ", ")):
        cleaned = F.replace(cleaned, F.lit(old), F.lit(new))
    return F.array_intersect(F.split(cleaned, r"[,\s]+"), F.array(*map(F.lit, ("above", "below", "left", "right"))))


def stepgame_score(prediction: Column, target: Column) -> Column:
    """1 for the same set of directions, 0.5 for an overlap."""
    said = stepgame_directions(prediction)
    return F.when(F.size(said) == 0, 0.0).when(F.array_sort(said) == F.array_sort(F.array_distinct(target)), 1.0).when(F.arrays_overlap(said, target), 0.5).otherwise(0.0)


def babi_score(prediction: Column, truth: Column) -> Column:
    """1 for both words, 0.5 for the first alone; fewer than two words must be equal."""
    p, t = F.split(F.lower(strip(prediction)), r"\s+"), F.split(F.lower(strip(truth)), r"\s+")
    few = (F.size(p) < 2) | (F.size(t) < 2)
    first, second = F.get(p, F.lit(0)) == F.get(t, F.lit(0)), F.get(p, F.lit(1)) == F.get(t, F.lit(1))
    return F.when(few, F.when(F.lower(strip(prediction)) == F.lower(strip(truth)), 1.0).otherwise(0.0)).when(first & second, 1.0).when(first, 0.5).otherwise(0.0)


def normal_answer(text: Column) -> Column:
    """Lower case, without full stops at the end or an article before."""
    return F.regexp_replace(strip(F.regexp_replace(F.lower(strip(text)), r"\.+$", "")), "^(?:a|an|the) ", "")


def options(question: Column) -> Column:
    """(first, second) around the last " or "; the first keeps the question before it."""
    text = strip(F.regexp_replace(question, r"\?+$", ""))
    return F.struct(strip(F.regexp_extract(text, "(?s)^(.*) or (.*)$", 1)).alias("first"), strip(F.regexp_extract(text, "(?s)^(.*) or (.*)$", 2)).alias("second"))


def spartqa_match(prediction: Column, references: Column, question: Column) -> Column:
    """Equal to a reference, or naming by ordinal an option that is."""
    said, choice = F.lower(strip(prediction)), options(question)
    meant = F.when(F.contains(said, F.lit("first option")), normal_answer(choice["first"])).when(F.contains(said, F.lit("second option")), normal_answer(choice["second"]))
    return F.exists(references, lambda r: normal_answer(r).eqNullSafe(normal_answer(prediction)) | F.coalesce(normal_answer(r) == meant, F.lit(False)))
