"""Layouts as array<struct<obj, x, y>> columns: parse, compact, compare, render. All in the row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlogic.functions.algebra import bound, relation

LAYOUT = "array<struct<obj:string,x:int,y:int>>"
TOKEN = r"[\p{L}\p{N}]+"


def grid_lines(art: Column) -> Column:
    """Lines without the blank ones before and after."""
    return F.split(F.regexp_replace(F.regexp_replace(art, r"^(?:[^\S\n]*\n)+", ""), r"(?:\n[^\S\n]*)+$", ""), "\n", -1)


def line_tokens(line: Column, y: Column) -> Column:
    """(obj, x, y) of each maximal run of letters and digits, lower-case, at its first column."""
    start = F.struct(F.lit(1).alias("from"), F.array().cast(LAYOUT).alias("out"))

    def add(acc, token):
        at = F.position(token, line, acc["from"])
        found = F.struct(F.lower(token).alias("obj"), (at - 1).alias("x"), y.alias("y"))
        return F.struct((at + F.length(token)).alias("from"), F.concat(acc["out"], F.array(found)).alias("out"))

    return F.aggregate(F.regexp_extract_all(line, F.lit(f"({TOKEN})"), F.lit(1)), start, add)["out"]


def parse_art(art: Column) -> Column:
    """L1: a layout with the columns and rows of the text; null for null."""
    return F.flatten(F.transform(grid_lines(art), lambda line, y: line_tokens(line, y)))


def duplicates(layout: Column) -> Column:
    """Names that occur more than once, sorted."""
    twice = lambda names: F.filter(names, lambda n, i: F.array_position(names, n) != i + 1)
    return F.array_sort(F.array_distinct(bound(F.transform(layout, lambda o: o["obj"]), twice)))


def objects(layout: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(layout, lambda o: o["obj"])))


def compact(layout: Column) -> Column:
    """L2: columns and rows renumbered densely from 0, independently."""
    places = lambda own, axis: F.sort_array(F.array_compact(F.array_distinct(F.transform(own, lambda o: o[axis]))))
    at = lambda all_, value: (F.array_position(all_, value) - 1).cast("int")
    numbered = lambda own, xs, ys: F.transform(own, lambda o: F.struct(o["obj"].alias("obj"), at(xs, o["x"]).alias("x"), at(ys, o["y"]).alias("y")))
    return bound(layout, lambda own: bound(places(own, "x"), lambda xs: bound(places(own, "y"), lambda ys: numbered(own, xs, ys))))


def all_relations(layout: Column) -> Column:
    """Array of (obj1, obj2, dir) for all ordered pairs."""
    one = lambda p, q: F.struct(p["obj"].alias("obj1"), q["obj"].alias("obj2"), relation(p, q).alias("dir"))
    return F.flatten(F.transform(layout, lambda p: F.transform(F.filter(layout, lambda q: q["obj"] != p["obj"]), lambda q: one(p, q))))


def place(layout: Column, name: Column) -> Column:
    """The (obj, x, y) of a name, else null."""
    return F.get(F.filter(layout, lambda o: o["obj"] == name), F.lit(0))


def direction_between(layout: Column, obj1: Column, obj2: Column) -> Column:
    """Where obj1 is as seen from obj2; null if one is missing or both are the same."""
    both = F.struct(place(layout, obj1).alias("p"), place(layout, obj2).alias("q"))
    return bound(both, lambda b: F.when(b["p"].isNotNull() & b["q"].isNotNull() & (obj1 != obj2), relation(b["p"], b["q"])))


def _bounds(layout: Column) -> Column:
    """(width, height, cell)"""
    width = F.array_max(F.transform(layout, lambda o: o["x"])) + 1
    height = F.array_max(F.transform(layout, lambda o: o["y"])) + 1
    cell = F.array_max(F.transform(layout, lambda o: F.length(o["obj"]))) + 2
    return F.struct(width.alias("width"), height.alias("height"), cell.alias("cell"))


def _name(row: Column, x: Column) -> Column:
    """The name in a column among a row's objects, or nothing."""
    return F.coalesce(F.get(F.filter(row, lambda o: o["x"] == x), F.lit(0))["obj"], F.lit(""))


def _text_rows(layout: Column, size: Column) -> Column:
    row = lambda own: F.array_join(F.transform(F.sequence(F.lit(0), size["width"] - 1), lambda x: F.rpad(_name(own, x), size["cell"], " ")), "")
    return F.transform(F.sequence(F.lit(0), size["height"] - 1), lambda y: bound(F.filter(layout, lambda o: o["y"] == y), row))


def render_simple(layout: Column) -> Column:
    """Names at their columns; no trailing spaces, no empty rows."""
    rows = F.transform(bound(_bounds(layout), lambda size: _text_rows(layout, size)), lambda r: F.rtrim(r))
    return F.when(F.size(layout) == 0, "No objects to display").otherwise(F.array_join(F.filter(rows, lambda r: r != ""), "\n"))


def render_grid(layout: Column) -> Column:
    """Cells with borders, names centred towards the left."""
    def drawn(size):
        width, height, cell = size["width"], size["height"], size["cell"]
        border = F.concat(F.lit("+"), F.repeat(F.concat(F.repeat(F.lit("-"), cell - 1), F.lit("+")), width))
        lead = lambda n: F.repeat(F.lit(" "), F.floor((cell - F.length(n)) / 2).cast("int") - 1)
        inside = lambda name: bound(name, lambda n: F.concat(F.rpad(F.concat(lead(n), n), cell - 1, " "), F.lit("|")))
        row = lambda own: F.concat(F.lit("|"), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda x: inside(_name(own, x))), ""))
        line = lambda y, below: F.concat(bound(F.filter(layout, lambda o: o["y"] == y), row), F.lit("\n"), below)
        return bound(border, lambda b: F.concat(b, F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(0), height - 1), lambda y: line(y, b)), "\n")))

    return F.when(F.size(layout) == 0, "No objects to display").otherwise(bound(_bounds(layout), drawn))


def render_panel(layout: Column) -> Column:
    """Names in one frame."""
    def framed(size):
        line = F.repeat(F.lit("─"), size["width"] * size["cell"] + 1)
        rows = F.transform(_text_rows(layout, size), lambda r: F.concat(F.lit("│ "), r, F.lit("│")))
        return F.concat(F.lit("┌"), line, F.lit("┐\n"), F.array_join(rows, "\n"), F.lit("\n└"), line, F.lit("┘"))

    return F.when(F.size(layout) == 0, "No objects to display").otherwise(bound(_bounds(layout), framed))


RENDERERS = {"simple": render_simple, "grid": render_grid, "panel": render_panel}


def render(layout: Column, style: str = "panel") -> Column:
    """An unknown style is panel."""
    return RENDERERS.get(style, render_panel)(layout)
