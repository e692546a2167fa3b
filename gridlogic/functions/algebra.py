"""Relation algebra on columns: inverse, offset, relation of two places, components, composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlogic.functions.vocab import BASE, INVERSE, STEP


def _case(value: Column, table: dict, otherwise: Column) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(value == k, F.lit(v))
    return out.otherwise(otherwise)


def inverse(direction: Column) -> Column:
    """The opposite direction; anything else stays."""
    return _case(direction, INVERSE, direction)


def dx(direction: Column) -> Column:
    """R2: the unit step to the right; 0 for an unknown direction."""
    return _case(direction, {d: s[0] for d, s in STEP.items()}, F.lit(0))


def dy(direction: Column) -> Column:
    """R2: the unit step down; 0 for an unknown direction."""
    return _case(direction, {d: s[1] for d, s in STEP.items()}, F.lit(0))


def of_offset(x: Column, y: Column) -> Column:
    """The direction of an offset; no offset at all is above, as long as strict handling isn't asked for."""
    return (
        F.when((x == 0) & (y > 0), "below").when(x == 0, "above").when((y == 0) & (x > 0), "right").when(y == 0, "left")
        .otherwise(F.concat(F.when(y > 0, "lower").otherwise("upper"), F.when(x > 0, F.lit("-right")).otherwise("-left")))
    )


def offset_code(x: Column, y: Column) -> Column:
    """A number for each direction of of_offset(), equal where the directions are: cheaper to compare."""
    return F.when(x == 0, F.when(y > 0, 1).otherwise(-1)).otherwise(F.when(x > 0, 10).otherwise(-10) + F.when(y > 0, 1).when(y == 0, 0).otherwise(-1))


def relation(p: Column, q: Column) -> Column:
    """Where p is as seen from q, both structs with x and y."""
    return of_offset(p["x"] - q["x"], p["y"] - q["y"])


def vertical(direction: Column) -> Column:
    """Above, below, or same level."""
    return F.when(direction.isin("above", "upper-left", "upper-right"), "above").when(direction.isin("below", "lower-left", "lower-right"), "below").otherwise("same level")


def horizontal(direction: Column) -> Column:
    """Left, right, or same column."""
    return F.when(direction.isin("left", "upper-left", "lower-left"), "left").when(direction.isin("right", "upper-right", "lower-right"), "right").otherwise("same column")


def component(direction: Column, query_type: Column) -> Column:
    """What a query of the type asks for."""
    return F.when(query_type == "full", direction).when(query_type == "vertical", vertical(direction)).otherwise(horizontal(direction))


def compose(directions: Column) -> Column:
    """The direction of a path of unit steps; null for an empty path, an unknown direction, or steps that cancel."""
    zero = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))
    total = lambda own: F.aggregate(own, zero, lambda acc, d: F.struct((acc["x"] + dx(d)).alias("x"), (acc["y"] + dy(d)).alias("y")))
    known = lambda own: F.forall(own, lambda d: F.coalesce(d.isin(*BASE), F.lit(False)))
    summed = lambda own: bound(total(own), lambda t: F.when((t["x"] != 0) | (t["y"] != 0), of_offset(t["x"], t["y"])))
    return bound(directions, lambda own: F.when((F.size(own) > 0) & known(own), summed(own)))


def is_direction(value: Column) -> Column:
    """R9."""
    return F.coalesce(value.isin(*BASE), F.lit(False))


def offset_matches(direction: Column, x: Column, y: Column) -> Column:
    """Whether an offset points in a direction, whatever its length."""
    return F.coalesce(direction.isin(*BASE), F.lit(False)) & (F.signum(x) == dx(direction)) & (F.signum(y) == dy(direction))


def conflicts(direction: Column, stated: Column) -> Column:
    """Whether a direction contradicts one that is stated for the same pair: the opposite does."""
    return F.coalesce(inverse(direction) == stated, F.lit(False))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
