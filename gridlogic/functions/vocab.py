"""Directions and the phrases that stand for them."""

from __future__ import annotations

BASE = ("above", "below", "left", "right", "upper-left", "upper-right", "lower-left", "lower-right")
VERTICAL = ("above", "below", "same level")
HORIZONTAL = ("left", "right", "same column")
#: (dx, dy) of a unit step; y grows downward.
STEP = {d: ((d.endswith("right") - d.endswith("left")), ((d == "below" or d.startswith("lower")) - (d == "above" or d.startswith("upper")))) for d in BASE}
INVERSE = {d: next(e for e in BASE if STEP[e] == (-STEP[d][0], -STEP[d][1])) for d in BASE}


def _halves(direction: str) -> tuple[str, str]:
    vertical, side = direction.split("-")
    return ("above" if vertical == "upper" else "below"), side


# The phrases of a cardinal direction in "A is ... B"; those of diagonals follow one pattern.
_SPATIAL = {
    "above": ["above", "over", "higher than", "on top of", "positioned above", "located above"],
    "below": ["below", "under", "beneath", "lower than", "underneath", "positioned below", "located below"],
    "left": ["to the left of", "on the left side of", "left of", "positioned to the left of", "located to the left of"],
    "right": ["to the right of", "on the right side of", "right of", "positioned to the right of", "located to the right of"],
}
_DIAGONAL = (
    "{v} and to the {s} of", "to the {d} of", "at the {t}-{s} of", "in the {d} of", "positioned {d} of", "to the {s} and {v}",
    "{s} and {v}", "{v} and {s}", "to the {v} and to the {s} of", "to the {s} and to the {v} of", "to the {s} of and {v}", "to the {v} of and {s}",
)
_COMPASS = {"above": "north", "below": "south", "left": "west", "right": "east"}
_ONE_POINT = ("{a} of", "to the {a} of", "directly {a} of", "{a}ward of", "{a}ward from")
_TWO_POINTS = (
    "to the {a}{b} of", "{a}{b} of", "{a} and {b} of", "to the {a} and {b} of", "{b} and {a} of", "to the {b} and {a} of",
    "to the {a} and to the {b} of", "to the {b} and to the {a} of", "{a}{b}ward of", "{a}{b}ward from",
)
#: The times on a clock face; "h" and a whole hour, or a half past.
_CLOCK = {
    "above": ["12 o'clock", "12:00", "0 o'clock"], "below": ["6 o'clock", "6:00"], "left": ["9 o'clock", "9:00"], "right": ["3 o'clock", "3:00"],
    "upper-left": ["10 o'clock", "10:30", "11 o'clock"], "upper-right": ["1 o'clock", "1:30", "2 o'clock"],
    "lower-left": ["7 o'clock", "7:30", "8 o'clock"], "lower-right": ["4 o'clock", "4:30", "5 o'clock"],
}


def _spatial(d: str) -> list[str]:
    if d in _SPATIAL:
        return list(_SPATIAL[d])
    v, s = _halves(d)
    return [p.format(d=d, v=v, s=s, t="top" if v == "above" else "bottom") for p in _DIAGONAL]


def _cardinal(d: str) -> list[str]:
    if d in _COMPASS:
        return [p.format(a=_COMPASS[d]) for p in _ONE_POINT]
    v, s = _halves(d)
    return [p.format(a=_COMPASS[v], b=_COMPASS[s]) for p in _TWO_POINTS]


SPATIAL = {d: _spatial(d) for d in BASE}
CARDINAL = {d: _cardinal(d) for d in BASE}
CLOCK = {d: [p for time in _CLOCK[d] for p in (f"at {time} from", f"at the {time} position from")] for d in BASE}
POOLS = {"spatial": SPATIAL, "cardinal": CARDINAL, "clock": CLOCK}

# Further words that an answer may use.
ALIASES = {
    "above": ["above", "over", "top", "upper", "higher", "north", "northern", "upward", "up", "12:00", "12 o'clock", "0:00", "0 o'clock", "positioned above", "located above", "higher than", "on top"],
    "below": ["below", "under", "beneath", "bottom", "lower", "south", "southern", "downward", "down", "6:00", "6 o'clock", "positioned below", "located below", "lower than", "underneath"],
    "left": ["left", "west", "western", "leftward", "9:00", "9 o'clock", "positioned to the left", "located to the left", "to the left", "on the left side", "left of", "to the west"],
    "right": ["right", "east", "eastern", "rightward", "3:00", "3 o'clock", "positioned to the right", "located to the right", "to the right", "on the right side", "right of", "to the east"],
    "upper-left": ["upper-left", "top-left", "upper left", "top left", "northwest", "northwestern", "10:30", "10 o'clock", "11 o'clock", "positioned upper-left", "located upper-left", "above and to the left", "to the upper-left", "at the top-left", "to the northwest", "in the upper-left", "north-west", "north west", "northwestward"],
    "upper-right": ["upper-right", "top-right", "upper right", "top right", "northeast", "northeastern", "1:30", "1 o'clock", "2 o'clock", "positioned upper-right", "located upper-right", "above and to the right", "to the upper-right", "at the top-right", "to the northeast", "in the upper-right", "north-east", "north east", "northeastward"],
    "lower-left": ["lower-left", "bottom-left", "lower left", "bottom left", "southwest", "southwestern", "7:30", "7 o'clock", "8 o'clock", "positioned lower-left", "located lower-left", "below and to the left", "to the lower-left", "at the bottom-left", "to the southwest", "in the lower-left", "south-west", "south west", "southwestward"],
    "lower-right": ["lower-right", "bottom-right", "lower right", "bottom right", "southeast", "southeastern", "4:30", "4 o'clock", "5 o'clock", "positioned lower-right", "located lower-right", "below and to the right", "to the lower-right", "at the bottom-right", "to the southeast", "in the lower-right", "south-east", "south east", "southeastward"],
    "same level": ["same level", "same height", "horizontally aligned", "same vertical position", "same y", "same row", "aligned horizontally", "level", "even"],
    "same column": ["same column", "same horizontal position", "vertically aligned", "same x", "aligned vertically", "same vertical line", "inline"],
    "same position": ["same position", "same location", "same spot", "identical position", "co-located", "at the same position", "in the same location"],
}

ALIAS_LABEL = {alias: label for label, aliases in ALIASES.items() for alias in aliases}
#: Phrases of the three generators; and with the aliases, which win.
GENERATED = {p: d for pool in POOLS.values() for d in BASE for p in pool[d]}
PHRASES = GENERATED | ALIAS_LABEL
#: Longest first, then in the order of the table: the order in which an answer is searched for aliases.
ALIASES_BY_LENGTH = sorted(ALIAS_LABEL, key=lambda a: -len(a))


def aliases_for(query_type: str) -> dict[str, list[str]]:
    """The aliases that can answer a vertical, horizontal or full query."""
    if query_type == "vertical":
        return {d: ALIASES[d] for d in VERTICAL}
    if query_type == "horizontal":
        return {d: ALIASES[d] for d in HORIZONTAL}
    return {d: a for d, a in ALIASES.items() if d not in ("same level", "same column")}
