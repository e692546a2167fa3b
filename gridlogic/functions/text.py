"""Reading relations, queries, labels and outputs from text, and writing them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlogic.functions.algebra import bound, compose
from gridlogic.functions.vocab import ALIAS_LABEL, ALIASES_BY_LENGTH, BASE, GENERATED, PHRASES, SPATIAL


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lookup(value: Column, table: dict[str, str]) -> Column:
    """The table's entry for a value, else null: a hashed set for each result, not a scan of the entries. The value is computed once."""
    def found(v):
        out = F
        for result in dict.fromkeys(table.values()):
            out = out.when(v.isin([k for k, r in table.items() if r == result]), result)
        return out.otherwise(F.lit(None))

    return bound(value, found)


#: Phrases as they are, then what is left of those that end in of, then of those in from.
SHORTENED = {p.removesuffix(end): d for end in (" from", " of", "") for p, d in PHRASES.items() if p.endswith(end)}


def literals(texts: list[str]) -> Column:
    """An array of constants."""
    escaped = (t.replace("\\", "\\\\").replace("'", "\\'") for t in texts)
    return F.expr("array(" + ", ".join(f"'{t}'" for t in escaped) + ")")


def phrase_direction(phrase: Column) -> Column:
    """A phrase's direction, also with a following of or from."""
    return lookup(phrase, SHORTENED)


def _part(part: Column, subject: Column) -> Column:
    """(obj1, obj2, dir) of one clause; dir is null if it can't be read."""
    joined, plain = r"(?U)^(.+?)\s+(?:of|from|as)\s+(\w+)$", r"(?U)^(.+?)\s+(\w+)$"
    first = phrase_direction(strip(F.regexp_extract(part, joined, 1)))
    second = phrase_direction(strip(F.regexp_extract(part, plain, 1)))
    return F.struct(subject.alias("obj1"), F.regexp_extract(part, plain, 2).alias("obj2"), F.coalesce(first, second).alias("dir"))


def parse_description(text: Column) -> Column:
    """Array of (obj1, obj2, dir) by sentences and their parts around "and"; what can't be read is left out."""
    head = r"(?iU)^(\w+)\s+is\s+"
    sentences = F.filter(F.transform(F.split(text, "[.,]", -1), strip), lambda s: F.rlike(s, F.lit(head)))

    def clauses(s):
        subject = F.lower(F.regexp_extract(s, head, 1))
        rest = strip(F.regexp_replace(s, head, ""))
        parts = F.transform(F.split(rest, r"\s+and\s+", -1), lambda p: strip(F.lower(p)))
        return bound(subject, lambda name: F.transform(parts, lambda p: _part(p, name)))

    return F.filter(F.flatten(F.transform(sentences, clauses)), lambda r: r["dir"].isNotNull() & (r["obj2"] != ""))


def parse_whole(text: Column) -> Column:
    """Array of (obj1, obj2, dir), a sentence's whole phrase being looked up; objects keep their case."""
    tail = r"^(.*)\s+(\S+)$"
    sentences = F.filter(F.transform(F.split(text, r"\.", -1), strip), lambda s: F.contains(s, F.lit(" is ")))

    def one(s):
        subject = strip(F.substring_index(s, " is ", 1))
        rest = strip(F.substr(s, F.instr(s, " is ") + 4))
        return F.struct(subject.alias("obj1"), F.regexp_extract(rest, tail, 2).alias("obj2"), lookup(strip(F.regexp_extract(rest, tail, 1)), GENERATED).alias("dir"))

    return F.filter(F.transform(sentences, one), lambda r: r["dir"].isNotNull())


def parse_query(text: Column) -> Column:
    """(obj1, obj2, query_type), lower-case objects; all null if it is no such question."""
    out = F.lit(None).cast("struct<obj1:string,obj2:string,query_type:string>")
    for kind, word in (("full", ""), ("horizontal", "horizontally "), ("vertical", "vertically ")):
        pattern = rf"(?iU)Where is (\w+) {word}relative to (\w+)\?"
        found = F.struct(F.lower(F.regexp_extract(text, pattern, 1)).alias("obj1"), F.lower(F.regexp_extract(text, pattern, 2)).alias("obj2"), F.lit(kind).alias("query_type"))
        out = F.when(F.rlike(text, F.lit(pattern)), found).otherwise(out)
    return out


def query_text(obj1: Column, obj2: Column, query_type: Column) -> Column:
    """X10."""
    word = F.when(query_type == "vertical", "vertically ").when(query_type == "horizontal", "horizontally ").otherwise("")
    return F.concat(F.lit("Where is "), obj1, F.lit(" "), word, F.lit("relative to "), obj2, F.lit("?"))


def clean_answer(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), "[.!?;:,]+$", "")


#: At each place of a text the longest alias that stands there between word bounds; a look-ahead, so that one may begin within another.
ALIAS_HERE = rf"(?U)(?=\b({'|'.join(map(re.escape, ALIASES_BY_LENGTH))})\b)"


def resolve_label(text: Column) -> Column:
    """An answer's label: an exact alias, else the longest alias at word bounds (of equally long ones the first of the table), else the cleaned text itself."""
    cleaned = clean_answer(text)
    places = F.create_map(*(x for i, a in enumerate(ALIASES_BY_LENGTH) for x in (F.lit(a), F.lit(i))))
    first = F.array_min(F.transform(F.regexp_extract_all(cleaned, F.lit(ALIAS_HERE), 1), lambda a: F.try_element_at(places, a)))
    return F.coalesce(lookup(cleaned, ALIAS_LABEL), F.get(literals([ALIAS_LABEL[a] for a in ALIASES_BY_LENGTH]), first), cleaned)


def phrase(direction: Column) -> Column:
    """The first phrase of the spatial pool."""
    def found(own):
        out = F
        for d in BASE:
            out = out.when(own == d, SPATIAL[d][0])
        return out.otherwise(own)

    return bound(direction, found)


def pick_phrase(direction: Column, pool: dict[str, list[str]], seed: Column) -> Column:
    """One of a pool's phrases for a direction, chosen by a number."""
    out = F
    for d in BASE:
        out = out.when(direction == d, F.element_at(F.array(*map(F.lit, pool[d])), (F.pmod(seed, F.lit(len(pool[d]))) + 1).cast("int")))
    return out.otherwise(direction)


def describe(relations: Column, pool: dict[str, list[str]], seed: Column) -> Column:
    """Sentences for an array of (obj1, obj2, dir)."""
    sentences = F.transform(relations, lambda r, i: F.concat(r["obj1"], F.lit(" is "), pick_phrase(r["dir"], pool, seed + i), F.lit(" "), r["obj2"]))
    return F.when(F.size(relations) == 0, "No relationships defined").otherwise(F.concat(F.array_join(sentences, ". "), F.lit(".")))


def terminology(text: Column) -> Column:
    """Which vocabularies a description uses, joined by +; spatial if none is found."""
    def any_of(low, name):
        from gridlogic.functions.vocab import POOLS

        others = {p for k, pool in POOLS.items() if k != name for d in BASE for p in pool[d]}
        own = {p for d in BASE for p in POOLS[name][d] if p not in others}
        # a phrase that holds another of them says no more than that one
        least = sorted((p for p in own if not any(q != p and q in p for q in own)), key=len)
        return F.exists(literals(least), lambda p: F.contains(low, p))

    found = lambda low: F.concat_ws("+", *(F.when(any_of(low, k), F.lit(k)) for k in ("spatial", "cardinal", "clock")))
    return F.regexp_replace(bound(F.lower(text), found), "^$", "spatial")


def component_name(i: Column) -> Column:
    """X11: A to Z, then AA, AB and on, from 0."""
    letter = lambda n: F.char(n + 65)
    return F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26) - 1), letter(F.pmod(i, F.lit(26)))))


def reasoning_chain(path: Column) -> Column:
    """Sentences of a path with nodes (n+1) and dirs (n): each hop, and after the second on what follows from the hops so far."""
    return bound(path, _chain)


def _chain(path: Column) -> Column:
    nodes, dirs = path["nodes"], path["dirs"]
    n = F.size(dirs)

    def said(a, d, b):
        return F.concat(a, F.lit(" is "), phrase(d), F.lit(" "), b)

    def hop(i):
        fact = said(F.get(nodes, i + 1), F.get(dirs, i), F.get(nodes, i))
        before, now = compose(F.slice(dirs, F.lit(1), i)), compose(F.slice(dirs, F.lit(1), i + 1))
        first = F.get(nodes, F.lit(0))
        since = F.concat(F.lit("Since "), said(F.get(nodes, i), before, first), F.lit(" and "), fact, F.lit(", "), said(F.get(nodes, i + 1), now, first))
        return F.concat_ws(". ", fact, F.when((i >= 1) & (i < n - 1), since))

    return F.when(n > 0, F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), hop), ". "), F.lit("."))).otherwise("")


def json_field(text: Column, key: str) -> Column:
    """A field of a JSON object as text: '' if it isn't there, null if the text is no JSON object."""
    return field_in(F.try_parse_json(text), key)


def field_in(value: Column, key: str) -> Column:
    """json_field() of what is parsed."""
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return F.when(is_object, F.coalesce(F.try_variant_get(value, f"$.{key}", "string"), F.lit("")))


def display_name(text: Column) -> Column:
    """P12."""
    return F.initcap(F.translate(text, "_-", "  "))


def model_folder(text: Column) -> Column:
    """P13."""
    return F.regexp_replace(text, r"[/\\ ]", "_")


def clean_story(text: Column) -> Column:
    """P14."""
    return F.regexp_replace(text, r"\.\.+", ".")


def confusion_key(truth: Column, predicted: Column) -> Column:
    """X19."""
    return F.concat(F.lit("expected_"), truth, F.lit("_predicted_"), predicted)
