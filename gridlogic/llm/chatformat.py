"""Chat formatting that a deterministic parser reads back unchanged.

    conversation := unit*
    unit := ("### " | "###\\ ") role ": " text "</turn>" line-feed

Each unit is rendered plain first and reparsed. If role and text do not come back, or hold a control string, it is rendered again escaped, which its mark (###,
backslash, space) tells, and reparsed again; text that does not come back from that either is an error. Escaping doubles backslashes and puts one into "</turn>", between
any two number signs and, in the role, into ": ". No control string is left in an escaped unit, so units can be parsed one by one after cutting at "</turn>".
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlogic.llm.common import table

PLAIN, ESCAPED, END = "### ", "###\\ ", "</turn>"
TRAINED_ROLE = "assistant"


#: What escaping replaces, in order; in a role also the last. The second time, the number signs that met when pairs were parted.
ESCAPES = (("\\", "\\\\"), (END, "<\\/turn>"), ("##", "#\\#"), ("##", "#\\#"))
ROLE_ESCAPE = (": ", ":\\ ")


def escaped(text: Column, role: bool = False) -> Column:
    out = text
    for plain, safe in (*ESCAPES, *([ROLE_ESCAPE] if role else [])):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def parse_unit(unit: Column) -> Column:
    """(role, text, safe) of a unit without its end: safe tells that it was escaped."""
    safe = F.startswith(unit, F.lit(ESCAPED))
    body = F.substr(unit, F.when(safe, len(ESCAPED) + 1).otherwise(len(PLAIN) + 1))
    role = F.substring_index(body, ": ", 1)
    text = F.substr(body, F.length(role) + 3)
    return F.struct(F.when(safe, unescaped(role)).otherwise(role).alias("role"), F.when(safe, unescaped(text)).otherwise(text).alias("text"), safe.alias("safe"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order: array of (role, text, safe)."""
    units = F.split(formatted, END, -1)
    return F.transform(F.slice(units, F.lit(1), F.size(units) - 1), lambda u, i: parse_unit(F.when(i == 0, u).otherwise(F.substr(u, F.lit(2)))))


def render(role: Column, text: Column) -> Column:
    """A turn's unit: plain if that reparses to role and text and neither holds a control string, else escaped; an error if that doesn't reparse to them."""

    def unit(mark, role_, text_):
        return F.concat(F.lit(mark), role_, F.lit(": "), text_, F.lit(END + "\n"))

    def returns(unit_):
        back = parse(unit_)
        return (F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text)

    plain, safe = unit(PLAIN, role, text), unit(ESCAPED, escaped(role, role=True), escaped(text))
    free = ~F.contains(text, F.lit("###")) & ~F.contains(role, F.lit("###"))
    return F.when(free & returns(plain), plain).when(returns(safe), safe).otherwise(F.raise_error(F.lit("a turn does not come back from its escaped form")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, n_turns): a row for each conversation, its turns by (turn, role, text), null first.

    Null text and role count as empty; rows without conv_id are one conversation; repeated rows are repeated turns; an empty table gives no row. loss_spans are the
    (start, end) of assistant texts as they stand in formatted, in code points, end exclusive. Other columns are ignored. One shuffle by conv_id; a conversation is one row
    of the result and so meets in one task.
    """
    own = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # two turns of (conv_id, turn) come in the order of their contents
    units = own.withColumn("unit", render(F.col("role"), F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.length(F.substring_index("unit", ": ", 1)) + 2
    placed = units.withColumn("k", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum(F.length("unit")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.when(F.col("role") == TRAINED_ROLE, F.struct((F.col("before") + head).alias("start"), (F.col("before") + F.length("unit") - len(END) - 1).alias("end")))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "unit", span.alias("span")))).alias("units"))
    spans = F.filter(F.transform("units", lambda u: u["span"]), lambda s: s.isNotNull())
    return grouped.select("conv_id", F.array_join(F.transform("units", lambda u: u["unit"]), "").alias("formatted"), spans.alias("loss_spans"), F.size("units").cast("long").alias("n_turns"))


def trained_text(formatted: DataFrame) -> DataFrame:
    """formatted (with turns, as parse() gives them) with trained: the text under loss_spans, joined; pieces of escaped units are unescaped, which the
    assistant turn of the same place tells. Four bytes a code point let each piece be cut out without a scan from the start."""
    marks = F.transform(F.filter("turns", lambda t: t["role"] == TRAINED_ROLE), lambda t: t["safe"])

    def piece(wide, span, safe):
        text = F.decode(F.substring(wide, (span["start"] * 4 + 1).cast("int"), ((span["end"] - span["start"]) * 4).cast("int")), "UTF-32")
        return F.when(safe, unescaped(text)).otherwise(text)

    # wide as a lambda's variable: made once a row, and not copied for each span as a column's bytes are
    joined = F.transform(F.array(F.encode("formatted", "UTF-32")), lambda wide: F.array_join(F.zip_with("loss_spans", marks, lambda span, safe: piece(wide, span, safe)), ""))
    return formatted.select("*", F.get(joined, F.lit(0)).alias("trained"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the parser reads back from the formatted text, and what the loss mask covers."""
    back = formatted.select("conv_id", "formatted", "loss_spans", F.explode(F.array(parse(F.col("formatted")))).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = trained_text(back).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), "trained", F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars")


#: The conversation that the query adds, whose texts hold control strings.
HARD = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all of `conversations` and conversation -7, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(hard)))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), units AS (
  SELECT *, CASE WHEN contains(role || ': ' || text, '</turn>') OR contains(text, '###') OR contains(role, '###') OR contains(role, ': ')
    THEN 15 + length(replace(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), '##', '#\#'), ': ', ':\ '))
            + length(replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), '##', '#\#'))
    ELSE 14 + length(role) + length(text) END AS chars
  FROM turns
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS trained,
         sum(chars)::BIGINT AS formatted_chars
  FROM units GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(trained)::BIGINT AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars
FROM joined
"""
