"""Line dedup: three-line windows that occur before are removed.

Every three consecutive lines of a text are hashed. Windows with equal hashes are found globally; the first occurrence, by (doc_id, line),
stays, and in every later one the lines that its windows cover go. A text of one or two lines is one shorter window. Windows of blank
lines alone do not count. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.llm.common import checkpointed, join_dealt, quoted, table, unused

WINDOW = 3


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, __text, pos, h1, h2): each window's first line and 128 bits of hash. __text tells texts with one doc_id apart."""
    lined = docs.select("doc_id", F.xxhash64("text").alias("__text"), F.split("text", "\n", -1).alias("lines"))
    spread = lined.select("doc_id", "__text", "lines", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("lines") - WINDOW, F.lit(0)))).alias("pos"))
    cut = spread.select("doc_id", "__text", "pos", F.slice("lines", F.col("pos") + 1, WINDOW).alias("w"))
    return cut.where(F.trim(F.array_join("w", "")) != "").select("doc_id", "__text", "pos", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(WINDOW), "w").alias("h2"))


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, __text, starts): the sorted first lines of the windows that occur earlier, of the documents that have some.

    The first occurrence of a window is a minimum, of which each task makes its part before the shuffle; only windows with more than one
    occurrence are joined back, and those of a great many are dealt over tasks by their count.
    """
    found = windows(docs)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__text", "pos")
    first = checkpointed(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = first.agg(F.sum("n")).first()[0] or 0
    later = join_dealt(found, first, ["h1", "h2"], total, ["doc_id", "pos"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "__text").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """docs with text cut down to the lines that no repeated window covers; with counts, also n_lines and n_removed.

    A null text stays null (n_lines 0). A text all of whose lines go becomes empty; no row goes. A null doc_id comes after all others. Rows with equal
    doc_id and text are one document and are treated alike. Other columns stay, whatever their names; with counts, n_lines and n_removed must not be
    among them (ValueError). An empty table gives an empty one. A text is held whole, in one task, however long.
    """
    if counts and {"n_lines", "n_removed"} & {c.lower() for c in docs.columns}:
        raise ValueError("docs has a column n_lines or n_removed")
    found_id, found_hash, starts, hashed, lined, kept = (unused(docs, n) for n in ("id", "found_hash", "starts", "hash", "lines", "kept"))
    found = repeated(docs).select(F.col("doc_id").alias(found_id), F.col("__text").alias(found_hash), F.col("starts").alias(starts))
    own = docs.withColumn(hashed, F.xxhash64("text"))
    joined = own.join(found, own["doc_id"].eqNullSafe(found[found_id]) & (own[hashed] == found[found_hash]), "left")
    lines, size = F.split("text", "\n", -1), F.size(lined)

    def start(i):
        return F.coalesce(F.get(starts, i), size)

    def after(i):  # first line after window i-1
        return F.least(F.coalesce(F.get(starts, i - 1) + WINDOW, F.lit(0)), size)

    parts = F.transform(F.sequence(F.lit(0), F.size(starts)), lambda i: F.slice(lined, after(i) + 1, F.greatest(start(i) - after(i), F.lit(0))))
    cut = joined.withColumn(lined, lines).withColumn(kept, F.when(F.col(starts).isNotNull(), F.flatten(parts)))
    text = F.when(F.col(starts).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    extra = [F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.when(F.col(starts).isNotNull(), size - F.size(kept)), F.lit(0)).cast("long").alias("n_removed")]
    return cut.select(*(text.alias("text") if c == "text" else F.col(quoted(c)) for c in docs.columns), *(extra if counts else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all of `documents` without repeated lines."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


ORACLE_SQL = """
WITH lined AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), cut AS (
  SELECT doc_id, p AS pos, lines[p + 1 : least(p + 3, len(lines))] AS w
  FROM (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 3, 0) + 1)) AS p FROM lined WHERE text IS NOT NULL)
), kept_windows AS (
  SELECT * FROM cut WHERE trim(array_to_string(w, '')) <> ''
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, pos) AS k FROM kept_windows) WHERE k > 1
), covered AS (
  SELECT DISTINCT doc_id, pos + d AS line FROM later, (SELECT unnest([0, 1, 2]) AS d)
), gone AS (
  SELECT doc_id, list(line) AS gone FROM covered GROUP BY doc_id
), result AS (
  SELECT l.doc_id, l.text, l.lines, g.gone,
         [x FOR x, i IN l.lines IF NOT list_contains(g.gone, i - 1)] AS kept
  FROM lined l LEFT JOIN gone g USING (doc_id)
)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines,
       CASE WHEN gone IS NULL THEN 0 ELSE len(lines) - len(kept) END::BIGINT AS n_removed
FROM result
"""
