"""Spelling variants: pairs of words one edit apart, by merging the light subtrees of a trie with one character skipped or replaced.

The trie of all words is a table of edges (node, character, size). Each node's largest subtree is its heavy child; the end of a word is a child too, but never the
heavy one. Only what hangs on light edges moves, and a word has log2(words) + 1 of them at most, whatever its length. Below a node with heavy child h, each light
word `prefix + c + rest` is merged three times:

* its character skipped: `prefix + rest` (of a run of equal characters the last, so that a pair is met once),
* the heavy subtree's character skipped: what coincides with it is `prefix + h + c + rest`,
* its character replaced: `prefix + h + rest` in the heavy subtree, and all light words with the same rest coincide with each other.

Terminals that coincide are equal strings, found by one grouping; each pair of words one edit apart meets exactly once, at the node where they part. A group holds
at most the near words of one string, so no more than its alphabet times its length. Nodes are known by a hash of their prefix; two nodes with one hash would
share a heavy character, which costs time but changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.llm.common import checkpointed, join_dealt, ready, table

#: A form occurs at least so many times as often as the word that it is a form of.
FORM_TIMES = 5
#: What the query takes for words: runs of these with so many characters and occurrences; one run in so many loses a character.
LETTERS, LEAST_CHARS, LEAST_COUNT, LOSSY = r"[A-Za-zÀ-ÿ]", 6, 5, 199

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, word): for each of a word's characters, and its end (empty), the node that it leaves and how many characters are before it."""
    for batch in batches:
        ids, words = batch.column("id").to_numpy(), batch.column("word").to_pylist()
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = np.repeat(ends - sizes, sizes)
        at = np.arange(len(starts)) - starts
        points = np.frombuffer("".join(f"{w}\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        powers = np.cumprod(np.full(int(sizes.max(initial=1)), _BASE, np.uint64))
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[at])])[:-1]
        node = before - before[starts]  # modulo 2^64
        node ^= node >> np.uint64(31)
        chars = pa.array([c for w in words for c in (*w, "")], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(at.astype(np.int32)), pa.array(node.view(np.int64)), chars], names=["id", "at", "node", "char"])


def light_edges(words: DataFrame) -> DataFrame:
    """words: (id, word), each once. (id, at, char, heavy): the edges that aren't the heaviest of their node, with that one's character. Ties: the smallest character."""
    edges = words.select("id", "word").mapInArrow(_edges, "id long, at int, node long, char string")
    sizes = edges.groupBy("node", "char").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.when(F.col("char") == "", F.lit(1)).otherwise(-F.col("n")), F.col("char"))
    nodes = sizes.groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("children"), F.min_by("char", rank).alias("heavy"))
    nodes = checkpointed(nodes.where(F.col("children") > 1).drop("children"))
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    return join_dealt(edges, nodes, ["node"], total, ["id"]).where(F.col("char") != F.col("heavy")).select("id", "at", "char", "heavy")


def merged(words: DataFrame) -> DataFrame:
    """words: (id, word, n). (target, kind, at, n, word): each light word under the strings that it becomes, and every word as itself."""
    light = light_edges(words).join(words, "id")
    before, after = F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)")
    skipped = F.when((F.col("char") != "") & (F.expr("substring(word, at + 2, 1)") != F.col("char")), F.concat(before, after))
    replaced = F.when(F.col("char") != "", F.concat(before, "heavy", after))
    put_in = F.concat(before, "heavy", F.expr("substring(word, at + 1)"))
    kinds = F.array(*(F.struct(t.alias("target"), F.lit(k).alias("kind")) for k, t in (("skipped", skipped), ("replaced", replaced), ("put in", put_in))))
    found = light.select(F.explode(kinds).alias("m"), "at", "n", "word").select("m.target", "m.kind", "at", "n", "word").where(F.col("target").isNotNull())
    return found.union(words.select(F.col("word").alias("target"), F.lit("itself").alias("kind"), F.lit(-1).alias("at"), "n", "word"))


def _best(near: Column) -> Column:
    """Of an array of (n, word) the one with the largest n, ties by code points, as (-n, word)."""
    return F.array_min(F.transform(near, lambda x: F.struct((-x["n"]).alias("less"), x["word"].alias("word"))))


def near_words(words: DataFrame) -> DataFrame:
    """words: (id, word, n), each word once. (word, near, best): how many words are one edit away, and the most frequent of them, as parts to be added up."""
    members = F.collect_list(F.struct("kind", "at", "n", "word")).alias("members")
    groups = merged(words).groupBy("target").agg(members, F.max(F.when(F.col("kind") == "itself", F.col("n"))).alias("own")).where(F.size("members") > 1)
    others = F.filter("members", lambda x: x["kind"] != "itself")
    # Rows of a group that replace at one place are near each other, and all are near the word that the target is, if it is one.
    place = F.transform(F.filter("members", lambda x: x["kind"] == "replaced"), lambda x: x["at"])
    groups = groups.select("target", "own", others.alias("others"), F.array_distinct(place).alias("places")).where(F.col("own").isNotNull() | (F.size("others") > 1))
    itself = groups.where(F.col("own").isNotNull())
    to_itself = itself.select(F.explode("others").alias("x"), "own", "target").select("x.word", F.lit(1).alias("near"), F.struct((-F.col("own")).alias("less"), F.col("target").alias("word")).alias("best"))
    from_itself = itself.where(F.size("others") > 0).select(F.col("target").alias("word"), F.size("others").alias("near"), _best(F.col("others")).alias("best"))
    by_place = groups.select("others", F.explode("places").alias("place")).select(F.expr("filter(others, x -> x.kind = 'replaced' and x.at = place)").alias("same")).where(F.size("same") > 1)
    by_place = by_place.select(_best(F.col("same")).alias("first"), F.col("same"))
    second = F.expr("array_min(transform(filter(same, x -> x.word != first.word), x -> struct(-x.n as less, x.word as word)))")
    by_place = by_place.select("first", second.alias("second"), F.size("same").alias("size"), F.explode("same").alias("x"))
    among = by_place.select("x.word", (F.col("size") - 1).alias("near"), F.when(F.col("x.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    return to_itself.union(from_itself).union(among)


def follow(links: DataFrame) -> DataFrame:
    """links: (word, form), each word once, without circles. (word, root): where the forms end; paths are halved each round."""
    roots = checkpointed(links.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = checkpointed(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return roots


def spelling_variants(words: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """words: (word, n). One row a word: word, form, root, n, n_near, form_n.

    A word's form is the most frequent word one edit away (one code point more, less or other; ties: the smallest in code-point order), if that occurs at least times as often,
    else null with form_n; its root is where its forms end, itself without a form. Rows of one word are added up; null words are left out; an empty table gives
    an empty one. A word's length costs one row a character.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than their variants: times is 2 at least")
    ready(words.sparkSession)
    counted = words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted.withColumn("id", F.monotonically_increasing_id()))
    none = counted.select("word", F.lit(0).alias("near"), F.lit(None).cast("struct<less:bigint,word:string>").alias("best"), "n")
    found = near_words(counted).withColumn("n", F.lit(None).cast("long")).union(none).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    has_form = -F.col("best.less") >= times * F.col("n")
    found = checkpointed(found.select("word", F.when(has_form, F.col("best.word")).alias("form"), "n", "n_near", F.when(has_form, -F.col("best.less")).alias("form_n")))
    roots = follow(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n): runs of LETTERS, in lower case (A to Z only), one in LOSSY without one of its characters, of LEAST_CHARS and with LEAST_COUNT occurrences.

    Whole texts; a null text has no words; a null doc_id counts as empty text. Which runs lose a character follows from a CRC-32 of doc_id and run.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{LEAST_CHARS},}}"), F.lit(0))).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = runs.select("doc", F.translate("run", upper, upper.lower()).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    less = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = hashed.select(F.when(F.col("h") % LOSSY == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the words of all of `documents`, with what they are spelling variants of."""
    return spelling_variants(corpus_words(table(spark, sf_dir, "documents")))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: CRC-32 by a table of 256 entries; pairs by what is left after one deletion.
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256))::BIGINT AS i)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '{LETTERS}{{{LEAST_CHARS},}}')), '{_UPPER}', '{_UPPER.lower()}') AS run FROM documents
), counted AS (
  SELECT doc, run, count(*) AS n, hex(encode(doc || ':' || run)) AS h FROM runs GROUP BY ALL
), coded AS (
  SELECT run, n, list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17)::BIGINT)) AS bytes FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM coded, crc
), words AS (
  SELECT CASE WHEN h % {LOSSY} = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_CHARS} AND sum(n) >= {LEAST_COUNT}
), less AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word)))::INTEGER AS i FROM words)
), pairs AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest
), best AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS b, max(w.n) AS best_n FROM pairs JOIN words w ON w.word = b GROUP BY a
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {FORM_TIMES} * n THEN b END AS form, CASE WHEN best_n >= {FORM_TIMES} * n THEN best_n END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS reached, 0 AS k FROM formed UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN formed f ON f.word = c.reached WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(reached, k) AS root FROM chain GROUP BY word
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed JOIN ends USING (word)
"""
