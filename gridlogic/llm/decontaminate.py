"""Benchmark decontamination: which documents hold a window of a benchmark item, word for word.

A window is ten consecutive words of an item (an item of fewer words is one window). The window's shingles of five words are its set; as
the whole set must be in the document, a prefix of one shingle in the order of rarity is enough for the join: the one that the fewest places
of the corpus hold. Places where that shingle stands are joined on its hash, placed and bounded (the window must fit into the document around it), and
verified word by word over the window. Windows go by an id; which items have them is looked up for what was found. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.llm.common import checkpointed, join_dealt, quoted, table, unused

WINDOW, SHINGLE = 10, 5
#: Bytes of windows (words, and 100 for each) that are broadcast at most; beyond that, places that may match travel to them.
BROADCAST_BYTES = 64 << 20
#: Hashes, or their last bits if there are more of them, that are broadcast to tell such places.
MASK = 1 << 21
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words(text: Column) -> Column:
    """Runs of digits, letters and what is beyond ASCII, A-Z in lower case; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingle_hash(array: str, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(F.col(array), at + i) for i in range(k)))


def window_id(w: Column) -> Column:
    return F.struct(F.xxhash64(w).alias("a"), F.xxhash64(F.lit(WINDOW), w).alias("b"))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wid, w) of each distinct window, its words; and (wid, item_id) of who has it (null ids are left out)."""
    own = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    cut = own.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))).alias("at"))
    cut = cut.select("item_id", F.slice("words", F.col("at") + 1, WINDOW).alias("w")).withColumn("wid", window_id(F.col("w")))
    return cut.groupBy("wid").agg(F.min("w").alias("w")), cut.where("item_id is not null").select("wid", "item_id").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(wid, size, k, o, h): the shingles of each window, of SHINGLE words or of all if there are fewer."""
    k = F.least(F.size("w"), F.lit(SHINGLE))
    spread = windows.select("wid", "w", F.size("w").alias("size"), k.alias("k"), F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("o"))
    own = F.coalesce(*(F.when(F.col("k") == n, shingle_hash("w", F.col("o"), n)) for n in range(1, SHINGLE + 1)))
    return spread.select("wid", "size", "k", "o", own.alias("h"))


def places(docs: DataFrame, ks: list[int]) -> DataFrame:
    """(doc_id, __text, words, at, h): a row for each shingle of k words of each document, for each k, made and used within one stage."""
    own = docs.select("doc_id", F.xxhash64("text").alias("__text"), words(F.col("text")).alias("words"))
    # outer, as an inner explode would have Spark test its input before, for which the text would be cut twice
    spread = own.select("doc_id", "__text", "words", F.explode_outer(F.when(F.size("words") >= min(ks), F.sequence(F.lit(0), F.size("words") - min(ks)))).alias("at"))
    hashes = [F.when(F.col("at") + k <= F.size("words"), shingle_hash("words", F.col("at"), k)) for k in ks]
    return spread.select("doc_id", "__text", "words", "at", hashes[0].alias("h") if len(ks) == 1 else F.explode_outer(F.array(*hashes)).alias("h"))


def having(found: DataFrame, hashes: DataFrame, n: int) -> DataFrame:
    """The rows of found whose h is one of at most n hashes; if n is over MASK, also some others, whose h is one in its last bits."""
    key = (lambda h: h) if n <= MASK else (lambda h: h.bitwiseAND(F.lit(MASK - 1)))
    return found.join(F.broadcast(hashes.select(key(F.col("h")).alias("__m")).distinct()), key(F.col("h")) == F.col("__m"), "left_semi")


def matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, __text, start, end, wid): every occurrence of a benchmark window, in word positions, end exclusive; and (wid, item_id, n) of all windows that may
    occur, n being an upper bound of how often."""
    windows, owners = map(checkpointed, benchmark_windows(benchmark))
    k = F.least(F.size("w"), F.lit(SHINGLE))
    size = windows.agg(F.sum(F.size("w") - k + 1).alias("shingles"), F.sum(F.octet_length(F.array_join("w", " ")) + 100).alias("bytes"), F.collect_set(k).alias("ks")).first()
    ks = sorted(size.ks) or [SHINGLE]
    shingles = checkpointed(window_shingles(windows))
    counts = checkpointed(having(places(docs, ks).select("h"), shingles, size.shingles or 0).groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    rated = shingles.join(counts, "h")  # a shingle that no place holds can't be in a match
    rarest = rated.groupBy("wid", "size", "k").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "h", "o")).alias("r"))
    whole = rarest.where(F.col("found") == F.col("size") - F.col("k") + 1).select("wid", "size", "r.n", "r.h", "r.o")
    prefix = checkpointed(whole.join(windows, "wid"))
    start = F.col("at") - F.col("o")
    if (size.bytes or 0) <= BROADCAST_BYTES:
        fits = (start >= 0) & (start + F.col("size") <= F.size("words"))
        met = places(docs, ks).join(F.broadcast(prefix), "h").where(fits & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("w")))
    else:  # of the places that may match, only the words around travel to the windows
        total = prefix.select("h", "n").distinct().agg(F.sum("n")).first()[0] or 0
        low = F.greatest(F.col("at") - WINDOW, F.lit(0))
        around = having(places(docs, ks), prefix, prefix.count()).select("doc_id", "__text", "at", "h", F.size("words").alias("n_words"), low.alias("low"), F.slice("words", low + 1, 2 * WINDOW + SHINGLE).alias("near"))
        met = join_dealt(around, prefix, ["h"], total, ["doc_id", "at"]).where((start >= 0) & (start + F.col("size") <= F.col("n_words")) & (F.slice("near", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.col("size")) == F.col("w")))
    found = checkpointed(met.select("doc_id", "__text", start.alias("start"), (start + F.col("size")).alias("end"), "wid"))
    return found, owners.join(prefix.select("wid", "n"), "wid")


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, __text, n_hit, combo) of the documents that hold some window, with the words covered; and (combo, items), the distinct item_ids of each combination of windows.

    Windows that the same items hold are alike, and documents that hold alike windows are one combination, whose items are gathered once: so documents do not multiply with
    items, however many share a passage. What is gathered for a document is bounded by its own words, for a combination by the benchmark.
    """
    found, owners = matches(docs, benchmark)
    grouped = found.groupBy("doc_id", "__text").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("reach"))

    def add(acc, s):
        new = F.greatest(s["end"] - F.greatest(s["start"], acc["reach"]), F.lit(0))
        return F.struct((acc["covered"] + new).alias("covered"), F.greatest(acc["reach"], s["end"]).alias("reach"))

    covered = grouped.select("doc_id", "__text", F.aggregate("spans", zero, add)["covered"].cast("long").alias("n_hit"))
    # A window's items as 128 bits and their number, whatever their order.
    own = F.struct(F.bit_xor(F.xxhash64("item_id")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "item_id")).alias("b"), F.count(F.lit(1)).alias("c"))
    alike = checkpointed(owners.groupBy("wid").agg(own.alias("held_by"), F.max("n").alias("n")))
    held = join_dealt(found.select("doc_id", "__text", "wid").distinct(), alike, ["wid"], found.count(), ["doc_id"])
    sets = F.array_sort(F.collect_set("held_by"))
    by_doc = checkpointed(held.groupBy("doc_id", "__text").agg(sets.alias("sets")).withColumn("combo", F.struct(F.xxhash64("sets").alias("a"), F.xxhash64(F.lit(1), "sets").alias("b"))))
    one_of = alike.groupBy("held_by").agg(F.min("wid").alias("wid"))
    combos = by_doc.groupBy("combo").agg(F.first("sets").alias("sets")).select("combo", F.explode("sets").alias("held_by"))
    items = combos.join(one_of, "held_by").join(owners.select("wid", "item_id"), "wid").groupBy("combo").agg(F.collect_set("item_id").alias("items"))
    named = by_doc.select(F.col("doc_id").alias("__i"), F.col("__text").alias("__t"), "combo")
    both = covered.join(named, covered["doc_id"].eqNullSafe(named["__i"]) & (covered["__text"] == named["__t"]), "left")
    return both.select("doc_id", "__text", "n_hit", "combo"), items


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs.

    Null and empty texts have no words; items without words have no window; rows with equal doc_id and text are judged alike, a null doc_id included; an empty benchmark hits
    nothing. Other columns of either table are ignored.
    """
    found, items = hits(docs, benchmark)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    digests = items.select("combo", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    found = found.join(digests, "combo", "left").drop("combo").withColumnsRenamed({"doc_id": "__id", "__text": "__hash"})
    own = docs.select("doc_id", F.xxhash64("text").alias("__text"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    both = own.join(found, own["doc_id"].eqNullSafe(found["__id"]) & (own["__text"] == found["__hash"]), "left")
    return both.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns as they are and whatever their names, without those that hold a window of an item. Null and empty texts stay; so does all, if the benchmark is empty."""
    key, other, own_id = (unused(docs, n) for n in ("hash_of_text", "hash_of_hit", "id_of_hit"))
    found = matches(docs, benchmark)[0].select(F.col("doc_id").alias(own_id), F.col("__text").alias(other)).distinct()
    own = docs.select(*(F.col(quoted(c)) for c in docs.columns), F.xxhash64("text").alias(key))
    return own.join(found, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(other)), "left_anti").drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all of `documents` against all of `benchmark`."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, words[p + 1 : least(p + 10, len(words))] AS w
  FROM (SELECT item_id, words, unnest(range(0, greatest(len(words) - 10, 0) + 1)) AS p FROM items WHERE len(words) > 0)
), lengths AS (
  SELECT DISTINCT len(w) AS n FROM windows
), cut AS (
  SELECT doc_id, n, unnest(range(0, len(words) - n + 1)) AS p, words FROM worded, lengths WHERE len(words) >= n
), found AS (
  SELECT doc_id, p, n, item_id FROM (SELECT doc_id, p, n, words[p + 1 : p + n] AS w FROM cut) JOIN windows USING (w)
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
