"""SimHash near-dedup by deletion variants.

A fingerprint has 64 bits. Two that differ in at most two bits, cut into two segments of 32, have one segment that differs in at most one: either a
segment is equal (the other differs in up to two bits), or each differs in one. So the index holds both segments as they are, and the
first with each of its bits deleted in turn; equality joins on these variants find every pair, which is then verified.

Buckets of an index key with more than DENSE fingerprints are not paired: their members are indexed once more with the free bits
deleted (two of the other segment, or one), which is exact by itself: whoever shares such a key differs in those bits at most, four members at most
have it, and all link to its least. Work is linear in either case. Links join distinct fingerprints; components follow by contracting stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.llm.common import checkpointed, join_dealt, quoted, ready, table, unused

SHINGLE, SEED = 3, 42
#: Fingerprints in a bucket that are still compared in pairs.
DENSE = 256
#: Shingles hashed at once.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the 3-word shingles, repeats included; no word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if n > 1 or len(words) == SHINGLE else [b" ".join(words)]
        hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_py()) for x in batch.column("text")], dtype="<u8").view("<i8")
        yield batch.drop_columns(["text"]).append_column("fp", pa.array(found))


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, __text: hash of the text, fp: the fingerprint's bits as a long) and columns of type long that are named too, a row for each row of docs."""
    ready(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__text"), *more, F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_fingerprints, ", ".join(["doc_id long, __text long", *(f"{c} long" for c in more), "fp long"]))


def variants(fps: DataFrame) -> DataFrame:
    """(key, side, fp): index keys of distinct fingerprints. Tag 0: high segment; 1: low; 2+j: high without bit j, side being that bit."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    tagged = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(33))).alias("tag"))
    bit = F.expr("shiftleft(1L, tag - 2)")
    value = F.when(F.col("tag") == 0, high).when(F.col("tag") == 1, low).otherwise(high.bitwiseAND(F.bitwise_not(bit)))
    side = F.when(F.col("tag") < 2, F.lit(0)).otherwise(F.expr("cast(shiftrightunsigned(fp, 32 + tag - 2) & 1 as int)"))
    return tagged.select("tag", (F.col("tag").cast("long") * F.lit(1 << 32) + value).alias("key"), side.alias("side"), "fp")


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """(u, v): links among distinct fingerprints, which join all that are two or fewer bits apart (in dense buckets through the least of a group)."""
    sizes = variants(fps).groupBy("tag", "key").agg(F.count(F.lit(1)).alias("n"), F.max("side").alias("most"), F.min("side").alias("least"))
    sizes = checkpointed(sizes.where((F.col("n") > 1) & ((F.col("tag") < 2) | (F.col("least") < F.col("most")))).select("key", "n"))
    met = checkpointed(join_dealt(variants(fps), sizes, ["key"], sizes.agg(F.sum("n")).first()[0] or 0, ["fp"]).select("tag", "key", "side", "fp", "n"))
    few, many = met.where(F.col("n") <= dense), met.where(F.col("n") > dense)
    a, b = few.select("key", F.col("side").alias("s"), F.col("fp").alias("u")), few.select("key", F.col("side").alias("t"), F.col("fp").alias("v"), "tag")
    distinct_halves = F.when(F.col("tag") < 2, F.col("u") < F.col("v")).otherwise(F.col("s") < F.col("t"))
    paired = a.join(b, "key").where(distinct_halves & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")
    if many.isEmpty():
        return paired
    pairs = F.expr("flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> i * 32 + j)))")
    singles = F.expr("transform(sequence(0, 31), i -> i * 33)")
    freed = many.select("tag", "key", "fp", F.explode(F.when(F.col("tag") < 2, pairs).otherwise(singles)).alias("ij"))
    # the free bits lie in the low segment, or, where that is the key, in the high one; tag 2+j also frees bit j of the high segment
    keyed = freed.selectExpr("key", "ij", "fp", "if(tag = 1, 32, 0) as free", "if(tag < 2, 0L, shiftleft(1L, 30 + tag)) as wild")
    keyed = keyed.selectExpr("key", "ij", "fp", "fp & ~(shiftleft(1L, free + cast(ij div 32 as int)) | shiftleft(1L, free + ij % 32) | wild) as rest")
    least = keyed.groupBy("key", "ij", "rest").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    return paired.unionByName(least.select(F.explode("members").alias("u"), "v").where("u <> v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges (u, v), the least node that it reaches; by alternately contracting large and small stars.

    Each round is joins and minima over links, written to the checkpoint folder; only their count and a checksum come to the driver. The links of a node that
    many have become stars of are dealt over tasks.
    """
    own = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    n, last = own.count(), None
    while True:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_dealt(both.where("v > u"), least, ["u"], 2 * n, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_dealt(large, smallest, ["u"], n, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = checkpointed(small.unionByName(smallest.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = own.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return own.select(F.col("u").alias("node"), F.col("v").alias("root"))
        n, last = now[0], now


def groups(found: DataFrame, dense: int = DENSE) -> DataFrame:
    """(fp, root, copies, n, component_id) for each distinct fingerprint of found (fingerprints(), checkpointed): its component's least fingerprint, its own rows,
    its component's, and that one's smallest doc_id."""
    fps = checkpointed(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    roots = components(links(fps.select("fp"), dense))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep", "copies")
    whole = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("n"), F.count(F.lit(1)).alias("fps"))
    return join_dealt(rooted.select("fp", "root", "copies"), whole, ["root"], fps.count(), ["fp"], n="fps").drop("fps")


def with_groups(found: DataFrame, dense: int = DENSE) -> DataFrame:
    """found with root and component_id of those that share a component with another row, else nulls; the rows of one fingerprint are dealt by their number."""
    shared = checkpointed(groups(found, dense).where("n > 1").select("fp", "root", "copies", "component_id"))
    return join_dealt(found, shared, ["fp"], shared.agg(F.sum("copies")).first()[0] or 0, ["doc_id"], "left", n="copies")


def near_duplicates(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id), a row for each row of docs.

    Null and empty texts have the fingerprint zero and link like any other; a null doc_id counts as no id, and a component without any has a null id;
    repeated rows link as equal texts do. Other columns are ignored.
    """
    found = checkpointed(fingerprints(docs).select("doc_id", "fp"))
    component = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return with_groups(found, dense).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's columns, but for maps and variants, which have none."""
    plain = [F.col(quoted(f.name)) for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(*plain)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of docs, all columns as they are: that with the smallest doc_id (null last), of several such rows one by the hashes of text and row.

    Null and empty texts are one component. Rows that are alike in every column are one row before anything is joined, so that a row of a great many copies
    does not meet itself; an empty table stays empty; names in docs may be any.
    """
    key = unused(docs, "key")
    names = [F.col(quoted(c)) for c in docs.columns]
    one = lambda doc_id, text, row: F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), text.cast("string"), row.cast("string"))
    own = docs.select(*names, one(F.col("doc_id").cast("long"), F.xxhash64("text"), row_key(docs)).alias(key)).dropDuplicates([key])
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key(docs).alias("__row"))
    found = checkpointed(fingerprints(hashed, "__row"))
    rooted = with_groups(found).withColumn("root", F.coalesce("root", "fp"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("__text").alias("text"), F.col("__row").alias("row"))
    # joined on what rows are dealt by already, so that texts are dealt once
    winners = rooted.groupBy("root").agg(F.min(place).alias("w")).select(one(F.col("w.doc_id"), F.col("w.text"), F.col("w.row")).alias(key))
    return own.join(winners, key, "left_semi").select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: near duplicates among all of `documents`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
