"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language, the words that a bounded sample of labelled rows uses most, over their whole texts, make a raw-content zstandard dictionary, the most
frequent last, where a match costs least. A text is lower-cased, its white space made single spaces, and encoded in chunks against each dictionary (so that a
long text does not become its own dictionary); the sizes of all chunks are added up and the smallest sum wins, by the same rule at any length. The score is the margin to the runner-up
as a share of the runner-up's size; a reject threshold applies to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlogic.llm.common import checkpointed, quoted, ready, table, unused

#: Labelled documents per language that are learned from at most: the bound of the sample. Their texts are read whole.
SAMPLE_DOCS = 400
#: Bytes of a dictionary, and of the longest word in it, longer ones being cut into pieces of so many characters (languages without spaces have no others); languages
#: at most, as each worker holds a dictionary for each.
DICT_BYTES, WORD_BYTES, PIECE_CHARS, MOST_LANGS = 16_000, 64, 3, 1_000
#: Bytes of text compressed at once, and zstandard's level.
CHUNK, LEVEL = 2048, 6
#: Texts with a smaller margin are rejected.
MIN_SCORE = 0.01
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Not learned from: crc32(doc_id as text) mod 4 is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, lang): of each language the sample_docs doc_ids with the smallest hashes, however many rows each has.

    The distinct doc_ids of a language are estimated first; the hash threshold that follows from that leaves little more than the sample. Ids and
    languages alone are read. Rows without doc_id, lang or text teach nothing.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    sizes = checkpointed(labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")))
    if sizes.count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    near = labelled.join(F.broadcast(sizes), "lang").where(share < (2 * sample_docs + 20) / F.col("n")).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(share, "doc_id")
    return near.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= sample_docs).drop("__rank")


def dictionaries(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Language: dictionary content, from the words of sample()'s documents, each text once (of differing texts with one doc_id the least).

    Words are counted by the cluster; what the driver gets is at most dict_bytes / 2 words per language, of at most MOST_LANGS.
    """
    chosen = checkpointed(sample(docs, sample_docs))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    own = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    words = own.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where(F.col("word") != "")
    pieces = F.regexp_extract_all("word", F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))
    words = words.select("lang", F.explode(F.when(F.octet_length("word") <= WORD_BYTES, F.array("word")).otherwise(pieces)).alias("word"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    ranked = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= dict_bytes // 2)
    found: dict[str, list[bytes]] = {}
    for r in ranked.orderBy("lang", "k").select("lang", "word").collect():
        found.setdefault(r.lang, []).append(r.word.encode("utf-8", "surrogatepass"))
    return {lang: dictionary(ordered, dict_bytes) for lang, ordered in found.items()}


def dictionary(words: list[bytes], size: int) -> bytes:
    """Words, the most frequent first, as far as size goes, turned round."""
    out, total = [], 0
    for w in words:
        total += len(w) + 1
        if total > size:
            break
        out.append(w)
    return b" " + b" ".join(reversed(out)) + b" "


class Classifier:
    """contents: as dictionaries() returns."""

    def __init__(self, contents: dict[str, bytes]):
        self.langs, self.compressors = sorted(contents), []
        plain = {"format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        for lang in self.langs:
            data = contents[lang]
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=CHUNK, dict_size=len(data), **plain)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params))

    @staticmethod
    def chunks(data: bytes) -> list[bytes]:
        """Cut at spaces near every CHUNK bytes."""
        out, at = [], 0
        while len(data) - at > CHUNK + CHUNK // 4:
            cut = data.rfind(b" ", at + CHUNK // 2, at + CHUNK)
            cut = at + CHUNK if cut < 0 else cut
            out.append(data[at:cut])
            at = cut
        return [*out, data[at:]]

    def sizes(self, data: bytes) -> list[int]:
        parts = self.chunks(data)
        return [sum(len(c.compress(p)) for p in parts) for c in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, score); no letter or nothing learned: und, 0. Equal sizes: the first language by name, score 0."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        sizes = self.sizes(b" %b " % b" ".join(text.lower().encode("utf-8", "surrogatepass").split()))
        (best, i), (second, _) = sorted((n, i) for i, n in enumerate(sizes))[:2]
        return self.langs[i], (second - best) / second


def _classifier(contents: dict[str, bytes], text_column: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(contents)
        for batch in batches:
            found = [classify(x.as_py()) for x in batch.column(text_column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=names)

    return run


def classify(docs: DataFrame, contents: dict[str, bytes], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, the language and its score (by the names given, which docs must not have: ValueError).

    One pass without a shuffle, one row for each row, in which only the text is looked at. A null or empty text, or one without a letter, is und with score 0; so is
    any if nothing was learned; repeated rows are judged alike; an empty table gives an empty one. A text is held whole, in one worker.
    """
    if {pred.lower(), score.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {pred} or {score}")
    ready(docs.sparkSession)
    schema = ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema), f"{quoted(pred)} string, {quoted(score)} double"])
    return docs.mapInArrow(_classifier(contents, docs.columns.index("text"), [*docs.columns, pred, score]), schema)


def rejected(pred: Column, score: Column, min_score: float = MIN_SCORE) -> Column:
    """No letter, or a margin under min_score."""
    return (pred == UNKNOWN) | (score < min_score)


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without those that the classifier rejects. All columns stay as they are, whatever their names; null texts go, repeated rows stay or go together."""
    pred, score = unused(docs, "pred"), unused(docs, "score")
    found = classify(docs, dictionaries(docs), pred, score)
    return found.where(~rejected(F.col(pred), F.col(score), min_score)).drop(pred, score)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the language of all of `documents`, and whether a filter would reject it."""
    docs = table(spark, sf_dir, "documents")
    found = classify(docs.select("doc_id", "text"), dictionaries(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", rejected(F.col("lang_pred"), F.col("score")).alias("rejected"))
