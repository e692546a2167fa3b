import struct
import zlib
from collections import Counter

import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from gridlogic.llm import langid as I

DOCS = "doc_id long, text string, lang string, source string, `__pred` string"


def test_held_out_accuracy_and_contract(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = I.query(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    langs = {x.lang for x in docs.values()}
    assert {r.lang_pred for r in got} <= langs | {I.UNKNOWN}
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.95


def slow_dictionaries(docs, sample_docs=400, size=16_000):
    """The same by loops over all rows: sample by hash, words of whole texts, the most frequent last."""
    share = lambda i: (xxhash.xxh64_intdigest(struct.pack("<q", i), 42) % (1 << 40)) / (1 << 40)
    out = {}
    for lang in {r.lang for r in docs} - {None}:
        own = {r.doc_id: r.text for r in docs if r.lang == lang and r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
        counts = Counter(w for i in sorted(own, key=lambda i: (share(i), i))[:sample_docs] for w in own[i].lower().split() if len(w.encode()) <= 64)
        best, total = [], 0
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode())):
            total += len(w.encode()) + 1
            if total > size:
                break
            best.insert(0, w)
        if best:
            out[lang] = (" " + " ".join(best) + " ").encode()
    return out


def slow_language(text, contents):
    """Each chunk compressed by a fresh compressor, sizes added up."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    left, sums = (" " + " ".join(text.lower().encode().decode("ascii", "surrogateescape").split()) + " ").encode("ascii", "surrogateescape"), Counter()
    plain = dict(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    while left:
        cut = len(left)
        if cut > 2048 + 512:
            cut = left.rfind(b" ", 1024, 2048)
            cut = 2048 if cut < 0 else cut
        for lang, data in contents.items():
            params = zstandard.ZstdCompressionParameters.from_level(6, source_size=2048, dict_size=len(data), **plain)
            sums[lang] += len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(left[:cut]))
        left = left[cut:]
    (first, lang), (second, _) = sorted((n, k) for k, n in sums.items())[:2]
    return lang, (second - first) / second


def test_query_equals_a_brute_force_version(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    contents = slow_dictionaries(docs)
    assert I.dictionaries(spark.read.parquet(f"{d}/documents.parquet")) == contents
    got = {r.doc_id: r for r in I.query(spark, d).collect()}
    for r in docs[:300]:
        lang, score = slow_language(r.text, contents)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].rejected) == (lang, score < 0.01) and got[r.doc_id].score == pytest.approx(score)


def test_repeated_ids_do_not_crowd_a_language_out(spark):
    many = spark.range(50_000).select((F.col("id") % 5).alias("doc_id"), F.lit("das haus und der hund").alias("text"), F.lit("de").alias("lang"))
    few = spark.range(100, 1100).select(F.col("id").alias("doc_id"), F.lit("the house and the dog").alias("text"), F.lit("en").alias("lang"))
    assert set(I.dictionaries(many.unionByName(few))) == {"de", "en"}
    assert {r.lang: r["count"] for r in I.sample(many.unionByName(few)).groupBy("lang").count().collect()} == {"de": sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(5)), "en": 400}


def rows():
    en, de = "the house of the man is on the hill and the dog runs. ", "das haus von dem mann ist auf dem berg und der hund rennt. "
    out = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de", "s", "y") for i in range(60)]
    return out + [(100, None, "en", "s", "y"), (101, "", None, "s", "y"), (102, "123 !?", "de", "s", "y"), (None, en, "en", "s", "y"), (103, en.upper(), None, "s", "y"), (103, en.upper(), None, "s", "y"), (104, de * 20_000, None, None, None)]


def test_edges(spark):
    df = spark.createDataFrame(rows(), DOCS)
    found = I.classify(df, I.dictionaries(df)).collect()
    assert len(found) == len(rows())
    for r in found:
        want = I.UNKNOWN if not r.text or r.doc_id == 102 else "en" if "the" in r.text.lower().split() else "de"
        assert r["lang_pred"] == want, r
    kept = I.keep_identified(df)
    assert kept.columns == df.columns
    assert kept.count() == len(rows()) - 3


def test_only_learns_from_the_training_fold(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    df = spark.createDataFrame([(i, f"wrong{i} words here", "zz", "s", "y") for i in held] + rows(), DOCS)
    assert set(I.dictionaries(df)) == {"en", "de"}


def test_nothing_to_learn_from(spark):
    for data in ([], [(1, "text", None, "s", "y")]):
        df = spark.createDataFrame(data, DOCS)
        assert [r["lang_pred"] for r in I.classify(df, I.dictionaries(df)).collect()] == [I.UNKNOWN] * len(data)
    one = spark.createDataFrame([(3, "text here", "en", "s", "y")], DOCS)
    assert I.classify(one, I.dictionaries(one)).first()["lang_pred"] == "en"


def test_taken_names(spark):
    df = spark.createDataFrame(rows(), DOCS).withColumnsRenamed({"source": "score"})
    assert I.keep_identified(df.withColumn("__score", F.lit(1))).columns == [*df.columns, "__score"]
    with pytest.raises(ValueError):
        I.classify(df, {})


def test_a_language_without_spaces_is_learned(spark):
    import random

    rng = random.Random(3)
    signs = [chr(0x4E00 + 37 * i) for i in range(120)]
    parts = ["".join(rng.choices(signs, k=2)) for _ in range(60)]
    words = {"en": [f"eng{i}ish" for i in range(50)], "de": [f"deu{i}sch" for i in range(50)]}
    rows = []
    for i in range(160):
        lang = ("zh", "en", "de", "zh")[i % 4]
        text = "".join(rng.choices(parts, k=60)) if lang == "zh" else " ".join(rng.choices(words[lang], k=40))
        rows.append((i, lang, text))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    learned = I.dictionaries(docs)
    assert set(learned) == {"zh", "en", "de"}
    got = I.classify(docs, learned).collect()
    assert all(r.lang_pred == r.lang for r in got)
