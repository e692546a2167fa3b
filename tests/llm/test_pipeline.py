import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from gridlogic.llm import langid, mixing, simhash, tokenshards
from tests.llm.test_native import words
from tests.llm.test_simhash import slow_components, slow_fingerprint

SMALL = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_output"]


def test_run_equals_a_brute_force_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    classify = langid.Classifier(langid.dictionaries(docs))
    rows = [r for r in docs.collect() if (c := classify(r.text))[0] != langid.UNKNOWN and c[1] >= langid.MIN_SCORE]
    component = slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in rows])
    rows = [r for r in rows if component[r.doc_id, slow_fingerprint(r.text)] == r.doc_id]
    windows = set()
    for item in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(item.text)
        windows |= {tuple(w[p : p + 10]) for p in range(max(len(w) - 9, 1))}
    clean = lambda t: not any(tuple(w[p : p + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for p in range(len(w) - n + 1))
    rows = [r for r in rows if clean(r.text)]
    drawn = mixing.mix(spark.createDataFrame(rows, docs.schema), mixing.WEIGHTS, mixing.OTHER_WEIGHT).collect()
    t = Tokenizer.from_file(tokenshards.vocabulary_path())
    want, at = [], 0
    for r in sorted(drawn, key=lambda r: r.doc_id):
        ids = t.encode(r.text, add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = corpus_pipeline.run(spark, SMALL)
    assert [tuple(r) for r in got.orderBy("start").collect()] == want and len(want) > 50


def test_stages_keep_the_columns_and_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 0


def test_stages_take_nulls_ties_repeats_and_taken_names(spark):
    small = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    rows = [tuple(r) for r in small.collect()]
    long = "the house of the words is a long one and "
    rows += [(None, None, None, None, None), (5, None, "en", "src0", 0), (6, "", None, None, 0), (None, "the man and the house of the hill are here", "en", None, 3), rows[3], rows[3], (rows[3][0], "an other text of the same id is here", "en", "src0", 1), (900, long * 20_000, "en", "src1", 9)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __key string, `lang_pred` string")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(docs.count())
    assert 40 < counts[0] <= len(rows) - 3 and counts[1] < counts[0] and counts[2] <= counts[1]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == counts[-1]


def test_simhash_is_what_the_stage_uses():
    assert simhash.fingerprint("a b c") == slow_fingerprint("a b c")
