import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlogic.llm import tokenshards as T

DOCS = "doc_id long, text string, start long, ids string"
TEXTS = [None, "", "a", " a", "a ", "a  b", "a\n\nb", "x.\nY, z", "\n", "tab\tx", "nb sp", "é, ü.\nñ", "<|endoftext|> x", "don't 12 a3", "\r\nx", "ideo　graph", "a\x1cb", "😀 ok".encode("utf-16", "surrogatepass").decode("utf-16")]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.vocabulary_path())
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer_on_whole_texts(plain, monkeypatch):
    rng = random.Random(1)
    pieces = ["word", "Ünd", "the,", "x.", " ", " ", " ", "  ", "\n", "\n", "\t", "12", "'s", "$$", "é", "\xa0", "don't", "日本", "a'", "...", "<|endoftext|>", "ŉ", "\x1c", "\r\n", "'", "ǅ.", "e\u0301,"]
    texts = [x for x in TEXTS if x is not None] + ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(3000)] + ["long " * 30_000, "x" * 5_000, "\n\n" * 900 + "end"]
    want = [plain(x) for x in texts]
    for known in (T.STORE_WORDS, 5):
        monkeypatch.setattr(T, "STORE_WORDS", known)
        encode = T.WordEncoder(T.vocabulary_path())
        for at in (0, 700, 0):
            ids, starts = encode(pa.array(texts[at:], T.TEXT))
            assert [ids[i:j].tolist() for i, j in zip(starts, starts[1:])] == want[at:]
        assert len(encode.words) == len(encode.ids) <= known
    encode.by_words = False  # a tokenizer that doesn't cut at spaces
    ids, starts = encode(pa.array(texts[:9], T.TEXT))
    assert [ids[i:j].tolist() for i, j in zip(starts, starts[1:])] == want[:9]


def test_texts_are_taken_by_bytes():
    rows = [(i, None if i % 7 == 3 else "é" * (i % 5)) for i in range(50)] + [(99, "y" * 300)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.string())], names=["doc_id", "text"]) for part in (rows[:20], rows[:0], rows[20:])]
    got = [(ids, texts.to_pylist()) for ids, texts in T._slices(batches, 40)]
    assert [(i, t) for ids, texts in got for i, t in zip(ids, texts, strict=True)] == [(i, t or "") for i, t in rows]
    assert all(sum(len(t.encode()) for t in texts) <= 40 or len(texts) == 1 for _, texts in got) and len(got) < 12


def test_records_come_back_and_damage_is_seen(plain):
    framed = b"".join(T.frame(p) for p in (b"", b"abc", bytes(1000)))
    assert T.unframe(framed, 0) == b"" and T.unframe(framed, 16) == b"abc" and T.unframe(framed, 35) == bytes(1000)
    for at in (3, 9, 20, 30, 500):
        broken = bytearray(framed)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            [T.unframe(bytes(broken), o) for o in (0, 16, 35)]


def test_round_trip_in_order_with_repeated_and_null_ids(spark, tmp_path, plain):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, "again", 1, "x"), (3, "again", 1, "x"), (None, "no id", 1, "x"), (-5, "minus", 1, "x")]
    path = f"file://{tmp_path}/shards"
    manifest = T.write_token_shards(spark.createDataFrame(rows, DOCS), path, T.vocabulary_path(), shards=3)
    got = T.token_digests(T.read_token_shards(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    want = {}
    for i, t, *_ in rows:
        ids = plain(t or "") + [2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert sum(s["ids"] for s in manifest["shards"]) == at
    records = list(T.shuffled_records(path, seed=4))
    assert len(records) == len(rows) and [d for d, _ in records] != [d for d, _ in T.shuffled_records(path, seed=5)]
    assert sorted(len(x) for _, x in records) == sorted(r.n_tokens for r in got)
    assert json.loads((tmp_path / "shards/_manifest.json").read_text()) == manifest


def test_large_vocabularies_take_four_bytes():
    assert T.id_type(50_257, 2) == "<u2" and T.id_type(65_537, 2) == "<u4" and T.id_type(10, 70_000) == "<u4"


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert T.write_token_shards(spark.createDataFrame([], DOCS), path, T.vocabulary_path())["shards"] == []
    assert T.read_token_shards(spark, path).collect() == []


def test_query_over_the_small_table(spark, plain):
    d = "/root/testdata/sf0.001"
    got = T.query(spark, d).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    at = 0
    for r, d in zip(got, docs, strict=True):
        ids = plain(d.text) + [2]
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
