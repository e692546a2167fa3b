"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridlogic.llm import spelling

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=5):
    by_key, near = {}, {w: set() for w in counts}
    for w in counts:  # words one edit apart share a string with one character less; those pairs are checked one by one
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_key.setdefault(key, []).append(w)
    for group in by_key.values():
        for a in group:
            near[a].update(b for b in group if b != a and b not in near[a] and one_edit(a, b))
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "abc", "aé漢𝄞", "abcdefgh"][seed]
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))): rng.choice([1, 2, 5, 10, 50, 250]) for _ in range(250)}
    got = found(spelling.spelling_variants(spark.createDataFrame([*counts.items()], "word string, n long")))
    assert got == brute(counts)


def test_query_against_brute_force(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", r.text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    assert found(spelling.query(spark, SMALL)) == brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


def test_odd_input(spark):
    long = "ab" * 20_000
    rows = [(None, 5), ("word", 3), ("word", 4), ("words", 35), ("", 1), ("w", 9), (long, 5), (long + "c", 30), (long[:9_000] + "x" + long[9_001:], 1)]
    got = found(spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")))
    assert got["word"] == ("words", "words", 7, 1, 35) and got["words"] == (None, "words", 35, 1, None)
    assert got[""] == ("w", "w", 1, 1, 9)
    assert got[long] == (long + "c", long + "c", 5, 2, 30) and got[long[:9_000] + "x" + long[9_001:]] == (long, long + "c", 1, 1, 5)
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).isEmpty()
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long"), times=1)


def test_long_chain_of_forms(spark):
    counts = {"a" * k: 5**k for k in range(1, 13)}
    assert {r[1] for r in found(spelling.spelling_variants(spark.createDataFrame([*counts.items()], "word string, n long"))).values()} == {"a" * 12}


def test_words_of_odd_documents(spark):
    rows = [(None, "Lettere lettere " * 5), (3, None), (4, ""), (5, "short ÀÈÌÒÙÉ " * 6)]
    got = {r.word: r.n for r in spelling.corpus_words(spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit(1))).collect()}
    assert got == {"lettere": 10, "ÀÈÌÒÙÉ": 6}
