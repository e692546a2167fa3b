import random

import xxhash
from pyspark.sql import functions as F

from gridlogic.llm import common, simhash

DOCS = "doc_id long, text string, fp string, `key` string"


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in words).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(shingles))


def slow_components(nodes):
    """nodes: (doc_id, fp) pairs; by comparing all."""
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if (nodes[i][1] ^ nodes[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(nodes)):
        ids = [nodes[k][0] for k in range(len(nodes)) if find(k) == find(i) and nodes[k][0] is not None]
        out.setdefault(nodes[i], min(ids, default=None))
    return out


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(300)]
    base = " ".join(rng.choices(vocabulary, k=400))
    out = [None, "", " \t\n", "One", "one two", "A b C", "a b c d", base, base.upper(), base]
    for _ in range(40):
        words = base.split()
        words[rng.randrange(len(words))] = "x%d" % rng.randrange(9)
        out.append(" ".join(words))
    out += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))) for _ in range(60)]
    out.append(" ".join(rng.choices(vocabulary, k=200_000)))
    return out


def test_matches_brute_force(spark):
    rows = [(None if i == 8 else i // 2 * 2 + i % 2, t, "x", "y") for i, t in enumerate(texts())] + [(7, texts()[7], "x", "y")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    nodes = [(i, slow_fingerprint(t)) for i, t, *_ in rows]
    want = slow_components(nodes)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(((i, f"{f:016x}", want[i, f]) for i, f in nodes), key=str)


def linked(spark, fps, dense):
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    return {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.components(simhash.links(df, dense)).collect()}


def test_every_pair_within_two_bits_links_in_sparse_and_dense_buckets(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        center, weak = rng.getrandbits(64), rng.sample(range(64), 9)
        fps |= {center ^ sum(1 << b for b in rng.sample(weak, rng.randrange(5))) for _ in range(60)}
    fps |= {rng.getrandbits(64) for _ in range(40)} | {0, 1, 3, 7, 1 << 63, (1 << 63) | 1, (1 << 32) | 1}
    nodes = sorted(fps)
    brute = slow_components([(n, n) for n in nodes])
    for dense in (256, 4, 1):
        got = linked(spark, nodes, dense)
        classes, wanted = {}, {}
        for n in nodes:
            classes.setdefault(got.get(n, n), set()).add(n)
            wanted.setdefault(brute[n, n], set()).add(n)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, wanted.values())), dense


def test_pairs_are_exact(spark):
    rng = random.Random(9)
    base = rng.getrandbits(63)
    fps = [base] + [base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i, 64)][::7]
    fps = [f for f in set(fps) if f < 1 << 63]
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 10**9).collect()}
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert len(got) == len({tuple(sorted(p)) for p in got})


def test_one_of_each_group_stays(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(None, None, "x", "y"), (4, "one two", "x", "y")]
    df = spark.createDataFrame(rows, DOCS)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {r.component_id for r in simhash.near_duplicates(df).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_rows_with_one_id_and_taken_names(spark):
    rows = [(1, "same words here", "b", "y"), (1, "same words here", "a", "y"), (1, "same words here", "a", "y"), (2, "same words here", "a", "y"), (3, None, "__key", None), (None, "", None, None), (3, None, "__key", None), (None, "a text all of its own", "x", None), (None, "a text all of its own", "x", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, `__key` string, `a.b` string").withColumn("__text", F.create_map(F.lit(1), F.lit("m")))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "3", "None"]
    again = simhash.drop_near_duplicates(df.repartition(5, "__key"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, again.collect()))


def test_half_of_all_rows_are_copies_and_a_star(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = [(i, "one text that many share" if i % 2 else f"its own text {i} with {i * 7} words", "x", "y") for i in range(300)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    want = slow_components([(i, slow_fingerprint(t)) for i, t, *_ in rows])
    assert got == {i: want[i, slow_fingerprint(t)] for i, t, *_ in rows}
    star = [0] + [1 << i for i in range(62)] + [3 << i for i in range(60)]
    assert set(linked(spark, star, 4).values()) == {0}
    assert simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).count() == len(set(got.values()))


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(none).collect() == [] and simhash.drop_near_duplicates(none).collect() == []


def test_query_over_the_small_table(spark):
    got = simhash.query(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    nodes = [(d.doc_id, slow_fingerprint(d.text)) for d in docs]
    want = slow_components(nodes)
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in got] == [(i, f"{f:016x}", want[i, f]) for i, f in nodes]
