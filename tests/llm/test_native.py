"""Mixing, decontamination, chat formatting and line dedup against plain Python and SQL."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gridlogic.llm import chatformat as C
from gridlogic.llm import common
from gridlogic.llm import decontaminate as D
from gridlogic.llm import linededup as L
from gridlogic.llm import mixing as M
from gridlogic.llm import registry

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `h` string, copy string"


def as_rows(df):
    names = sorted(df.columns)
    return sorted((tuple(str(r[c]) for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SMALL)
    names = sorted(got.columns)
    want = con.execute(registry.ORACLES[name])
    order = [[x[0] for x in want.description].index(c) for c in names]
    exact = lambda v: repr(v) if isinstance(v, float) else str(v)
    assert sorted(tuple(exact(r[c]) for c in names) for r in got.collect()) == sorted(tuple(exact(r[i]) for i in order) for r in want.fetchall())


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "h", "c") for i, t, s in rows], DOCS)


def test_mixing_rates_and_edges(spark):
    rows = [(i, "x" * 10, "a" if i < 3000 else "b" if i < 4000 else None) for i in range(5000)]
    out = M.mix(docs(spark, rows), {"a": 0.2, "b": 0.5, "gone": 9.0}, 0.3)
    assert out.columns == docs(spark, rows).columns
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    for source, share in (("a", 0.2), ("b", 0.5), (None, 0.3)):
        assert abs(n[source] - 5000 * share) < 5 * (5000 * share) ** 0.5
    again = M.mix(docs(spark, rows).drop("copy"), {"a": 0.2, "b": 0.5, "gone": 9.0}, 0.3, trace=True).collect()
    keys = [r.mix_key for r in again]
    assert keys == sorted(keys) and [r.doc_id for r in again] != sorted(r.doc_id for r in again)


def test_mixing_large_rates_and_nothing(spark):
    assert M.mix(docs(spark, []), {"a": 1.0}, 1.0).collect() == []
    none = [(1, None, "a"), (2, "", "a"), (None, "yes", None), (None, "yes", None)]
    assert {r.text for r in M.mix(docs(spark, none), {"a": 1.0}, 1.0, epochs=40).collect()} <= {"yes"}
    many = M.mix(docs(spark, [(1, "x", "a"), (2, "y" * 1999, "b")]), {"a": 1.0}, 1.0).where("source = 'a'").count()
    assert abs(many - 1000) < 160  # a mean of 1000, whose exp(-mean) is no double
    for weights, trace in (({"a": -1.0}, False), ({"a": 1.0}, True)):
        with pytest.raises(ValueError):
            M.mix(docs(spark, []), weights, 1.0, trace=trace)
    odd = docs(spark, none).withColumnsRenamed({"h": "__key", "copy": "__class"})
    assert M.mix(odd, {"a": 1.0}, 1.0).columns == odd.columns


def test_a_source_of_one_short_document_is_drawn_in_parts(spark):
    rows = [(1, "x", "src0"), (2, "y" * 60_000, "src1"), (3, "z" * 40_000, None), (3, "z" * 40_000, None)]
    df = docs(spark, rows).drop("copy", "h")
    got = M.mix(df, M.WEIGHTS, M.OTHER_WEIGHT, trace=True).select("doc_id", "copy", "mix_key").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [(i, t, "en", s, 1) for i, t, s in rows])
    want = con.execute(f"SELECT doc_id, copy, mix_key FROM ({M.ORACLE_SQL})").fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
    mean = 0.25 / 0.9 * 140_001
    assert abs(sum(r.doc_id == 1 for r in got) - mean) < 6 * mean**0.5
    assert len({r.copy for r in got if r.doc_id == 1}) == sum(r.doc_id == 1 for r in got)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination_by_brute_force(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "Only Four short words"), (3, None), (4, "..."), (5, "solo"), (2, "only four SHORT words"), (None, "an item that has no id"), (7, " ".join(["the"] * 12)), (8, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    texts = [None, "", "clean text", f"before {long} after", "w0 w1 w2 w3 w4 w5 w6 w7 w8", "x W5-w6, w7 w8 w9 w10 w11 w12 w13 w14! y", "has only four short words inside, only four short words", "solo", "SOLO solo soloist", "the " * 25, "an item that has no id", "é " * 9, "w1 " * 50_000 + long]
    rows = [(i if i != 6 else None, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (3, "clean text", "s")]
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, words string")
    windows = set()
    for i, t in items:
        w = words(t)
        windows |= {(tuple(w[p : p + 10]), i) for p in range(max(len(w) - 9, 1))} if w else set()
    want = []
    for i, t, _ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x, _ in windows}:
            for p in range(len(w) - n + 1):
                for x, item in windows:
                    if tuple(w[p : p + n]) == x:
                        hit |= set(range(p, p + n))
                        found |= {item} - {None}
        names = sorted(map(str, found))
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    df = docs(spark, rows)
    for most, mask in ((10**6, 1 << 21), (0, 1 << 21), (0, 4), (10**6, 4)):
        monkeypatch.setattr(D, "BROADCAST_BYTES", most)
        monkeypatch.setattr(D, "MASK", mask)
        assert sorted(map(str, (tuple(r) for r in D.report(df, bench).collect()))) == sorted(map(str, want)), (most, mask)
    kept = D.remove_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((r[0], r[1])) for r, w in zip(rows, want, strict=True) if not w[-1])
    odd = df.withColumnsRenamed({"source": "__hash"}).withColumn("__hash_of_text", F.lit(1))
    assert D.remove_contaminated(odd, bench).columns == odd.columns and D.remove_contaminated(odd, bench).count() == kept.count()
    assert D.report(df, bench.limit(0)).where("contaminated").count() == 0 and D.report(docs(spark, []), bench).collect() == []


def test_a_passage_of_half_the_documents_and_of_many_items(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    passage = " ".join(f"p{i}" for i in range(14))
    df = docs(spark, [(i, f"a{i} {passage} z{i}" if i % 2 else f"own words {i}", "s") for i in range(200)])
    bench = spark.createDataFrame([(i, passage) for i in range(30)], "item_id long, text string")
    names = ",".join(sorted(map(str, range(30))))
    for most in (1 << 26, 0):
        monkeypatch.setattr(D, "BROADCAST_BYTES", most)
        got = {r.doc_id: r for r in D.report(df, bench).collect()}
        assert all((r.n_hit, r.n_items) == ((14, 30) if i % 2 else (0, 0)) for i, r in got.items()) and got[1].items_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert D.remove_contaminated(df, bench).count() == 100


def turns(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "f") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, formatted string")


NASTY = ["", "hi", "</turn>", "\\</turn>\n", "### user: x</turn>", "a: b", "\\", "\\\\", "<", "</turn", "n>", "###\\ x", "### ", "#", "\n", *("#" * n for n in range(2, 10)), "a ### b #### c", "\\" + "#" * 7 + "\\", "#\\###\\##", C.HARD, "日本 " * 3, "<\\/turn>", "x" * 50_000]


def test_chat_formatting_reads_back_what_went_in(spark):
    rows = [(k, i, role, text) for k, role in enumerate(["user", "assistant", "a: b", "</turn>", "x\\", "", "### ", "r###", "#####: "]) for i, text in enumerate(NASTY)]
    rows += [(90, 1, "assistant", None), (90, 0, None, "q"), (90, 1, "assistant", None), (None, None, "user", "x"), (None, 2, "assistant", "y")]
    formatted = C.format_conversations(turns(spark, rows))
    back = {r.conv_id: r for r in formatted.select("*", C.parse(F.col("formatted")).alias("back")).collect()}
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    assert set(back) == set(groups)
    for c, own in groups.items():
        got = back[c]
        assert [(b.role, b.text) for b in got.back] == [x[1:] for x in sorted(own)]
        for unit in got.formatted.split("</turn>")[:-1]:  # control strings mark turns and stand nowhere else
            unit = unit.removeprefix("\n")
            assert unit.startswith("###") and unit.count("###") == 1
        spans = [got.formatted[s.start : s.end] for s in got.loss_spans]
        assert len(spans) == sum(x[1] == "assistant" for x in own)
        plain = [b.text for b in got.back if b.role == "assistant" and not b.safe]
        assert [s for s, b in zip(spans, (b for b in got.back if b.role == "assistant"), strict=True) if not b.safe] == plain
    hard = {r.conv_id: r for r in C.digests(C.format_conversations(turns(spark, [(-7, 0, "user", C.HARD), (-7, 1, "assistant", C.HARD)]))).collect()}[-7]
    assert hard.loss_sha256 == hashlib.sha256(C.HARD.encode()).hexdigest() and hard.loss_chars == len(C.HARD)
    assert C.format_conversations(turns(spark, [])).collect() == []


def test_loss_digests_are_of_the_spans(spark):
    rows = [(k, i, role, text) for k, role in enumerate(["user", "assistant", "b"]) for i, text in enumerate(NASTY)]
    rows += [(9, i, "assistant" if i % 2 else "user", text) for i, text in enumerate(["é 😀", *NASTY])]
    formatted = C.format_conversations(turns(spark, rows))
    want = {k: "".join(text for c, _, role, text in rows if c == k and role == "assistant") for k in (0, 1, 2, 9)}
    sums = lambda df: {r.conv_id: (r.loss_chars, r.loss_sha256) for r in C.digests(df).collect()}
    right = {k: (len(v), hashlib.sha256(v.encode()).hexdigest()) for k, v in want.items()}
    assert sums(formatted) == right
    shifted = F.transform("loss_spans", lambda s: F.struct((s["start"] - 1).alias("start"), s["end"].alias("end")))
    for wrong in (shifted, F.slice("loss_spans", 2, 1000), F.slice("loss_spans", 1, 0)):
        got = sums(formatted.withColumn("loss_spans", wrong))
        assert got[0] == right[0] and got[1] != right[1] and got[9] != right[9]


def slow_dedup(rows):
    """First occurrences by (doc_id, null last), line."""
    places = {}
    for i, t in set(rows):
        lines = t.split("\n") if t is not None else []
        for p in range(max(len(lines) - 2, 1) if lines else 0):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip(" "):
                places.setdefault(w, []).append(((i is None, i or 0), p, (i, t)))
    gone = {}
    for found in places.values():
        for _, p, key in sorted(found, key=lambda x: (x[0], x[1]))[1:]:
            gone.setdefault(key, set()).update(range(p, p + 3))
    out = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        lost = {k for k in gone.get((i, t), ()) if k < len(lines)}
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in lost) if t is not None else None, len(lines), len(lost)))
    return out


def test_line_dedup_by_brute_force(spark):
    block = "one\ntwo\nthree"
    texts = [None, "", "single", "single", block, f"a\nb\n{block}\nc\nd", f"{block}\nfour", f"two\nthree\nfour\n{block}\n{block}", "\n\n\n\n", "\n\n\nx", "one\ntwo", "one\ntwo", "é\nü\nñ\n" * 3, "r\n" * 9, "\n".join(map(str, range(30_000))), "p\n" + "\n".join(map(str, range(100, 30_050)))]
    rows = list(enumerate(texts))
    rows[5] = (None, texts[5])
    rows += [(4, block), (40, " \n \n ")]
    got = L.dedup_lines(docs(spark, [(i, t, "s") for i, t in rows]), counts=True)
    assert sorted(map(str, ((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()))) == sorted(map(str, slow_dedup(rows)))
    assert L.dedup_lines(docs(spark, [])).collect() == [] and L.dedup_lines(docs(spark, [])).columns == docs(spark, []).columns


def test_line_dedup_leaves_other_columns_alone(spark):
    rows = [(1, "a\nb\nc\nd", "mine", 5, "s", "k"), (2, "a\nb\nc\ne", "mine", 6, None, "k"), (3, None, "mine", 7, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string, __id long, __starts string, `__KEPT` string")
    got = {r.doc_id: tuple(r) for r in L.dedup_lines(df).collect()}
    assert got == {1: rows[0], 2: (2, "e", *rows[1][2:]), 3: rows[2]}
    with pytest.raises(ValueError):
        L.dedup_lines(df.withColumn("N_lines", df.doc_id), counts=True)
    assert L.dedup_lines(df.withColumn("n_lines", df.doc_id)).columns == [*df.columns, "n_lines"]


def test_a_passage_of_many_items_in_many_documents(spark):
    passage, other = " ".join(f"w{i}" for i in range(15)), " ".join(f"v{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"{passage} d{i}" + (f" {other}" if i % 3 == 0 else "")) for i in range(300)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, f"x{i} {passage}") for i in range(200)] + [(1000, other), (1001, other)], "item_id long, text string")
    found, items = D.hits(docs, benchmark)
    assert sorted(len(r["items"]) for r in items.collect()) == [200, 202] and found.count() == 300  # two combinations, however many documents
    got = {r.doc_id: (r.n_items, r.items_sha256, r.n_hit) for r in D.report(docs, benchmark).collect()}
    digest = lambda ids: hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    assert got[1] == (200, digest(range(200)), 15) and got[3] == (202, digest([*range(200), 1000, 1001]), 27) and len(set(got.values())) == 2
