"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from gridlogic.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def value(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SMALL)
    rows, names = got.collect(), sorted(got.columns)
    assert rows
    if name not in catalog.ORACLES:
        return
    want = con.execute(catalog.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert sorted([value(r[c]) for c in names] for r in rows) == sorted([value(r[i]) for i in order] for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_generated_instances_return_the_layouts_that_were_placed(spark):
    from pyspark.sql import functions as F

    from gridlogic.functions import layout as L
    from gridlogic.functions import score, text
    from gridlogic.operators.hold import held

    own = catalog.QUERIES["generated_instances"](spark, SMALL)
    judged = [
        held(own, model=L.compact(L.parse_art(F.col(f"ascii_{v}"))), asked=text.parse_query(F.col("query_relation"))).select("num_components", F.size("model").alias("n"), (score.answer_from_layout(F.col("model"), F.col("asked.obj1"), F.col("asked.obj2"), F.col("asked.query_type")) == F.col("label")).alias("right")).collect()
        for v in ("grid", "panel")
    ]
    assert all(r.n == r.num_components and r.right for rows in judged for r in rows) and len(judged[0]) == len(judged[1]) > 0
    assert own.where("coalesce(ascii_simple, '') = ''").isEmpty()
