"""Whitening against numpy over all rows."""

import math

import numpy as np
import pytest

from gridlogic.llm import whitening

SMALL = "/root/testdata/sf0.001"


def brute(x, k):
    n = len(x)
    sums = x.sum(0)
    c = (x - sums // n) - (sums % n) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:k]
    return c @ (u[:, order] / np.sqrt(e[order])), ((n * x.astype(object) - sums) ** 2).sum(1), e[order] / np.trace(v)


def test_query_against_numpy(spark):
    got = whitening.query(spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(rows.embedding).astype(float)).astype(np.int64) + 1_000_000
    white, deviation, explained = brute(x, 32)
    mine = got.whitened.to_numpy().reshape(len(x), -1)
    assert mine.shape == (len(x), 32)
    np.testing.assert_allclose(mine * np.sign((mine * white).sum(0)), white, atol=1e-7)
    assert (got.deviation.to_numpy().reshape(len(x), -1) == deviation[:, None]).all()
    np.testing.assert_allclose(got.explained[:32], explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert set(got.n) == {len(x)}


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(v) for v in rng.normal(size=3)], "x") for i in range(20)]
    odd = [(50, None, "x"), (51, [], "x"), (52, [1.0, None, 2.0], "x"), (53, [1.0, math.nan, 2.0], "x"), (54, [math.inf, 0.0, 1.0], "x"), (55, [1.0, 2.0], "x"), (None, good[0][1], None)]
    df = spark.createDataFrame(good + odd + good[:2], "id long, embedding array<double>, `white ned` string")
    rows, model = whitening.whiten(df, components=2)
    got = rows.collect()
    assert sorted(str(r.id) for r in got) == sorted([*map(str, range(20)), "None", "0", "1"])
    assert model.n == 23 and all(len(r.whitened) == 2 for r in got)
    assert len({tuple(r.whitened) for r in got if r.id in (0, None)}) == 1
    assert whitening.identity_error(rows, model) < 1e-9


def test_extremes(spark):
    """Entries that no long holds in 64ths, equal vectors, one row, none."""
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], "id long, embedding array<double>")
    rows, model = whitening.whiten(df)
    got = {r.id: r for r in rows.collect()}
    top, shift = 64 * (1 << 55), 1_000_000
    x = {1: [top + shift, shift], 2: [-top + shift, 64 + shift], 3: [shift, 128 + shift]}
    assert model.sums == [3 * shift, 3 * shift + 192]
    for i, v in x.items():
        want = sum((3 * a - s) ** 2 for a, s in zip(v, model.sums))
        assert got[i].deviation is None if want >= 10**38 else int(got[i].deviation) == want
    for rows_in in ([(1, [2.0, 3.0])], [(1, [2.0, 3.0])] * 4):
        rows, model = whitening.whiten(spark.createDataFrame(rows_in, "id long, embedding array<float>"))
        assert [(list(r.whitened), int(r.deviation)) for r in rows.collect()] == [([], 0)] * len(rows_in) and whitening.identity_error(rows, model) == 0
    rows, model = whitening.whiten(spark.createDataFrame([], "id long, embedding array<float>"))
    assert model is None and rows.columns == ["id", "whitened", "deviation"] and rows.isEmpty()


def test_clashing_names(spark):
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([([1.0], 1)], "embedding array<double>, Whitened int"))
