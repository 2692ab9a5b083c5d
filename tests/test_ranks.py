"""Distributed ranks against pandas, and p values against known figures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradelens.operators.ranks import average_ranks, correlation_p, fifths, incomplete_beta, log_gamma, percent_ranks, spearman
from tradelens.sources.staging import numbered


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(8)
    n = 2000
    frame = pd.DataFrame({"k": rng.choice(["a", "b", "c"], n, p=[0.8, 0.19, 0.01]), "x": rng.integers(0, 30, n).astype(float), "y": rng.normal(size=n), "id": np.arange(n)})
    frame.loc[frame.index < 700, "x"] = 7.0  # one value that a third of the rows have
    return frame, spark.createDataFrame(frame).repartition(7)


def test_numbers(spark, world):
    frame, df = world
    got = numbered(df, F.desc("y"), "id", parts=5).toPandas().sort_values("place")
    assert got.place.tolist() == list(range(1, 2001)) and got.y.is_monotonic_decreasing
    each = numbered(df, "x", "id", keys=["k"], parts=6).toPandas()
    want = frame.sort_values(["x", "id"]).groupby("k").cumcount() + 1
    assert each.set_index("id").place.sort_index().tolist() == want.sort_index().tolist()
    assert numbered(df.limit(0), "x").count() == 0
    odd = numbered(spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, x int"), "x", keys=["k"])
    assert sorted((str(r.k), r.x, r.place) for r in odd.collect()) == [("None", 1, 1), ("None", 2, 2), ("a", 5, 1)]


def test_ranks(world):
    frame, df = world
    got = percent_ranks(average_ranks(df, ["k"], "x", ["id"], "r"), [], "x", ["id"], "p").toPandas().set_index("id").sort_index()
    assert np.allclose(got.r, frame.groupby("k").x.rank()) and np.allclose(got.p, frame.x.rank(pct=True))
    by_key = percent_ranks(df, ["k"], "x", ["id"], "p").toPandas().set_index("id").sort_index()
    assert np.allclose(by_key.p, frame.groupby("k").x.rank(pct=True))


def test_spearman_and_fifths(spark, world):
    frame, df = world
    got = {r.k: (r.n, r.rho) for r in spearman(df, ["k"], "x", "y", ["id"]).collect()}
    for k, g in frame.groupby("k"):
        assert got[k] == (len(g), pytest.approx(g.x.rank().corr(g.y.rank())))
    flat = spark.createDataFrame([(1.0, float(i), i) for i in range(20)] + [(None, 0.0, 99)], "x double, y double, id int")
    assert tuple(spearman(flat, [], "x", "y", ["id"]).first()) == (20, None) and spearman(flat.limit(3), [], "y", "x", ["id"]).first().rho is None
    cut = fifths(df, [], "x", ["id"]).toPandas().set_index("id").sort_index()
    want = pd.qcut(frame.sort_values(["x", "id"]).x.reset_index().index.to_series(index=frame.sort_values(["x", "id"]).index), 5, labels=False)
    assert cut.fifth.tolist() == want.sort_index().tolist()


def test_p_values(spark):
    known = [(0.5, 12, 0.0979), (0.9, 10, 0.00038716), (0.0, 30, 1.0), (-0.3, 50, 0.034276), (1.0, 10, 0.0), (0.05, 1000, 0.114085)]
    rows = spark.createDataFrame(known, "rho double, n long, want double").withColumn("p", correlation_p(F.col("rho"), F.col("n"))).collect()
    for r in rows:
        assert r.p == pytest.approx(r.want, rel=2e-3, abs=1e-9)
    beta = spark.createDataFrame([(a, b, x) for a in (0.5, 1.0, 4.0) for b in (0.5, 2.0) for x in (0.1, 0.5, 0.93)], "a double, b double, x double")
    for r in beta.withColumns({"i": incomplete_beta(F.col("a"), F.col("b"), F.col("x")), "g": log_gamma(F.col("a") + 0.25)}).collect():
        u = (np.arange(400_000) + 0.5) / 400_000  # with u**2 for the argument the ends are smooth
        w = lambda top, a=r.a, b=r.b: (2 * (u * math.sqrt(top)) ** (2 * a - 1) * (1 - (u * math.sqrt(top)) ** 2) ** (b - 1)).mean() * math.sqrt(top)
        whole = math.gamma(r.a) * math.gamma(r.b) / math.gamma(r.a + r.b)
        assert r.i == pytest.approx(w(r.x) / whole, rel=1e-4) and r.g == pytest.approx(math.lgamma(r.a + 0.25), rel=1e-10)
