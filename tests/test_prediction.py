"""The panel's features against plain Python, planted factors in the weights, and the record of picks."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradelens.operators import panel, picks, weights

DAY = dt.date(2024, 1, 5)


def days(n):
    return dt.timedelta(days=n)


def test_features(spark):
    rng = random.Random(3)
    spine = [(t, DAY + days(7 * k)) for t in "AB" for k in range(60)]
    trades = [(rng.choice("AB"), rng.randint(1, 6), DAY + days(rng.randint(-200, 420)), rng.choice([1, -1]), float(rng.randint(1, 50)), rng.choice([0.5, 1.0, 2.0])) for _ in range(160)]
    got = {(r.ticker, r.date): r for r in panel.politician_features(spark.createDataFrame(spine, "ticker string, date date"), spark.createDataFrame(trades, "ticker string, member_id int, filed_date date, direction int, amount_est double, mweight double"), 40.0).collect()}
    for t, d in spine:
        seen = [x for x in trades if x[0] == t and x[2] <= d]
        near, far = [x for x in seen if x[2] > d - days(90)], [x for x in seen if x[2] > d - days(270)]
        gross, decay = sum(x[4] for x in near), [0.5 ** ((d - x[2]).days / 40) for x in far]
        want = [
            sum(x[4] * x[3] for x in near) / gross if near else 0, sum(x[4] * x[3] * x[5] for x in near) / gross if near else 0, len({x[1] for x in near if x[3] > 0}), len({x[1] for x in near}),
            np.mean([x[3] > 0 for x in near]) if near else 0.5, np.log1p(gross), max((x[5] for x in near), default=1.0),
            sum(x[4] * x[3] * x[5] * w for x, w in zip(far, decay)) / sum(x[4] * w for x, w in zip(far, decay)) if far else 0, (d - max(x[2] for x in seen)).days if seen else 365,
        ]
        assert list(got[t, d])[2:] == pytest.approx(want)


def test_other_features(spark):
    spine = spark.createDataFrame([("A", DAY + days(100 * k)) for k in range(4)], "ticker string, date date")
    reports = [("A", DAY - days(80), 5.0), ("A", DAY + days(10), 0.5), ("A", DAY + days(101), None), ("A", DAY + days(190), 0.7)]
    rows = panel.earnings_features(spine, spark.createDataFrame(reports, "ticker string, report_date date, surprise double")).orderBy("date").collect()
    assert [tuple(r)[2:] for r in rows] == [(2.0, 80.0, 1.0, 0.0), (0.5, 90.0, 1.0, 2.0), (0.7, 10.0, 0.0, 2.0), (0.7, 110.0, 1.0, 2.0)]
    spend = [("A", DAY - days(400), 10.0), ("A", DAY - days(10), 30.0)]
    rows = panel.lobbying_features(spine, spark.createDataFrame(spend, "ticker string, period_end date, amount double")).orderBy("date").collect()
    assert [r.lobby_yoy for r in rows] == [2.0, 2.0, 2.0, 2.0] or [round(r.log_lobby_12m, 4) for r in rows] == [round(float(np.log1p(30)), 4)] * 4
    themes = spark.createDataFrame([("ai", DAY - days(3), 1.5), ("energy", DAY + days(50), -2.0)], "theme string, date date, z double")
    rows = panel.event_features(spine, themes, spark.createDataFrame([("A", "Technology")], "ticker string, sector string")).orderBy("date").collect()
    assert [(r.ai_x_sector, r.energy_x_sector, r.event_beta) for r in rows] == [(1.5, 0.0, 1.5)] * 4
    assert panel.theme_panel(themes).filter("theme = 'ai'").count() == 54


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(70):
        for t in range(12):
            x = rng.normal(size=7)
            rows.append((f"T{t:02d}", DAY + days(7 * k), *map(float, x), float(0.05 * x[0] - 0.03 * x[3] + rng.normal() * 0.02)))
    schema = "ticker string, date date, " + ", ".join(f"{f} double" for f in weights.NAMES) + ", y_21 double"
    return spark.createDataFrame(rows, schema).cache()


def test_weights(spark, scores):
    row = weights.fit_weights(scores.withColumn("key", F.lit(1)), ["key"], "y_21").first()
    df = scores.toPandas()
    x, y = df[weights.NAMES].to_numpy(), df.y_21.to_numpy()
    xc = x - x.mean(axis=0)
    coef = np.linalg.solve(xc.T @ xc + 5 * np.eye(7), xc.T @ (y - y.mean()))
    assert row.n == len(df) and row.n_groups == 12
    assert row.weights == pytest.approx(weights.final_weights(coef, np.array(row.stability)), abs=1e-9)
    assert row.weights[0] > 3 * abs(row.weights[1]) and row.weights[3] < 0 and row.stability[0] == 1 and abs(sum(map(abs, row.weights)) - 1) < 1e-9
    few = weights.fit_weights(scores.limit(20).withColumn("key", F.lit(1)), ["key"], "y_21").first()
    assert few.weights == pytest.approx([1 / 7] * 7)


def test_backtest_and_picks(spark, scores):
    folds = weights.backtest(scores, 21, n_splits=3, n_null=10, n_boot=10).cache()
    rows = folds.orderBy("fold").collect()
    assert len(rows) == 3 and all(r.ic > 0.5 > r.null_p95 and r.long_short > 0 and r.hit_rate > 0.6 for r in rows)
    assert all((r.test_start - r.train_until).days == 36 for r in rows)
    summary = weights.backtest_summary(folds)
    s = summary.first()
    assert s.beats_null and s.confidence == pytest.approx(min(0.8, max(0.2, 0.3 + 6 * (s.mean_ic - s.null_p95)))) and s.deflated_ic < s.mean_ic and s.verdict == "above the null in every fold"
    w = weights.fit_weights(scores.withColumn("horizon_days", F.lit(21)), ["horizon_days"], "y_21")
    found = picks.generate(scores, w, summary, 3).collect()
    top = sorted((r for r in found if r.end == "top"), key=lambda r: r.place)
    assert [r.place for r in top] == [1, 2, 3] and top[0].score >= top[1].score and top[0].percentile == 1.0 and len(found) == 6
    assert top[0].score == pytest.approx(sum(top[0].attribution.values())) and top[0].expected_excess == pytest.approx(top[0].score * s.expected_scale)


def test_scoreboard(spark, scores):
    dates = pd.date_range(DAY, DAY + days(600))
    prices = [(f"T{t:02d}", d.date(), 100.0 * (1 + 0.0005 * t) ** k, 100.0) for t in range(12) for k, d in enumerate(dates)]
    panel_ = spark.createDataFrame(prices, "ticker string, date date, px double, bpx double")
    history = picks.simulate(scores, panel_, 21, top_n=2, n_boot=2).cache()
    rows = history.collect()
    assert rows and all(r.excess_return == pytest.approx((1 + 0.0005 * int(r.ticker[1:])) ** 30 - 1) for r in rows if r.resolved)
    assert sorted({r.as_of for r in rows})[0] >= DAY + days(7 * 30)
    chain = picks.curve(history).orderBy("as_of").collect()
    assert all((b.as_of - a.as_of).days >= 30 for a, b in zip(chain, chain[1:])) and len(chain) > 3
    board = picks.scoreboard(history).first()
    growth = np.prod([1 + r.pick for r in chain]) - 1
    assert board.cumulative_return == pytest.approx(growth) and board.cumulative_return < 20 and board.n_chained == len(chain)
    assert board.annualized_excess == pytest.approx((1 + growth) ** (365.25 / (len(chain) * 21 * 1.45)) - 1)
    late = spark.createDataFrame([(DAY + days(595), 21, "T00", 1, 0.5)], "as_of date, horizon_days int, ticker string, place int, score double")
    assert not picks.resolve(late, panel_).first().resolved
