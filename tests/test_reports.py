"""Reports, boosted trees and the ingest of arriving files, on small tables."""

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from tradelens.operators import boosted, reports
from tradelens.streaming.ingest import latest, merge_trades, resolved_when_due

DAY = dt.date(2024, 1, 5)


def test_reports(spark):
    trades = spark.createDataFrame([("house", 1, "A", DAY, 0.9, 5.0), ("house", 1, "A", DAY, 0.9, 5.0), ("vendor", 1, "A", DAY, 0.9, 1.0), ("vendor", 2, "B", DAY, 0.9, 1.0), ("senate", 3, "C", None, 0.9, 1.0), ("house", None, None, DAY, 0.1, 1.0)], "source string, member_id int, ticker string, transaction_date date, ticker_confidence double, amount_est double")
    assert tuple(reports.reconcile(trades).first()) == (2, 1, 1)
    members = spark.createDataFrame([(1, "One", "house"), (2, "Two", "house")], "member_id int, full_name string, chamber string")
    filings = spark.createDataFrame([("u", "A", 10.0, "failed", DAY)], "filing_uuid string, ticker string, amount double, parse_status string, filed_date date")
    h = reports.health(members, filings, trades, {"predictions": members.limit(0)}).first()
    assert (h.transactions, h.transactions_with_ticker, h.transactions_unlinked_member, h.distinct_tickers, h.filings_failed, h.members, h.predictions) == (6, 5, 1, 3, 1, 2, 0)
    acts = spark.createDataFrame([("u", "def", "d", "e"), ("u", "def", "d", "e"), ("u", "TAX", "d", "e")], "filing_uuid string, issue_code string, description string, entity string")
    held = spark.createDataFrame([(1, "HSAS"), (1, "SSFI"), (1, "ZZ"), (2, "HSAS")], "member_id int, committee_id string")
    rows = reports.committee_alignment(trades, members, filings, acts, held).collect()
    assert [tuple(r) for r in rows] == [(1, "One", "house", "A", "HSAS,SSFI", 3, 11.0, 20.0)]
    runs = spark.createDataFrame([("x", "error", "boom", 2), ("x", "ok", None, 1), ("y", "error", "old", 1)], "source string, status string, note string, finished_at int")
    prices = spark.createDataFrame([("A",)], "ticker string")
    assert sorted(r.problem for r in reports.blocking_problems(prices, trades, runs, "B").collect()) == ["no prices of the benchmark B: no excess return is defined", "stage x failed: boom"]
    assert [(r.source, r.status) for r in reports.last_runs(runs).collect()] == [("x", "error"), ("y", "error")]


def test_boosted(spark):
    rng = np.random.default_rng(2)
    rows = [(f"T{t}", DAY + dt.timedelta(days=30 * k), float(a), None if t == 0 else float(b), float(0.2 * a + 0.01 * rng.normal())) for k in range(60) for t in range(10) for a, b in [rng.normal(size=2)]]
    panel = spark.createDataFrame(rows, "ticker string, date date, a double, b double, y double")
    folds = boosted.train(panel, ["a", "b"], "y", horizon=20, n_splits=2, n_trees=10).collect()
    assert len(folds) == 2 and all(r.ic > 0.6 and r.rmse < r.rmse_of_mean for r in folds)
    top = {r.feature: r.importance for r in boosted.importance(panel, ["a", "b"], "y", n_trees=5, repeats=1).collect()}
    assert top["a"] > 5 * abs(top["b"])


def test_stream(spark, tmp_path):
    source, store, known = (str(tmp_path / x) for x in ("in", "out", "known"))
    write = lambda name, rows: (tmp_path / "in").mkdir(exist_ok=True) or (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))
    write("a.json", [{"txn_id": "1", "x": 1}, {"txn_id": "2", "x": 2}])
    go = lambda: merge_trades(spark, source, "txn_id string, x int", store, known).awaitTermination()
    go()
    write("b.json", [{"txn_id": "2", "x": 3}, {"txn_id": "3", "x": 4}])
    go()
    go()
    assert sorted((r.txn_id, r.x) for r in latest(spark, store).select("txn_id", "x").collect()) == [("1", 1), ("2", 3), ("3", 4)]
    picks = spark.createDataFrame([(DAY, 21), (DAY, 126)], "as_of date, horizon_days int")
    assert resolved_when_due(picks, "2024-03-01").count() == 1 and picks.filter(F.lit(True)).count() == 2
