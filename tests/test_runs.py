"""Failover, merging by buckets, runs of stages, the universe's fallback, documents by key, saved models."""

import datetime as dt

import pytest

from tradelens.operators import boosted, endpoints
from tradelens.plans.stages import Stage, run_log, run_stages, stored_universe, universe_tickers
from tradelens.sources.failover import csv_outcome, provider_order, replay, sync_report
from tradelens.streaming.ingest import latest, manifest, merge


def answers(spark, rows):
    return spark.createDataFrame(rows, "place int, ticker string, provider string, outcome string, n_rows int, note string")


def test_failover(spark):
    assert provider_order("yahoo") == ["yahoo", "stooq", "fmp"] and provider_order("x") == ["stooq", "yahoo", "fmp"]
    tickers = ["SPY", "AAPL", "MSFT"]
    rows = [(k, t, "stooq", "refused", 0, "daily limit") for k, t in enumerate(tickers)] + [(k, t, "yahoo", "rows", 1, None) for k, t in enumerate(tickers)]
    got = sync_report(replay(answers(spark, rows), ["stooq", "yahoo"]), "SPY", 1).first()
    assert (got.rows, got.wins["yahoo"], got.dead, got.calls["stooq"], got.status) == (3, 3, {"stooq": "daily limit"}, 1, "ok")
    all_refuse = [(k, t, p, "refused", 0, "blocked") for k, t in enumerate("ABCD") for p in ("stooq", "yahoo")]
    got = sync_report(replay(answers(spark, all_refuse), ["stooq", "yahoo"]), "SPY", 0).first()
    assert (got.rows, got.asked, got.none, len(got.dead)) == (0, 1, ["A"], 2) and got.status.startswith("FAILED") and "SPY" in got.status
    errors = [(k, f"T{k}", "stooq", "error", 0, "timeout") for k in range(9)] + [(k, f"T{k}", "yahoo", "rows" if k < 2 else "empty", 5, None) for k in range(9)]
    got = sync_report(replay(answers(spark, errors), ["stooq", "yahoo"]), "SPY", 4000).first()
    assert got.dead == {"stooq": "6 consecutive errors, last: timeout"} and got.calls["stooq"] == 6 and got.none == [f"T{k}" for k in range(2, 9)] and got.status.startswith("DEGRADED: only 2/9")
    kept = [(k, f"T{k}", "stooq", "rows" if k == 0 else "error", 5, "x") for k in range(12)]
    assert replay(answers(spark, kept), ["stooq"]).first().dead == {}  # it has given something
    assert sync_report(replay(answers(spark, []), ["stooq"]), "SPY", 0).first().status == "ok"
    texts = spark.createDataFrame([("Exceeded the daily hits limit",), ("<html>404</html>",), ("Date,Close\n2024-01-02,1",), (None,)], "t string")
    assert [r.o.outcome for r in texts.select(csv_outcome(texts.t).alias("o")).collect()] == ["refused", "empty", "rows", "empty"]


def test_merge_touches_its_buckets(spark, tmp_path):
    store = str(tmp_path / "s")
    table = lambda rows: spark.createDataFrame(rows, "k int, v int")
    whole = lambda: sorted(map(tuple, latest(spark, store).collect()))
    assert latest(spark, store) is None
    merge(spark, store, table([(k, 0) for k in range(500)] + [(7, 3)]), ["k"], 0, buckets=16)
    assert len(whole()) == 500 and (7, 3) in whole()
    found = merge(spark, store, table([(3, 1), (600, 2)]), ["k"], 1)
    changed = [b for b, n in found["at"].items() if n == 1]
    assert len(changed) <= 2 and len(found["at"]) == 16 and {(3, 1), (600, 2)} <= set(whole()) and len(whole()) == 501
    before = whole()
    merge(spark, store, table([(3, 1), (600, 2)]), ["k"], 1)
    assert whole() == before and manifest(spark, store)["number"] == 1
    merge(spark, store, table([]), ["k"], 2)
    assert whole() == before
    merge(spark, store, table([(k, 9) for k in range(500)]), ["k"], 3)
    merge(spark, store, table([(k, 10) for k in range(500)]), ["k"], 4)
    numbers = sorted(p.name for p in (tmp_path / "s" / "data").iterdir())
    assert numbers == ["number=3", "number=4"] and len(whole()) == 501 and (600, 2) in whole()


def test_stages(spark, tmp_path):
    calls, broken = [], {"prices"}

    def stage(name, needs=()):
        def run(_):
            calls.append(name)
            if name in broken:
                raise ValueError("no data for the benchmark")
            return 5

        return Stage(name, run, [*needs])

    stages = [stage("trades"), stage("prices"), stage("lobbying"), stage("returns", ["trades", "prices"]), stage("scores", ["returns"])]
    log = str(tmp_path / "log")
    assert run_stages(spark, stages, log, "v1") == {"trades": "ok", "prices": "error", "lobbying": "ok", "returns": "blocked", "scores": "blocked"}
    notes = {r.stage: r.note for r in run_log(spark, log).collect()}
    assert "no data for the benchmark" in notes["prices"] and notes["scores"] == "needs returns" and calls == ["trades", "prices", "lobbying"]
    broken.clear()
    assert run_stages(spark, stages, log, "v1") == {"trades": "skipped", "prices": "ok", "lobbying": "skipped", "returns": "ok", "scores": "ok"}
    assert set(run_stages(spark, stages, log, "v1").values()) == {"skipped"} and len(calls) == 6
    assert set(run_stages(spark, stages, log, "v2").values()) == {"ok"} and run_log(spark, log).count() == 13


def test_universe(spark):
    old = spark.createDataFrame([("A", dt.date(2020, 1, 1)), ("Z", dt.date(2019, 1, 1))], "ticker string, added_on date")
    new = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, rank int")
    stored = stored_universe(old, new, "2026-01-01")
    assert {r.ticker: str(r.added_on) for r in stored.collect()} == {"A": "2020-01-01", "B": "2026-01-01"}
    trades = spark.createDataFrame([("X", 0.9), ("Y", 0.9), ("Y", 0.9), ("Z", 0.1), (None, 1.0)], "ticker string, ticker_confidence double")
    assert [r.ticker for r in universe_tickers(stored, trades).orderBy("place").collect()] == ["A", "B"]
    assert [r.ticker for r in universe_tickers(stored.limit(0), trades, 1).orderBy("place").collect()] == ["Y"]


def test_documents_by_key(spark, tmp_path):
    members = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three")], "member_id int, full_name string")
    scores = spark.createDataFrame([(1, 90, 0.5), (1, 30, float("nan"))], "member_id int, horizon_days int, weight double")
    trades = spark.createDataFrame([(1, k, dt.date(2020, 1, 1) + dt.timedelta(days=k)) for k in range(25)] + [(2, 99, None), (None, 5, None)], "member_id int, txn_id int, transaction_date date")
    docs = endpoints.member_documents(members, scores, trades, page_rows=10)
    path = str(tmp_path / "m")
    endpoints.write_by_key(docs, "member_id", path, buckets=4)
    one = endpoints.read_by_key(spark, "member_id", 1, path, buckets=4)
    pages = one.orderBy("page").collect()
    assert [len(p.trades) for p in pages] == [10, 10, 5] and pages[0].trades[0].txn_id == 24 and [s.horizon_days for s in pages[0].scores] == [30, 90]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert endpoints.read_by_key(spark, "member_id", 3, path, buckets=4).first().trades == [] and endpoints.read_by_key(spark, "member_id", 77, path, buckets=4).count() == 0
    text = endpoints.json_documents(docs.filter("member_id = 1 and page = 2")).first().value
    assert '"weight":null' in text and '"full_name":"One"' in text
    endpoints.export_site({"one": endpoints.listed(members.orderBy("member_id"))}, str(tmp_path / "site"))
    assert spark.read.text(str(tmp_path / "site/api/one")).first().value.startswith('{"rows":[{"member_id":1')
    assert "generated_at" in spark.read.text(str(tmp_path / "site/api/meta")).first().value


def test_views_of_odd_trades(spark):
    none = spark.createDataFrame([], "member_id int, ticker string, amount_est double, filing_delay_days int")
    assert tuple(endpoints.summary_view(none).first()) == (0, 0.0, 0, 0, None, None, None) and endpoints.delay_view(none).count() == 0
    some = spark.createDataFrame([(1, "A", 1.0, d) for d in (-1, 0, 15, 16, 46, 181, None)], none.schema)
    assert [(r.bucket, r.n) for r in endpoints.delay_view(some).orderBy("place").collect()] == [("<0", 1), ("0-15", 2), ("16-30", 1), ("46-90", 1), ("180+", 1)]
    assert endpoints.summary_view(some).first().median_disclosure_delay == 16
    studied = spark.createDataFrame([("txn", "1", 2.0), ("txn", "2", -3.0), ("policy_event", "3", 9.0), ("txn", "4", None)], "scope string, key string, t_stat double")
    own = spark.createDataFrame([(1, "A", 1, 7)], "txn_id int, ticker string, direction int, member_id int")
    rows = endpoints.events_view(studied, own, spark.createDataFrame([(7, "Seven")], "member_id int, full_name string")).collect()
    assert sorted((r.key, r.ticker, r.full_name) for r in rows) == [("1", "A", "Seven"), ("2", None, None)]


def test_model_is_kept(spark, tmp_path):
    rows = [(f"T{k % 7}", dt.date(2020, 1, 1) + dt.timedelta(days=k), float(k % 11), float(k % 3), float(k % 11)) for k in range(400)]
    panel = spark.createDataFrame(rows, "ticker string, date date, a double, b double, y double")
    prepare, model = boosted._model(panel, ["a", "b"], "y", 5)
    boosted.save(model, str(tmp_path / "model"))
    again = boosted.load(str(tmp_path / "model"))
    first = lambda m: [r.pred for r in m.transform(prepare(panel)).orderBy("ticker", "date").limit(5).collect()]
    assert first(model) == pytest.approx(first(again))
    found = {r.feature: r for r in boosted.importance(panel, ["a", "b"], "y", n_trees=5, repeats=3, bucket_rows=100).collect()}
    assert found["a"].importance > 10 * abs(found["b"].importance) and found["a"].sd >= 0
