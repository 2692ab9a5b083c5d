"""Scalar functions, entity resolution and writing, on the cases that define them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tradelens.functions import scalars as s
from tradelens.sources.entities import match_members, resolve_tickers
from tradelens.sources.store import changed, check_integrity, export, json_rows, preserved, replace_partitions, set_values, updated, upsert


def apply(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_amounts(spark):
    got = apply(spark, s.parse_amount, "$1,001 - $15,000", "$15,001–$50,000", "1,000,001 - 5,000,000", "$50,001 -$100,000", "Over $50,000,000", "n/a", None, "$20,000", "7.5")
    more = apply(spark, s.parse_amount, "greater than $50,000,000", "More than $5", "+ $1,000", "$1,001+", "None")
    assert [(r.low, r.high) for r in more] == [(50_000_000, 100_000_000), (5, 10), (1000, 2000), (1001, 15000), (None, None)]
    assert [(r.low, r.high) for r in got] == [(1001, 15000), (15001, 50000), (1000001, 5000000), (50001, 100000), (50000000, 100000000), (None, None), (None, None), (15001, 50000), (1, 1000)]
    assert got[0].est == pytest.approx((1001 * 15000) ** 0.5) and got[5].est is None


def test_dates(spark):
    got = apply(spark, s.iso, "01/02/2026", "1/2/26", "2026-01-02", "Jan 2, 2026", "January 2, 2026", "2 Jan 2026", "01-02-2026", "2026/01/02", "01/02/2026 10:00", "soon", "", None, "5/6/71")
    assert got == ["2026-01-02"] * 5 + [None] + ["2026-01-02"] * 3 + [None, None, None, "1971-05-06"]
    row = spark.range(1).select(s.delay_days(F.lit("01/02/2026"), F.lit("03/14/2026")).alias("d"), s.quarter_of(F.to_date(F.lit("2026-03-14"))).alias("q"), s.shift_quarter(F.lit("2026Q1"), -1).alias("b"), s.period_dates(F.lit("Second Quarter (x)"), F.lit(2025)).alias("p"), s.period_dates(F.lit("?"), F.lit(2025)).alias("n")).first()
    assert (row.d, row.q, row.b, str(row.p.start), str(row.p.end), row.n) == (71, "2026Q1", "2025Q4", "2025-04-01", "2025-06-30", None)


def test_names(spark):
    assert apply(spark, s.norm_person, "Pelosi, Nancy", "Hon. Nancy Pelosi", "Nancy P. Pelosi Jr.", "nancy pelosi", "", None) == ["pelosi nancy"] * 4 + ["", ""]
    assert apply(spark, s.normalize_name, "Société Générale SA", "The Apple Inc.", "Ｎｅｓｔｌé №1 Ạ̈ctive ﬁrm", None) == ["societe generale", "apple", "nestle no1 active firm", None]
    labels = spark.range(1).select(s.rationale(F.create_map(F.lit("lobbying"), F.lit(0.5), F.lit("events"), F.lit(-0.7), F.lit("momentum"), F.lit(1e-9))).alias("r"), s.rationale(F.create_map(F.lit("events"), F.lit(0.0))).alias("n")).first()
    assert tuple(labels) == ("− current-events regime, + federal lobbying spend", "no dominant factor")
    assert apply(spark, s.classify_asset, "US Treasury Note", "NVDA $170 Call", "Bitcoin [CT]", "Index Fund", "Apple [ST]", "Apple") == ["bond", "option", "crypto", "fund", "stock", "stock"]
    row = spark.range(1).select(s.trade_id(F.lit("a"), F.lit(None), F.lit("1001.0")).alias("id"), s.rationale(F.create_map(F.lit("x_y"), F.lit(-2.0), F.lit("z"), F.lit(1.0), F.lit("w"), F.lit(0.0))).alias("r"), s.finite(F.lit(float("inf"))).alias("f"), s.first_number(F.lit(""), F.lit("3.5")).alias("n"), s.relative_change(F.lit(1.0), F.lit(0.0)).alias("c"), s.staleness_weight(F.lit(10), 10.0).alias("w")).first()
    assert (row.id, row.r, row.f, row.n, row.c, row.w) == (hashlib.sha1(b"a|None|1001.0").hexdigest()[:20], "− x_y, + z", None, 3.5, None, 0.5)


def test_tickers(spark):
    companies = spark.createDataFrame([("AAPL", "Apple Inc."), ("MSFT", "MICROSOFT CORP"), ("NVDA", "NVIDIA CORP"), ("TSLA", "Tesla, Inc."), ("LMT", "LOCKHEED MARTIN CORP")], "ticker string, title string")
    texts = ["Apple Inc. (AAPL) [ST]", "MICROSOFT CORP - Common Stock", "NVIDIA Corp $170 Call 01/16/2026", "Tesla Inc Common Stock", "Lockheed Martin Corp 250 shares purchased", "Acme Widget Holdings LLC", "US Treasury Bill", "Foo (ZZZQ)", None]
    got = {r.id: r for r in resolve_tickers(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), companies).collect()}
    assert [got[i].ticker for i in range(9)] == ["AAPL", "MSFT", "NVDA", "TSLA", "LMT", None, None, "ZZZQ", None]
    assert all(got[i].confidence >= 0.7 for i in range(5)) and got[7].confidence == 0.7 and got[8].confidence == 0


def test_members(spark):
    members = spark.createDataFrame([(1, "Nancy", "Pelosi", "house", "CA", "11"), (2, "Rick", "Scott", "senate", "FL", None), (3, "Tim", "Scott", "senate", "SC", None), (4, "Bobby", "Scott", "house", "VA", "3")], "member_id int, first_name string, last_name string, chamber string, state string, district string")
    aliases = spark.createDataFrame([("pelosi nan", 1)], "alias_norm string, member_id int")
    filers = [(0, "Nan Pelosi", None, None, None), (1, "Pelosi, Nancy", "senate", None, None), (2, "Scott, Tim", "senate", None, None), (3, "Scott", "senate", None, None), (4, "R Scott", "senate", "FL", None), (5, "Nobody", None, None, None), (6, None, None, None, None)]
    got = {r.id: r.member_id for r in match_members(spark.createDataFrame(filers, "id int, name string, chamber string, state string, district string"), members, aliases).collect()}
    assert got == {0: 1, 1: 1, 2: 3, 3: None, 4: 2, 5: None, 6: None}


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(map(tuple, upsert(old, new, ["k"], replace=False).collect())) == [(1, "a"), (2, "b"), (3, "e")]
    assert (changed(old, new, ["k"]), changed(old, new, ["k"], replace=False)) == (2, 1)
    assert sorted(map(tuple, preserved(old, new.filter("v <> 'e'"), "k", "v").select("k", "v").collect())) == [(2, "b"), (3, "d")]
    assert sorted(map(tuple, updated(old, new.filter("k = 2"), ["k"], ["v"]).collect())) == [(1, "a"), (2, "c")]
    assert set_values(old, new).count() == 3 and [r.k for r in check_integrity(new, old, "k").collect()] == [3, 3]
    replace_partitions(old, f"{tmp_path}/t", ["k"])
    replace_partitions(new.limit(1), f"{tmp_path}/t", ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "a"), (2, "c")]
    assert json_rows(spark.createDataFrame([(1, float("nan"))], "k int, x double")).first().value == '{"k":1,"x":null}'
    export({"one": old}, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/meta").first().n_rows == 2
