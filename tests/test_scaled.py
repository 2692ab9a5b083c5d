"""Spark's forms of views against the plain ones, on tables with few days, few members, and trades without a member."""

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_catalogue import rows
from tradelens.functions.scalars import parse_amount
from tradelens.operators import reports
from tradelens.operators.activity import windows_text
from tradelens.operators.panel import seen_counts
from tradelens.plans.catalogue import ORACLES, QUERIES
from tradelens.plans.dialect import TABLES, duckdb_text
from tradelens.plans.world import ALL_VIEWS, SPARK_VIEWS, view
from tradelens.sources import filings
from tradelens.sources.filings import _Page, parse_house, parse_senate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """(folder, DuckDB's connection): dates within 300 days, 40 members that trade, one in 11 orders without a member."""
    folder, con = tmp_path_factory.mktemp("dense"), duckdb.connect()
    own = {"orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 40 END AS o_custkey, CAST(TIMESTAMP '1995-01-01' + to_days(CAST(o_orderkey * 7 % 300 AS INTEGER)) AS TIMESTAMP) AS o_orderdate) FROM t"}
    own["lineitem"] = "SELECT * REPLACE (CAST(TIMESTAMP '1995-01-01' + to_days(CAST(l_orderkey * 13 % 700 AS INTEGER)) AS TIMESTAMP) AS l_shipdate) FROM t"
    for t in TABLES:
        con.execute(f"COPY (WITH t AS (SELECT * FROM '{SF}/{t}.parquet') {own.get(t, 'SELECT * FROM t')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["windows", "politician", "quarterly", "stats"])
def test_scaled_view(spark, dense, name):
    folder, con = dense
    assert SPARK_VIEWS[name] != ALL_VIEWS[name]
    columns = {"quarterly": "ticker, quarter, q, n_trades, n_members, round(gross, 2) AS gross, round(net, 2) AS net", "windows": "ticker, side, transaction_date, n_members, n_trades, round(volume, 2) AS volume, round(weighted_volume, 0) AS weighted_volume"}
    text = f"SELECT {columns.get(name, '*')} FROM {name}"
    got, want = rows(view(spark, folder, text).toPandas()), rows(con.execute(duckdb_text(text, ALL_VIEWS)).df())
    assert len(got) == len(want) > 0
    assert sum(a != b for a, b in zip(got, want)) == 0


def test_windows_copy_no_trade_for_each_day():
    assert windows_text(14).count("named_struct") == windows_text(400).count("named_struct") == 3
    assert "EACH_INT" not in SPARK_VIEWS["windows"] + QUERIES["view_clusters"].keywords["query"]


def test_members_without_trades_are_as_in_the_sql(spark, dense):
    folder, con = dense
    got, want = QUERIES["view_member_detail"](spark, folder).toPandas(), con.execute(ORACLES["view_member_detail"]).df()
    assert (want.n_trades == 0).any()
    assert dict(zip(got.member_id, got.trades_sha256)) == dict(zip(want.member_id, want.trades_sha256))


def test_seen_counts(spark):
    rng = random.Random(3)
    start = pd.Timestamp("2020-01-01")
    trades = [(rng.choice("AB"), rng.choice([1, 2, 3, 4, None]), rng.randrange(60), rng.choice([1, -1])) for _ in range(150)]
    df = spark.createDataFrame([(t, m, (start + pd.Timedelta(days=d)).date(), s) for t, m, d, s in trades], "ticker string, member_id long, day date, side int")
    asks = [(t, d) for t in "AB" for d in range(0, 75, 3)]
    asked = spark.createDataFrame([(t, (start + pd.Timedelta(days=d)).date()) for t, d in asks], "ticker string, date date")
    got = {(r.ticker, (pd.Timestamp(r.date) - start).days): r for r in seen_counts(asked, df, "day", F.col("side"), {"n": None, "buy": 1, "sell": -1}, [5, 20]).collect()}
    for t, d in asks:
        for name, side in (("n", None), ("buy", 1), ("sell", -1)):
            for b in (5, 20):
                want = {m for u, m, x, s in trades if u == t and m is not None and d - b < x <= d and side in (None, s)}
                assert got[t, d][f"{name}_{b}"] == len(want)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_amount_is_searched_for_numbers_once(spark):
    rows = spark.createDataFrame([("$1,001 - $15,000",)], "t string").select(parse_amount(F.col("t")).alias("a")).select("a.low", "a.high", "a.est")
    assert _plan(rows).count("regexp_extract_all") == 1


def test_a_house_trade_has_its_name_cleaned_once(spark):
    filings = spark.createDataFrame([(1, "SP A Company [ST] P 01/02/2020 $1,001 - $15,000", False)], "doc_id long, text string, ocr boolean")
    assert _plan(parse_house(filings)).count(r"[$]200[?]") == 1


def test_a_senate_page_is_read_once(spark):
    pages = spark.createDataFrame([(1, "<table></table>")], "doc_id long, html string")
    assert _plan(parse_senate(pages)).count("MapInArrow") == 1


def test_a_senate_trade_is_counted_in_its_page(spark):
    """Trades are not dealt by page and sorted to be counted, lines are dealt by order once."""
    pages = spark.createDataFrame([(1, "<table></table>")], "doc_id long, html string")
    assert _dealt_by(parse_senate(pages)) == []
    assert _dealt_by(QUERIES["senate_parsed"](spark, SF)) == ["l_orderkey"]


PLAIN_PAGES = [
    "x<table class='a b'><TR ><td>a &amp; b<td> c <b>d</b>\xa0e\n</td></tr></table>tail &am",
    "<table><thead><tr><th>A</th></tr></thead><tr><td>1<table><tr><td>in</td></tr></table>2<td>3</table>",
    "<td>out</td></tr></table><tbody><table><tbody></tbody><tr><td>a</td></tbody></table>",
    "",
]
ODD_PAGES = [
    "<table><tr><td>1 < 2 > 0<td a='>'>x</td><td/>y<!-- <td>no --><td>z<!-- > --></table>",
    "<table><tr><td><script>a<td>&amp;</script>b<td>c <td</table><td title=\"x",
    "<table>> td><tr><td>td>x</td>> y</td></tr></table>",
]


def test_plain_pages_are_cut_as_the_parser_cuts_them(monkeypatch):
    def cells(page):
        texts, (cells, *sizes) = _Page().read(page)
        return [" ".join(" ".join(texts[i] for i in c).split()) for c in cells], sizes

    parsed, feed = [], _Page.feed
    monkeypatch.setattr(_Page, "feed", lambda self, html: parsed.append(html) or feed(self, html))
    plain = [cells(p) for p in PLAIN_PAGES]
    assert plain[1] == (["A", "A", "1", "3", "in"], [[1, 0], [3, 1], [1, 1, 1, 1]])
    assert parsed == [] and [cells(p) for p in ODD_PAGES] and parsed == ODD_PAGES
    monkeypatch.setattr(filings, "_plain", lambda tags: None)
    monkeypatch.setattr(filings, "SMALL", len(max(PLAIN_PAGES, key=len)))
    assert [cells(p) for p in PLAIN_PAGES] == plain


def test_an_empty_body_has_no_trades(spark):
    """A table's rows are those of its bodies where it has any, even if they are empty; its head holds none."""
    row = "<tr><td>01/09/2026</td><td>A</td><td>Sale</td><td>$1,001 - $15,000</td></tr>"
    head = f"<thead><tr><th>Date</th><th>Asset</th><th>Type</th><th>Amount</th></tr>{row}</thead>"
    pages = spark.createDataFrame([(1, f"<table>{head}<tbody></tbody></table>"), (2, f"<table>{head}<tbody>{row}</tbody></table>")], "doc_id long, html string")
    assert [(r.doc_id, r.place) for r in parse_senate(pages).collect()] == [(2, 1)]


@pytest.fixture(scope="module")
def doubled(tmp_path_factory):
    """(folder, DuckDB's connection): every third line stands twice, once as it is and once the other way round or not at all sure; one in 40 lines lacks a key."""
    folder, con = tmp_path_factory.mktemp("doubled"), duckdb.connect()
    lines = "SELECT * REPLACE (CASE WHEN l_orderkey % 40 = 1 THEN NULL ELSE l_suppkey END AS l_suppkey, CASE WHEN l_orderkey % 40 = 2 THEN NULL ELSE l_linenumber END AS l_linenumber) FROM t"
    own = {"lineitem": f"{lines} UNION ALL SELECT * REPLACE (CASE l_returnflag WHEN 'A' THEN 'R' ELSE 'A' END AS l_returnflag, l_extendedprice + 1 AS l_extendedprice, l_orderkey % 2 * 0.5 AS l_tax) FROM ({lines}) WHERE l_orderkey % 3 = 0 UNION ALL SELECT * FROM ({lines}) WHERE l_orderkey % 5 = 0"}
    for t in TABLES:
        con.execute(f"COPY (WITH t AS (SELECT * FROM '{SF}/{t}.parquet') {own.get(t, 'SELECT * FROM t')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


def _dealt_by(df):
    """The columns that rows are dealt by, one text for each exchange."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", d) for d in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)]


def _same_as_sql(df, con, text):
    cells = lambda found: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v)[:40] for v in r) for r in found)
    got, want = cells(df.select(sorted(df.columns)).collect()), cells(con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({text}) x").fetchall())
    assert len(got) == len(want) > 0
    assert sum(a != b for a, b in zip(got, want)) == 0


def test_timeline_of_lines_that_stand_twice(spark, doubled):
    folder, con = doubled
    _same_as_sql(QUERIES["member_timeline"](spark, folder), con, ORACLES["member_timeline"])


def test_timeline_deals_no_trade_by_its_text(spark):
    dealt = _dealt_by(QUERIES["member_timeline"](spark, SF))
    assert "txn_id" not in " ".join(dealt)
    assert sum("l_orderkey" in d for d in dealt) == 1


def test_alignment_of_lines_that_stand_twice(spark, doubled):
    folder, con = doubled
    _same_as_sql(QUERIES["committee_alignment"](spark, folder), con, ORACLES["committee_alignment"])


def test_alignment_deals_lines_once_and_trades_by_member(spark):
    dealt = _dealt_by(QUERIES["committee_alignment"](spark, SF))
    assert dealt.count("l_partkey") == 2 and dealt.count("l_orderkey") == 1
    assert not {"filing_uuid", "ticker, member_id"} & set(dealt)


def test_lobbied_lines(spark):
    rng = random.Random(5)
    lines = [(f"{k}-{n}", k, rng.choice(["A", "B", None]) if n else "A", rng.choice([1.0, 2.0, 5.0, None]), rng.choice(["def", "DEF", "TAX", None])) for k in range(30) for n in range(3) for _ in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(lines, "filing_uuid string, part int, ticker string, amount double, issue_code string")
    filings = df.groupBy("filing_uuid", "ticker").agg(F.max("amount").alias("amount"))
    one = df.groupBy("filing_uuid").agg(F.countDistinct("ticker").alias("k"), F.count_if(F.col("ticker").isNull()).alias("n")).filter("k = 1 and n = 0")  # a filing is of one company
    filings, df = filings.join(one, "filing_uuid", "left_semi"), df.join(one, "filing_uuid", "left_semi")
    acts = df.select("filing_uuid", "issue_code", F.lit("").alias("description"), F.lit("").alias("entity"))
    told = lambda x: {(r.ticker, r.issue_code): r.spend for r in x.collect()}
    want = told(reports.lobbied_issues(filings, acts))
    assert len(want) > 2 and told(reports.lobbied_lines(df)) == told(reports.lobbied_lines(df, "part")) == want


def test_equal_volumes_are_ordered_by_member(spark):
    trades = spark.createDataFrame([(m, "A", 0.9, x) for m, xs in ((1, [0.3, 0.2, 0.1]), (2, [0.1, 0.2, 0.3])) for x in xs], "member_id int, ticker string, ticker_confidence double, amount_est double").coalesce(1)
    members = spark.createDataFrame([(1, "One", "house"), (2, "Two", "house")], "member_id int, full_name string, chamber string")
    filings = spark.createDataFrame([("u", "A", 10.0)], "filing_uuid string, ticker string, amount double")
    acts = spark.createDataFrame([("u", "TAX", "", "")], "filing_uuid string, issue_code string, description string, entity string")
    held = spark.createDataFrame([(1, "SSFI"), (2, "SSFI")], "member_id int, committee_id string")
    assert [r.member_id for r in reports.committee_alignment(trades, members, filings, acts, held).collect()] == [1, 2]
