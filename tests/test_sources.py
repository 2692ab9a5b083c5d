"""Filings and feeds on small files of their forms."""

import datetime as dt
import json

from tradelens.sources import feeds
from tradelens.sources.filings import declared_over_inferred, house_meta, parse_house, parse_senate

HOUSE = """   Periodic Transaction Report
Name: Hon. A. Person
Filing ID #31337
ID  Owner  Asset   Transaction  Date  Notification  Amount  Cap. Gains >
                   Type               Date                  $200?
    SP     Acme Inc. (ACME) [ST]          P            01/14/2026  02/02/2026    $15,001 - $50,000
           Widget Corporation (WDGT) [ST] S (partial)  01/22/2026  02/02/2026    $1,001 - $15,000
           A Very Long Company Name (LONG)
           [ST]                           S            02/05/2026                Over $50,000,000
    JT     US Treasury Bill [GS]          {}            02/09/2026  02/19/2026    $500,001 - $1,000,000
* For the complete list of abbreviations
Digitally Signed: Hon. A. Person, 02/19/2026
"""
SENATE = """<table><thead><tr><th>#</th><th>Transaction Date</th><th>Owner</th><th>Ticker</th><th>Asset Name</th><th>Asset Type</th><th>Type</th><th>Amount</th><th>Comment</th></tr></thead>
<tr><td>1</td><td>01/09/2026</td><td>Child</td><td>acme</td><td><a href='x'>Acme &amp; Sons</a></td><td>Stock</td><td>Sale (Full)</td><td>$15,001 - $50,000</td><td>a note</td></tr>
<tr><td>2</td><td>02/02/2026</td><td>Self</td><td>--</td><td>US Note</td><td>Bond</td><td>Purchase</td><td>$1,001 - $15,000</td><td>--</td></tr></table>"""


def test_house(spark):
    docs = spark.createDataFrame([(1, HOUSE.format("P"), False), (2, HOUSE.format("F"), True), (3, None, False)], "doc_id int, text string, ocr boolean")
    rows = parse_house(docs).orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.owner, r.asset_name_raw, r.declared_ticker, r.txn_type, r.direction) for r in rows[:4]] == [
        (1, "spouse", "Acme Inc. (ACME) [ST]", "ACME", "buy", 1), (1, "self", "Widget Corporation (WDGT) [ST]", "WDGT", "sell_partial", -1),
        (1, "self", "A Very Long Company Name (LONG) [ST]", "LONG", "sell", -1), (1, "joint", "US Treasury Bill [GS]", None, "buy", 1),
    ]
    assert (rows[0].amount_low, rows[2].amount_low, rows[2].notification_date, rows[0].transaction_date) == (15001, 50_000_000, None, dt.date(2026, 1, 14))
    assert [r.txn_type for r in rows[4:]] == ["buy", "sell_partial", "sell", "buy"] and rows[7].parse_note == "ocr_type_fix:f->p" and rows[4].parse_note is None
    meta = docs.select(house_meta(docs.text).alias("m")).first().m
    assert (meta.filing_id, meta.filed_date) == ("31337", dt.date(2026, 2, 19))


def test_house_lines(spark):
    """Headings reset what was gathered, the look-back is bounded, and pieces of headings and numbers are cut off."""
    one = "P 01/14/2026 02/02/2026 $1,001 - $15,000"
    texts = [
        f"Hon. Jane Roe\nSome preface text line\nID Owner Asset\nSP Apple Inc. (AAPL) [ST] {one} Yes",
        f"first\nsecond\nthird\nfourth\nAcme (ACME) {one} No",
        f"1. ID Owner JT Acme Corp {one}\nPage 2\nFooter\n* For the complete list\n- Beta Notification Date LLC S (full) 1/2/2026 $50,000",
        f"x\n{'y' * 401}\nzz {one}",
        "Wrapped Name\nover two lines P\n01/14/2026 $15,001 - $50,000",
        f"# 12 SP Gamma {one}",
        f"AB {one}",
        "Delta 5 01/14/2026 $1,001 - $15,000\nEpsilon R 01/14/2026 $1,001 - $15,000",
    ]
    docs = spark.createDataFrame([(i, t, i == 7) for i, t in enumerate(texts)], "doc_id int, text string, ocr boolean")
    got = [(r.doc_id, r.owner, r.asset_name_raw, r.txn_type, r.cap_gains_over_200) for r in parse_house(docs).orderBy("doc_id", "place").collect()]
    assert got == [
        (0, "spouse", "Apple Inc. (AAPL) [ST]", "buy", 1), (1, "self", "fourth Acme (ACME)", "buy", 0), (2, "joint", "Acme Corp", "buy", None), (2, "self", "Beta LLC", "sell_full", None),
        (3, "self", f"{'y' * 401} zz", "buy", None), (4, "self", "Wrapped Name over two lines", "buy", None), (5, "spouse", "Gamma", "buy", None), (7, "self", "Delta", "sell", None), (7, "self", "Epsilon", "buy", None),
    ]
    notes = [r.parse_note for r in parse_house(docs.filter("doc_id = 7")).orderBy("place").collect()]
    assert notes == ["ocr_type_fix:5->s", "ocr_type_fix:r->p"]
    assert parse_house(docs.withColumn("ocr", docs.doc_id < 0)).filter("doc_id = 7").first().txn_type == "receive"


def test_senate_tables(spark):
    head = "<thead><tr><th>Date</th><th>Asset</th><th>Type</th><th>Amount</th></tr></thead>"
    other = "<thead><tr><th>Amount</th><th>Type</th><th>Ticker</th><th>Asset Name</th><th>Transaction Date</th></tr></thead>"
    page = f"""<table>{head}<tbody><tr><td>01/09/2026<td>A&#38;B &quot;Co&quot;<td>Sale (other)<td>$1,001 - $15,000</tr></tbody><tfoot><tr><td>01/09/2026</td><td>foot</td><td>x</td><td>$1</td></tr></tfoot></table>
    <p>between</p><table>{other}<tr><td>Over $50,000,000</td><td>Purchase - new</td><td>zz</td><td>Caf&eacute;</td><td>02/03/2026</td></tr><tr><td>1</td><td>2</td></tr></table>
    <table><tr><td>01/09/2026</td><td>no head</td><td>Sale</td><td>$1,001 - $15,000</td></tr></table>
    <table><thead><tr><th>Date</th><th>Asset</th><th>Type</th><th>Note</th></tr></thead><tr><td>01/09/2026</td><td>no amount</td><td>Sale</td><td>x</td></tr></table>"""
    rows = parse_senate(spark.createDataFrame([(1, page), (2, None), (3, "")], "doc_id int, html string")).orderBy("place").collect()
    assert [(r.place, r.asset_name_raw, r.txn_type, r.amount_low, r.declared_ticker, str(r.transaction_date)) for r in rows] == [(1, 'A&B "Co"', "sell", 1001, None, "2026-01-09"), (2, "Café (ZZ)", "buy", 50_000_000, "ZZ", "2026-02-03")]


def test_senate(spark):
    rows = parse_senate(spark.createDataFrame([(1, SENATE), (2, "<p>none</p>"), (3, None)], "doc_id int, html string")).collect()
    assert [(r.place, r.owner, r.asset_name_raw, r.declared_ticker, r.txn_type, r.amount_low, r.comment) for r in rows] == [(1, "dependent", "Acme & Sons (ACME)", "ACME", "sell_full", 15001, "a note"), (2, "self", "US Note", None, "buy", 1001, None)]
    inferred = spark.createDataFrame([("A", None, "B", 0.9, "stock"), (None, "bond", "C", 0.5, "fund")], "declared_ticker string, declared_asset_type string, ticker string, confidence double, asset_type string")
    assert [(r.ticker, r.confidence, r.asset_type) for r in declared_over_inferred(inferred).collect()] == [("A", 1.0, "stock"), ("C", 0.5, "bond")]


def test_index_and_vendors(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<R><Member><Last>Person</Last><First>A</First><FilingType>P</FilingType><StateDst>CA03</StateDst><Year>2026</Year><FilingDate>1/5/2026</FilingDate><DocID>7</DocID></Member></R>")
    index = feeds.filing_index(spark, str(tmp_path / "x.xml"))
    assert tuple(index.first()) == ("house:7", "7", "A Person", "ptr", "CA", "3", 2026, dt.date(2026, 1, 5))
    assert feeds.unread(index, index).count() == 0 and feeds.unread(index, index.limit(0), 5).count() == 1
    rows = [{"Ticker": "acme", "Transaction": "Sale (Partial)", "Range": "$1,001 - $15,000", "TransactionDate": "2026-01-02", "Representative": "A P"}, {"symbol": "B", "type": "buy", "date": "2026-01-03", "low": 4, "high": 9, "firstName": "F", "lastName": "L"}, {"symbol": "C"}]
    got = feeds.vendor_trades(spark.createDataFrame([(json.dumps(r),) for r in rows], "json string")).collect()
    assert [(r.ticker, r.txn_type, r.direction, r.amount_low, r.member_name) for r in got] == [("ACME", "sell_partial", -1, 1001, "A P"), ("B", "buy", 1, 4, "F L")] and got[1].amount_est == 6
    link = spark.createDataFrame([("A", "P", "x", '<a href="/search/view/ptr/ab-12/">', "01/02/2026"), ("A", "P", "x", "none", "")], "first string, last string, office string, link string, filed string")
    assert feeds.search_rows(link).first().filing_id == "senate:ab-12" and feeds.search_rows(link).count() == 1


def test_prices(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Volume\n2026-01-02,1,2,1,1.5,10\nbad,row\n2026-01-03,1,2,1,2.5,10\n")
    csv = feeds.price_csv(spark, str(tmp_path / "p.csv"), "a")
    chart = {"chart": {"result": [{"timestamp": [1767312000, 1767398400, 1767484800], "indicators": {"quote": [{"open": [1, 1, 1], "high": [1, 1, 1], "low": [1, 1, 1], "close": [9, None, 8], "volume": [1, 1, 1]}], "adjclose": [{"adjclose": [7]}]}}]}}
    other = feeds.price_chart(spark.createDataFrame([("a", json.dumps(chart)), ("b", '{"chart": {"result": null}}')], "ticker string, json string"))
    assert sorted((str(r.date), r.close, r.adj_close) for r in other.collect()) == [("2026-01-02", 9.0, 7.0), ("2026-01-04", 8.0, 8.0)]
    history = feeds.price_history(spark.createDataFrame([("a", '{"historical": [{"date": "2026-01-09", "close": 4.0}]}')], "ticker string, json string"))
    best = feeds.first_provider([csv, other, history], ["ticker", "date"]).orderBy("date").collect()
    assert [(str(r.date), r.close, r.provider) for r in best] == [("2026-01-02", 1.5, 0), ("2026-01-03", 2.5, 0), ("2026-01-04", 8.0, 1), ("2026-01-09", 4.0, 2)]
    trades = spark.createDataFrame([("X", 0.9), ("Y", 0.9), ("Y", 0.9), ("Z", 0.1), ("U", 0.9)], "ticker string, ticker_confidence double")
    universe = spark.createDataFrame([("U", 1)], "ticker string, rank int")
    assert [r.ticker for r in feeds.fetch_order("BENCH", universe, trades).collect()] == ["BENCH", "U", "Y", "X"]
    status = lambda n, b: feeds.fetch_status(csv, n, b).first().status
    assert (status(0, "Q"), status(5, "Q"), status(5, "A")) == ("ok", "FAILED", "DEGRADED")


def test_people_and_reports(spark, tmp_path):
    write = lambda n, x: (tmp_path / n).write_text(json.dumps(x)) and str(tmp_path / n)
    person = {"id": {"bioguide": "P1"}, "name": {"first": "Ann", "last": "Person", "nickname": "Annie"}, "terms": [{"type": "rep", "start": "2001-01-03", "end": "2003-01-03", "state": "CA", "district": 3, "party": "X"}, {"type": "sen", "start": "2005-01-03", "end": "2011-01-03", "state": "CA", "party": "X"}]}
    members, aliases = feeds.legislators(spark, write("l.json", [person]))
    assert (members.first().chamber, members.first().full_name) == ("senate", "Ann Person") and sorted(r.alias_norm for r in aliases.collect()) == ["person ann", "person annie"]
    bodies, held = feeds.committees(spark, write("c.json", [{"thomas_id": "HSAS", "name": "Arms", "subcommittees": [{"thomas_id": "01", "name": "Sub"}]}]), write("m.json", {"HSAS": [{"bioguide": "P1", "title": "Chair", "rank": 1}, {"bioguide": "Q"}], "HSAS01": [{"bioguide": "P1"}], "ZZ": [{"bioguide": "P1"}]}), members)
    assert bodies.count() == 2 and sorted((r.committee_id, r.role, r["rank"]) for r in held.collect()) == [("HSAS", "Chair", 1), ("HSAS01", "Member", 1)]
    assert feeds.executives(spark, write("e.json", [{"name": "J. Q. Public", "role": "x"}])).first().member_id == "exec-j-q-public"
    lobby = {"filing_uuid": "u", "filing_year": 2025, "filing_period": "2nd or Second Quarter", "income": "0.00", "expenses": "12.5", "client": {"id": 1, "name": "c"}, "lobbying_activities": [{"general_issue_code": "DEF", "government_entities": [{"name": "A"}, {"name": "B"}]}, {"general_issue_code": "TAX", "government_entities": []}]}
    filings, acts = feeds.lobbying(spark.createDataFrame([(json.dumps(lobby),)] * 2, "json string"))
    assert (filings.first().amount, str(filings.first().period_end), filings.count(), acts.count()) == (12.5, "2025-06-30", 1, 3)
    reports = feeds.earnings(spark.createDataFrame([("A", json.dumps([{"date": "2026-01-02", "eps": 2, "epsEstimated": 1}, {"period": "2026-02-02", "actual": 1, "estimate": 0}]))], "ticker string, json string")).collect()
    assert [r.surprise_pct for r in reports] == [1.0, None]
    assert feeds.theme_timeline(spark.createDataFrame([("ai", '{"timeline": [{"data": [{"date": "20260102T000000Z", "value": 3.5}]}]}')], "theme string, json string")).first().intensity == 3.5
    assert feeds.sector_labels(spark.createDataFrame([("a", '[{"sector": "S", "industry": "I"}]'), ("b", "[]")], "ticker string, json string")).count() == 1
    assert feeds.ticker_map(spark.createDataFrame([('{"0": {"ticker": "AAPL", "title": "Apple Inc."}}',)], "json string")).first().title == "Apple Inc."
