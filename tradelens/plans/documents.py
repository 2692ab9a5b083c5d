"""Filings written out of the test tables' orders, as forms and pages, and read again by the parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.plans.world import view
from tradelens.sources.filings import parse_house, parse_senate

#: Lines are dealt by order, into partitions of their size, before they meet their orders: they lie as pages need them then.
_LINES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus, p_brand, CAST(o_orderdate AS DATE) AS traded
FROM (SELECT /*+ REPARTITION(PARTS, l_orderkey) */ * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey))
JOIN orders ON l_orderkey = o_orderkey"""


def _dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 0))


def _lines(rows: DataFrame, *fields: str) -> DataFrame:
    """The lines of each order (l_orderkey, lines), in their order; texts are written after, so none is dealt or sorted."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*order, *fields))).alias("lines"))


def house_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a House filing with a heading, a footer between its trades, and names that run over two lines."""

    def trade(r: Column) -> Column:
        low = F.floor(r["l_extendedprice"])
        kind = F.when(r["l_returnflag"] == "A", "P").when(r["l_returnflag"] == "R", "S (partial)").otherwise("E")
        amount = F.when(r["l_linenumber"] == 1, F.concat(F.lit("Over "), _dollars(low))).otherwise(F.concat(_dollars(low), F.lit(" - "), _dollars(low + 500)))
        owner = F.when(r["l_linestatus"] == "O", "SP ").otherwise("")
        return F.concat(F.lit("Page 1\nstray words\n* For the complete list of codes\n"), owner, F.translate(r["p_brand"], "#", " "), F.lit(" Company\nCommon Shares [ST] "), kind, F.lit(" "), F.date_format(r["traded"], "MM/dd/yyyy"), F.lit(" "), amount, F.lit(" Yes"))

    filings = _lines(view(spark, sf_dir, _LINES), "l_returnflag", "l_linestatus", "p_brand", "traded")
    text = F.concat(F.lit("Hon. A. Person\nID Owner Asset\n"), F.array_join(F.transform("lines", trade), "\n"), F.lit("\nDigitally Signed: A. Person"))
    texts = filings.select(F.col("l_orderkey").alias("doc_id"), text.alias("text"), F.lit(False).alias("ocr"))
    return parse_house(texts).select("doc_id", "place", "owner", "asset_name_raw", "txn_type", "direction", "transaction_date", "amount_low", "amount_high", "cap_gains_over_200")


def senate_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a Senate page of two tables with other columns: buys in the first, all else in the second."""
    cells = lambda *x: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in x], F.lit("</tr>"))
    day, low = lambda r: F.date_format(r["traded"], "MM/dd/yyyy"), lambda r: _dollars(F.floor(r["l_extendedprice"]))
    name = lambda r: F.concat(F.translate(r["p_brand"], "#", " "), F.lit(" &amp; Sons"))
    first = lambda r: F.when(r["l_returnflag"] == "A", cells(day(r), F.lit("Self"), name(r), F.lit("Purchase"), F.concat(F.lit("greater than "), low(r))))
    second = lambda r: F.when(r["l_returnflag"] != "A", cells(low(r), F.when(r["l_returnflag"] == "R", "Sale (Full)").otherwise("Exchange"), F.lit("Spouse"), name(r), day(r)))
    body = lambda row: F.array_join(F.transform("lines", row), "")  # noqa: E731 - lines of the other table are null and not joined
    head = lambda *x: "<table><thead><tr>" + "".join(f"<th>{c}</th>" for c in x) + "</tr></thead><tbody>"
    html = F.concat(F.lit(head("Transaction Date", "Owner", "Asset Name", "Type", "Amount")), body(first), F.lit("</tbody></table>" + head("Amount", "Transaction Type", "Owner", "Asset", "Date")), body(second), F.lit("</tbody></table>"))
    pages = _lines(view(spark, sf_dir, _LINES), "l_returnflag", "p_brand", "traded").select(F.col("l_orderkey").alias("doc_id"), html.alias("html"))
    return parse_senate(pages).select("doc_id", "place", "owner", "asset_name_raw", "txn_type", "direction", "transaction_date", "amount_low", "amount_high")


_FROM = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
DOCUMENT_ORACLES = {
    "house_parsed": f"""
SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS INTEGER) AS place, CASE l_linestatus WHEN 'O' THEN 'spouse' ELSE 'self' END AS owner, replace(p_brand, '#', ' ') || ' Company Common Shares [ST]' AS asset_name_raw,
  CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell_partial' ELSE 'exchange' END AS txn_type, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS direction, CAST(o_orderdate AS DATE) AS transaction_date,
  floor(l_extendedprice) AS amount_low, CASE WHEN l_linenumber = 1 THEN 2 * floor(l_extendedprice) ELSE floor(l_extendedprice) + 500 END AS amount_high, 1 AS cap_gains_over_200 {_FROM}""",
    "senate_parsed": f"""
WITH brackets(lo, hi) AS (VALUES (1, 1000), (1001, 15000), (15001, 50000), (50001, 100000), (100001, 250000))
SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'A', {_ORDER}) AS INTEGER) AS place, CASE l_returnflag WHEN 'A' THEN 'self' ELSE 'spouse' END AS owner, replace(p_brand, '#', ' ') || ' & Sons' AS asset_name_raw,
  CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell_full' ELSE 'exchange' END AS txn_type, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS direction, CAST(o_orderdate AS DATE) AS transaction_date,
  CASE l_returnflag WHEN 'A' THEN floor(l_extendedprice) ELSE lo END AS amount_low, CASE l_returnflag WHEN 'A' THEN 2 * floor(l_extendedprice) ELSE hi END AS amount_high
{_FROM} LEFT JOIN brackets ON floor(l_extendedprice) BETWEEN lo AND hi""",
}
DOCUMENT_QUERIES = {f.__name__: f for f in (house_parsed, senate_parsed)}
