"""Domain views over the test tables: who trades what when, prices, lobbying, earnings, themes and sectors."""

from __future__ import annotations

from tradelens.operators.skill import SKILL_VIEWS

SCORABLE = "ticker_confidence >= 0.7 AND direction <> 0 AND asset_type IN ('stock', 'fund', 'option')"
USABLE = "t.ticker IS NOT NULL AND t.ticker_confidence >= 0.6 AND t.asset_type IN ('stock', 'fund', 'option')"

_BASE = {
    "members": """
SELECT c_custkey AS member_id, c_name AS full_name, r_name AS chamber, c_mktsegment AS party, n_name AS state
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "traded": """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING)) AS txn_id,
  p_brand AS ticker, p_type, o_custkey AS member_id, CAST(o_orderdate AS DATE) AS transaction_date,
  CAST(1 + MOD(l_partkey * 7 + l_linenumber * 13, 120) AS INT) AS filing_delay_days,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS direction, l_extendedprice AS amount_est, l_linestatus AS owner,
  CASE o_orderstatus WHEN 'F' THEN 'stock' WHEN 'O' THEN 'fund' ELSE 'option' END AS asset_type, round(1 - l_tax * 5, 2) AS ticker_confidence
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "trades": """
SELECT *, SHIFT[transaction_date; filing_delay_days] AS filed_date,
  CASE WHEN amount_est <= 15000 THEN 1001.0 WHEN amount_est <= 50000 THEN 15001.0 ELSE 50001.0 END AS amount_low,
  CASE WHEN amount_est <= 15000 THEN 15000.0 WHEN amount_est <= 50000 THEN 50000.0 ELSE 100000.0 END AS amount_high
FROM traded""",
    "quotes": """
SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice / l_quantity AS DECIMAL(28,12))) AS DOUBLE) AS total, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)""",
    "prices": """
SELECT ticker, date, total / n AS px FROM quotes UNION ALL SELECT 'BENCH' AS ticker, date, CAST(sum(CAST(total / n AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS px FROM quotes GROUP BY date""",
    "span": "SELECT min(date) AS lo, max(date) AS hi FROM quotes",
    # The last price on or before each calendar day from a ticker's first quote on; a stale price is carried to the end.
    "panel": """
SELECT ticker, px, EACH_DAY[date; until] AS date FROM (
  SELECT p.ticker, p.px, p.date, coalesce(SHIFT[lead(p.date) OVER (PARTITION BY p.ticker ORDER BY p.date); -1], s.hi) AS until FROM prices p CROSS JOIN span s) x""",
    "relative": """
SELECT ticker, date, px, bpx FROM (SELECT *, max(CASE WHEN ticker = 'BENCH' THEN px END) OVER (PARTITION BY date) AS bpx FROM panel) x WHERE ticker <> 'BENCH'""",
    "tradingdays": "SELECT date, CAST(row_number() OVER (ORDER BY date) AS INT) AS day FROM (SELECT DISTINCT date FROM quotes) d",
    "daily": """
SELECT p.ticker, d.day, p.date, p.px FROM prices p JOIN tradingdays d ON p.date = d.date""",
    "moves": """
SELECT ticker, day, date, px / before - 1 AS ret FROM (SELECT *, lag(px) OVER (PARTITION BY ticker ORDER BY day) AS before, lag(day) OVER (PARTITION BY ticker ORDER BY day) AS day_before FROM daily) x WHERE day_before = day - 1""",
    "lobbying": """
SELECT p_brand AS ticker, l_suppkey AS registrant, l_extendedprice * l_tax AS amount, CAST(l_shipdate AS DATE) AS period_end,
  concat(CAST(year(l_shipdate) AS STRING), 'Q', CAST(quarter(l_shipdate) AS STRING)) AS quarter,
  CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INT) AS q, p_type AS issue
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "spend": "SELECT ticker, quarter, q, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS spend, count(*) AS filings, count(DISTINCT registrant) AS registrants FROM lobbying GROUP BY ticker, quarter, q",
    "sectors": "SELECT DISTINCT p_brand AS ticker, concat('sector', CAST(MOD(NUMBER_IN[p_brand], 5) AS STRING)) AS sector FROM part",
    "themes": """
SELECT event_type AS theme, HOUR_START[ts] AS hour, CAST(count(*) AS DOUBLE) AS intensity FROM events GROUP BY event_type, HOUR_START[ts]""",
    "earnings": """
SELECT ticker, q, sum(total) AS eps_actual, lag(sum(total)) OVER (PARTITION BY ticker ORDER BY q) AS eps_estimate, max(date) AS report_date
FROM (SELECT *, CAST(year(date) * 4 + quarter(date) - 1 AS INT) AS q FROM quotes) x GROUP BY ticker, q""",
    # The first trading day on or after each calendar day.
    "anchorday": """
SELECT day, EACH_DAY[since; date] AS date FROM (SELECT day, date, coalesce(SHIFT[lag(date) OVER (ORDER BY date); 1], date) AS since FROM tradingdays) x""",
    "scorable": f"SELECT * FROM trades WHERE {SCORABLE}",
}

VIEWS = _BASE | SKILL_VIEWS
