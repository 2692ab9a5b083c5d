"""Spark's forms of views and queries whose plain forms copy facts, deal them often or gather them in few tasks: the same rows.

DuckDB runs the plain forms, so the queries on these views are held against another text. PARTS stands for a number of
partitions that grows with the lines, so that what one task holds doesn't.
"""

from __future__ import annotations

from tradelens.operators.activity import ACTIVITY_VIEWS, USABLE, windows_text
from tradelens.operators.skill import SKILL_VIEWS
from tradelens.sources.views import SCORABLE, VIEWS

_EXCESS = "round(((p.px / e.px0 - 1) - (p.bpx / e.bpx0 - 1)) * e.direction, 12) + 0.0"
_QUARTER = "concat(CAST(year(transaction_date) AS STRING), 'Q', CAST(quarter(transaction_date) AS STRING))"
_Q = "CAST(year(transaction_date) * 4 + quarter(transaction_date) - 1 AS INT)"

_KEPT = "member_id, txn_id, ticker, transaction_date, filed_date, filing_delay_days, direction, amount_low, amount_high, amount_est, owner"

SCALED = {
    # Lines with their part, dealt by order; the trades on them keep the order's number, which txn_id begins with.
    "dealt": """
SELECT /*+ REPARTITION(PARTS, l_orderkey) */ l.*, p_brand, p_type FROM (SELECT /*+ REPARTITION(PARTS, l_partkey) */ * FROM lineitem) l JOIN part ON l_partkey = p_partkey""",
    "dealt_traded": VIEWS["traded"].replace("SELECT ", "SELECT l_orderkey, ", 1).replace("FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey", "FROM dealt JOIN orders ON l_orderkey = o_orderkey"),
    "dealt_trades": VIEWS["trades"].replace("FROM traded", "FROM dealt_traded"),
    # Dealt by member once, before each trade becomes one for each horizon; prices are joined by broadcast and deal nothing anew.
    "stats": SKILL_VIEWS["stats"].replace(
        "FROM returns",
        f"""FROM (SELECT e.member_id, e.amount_est, e.horizon_days, {_EXCESS} AS excess_return
  FROM (SELECT e.*, p.px AS px0, p.bpx AS bpx0 FROM (
      SELECT t.member_id, t.ticker, t.amount_est, t.direction, h.horizon_days, greatest(t.transaction_date, s.lo) AS d0, greatest(SHIFT[t.transaction_date; h.horizon_days], s.lo) AS d1
      FROM (SELECT /*+ REPARTITION(PARTS, member_id) */ member_id, ticker, amount_est, direction, transaction_date FROM scorable WHERE member_id IS NOT NULL) t
      CROSS JOIN (VALUES (30), (90), (180), (365)) AS h(horizon_days) CROSS JOIN span s) e
    JOIN relative p ON p.ticker = e.ticker AND p.date = e.d0 WHERE p.px > 0 AND p.bpx > 0) e
  JOIN relative p ON p.ticker = e.ticker AND p.date = e.d1 WHERE p.px IS NOT NULL AND p.bpx IS NOT NULL) r""",
    ),
    # A member's trades of a quarter are counted where the member's weight is joined, so few rows go on from there.
    "quarterly": f"""
SELECT ticker, quarter, q, CAST(sum(n) AS BIGINT) AS n_trades, count(member_id) AS n_members, sum(gross) AS gross, sum(net) AS net, CAST(sum(weighted_net) AS DOUBLE) AS weighted_net FROM (
  SELECT t.ticker, {_QUARTER} AS quarter, {_Q} AS q, t.member_id, count(*) AS n, sum(amount_est) AS gross, sum(amount_est * direction) AS net, sum(CAST(amount_est * direction * coalesce(s.weight, 1.0) AS DECIMAL(28,8))) AS weighted_net
  FROM (SELECT /*+ REPARTITION(PARTS, member_id) */ t.ticker, t.member_id, t.transaction_date, t.amount_est, t.direction FROM trades t WHERE {USABLE}) t LEFT JOIN scores90 s ON s.member_id = t.member_id
  GROUP BY t.ticker, {_QUARTER}, {_Q}, t.member_id) x GROUP BY ticker, quarter, q""",
    "sided": ACTIVITY_VIEWS["sided"].replace("FROM trades t ", f"FROM (SELECT /*+ REPARTITION(PARTS, member_id) */ * FROM trades t WHERE {USABLE} AND t.direction <> 0 AND t.member_id IS NOT NULL) t "),
    "windows": windows_text(14),
    # Members and buyers are running sums of steps: a trade counts from its filing to the member's next one, or for 90 days.
    "politician": """
SELECT s.ticker, s.date, coalesce(sum(t.net) / nullif(sum(t.gross), 0.0), 0.0) AS net_ratio_90, coalesce(max(CASE WHEN t.day = t.newest THEN t.buyers END), 0) AS n_buyers_90, coalesce(max(CASE WHEN t.day = t.newest THEN t.members END), 0) AS n_members_90,
  coalesce(sum(t.buys) / nullif(sum(t.n), 0), 0.5) AS buy_share_90, ln(1 + coalesce(sum(t.gross), 0.0)) AS log_gross_90
FROM spine s LEFT JOIN (
  SELECT s.ticker, s.date, d.day, max(d.day) OVER (PARTITION BY s.ticker, s.date) AS newest, d.net, d.gross, d.buys, d.n, d.members, d.buyers FROM spine s JOIN (
    SELECT ticker, day, net, gross, buys, n, sum(member) OVER (PARTITION BY ticker ORDER BY day) AS members, sum(buyer) OVER (PARTITION BY ticker ORDER BY day) AS buyers FROM (
      SELECT ticker, e.day, sum(e.n * amount_est * direction) AS net, sum(e.n * amount_est) AS gross, sum(e.n * buy) AS buys, sum(e.n) AS n, CAST(sum(e.member) AS BIGINT) AS member, CAST(sum(e.buyer) AS BIGINT) AS buyer FROM (
        SELECT ticker, amount_est, direction, buy, explode(array(
            named_struct('day', filed_date, 'n', 1, 'member', known, 'buyer', known * buy), named_struct('day', least(next_any, date_add(filed_date, 90)), 'n', 0, 'member', -known, 'buyer', 0),
            named_struct('day', least(next_same, date_add(filed_date, 90)), 'n', 0, 'member', 0, 'buyer', -known * buy))) AS e FROM (
          SELECT *, lead(filed_date) OVER (PARTITION BY ticker, member_id ORDER BY filed_date) AS next_any, lead(filed_date) OVER (PARTITION BY ticker, member_id, buy ORDER BY filed_date) AS next_same FROM (
            SELECT /*+ REPARTITION(PARTS, member_id) */ ticker, member_id, filed_date, amount_est, direction, CASE WHEN direction > 0 THEN 1 ELSE 0 END AS buy, CASE WHEN member_id IS NULL THEN 0 ELSE 1 END AS known FROM scorable) t) u) v
      GROUP BY ticker, e.day) w) d ON d.ticker = s.ticker AND d.day <= s.date AND d.day > SHIFT[s.date; -90]) t ON t.ticker = s.ticker AND t.date = s.date
GROUP BY s.ticker, s.date""",
}

SCALED_QUERIES = {
    # A trade's own return is computed on its row. Trades of one txn_id share the largest of theirs, as the SQL's join gives;
    # those are of one order, so nothing is dealt by the text.
    "member_timeline": f"""
SELECT {_KEPT}, round(max(excess) OVER (PARTITION BY l_orderkey, txn_id), 5) + 0.0 AS excess_90 FROM (
  SELECT l_orderkey, {_KEPT}, max(excess) AS excess FROM (
    SELECT t.*, CASE WHEN {SCORABLE} THEN round(((p.px / e.px - 1) - (p.bpx / e.bpx - 1)) * t.direction, 12) + 0.0 END AS excess FROM dealt_trades t CROSS JOIN span s
    LEFT JOIN relative e ON e.ticker = t.ticker AND e.date = greatest(t.transaction_date, s.lo) AND e.px > 0 AND e.bpx > 0
    LEFT JOIN relative p ON p.ticker = t.ticker AND p.date = greatest(SHIFT[t.transaction_date; 90], s.lo)) x
  GROUP BY l_orderkey, {_KEPT}) y""",
}
