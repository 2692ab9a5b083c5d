"""Leaderboards, flows, disclosure delays, clusters, lobbying overlays and the universe of names."""

from __future__ import annotations

USABLE = "t.ticker IS NOT NULL AND t.ticker_confidence >= 0.6 AND t.asset_type IN ('stock', 'fund', 'option')"
_FLOW = "count(*) AS n_trades, count(DISTINCT member_id) AS n_members, round(sum(CASE WHEN direction > 0 THEN amount_est ELSE 0 END), 2) AS buy_volume, round(sum(CASE WHEN direction < 0 THEN amount_est ELSE 0 END), 2) AS sell_volume, round(sum(amount_est * direction), 2) + 0.0 AS net_volume"
#: The period that a date falls in; weeks begin on Monday and are numbered from 0 within the year.
PERIODS = {
    "d": "CAST(transaction_date AS STRING)",
    "w": "concat(substr(CAST(transaction_date AS STRING), 1, 5), lpad(CAST(CAST(floor((dayofyear(transaction_date) + 6 - WEEKDAY[transaction_date]) / 7) AS INT) AS STRING), 2, '0'))",
    "m": "substr(CAST(transaction_date AS STRING), 1, 7)",
    "q": "concat(CAST(year(transaction_date) AS STRING), 'Q', CAST(quarter(transaction_date) AS STRING))",
    "y": "substr(CAST(transaction_date AS STRING), 1, 4)",
}
_BUCKET = "CASE WHEN filing_delay_days < 0 THEN '<0' WHEN filing_delay_days <= 15 THEN '0-15' WHEN filing_delay_days <= 30 THEN '16-30' WHEN filing_delay_days <= 45 THEN '31-45' WHEN filing_delay_days <= 90 THEN '46-90' WHEN filing_delay_days <= 180 THEN '91-180' ELSE '180+' END"
_QUARTER = "concat(CAST(year(transaction_date) AS STRING), 'Q', CAST(quarter(transaction_date) AS STRING))"
_BY_QUARTER = f"SELECT ticker, {_QUARTER} AS quarter, CAST(year(transaction_date) * 4 + quarter(transaction_date) - 1 AS INT) AS q, count(*) AS n_trades, count(DISTINCT t.member_id) AS n_members, sum(amount_est) AS gross, sum(amount_est * direction) AS net, CAST(sum(CAST(amount_est * direction * coalesce(s.weight, 1.0) AS DECIMAL(28,8))) AS DOUBLE) AS weighted_net FROM trades t LEFT JOIN scores90 s ON s.member_id = t.member_id WHERE {USABLE} GROUP BY ticker, {_QUARTER}, CAST(year(transaction_date) * 4 + quarter(transaction_date) - 1 AS INT)"

_DAY = "DAYS[transaction_date; DATE '1970-01-01']"
_SIDED = f"SELECT t.ticker, CASE WHEN t.direction > 0 THEN 'buy' ELSE 'sell' END AS side, t.member_id, {_DAY} AS day, t.transaction_date, t.amount_est, t.amount_est * coalesce(s.weight, 1.0) AS weighted FROM trades t LEFT JOIN scores90 s ON s.member_id = t.member_id WHERE {USABLE} AND t.direction <> 0 AND t.member_id IS NOT NULL"

def _windows(days: int) -> str:
    """Windows of so many days that begin on a day with a trade: an equi-join of each member's day to the starts that it follows."""
    return f"SELECT s.ticker, s.side, s.transaction_date, count(DISTINCT p.member_id) AS n_members, CAST(sum(p.n) AS BIGINT) AS n_trades, sum(p.volume) AS volume, sum(p.weighted) AS weighted_volume FROM (SELECT *, EACH_INT[day - {days}; day] AS start FROM perday) p JOIN starts s ON s.ticker = p.ticker AND s.side = p.side AND s.day = p.start GROUP BY s.ticker, s.side, s.transaction_date"


def windows_text(days: int) -> str:
    """The same windows without copies: sums over the days of a side, and members as a running sum of steps.

    A member's day opens the windows that begin on the days up to it, and after the member's day before: so a member counts
    once in each. Days are one row for each ticker and side, however many trades fall on them.
    """
    steps = f"array(named_struct('day', day, 'date', transaction_date, 'step', 0, 'n', 1), named_struct('day', greatest(day - {days}, coalesce(before + 1, day - {days})), 'date', CAST(NULL AS DATE), 'step', 1, 'n', 0), named_struct('day', day + 1, 'date', CAST(NULL AS DATE), 'step', -1, 'n', 0))"
    ahead = f"(PARTITION BY ticker, side ORDER BY day RANGE BETWEEN CURRENT ROW AND {days} FOLLOWING)"
    return f"""
SELECT ticker, side, transaction_date, n_members, n_trades, volume, weighted_volume FROM (
  SELECT ticker, side, transaction_date, n, sum(step) OVER (PARTITION BY ticker, side ORDER BY day) AS n_members, sum(n) OVER {ahead} AS n_trades, sum(volume) OVER {ahead} AS volume, sum(weighted) OVER {ahead} AS weighted_volume FROM (
    SELECT ticker, side, e.day, max(e.date) AS transaction_date, CAST(sum(e.step) AS BIGINT) AS step, CAST(sum(e.n) AS BIGINT) AS n, sum(e.n * amount_est) AS volume, sum(e.n * weighted) AS weighted FROM (
      SELECT ticker, side, amount_est, weighted, explode({steps}) AS e FROM (
        SELECT ticker, side, day, transaction_date, amount_est, weighted, lag(day) OVER (PARTITION BY ticker, side, member_id ORDER BY day) AS before FROM sided) a) b
    GROUP BY ticker, side, e.day) c) d WHERE n > 0"""


#: What is correlated with the spend, by the name that the report gives it.
METRICS = {"n_members": "n_members", "gross_volume": "gross", "weighted_net_flow": "weighted_net"}

ACTIVITY_VIEWS = {
    "quarterly": _BY_QUARTER,
    # Trades beside the spend of the same quarter and of one and two quarters before; without lobbying the spend is 0.
    "overlaid": "SELECT k.lag_quarters, t.*, coalesce(s.spend, 0.0) AS lobbied, coalesce(s.filings, 0) AS filings FROM quarterly t CROSS JOIN (VALUES (0), (1), (2)) AS k(lag_quarters) LEFT JOIN spend s ON s.ticker = t.ticker AND s.q + k.lag_quarters = t.q",
    "measured": " UNION ALL ".join(f"SELECT lag_quarters, '{m}' AS metric, ticker, quarter, round(lobbied, 6) AS x, round(abs(CAST({c} AS DOUBLE)), 6) AS y FROM overlaid" for m, c in METRICS.items()),
    "placed": "SELECT lag_quarters, metric, rank() OVER (PARTITION BY lag_quarters, metric ORDER BY x) + (count(*) OVER (PARTITION BY lag_quarters, metric, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lag_quarters, metric ORDER BY y) + (count(*) OVER (PARTITION BY lag_quarters, metric, y) - 1) / 2.0 AS b FROM measured",
    "sided": _SIDED,
    # Every trade opens a window of 14 days.
    "starts": "SELECT DISTINCT ticker, side, day, transaction_date FROM sided",
    "perday": "SELECT ticker, side, member_id, day, count(*) AS n, sum(amount_est) AS volume, sum(weighted) AS weighted FROM sided GROUP BY ticker, side, member_id, day",
    # A member's day falls into the windows that begin on it and on the 14 days before; only days with a trade begin one.
    "windows": _windows(14),
    "newest": "SELECT max(transaction_date) AS as_of FROM trades",
    "recent": f"SELECT t.ticker, count(*) AS n_trades, count(DISTINCT t.member_id) AS n_members, sum(t.amount_est) AS volume, max(t.transaction_date) AS last_traded FROM trades t CROSS JOIN newest WHERE {USABLE} AND t.ticker_confidence >= 0.7 AND t.transaction_date >= SHIFT[as_of; -730] GROUP BY t.ticker",
    "ranked": "SELECT *, (rank() OVER (ORDER BY n_members) + (count(*) OVER (PARTITION BY n_members) - 1) / 2.0) / count(*) OVER () AS p_members, (rank() OVER (ORDER BY n_trades) + (count(*) OVER (PARTITION BY n_trades) - 1) / 2.0) / count(*) OVER () AS p_trades, (rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0) / count(*) OVER () AS p_volume FROM recent",
}


def timeline(member_id: int | None = None) -> str:
    """The trades of each member, or of one, with their excess return after 90 days."""
    one = "" if member_id is None else f" WHERE t.member_id = {int(member_id)}"
    own = "t.member_id, t.txn_id, t.ticker, t.transaction_date, t.filed_date, t.filing_delay_days, t.direction, t.amount_low, t.amount_high, t.amount_est, t.owner"
    return f"SELECT {own}, round(max(CASE WHEN r.horizon_days = 90 THEN r.excess_return END), 5) + 0.0 AS excess_90 FROM trades t LEFT JOIN returns r ON r.txn_id = t.txn_id{one} GROUP BY {own}"


def _quoted(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def where(start: str | None = None, end: str | None = None, chamber: str | None = None, party: str | None = None, owner: str | None = None, asset_types: tuple[str, ...] = ("stock", "fund", "option"), min_confidence: float = 0.6, ticker: str | None = None) -> str:
    """The common filter of trades t and members m; what isn't given doesn't count."""
    parts = ["t.ticker IS NOT NULL", f"t.ticker_confidence >= {float(min_confidence)}", f"t.asset_type IN ({', '.join(map(_quoted, asset_types))})"]
    parts += [f"t.transaction_date >= DATE {_quoted(start)}"] * (start is not None) + [f"t.transaction_date <= DATE {_quoted(end)}"] * (end is not None)
    return " AND ".join(parts + [f"{c} = {_quoted(v)}" for c, v in (("m.chamber", chamber), ("m.party", party), ("t.owner", owner), ("t.ticker", ticker)) if v is not None])


def _scores(horizon: int) -> str:
    return f"(SELECT member_id, weight, n_scored, mean_excess, shrunk_excess, hit_rate FROM scores WHERE horizon_days = {int(horizon)})"


def ticker_leaderboard(horizon: int = 90, limit: int = 50, **filters) -> str:
    """Tickers by how many members trade them, their flows weighted by the members' scores at the horizon."""
    return f"""
SELECT t.ticker, count(DISTINCT t.member_id) AS n_members, count(*) AS n_trades, CAST(sum(CASE WHEN t.direction > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_buys,
  CAST(sum(CASE WHEN t.direction < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_sells, count(DISTINCT CASE WHEN t.direction > 0 THEN t.member_id END) AS n_buyers,
  count(DISTINCT CASE WHEN t.direction < 0 THEN t.member_id END) AS n_sellers, round(sum(t.amount_est), 2) AS gross, round(sum(t.amount_est * t.direction), 2) + 0.0 AS net,
  round(sum(t.amount_est * t.direction * coalesce(s.weight, 1.0)), 1) + 0.0 AS weighted_net, round(sum(t.amount_low), 2) AS low_volume, round(sum(t.amount_high), 2) AS high_volume,
  round(avg(t.filing_delay_days), 4) AS avg_delay, min(t.transaction_date) AS first_trade, max(t.transaction_date) AS last_trade
FROM trades t LEFT JOIN members m ON m.member_id = t.member_id LEFT JOIN {_scores(horizon)} s ON s.member_id = t.member_id
WHERE {where(**filters)} GROUP BY t.ticker ORDER BY n_members DESC, gross DESC, t.ticker LIMIT {int(limit)}"""


def member_leaderboard(horizon: int = 90, limit: int = 100, **filters) -> str:
    """Members by gross volume, with their delays and scores."""
    return f"""
SELECT a.*, m.full_name, m.chamber, m.party, m.state, s.n_scored, round(s.mean_excess, 5) + 0.0 AS mean_excess, round(s.shrunk_excess, 5) + 0.0 AS shrunk_excess, round(s.hit_rate, 5) AS hit_rate, round(s.weight, 4) AS weight
FROM (SELECT t.member_id, count(*) AS n_trades, count(DISTINCT ticker) AS n_tickers, round(sum(amount_est), 2) AS gross, round(sum(amount_est * direction), 2) + 0.0 AS net,
    round(avg(filing_delay_days), 4) AS avg_delay, max(filing_delay_days) AS max_delay, CAST(sum(CASE WHEN filing_delay_days > 45 THEN 1 ELSE 0 END) AS BIGINT) AS n_late
  FROM trades t LEFT JOIN members m ON m.member_id = t.member_id WHERE {where(**filters)} AND t.member_id IS NOT NULL GROUP BY t.member_id ORDER BY gross DESC, t.member_id LIMIT {int(limit)}) a
LEFT JOIN members m ON m.member_id = a.member_id LEFT JOIN {_scores(horizon)} s ON s.member_id = a.member_id"""


def flow_timeseries(freq: str, **filters) -> str:
    """Trades, members and volumes by period: d, w, m, q or y."""
    return f"SELECT {PERIODS[freq]} AS period, {_FLOW.replace('count(DISTINCT member_id)', 'count(DISTINCT t.member_id)')} FROM trades t LEFT JOIN members m ON m.member_id = t.member_id WHERE {where(**filters)} GROUP BY {PERIODS[freq]}"


def clusters(window_days: int = 14, min_members: int = 4, limit: int = 40) -> str:
    """Windows in which most members trade a ticker to one side: for each number of members the one with the largest volume."""
    source = "windows" if window_days == 14 else f"({windows_text(int(window_days))})"
    return f"SELECT ticker, side, transaction_date AS window_start, SHIFT[transaction_date; {int(window_days)}] AS window_end, n_members, n_trades, round(volume, 2) AS volume, round(weighted_volume, 1) AS weighted_volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker, side, n_members ORDER BY round(weighted_volume, 4) DESC, transaction_date) AS k FROM {source} v WHERE n_members >= {int(min_members)}) x WHERE k = 1 ORDER BY x.n_members DESC, round(x.weighted_volume, 4) DESC, ticker, side LIMIT {int(limit)}"


ACTIVITY_QUERIES = {
    "ticker_leaderboard": ticker_leaderboard(),
    "ticker_leaderboard_filtered": ticker_leaderboard(horizon=30, limit=10, start="1994-01-01", end="1997-12-31", chamber="ASIA", owner="O", asset_types=("stock", "option"), min_confidence=0.7),
    "member_leaderboard": member_leaderboard(),
    "member_leaderboard_filtered": member_leaderboard(horizon=180, limit=20, start="1995-01-01", party="BUILDING"),
    "flow_timeseries_filtered": flow_timeseries("m", ticker="Brand#11", chamber="EUROPE"),
    **{f"flow_timeseries_{k}": flow_timeseries(k) for k in PERIODS},
    "member_timeline": timeline(),
    "disclosure_delay_stats": f"SELECT m.chamber, m.party, count(*) AS n, round(avg(t.filing_delay_days), 4) AS mean_delay, min(t.filing_delay_days) AS min_delay, max(t.filing_delay_days) AS max_delay, round(avg(CASE WHEN t.filing_delay_days > 45 THEN 1.0 ELSE 0.0 END), 6) AS pct_late FROM trades t JOIN members m ON m.member_id = t.member_id WHERE {USABLE} AND t.filing_delay_days IS NOT NULL GROUP BY m.chamber, m.party",
    "delay_histogram": f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM trades GROUP BY {_BUCKET}",
    "summary_counts": "SELECT count(*) AS n_trades, count(DISTINCT member_id) AS n_members, count(DISTINCT ticker) AS n_tickers, round(sum(amount_est), 2) AS volume, round(avg(filing_delay_days), 4) AS mean_delay, round(avg(CASE WHEN filing_delay_days > 45 THEN 100.0 ELSE 0.0 END), 4) AS pct_late FROM trades",
    # The upper median from counts by delay, so no row is ranked by itself.
    "median_delay_upper": "SELECT min(filing_delay_days) AS median_delay FROM (SELECT filing_delay_days, sum(n) OVER (ORDER BY filing_delay_days) AS upto, sum(n) OVER () AS total FROM (SELECT filing_delay_days, count(*) AS n FROM trades GROUP BY filing_delay_days) a) b WHERE upto >= floor(total / 2) + 1",
    "cluster_detector": clusters(),
    "lobbying_by_quarter": "SELECT ticker, quarter, round(spend, 4) AS spend, filings, registrants FROM spend",
    "trades_by_quarter": "SELECT ticker, quarter, n_trades, n_members, round(gross, 2) AS gross, round(net, 2) + 0.0 AS net, round(weighted_net, 1) + 0.0 AS weighted_net FROM quarterly",
    **{f"lobbying_overlay_lag{k}": f"SELECT t.ticker, t.quarter, t.n_trades, round(t.net, 2) + 0.0 AS net, round(s.spend, 2) AS spend FROM quarterly t LEFT JOIN spend s ON s.ticker = t.ticker AND s.q + {k} = t.q" for k in (0, 1, 2)},
    "lobbying_rollup": "SELECT ticker, round(sum(lobbied), 2) AS spend, CAST(sum(filings) AS BIGINT) AS filings, CAST(sum(n_members) AS BIGINT) AS n_members, round(sum(gross), 2) AS gross, round(sum(weighted_net), 1) + 0.0 AS weighted_net FROM overlaid WHERE lag_quarters = 0 GROUP BY ticker ORDER BY spend DESC, ticker LIMIT 40",
    # t_stat has n - 2 degrees of freedom.
    "correlation_report": "SELECT lag_quarters, metric, n, round(rho, 6) + 0.0 AS rho, round(rho * sqrt((n - 2) / nullif(1 - rho * rho, 0.0)), 4) + 0.0 AS t_stat FROM (SELECT lag_quarters, metric, count(*) AS n, corr(a, b) AS rho FROM placed GROUP BY lag_quarters, metric HAVING count(*) >= 10) x",
    "universe": "SELECT CAST(row_number() OVER (ORDER BY 0.5 * p_members + 0.25 * p_trades + 0.25 * p_volume DESC, ticker) AS INT) AS place, ticker, n_members, n_trades, round(volume, 2) AS volume, round(0.5 * p_members + 0.25 * p_trades + 0.25 * p_volume, 6) AS score, last_traded, concat(CAST(n_members AS STRING), ' members, ', CAST(n_trades AS STRING), ' trades') AS reason FROM ranked ORDER BY score DESC, ticker LIMIT 50",
    "trades_without_score": "SELECT t.txn_id FROM trades t WHERE NOT EXISTS (SELECT 1 FROM scores90 s WHERE s.member_id = t.member_id)",
    "topk_per_ticker": "SELECT ticker, txn_id, amount_est, CAST(k AS INT) AS k FROM (SELECT ticker, txn_id, amount_est, row_number() OVER (PARTITION BY ticker ORDER BY amount_est DESC, txn_id) AS k FROM trades) x WHERE k <= 3",
}
