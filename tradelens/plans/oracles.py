"""DuckDB SQL written by hand from the rules of the analytics, straight on the tables: no text is shared with the queries."""

from __future__ import annotations

_TRADES = """
t AS MATERIALIZED (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS txn_id, p_brand AS ticker, o_custkey AS member_id, CAST(o_orderdate AS DATE) AS traded,
    CAST(1 + (l_partkey * 7 + l_linenumber * 13) % 120 AS INTEGER) AS delay, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS side, l_extendedprice AS amount,
    round(1 - l_tax * 5, 2) AS sure
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
px AS MATERIALIZED (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_extendedprice / l_quantity AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS p
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
bench AS MATERIALIZED (SELECT day, CAST(sum(CAST(p AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS p FROM px GROUP BY day),
edge AS (SELECT min(day) AS lo, max(day) AS hi FROM px)"""


def _priced(name: str, rows: str, at: dict[str, str]) -> str:
    """rows with p_k and b_k for each k of at: the last price of the ticker and of the benchmark on or before a day."""
    clamped = ", ".join(f"greatest({d}, lo) AS d_{k}" for k, d in at.items())
    joins = " ".join(f"ASOF JOIN px p{k} ON p{k}.ticker = r.ticker AND p{k}.day <= r.d_{k} ASOF JOIN bench b{k} ON b{k}.day <= r.d_{k}" for k in at)
    found = ", ".join(f"p{k}.p AS p_{k}, b{k}.p AS b_{k}" for k in at)
    last = list(at.values())[-1]
    return f"{name} AS MATERIALIZED (SELECT r.*, {found} FROM (SELECT x.*, {clamped} FROM ({rows}) x, edge WHERE {last} <= hi) r {joins})"


_RETURNS = _TRADES + ",\n" + _priced("held", "SELECT t.*, h FROM t, (VALUES (30), (90), (180), (365)) v(h) WHERE sure >= 0.7 AND side <> 0", {"0": "traded", "1": "traded + h"}) + """,
ret AS MATERIALIZED (SELECT txn_id, member_id, amount, h, round(((p_1 / p_0 - 1) - (b_1 / b_0 - 1)) * side, 12) + 0 AS excess FROM held WHERE p_0 > 0 AND b_0 > 0)"""

_SCORES = _RETURNS + """,
m AS (SELECT h, member_id, count(*) AS n, avg(excess) AS mean, stddev_samp(excess) AS sd, avg(CAST(excess > 0 AS INTEGER)) AS hits,
  sum(excess * greatest(amount, 1)) / sum(greatest(amount, 1)) AS wtd FROM ret WHERE member_id IS NOT NULL GROUP BY h, member_id),
base AS (SELECT * FROM m WHERE n >= 5 OR h NOT IN (SELECT h FROM m WHERE n >= 5)),
usual AS (SELECT h, median(sd) AS sd0, sum(n * mean) / sum(n) AS mu FROM base GROUP BY h),
prior AS (SELECT b.h, any_value(mu) AS mu, any_value(sd0) AS sd0, greatest(coalesce(var_samp(mean), 0) - avg(pow(coalesce(sd, sd0), 2) / n), 1e-9) AS tau2 FROM base b JOIN usual u ON u.h = b.h GROUP BY b.h),
s AS (SELECT m.*, mu, mu + tau2 / (tau2 + pow(coalesce(sd, sd0), 2) / n) * (mean - mu) AS shrunk FROM m JOIN prior ON prior.h = m.h),
w AS MATERIALIZED (SELECT *, least(greatest(1 + (shrunk - mu) / (2 * CASE WHEN spread = 0 THEN 1 ELSE spread END), 0.25), 2) AS weight FROM (SELECT *, stddev_samp(shrunk) OVER (PARTITION BY h) AS spread FROM s) x)"""

_MEMBERS = "people AS (SELECT c_custkey AS member_id, c_name AS full_name, r_name AS chamber, c_mktsegment AS party, n_name AS state FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"

# The model fitted to each event by DuckDB's own regression over the days of its window.
_POLICY = _TRADES + """,
cal AS MATERIALIZED (SELECT day, row_number() OVER (ORDER BY day) AS k FROM bench),
every AS (SELECT ticker, k, p FROM px JOIN cal USING (day) UNION ALL SELECT 'BENCH', k, p FROM bench JOIN cal USING (day)),
moved AS (SELECT b.ticker, b.k, b.p / a.p - 1 AS r FROM every a JOIN every b ON b.ticker = a.ticker AND b.k = a.k + 1),
pairs AS MATERIALIZED (SELECT y.ticker, y.k, y.r AS y, x.r AS x FROM moved y JOIN moved x ON x.k = y.k AND x.ticker = 'BENCH' WHERE y.ticker <> 'BENCH'),
ev AS MATERIALIZED (SELECT DISTINCT CAST(o_orderdate AS DATE) AS event_date, p_brand AS ticker FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderpriority = '1-URGENT' AND l_quantity = 50),
placed AS MATERIALIZED (SELECT ev.*, (SELECT min(k) FROM cal WHERE day >= event_date) AS k0 FROM ev),
fit AS (SELECT event_date, a.ticker, k0, count(*) AS n, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, regr_r2(y, x) AS r2, sqrt(greatest(regr_syy(y, x) * (1 - regr_r2(y, x)), 0) / (count(*) - 2)) AS sd
  FROM placed a JOIN pairs p ON p.ticker = a.ticker AND p.k >= k0 - 250 AND p.k < k0 - 30 WHERE k0 > 250 AND k0 + 20 <= (SELECT max(k) FROM cal) GROUP BY event_date, a.ticker, k0 HAVING count(*) >= 40)
SELECT concat('E', event_date, ':', f.ticker) AS key, event_date, f.ticker, any_value(n) AS n_est, round(any_value(beta), 4) + 0 AS beta, round(any_value(r2), 4) + 0 AS r2,
  round(sum(y - alpha - beta * x), 4) + 0 AS car, round(sum(y - alpha - beta * x) / any_value(sd) / sqrt(count(*)), 3) + 0 AS t_stat
FROM fit f JOIN pairs p ON p.ticker = f.ticker AND p.k BETWEEN k0 - 5 AND k0 + 20 GROUP BY event_date, f.ticker"""

# Average ranks by quarter and ticker; the p value is the area under the density of t outside of it, by Simpson's rule.
_CORRELATION = _SCORES + """,
q AS (SELECT ticker, CAST(year(traded) * 4 + quarter(traded) - 1 AS BIGINT) AS quarter, count(DISTINCT t.member_id) AS n_members, sum(amount) AS gross_volume,
  CAST(sum(CAST(amount * side * coalesce(weight, 1) AS DECIMAL(28,8))) AS DOUBLE) AS weighted_net_flow FROM t LEFT JOIN w ON w.member_id = t.member_id AND w.h = 90 WHERE sure >= 0.6 GROUP BY 1, 2),
spent AS (SELECT p_brand AS ticker, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS BIGINT) AS quarter, CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE) AS spend FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
o AS (SELECT lag AS lag_quarters, q.*, coalesce(spend, 0) AS x FROM q, (VALUES (0), (1), (2)) v(lag) LEFT JOIN spent ON spent.ticker = q.ticker AND spent.quarter = q.quarter - lag),
l AS (SELECT lag_quarters, metric, round(x, 6) AS x, round(abs(value), 6) AS y FROM (SELECT lag_quarters, x, CAST(n_members AS DOUBLE) AS n_members, gross_volume, weighted_net_flow FROM o) UNPIVOT (value FOR metric IN (n_members, gross_volume, weighted_net_flow))),
k AS (SELECT lag_quarters, metric, rank() OVER (PARTITION BY lag_quarters, metric ORDER BY x) + (count(*) OVER (PARTITION BY lag_quarters, metric, x) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY lag_quarters, metric ORDER BY y) + (count(*) OVER (PARTITION BY lag_quarters, metric, y) - 1) / 2.0::DOUBLE AS b FROM l),
c AS (SELECT lag_quarters, metric, count(*) AS n, corr(a, b) AS rho FROM k GROUP BY 1, 2 HAVING count(*) >= 10),
g AS (SELECT *, n - 2 AS df, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM c),
area AS (SELECT lag_quarters, metric, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * i / 4000, 2) / df, -(df + 1) / 2.0::DOUBLE)) * t / 12000 * exp(lgamma((df + 1) / 2.0::DOUBLE) - lgamma(df / 2.0::DOUBLE)) / sqrt(df * pi()) AS half
  FROM g, range(4001) r(i) GROUP BY lag_quarters, metric, t, df)
SELECT lag_quarters, metric, n, round(rho, 6) + 0 AS rho, round(greatest(1 - 2 * half, 0), 6) AS p_value FROM g JOIN area USING (lag_quarters, metric)"""

_UNIVERSE = _TRADES + """,
u AS MATERIALIZED (SELECT ticker, count(*) AS n_trades, count(DISTINCT member_id) AS n_members, sum(amount) AS volume, max(traded) AS last_traded FROM t WHERE sure >= 0.7 AND traded >= (SELECT max(traded) - 730 FROM t) GROUP BY ticker),
v AS (SELECT u.*, count(*) FILTER (o.n_members < u.n_members) + (count(*) FILTER (o.n_members = u.n_members) + 1) / 2.0::DOUBLE AS a, count(*) FILTER (o.n_trades < u.n_trades) + (count(*) FILTER (o.n_trades = u.n_trades) + 1) / 2.0::DOUBLE AS b,
  count(*) FILTER (o.volume < u.volume) + (count(*) FILTER (o.volume = u.volume) + 1) / 2.0::DOUBLE AS c, count(*) AS n FROM u, u o GROUP BY ALL),
s AS (SELECT *, round((0.5::DOUBLE * a + 0.25::DOUBLE * b + 0.25::DOUBLE * c) / n, 6) AS score FROM v)
SELECT CAST(row_number() OVER (ORDER BY score DESC, ticker) AS INTEGER) AS place, ticker, n_members, n_trades, round(volume, 2) AS volume, score, last_traded, concat(n_members, ' members, ', n_trades, ' trades') AS reason FROM s ORDER BY score DESC, ticker LIMIT 50"""

WRITTEN = {
    "universe": f"WITH {_UNIVERSE}",
    "trade_returns": f"WITH {_RETURNS} SELECT txn_id, h AS horizon_days, round(excess, 5) + 0 AS excess_return FROM ret",
    "member_scores": f"WITH {_SCORES} SELECT h AS horizon_days, w.member_id, n AS n_scored, round(mean, 5) + 0 AS mean_excess, round(sd, 5) + 0 AS sd_excess, round(hits, 5) AS hit_rate, round(wtd, 5) + 0 AS dollar_wtd_excess, round(shrunk, 5) + 0 AS shrunk_excess, round(mean / nullif(sd / sqrt(n), 0), 4) + 0 AS t_stat, round(weight, 4) AS weight, n_trades FROM w JOIN (SELECT member_id, count(*) AS n_trades FROM t GROUP BY member_id) c USING (member_id)",
    "timing_decompose": f"WITH {_TRADES}, {_priced('legs', 'SELECT * FROM t WHERE sure >= 0.7 AND side <> 0 AND delay >= 0', {'0': 'traded', 'f': 'traded + delay', '1': 'traded + delay + 90'})},"
    " e AS (SELECT txn_id, delay, ((p_f / p_0 - 1) - (b_f / b_0 - 1)) * side AS pre, ((p_1 / p_f - 1) - (b_1 / b_f - 1)) * side AS post FROM legs WHERE least(p_0, p_f, p_1, b_0, b_f, b_1) > 0)"
    " SELECT txn_id, delay AS lag_days, round(pre, 5) + 0 AS pre, round(post, 5) + 0 AS post, round(pre + post, 5) + 0 AS total, CASE WHEN abs(pre + post) > 1e-9 THEN round(post / (pre + post), 3) + 0 END AS capturable_share FROM e",
    "ticker_leaderboard": f"WITH {_SCORES} SELECT ticker, count(DISTINCT t.member_id) AS n_members, count(*) AS n_trades, count(*) FILTER (side > 0) AS n_buys, count(*) FILTER (side < 0) AS n_sells, count(DISTINCT t.member_id) FILTER (side > 0) AS n_buyers, count(DISTINCT t.member_id) FILTER (side < 0) AS n_sellers,"
    " round(sum(amount), 2) AS gross, round(sum(amount * side), 2) + 0 AS net, round(sum(amount * side * coalesce(weight, 1)), 1) + 0 AS weighted_net, CAST(sum(CASE WHEN amount <= 15000 THEN 1001 WHEN amount <= 50000 THEN 15001 ELSE 50001 END) AS DOUBLE) AS low_volume,"
    " CAST(sum(CASE WHEN amount <= 15000 THEN 15000 WHEN amount <= 50000 THEN 50000 ELSE 100000 END) AS DOUBLE) AS high_volume, round(avg(delay), 4) AS avg_delay, min(traded) AS first_trade, max(traded) AS last_trade"
    " FROM t LEFT JOIN w ON w.member_id = t.member_id AND w.h = 90 WHERE sure >= 0.6 GROUP BY ticker ORDER BY n_members DESC, gross DESC, ticker LIMIT 50",
    "member_leaderboard": f"WITH {_SCORES}, {_MEMBERS} SELECT t.member_id, count(*) AS n_trades, count(DISTINCT ticker) AS n_tickers, round(sum(amount), 2) AS gross, round(sum(amount * side), 2) + 0 AS net, round(avg(delay), 4) AS avg_delay, max(delay) AS max_delay, count(*) FILTER (delay > 45) AS n_late,"
    " any_value(full_name) AS full_name, any_value(chamber) AS chamber, any_value(party) AS party, any_value(state) AS state, any_value(n) AS n_scored, round(any_value(mean), 5) + 0 AS mean_excess, round(any_value(shrunk), 5) + 0 AS shrunk_excess, round(any_value(hits), 5) AS hit_rate, round(any_value(weight), 4) AS weight"
    " FROM t LEFT JOIN people ON people.member_id = t.member_id LEFT JOIN w ON w.member_id = t.member_id AND w.h = 90 WHERE sure >= 0.6 GROUP BY t.member_id ORDER BY gross DESC, t.member_id LIMIT 100",
    "policy_event_study": f"WITH {_POLICY}",
    "correlation_report": f"WITH {_CORRELATION}",
}
