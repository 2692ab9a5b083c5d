"""Event studies, theme attention, momentum, forward returns, earnings and factor panels."""

from __future__ import annotations

MARKET_VIEWS = {
    # The estimation window must begin, and the event window end, within the calendar.
    "anchors": "SELECT DISTINCT ticker, day AS pos FROM (SELECT DISTINCT ticker, transaction_date FROM scorable) s JOIN anchorday d ON d.date = s.transaction_date CROSS JOIN (SELECT max(day) AS last FROM tradingdays) l WHERE day - 250 >= 1 AND day + 20 <= last",
    "paired": "SELECT m.ticker, m.day, m.ret, b.ret AS market, CAST(floor(m.day / 250.0) AS INT) AS span FROM moves m JOIN (SELECT day, ret FROM moves WHERE ticker = 'BENCH') b ON b.day = m.day WHERE m.ticker <> 'BENCH'",
    # One fit for each ticker and day, however many trades fall on it.
    "fits": """
SELECT a.ticker, a.pos, count(*) AS n_est, regr_slope(p.ret, p.market) AS beta, regr_intercept(p.ret, p.market) AS alpha, regr_r2(p.ret, p.market) AS r2,
  sqrt(greatest(regr_syy(p.ret, p.market) * (1 - regr_r2(p.ret, p.market)), 0.0) / (count(*) - 2)) AS sd
FROM (SELECT *, EACH_INT[CAST(floor((pos - 250) / 250.0) AS INT); CAST(floor((pos - 31) / 250.0) AS INT)] AS span FROM anchors) a
JOIN paired p ON p.ticker = a.ticker AND p.span = a.span AND p.day BETWEEN a.pos - 250 AND a.pos - 31 GROUP BY a.ticker, a.pos HAVING count(*) >= 40""",
    "cars": """
SELECT f.ticker, f.pos, f.n_est, f.beta, f.r2, sum(p.ret - f.alpha - f.beta * p.market) AS car, sum(p.ret - f.alpha - f.beta * p.market) / nullif(max(f.sd) * sqrt(count(*)), 0.0) AS t_stat
FROM (SELECT *, EACH_INT[CAST(floor(pos / 250.0) AS INT); CAST(floor((pos + 20) / 250.0) AS INT)] AS span FROM fits) f JOIN paired p ON p.ticker = f.ticker AND p.span = f.span AND p.day BETWEEN f.pos AND f.pos + 20 GROUP BY f.ticker, f.pos, f.n_est, f.beta, f.r2""",
    "zscored": """
SELECT theme, hour, intensity, CASE WHEN n >= 30 AND sd > 0 THEN least(greatest((intensity - mean) / sd, -6.0), 6.0) END AS z FROM (
  SELECT *, count(*) OVER w AS n, avg(intensity) OVER w AS mean, stddev_samp(intensity) OVER w AS sd
  FROM themes WINDOW w AS (PARTITION BY theme ORDER BY hour ROWS BETWEEN 180 PRECEDING AND 1 PRECEDING)) x""",
    "benchday": "SELECT day, px FROM daily WHERE ticker = 'BENCH'",
    "forward": """
SELECT a.ticker, a.date, a.day, b.px / a.px - 1 - (d.px / c.px - 1) AS y21 FROM daily a JOIN daily b ON b.ticker = a.ticker AND b.day = a.day + 21
JOIN benchday c ON c.day = a.day JOIN benchday d ON d.day = a.day + 21 WHERE a.ticker <> 'BENCH'""",
    "forward126": """
SELECT a.ticker, a.date, b.px / a.px - 1 - (d.px / c.px - 1) AS y126 FROM daily a JOIN daily b ON b.ticker = a.ticker AND b.day = a.day + 126
JOIN benchday c ON c.day = a.day JOIN benchday d ON d.day = a.day + 126 WHERE a.ticker <> 'BENCH'""",
    "momentum": """
SELECT ticker, date, coalesce(px / p20 - 1, 0.0) AS mom_20, coalesce(px / p120 - 1, 0.0) AS mom_120, CASE WHEN n > 10 THEN coalesce(vol, 0.0) ELSE 0.0 END AS vol_60, n FROM (
  SELECT ticker, date, px, lag(px, 20) OVER (PARTITION BY ticker ORDER BY date) AS p20, lag(px, 120) OVER (PARTITION BY ticker ORDER BY date) AS p120,
    stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS vol, count(*) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
  FROM (SELECT *, px / lag(px) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM daily WHERE ticker <> 'BENCH') r) x""",
    "weeks": "SELECT max(date) AS date FROM tradingdays GROUP BY WEEK_START[date]",
    "spine": "SELECT k.ticker, w.date FROM (SELECT DISTINCT ticker FROM quotes) k CROSS JOIN weeks w",
    "politician": """
SELECT s.ticker, s.date, coalesce(sum(t.amount_est * t.direction) / nullif(sum(t.amount_est), 0.0), 0.0) AS net_ratio_90, count(DISTINCT CASE WHEN t.direction > 0 THEN t.member_id END) AS n_buyers_90,
  count(DISTINCT t.member_id) AS n_members_90, coalesce(avg(CASE WHEN t.direction > 0 THEN 1.0 WHEN t.direction < 0 THEN 0.0 END), 0.5) AS buy_share_90, ln(1 + coalesce(sum(t.amount_est), 0.0)) AS log_gross_90
FROM spine s LEFT JOIN scorable t ON t.ticker = s.ticker AND t.filed_date <= s.date AND t.filed_date > SHIFT[s.date; -90] GROUP BY s.ticker, s.date""",
    "lobbyweek": """
SELECT s.ticker, s.date, sum(CASE WHEN l.period_end > SHIFT[s.date; -365] THEN l.amount ELSE 0.0 END) AS near, sum(CASE WHEN l.period_end <= SHIFT[s.date; -365] THEN l.amount ELSE 0.0 END) AS far
FROM spine s LEFT JOIN (SELECT ticker, period_end, sum(amount) AS amount FROM lobbying GROUP BY ticker, period_end) l ON l.ticker = s.ticker AND l.period_end <= s.date AND l.period_end > SHIFT[s.date; -730] GROUP BY s.ticker, s.date""",
    "features": "SELECT p.*, m.mom_20, m.mom_120, m.vol_60, f.y21 FROM politician p JOIN momentum m ON m.ticker = p.ticker AND m.date = p.date JOIN forward f ON f.ticker = p.ticker AND f.date = p.date WHERE m.n >= 130",
    "crossed": """
SELECT ticker, date, y21, least(greatest(coalesce((net_ratio_90 - avg(net_ratio_90) OVER w) / nullif(stddev_samp(net_ratio_90) OVER w, 0.0), 0.0), -3.0), 3.0) AS z_flow,
  least(greatest(coalesce((mom_20 - avg(mom_20) OVER w) / nullif(stddev_samp(mom_20) OVER w, 0.0), 0.0), -3.0), 3.0) AS z_mom_20, least(greatest(coalesce((mom_120 - avg(mom_120) OVER w) / nullif(stddev_samp(mom_120) OVER w, 0.0), 0.0), -3.0), 3.0) AS z_mom_120
FROM features WINDOW w AS (PARTITION BY date)""",
    "composite": "SELECT ticker, date, y21, z_flow, (z_mom_20 + z_mom_120) / 2 AS z_momentum, round((z_flow + (z_mom_20 + z_mom_120) / 2) / 2, 9) AS score FROM crossed",
    "forwards": "SELECT s.ticker, s.date, f.y21, g.y126 FROM spine s LEFT JOIN forward f ON f.ticker = s.ticker AND f.date = s.date LEFT JOIN forward126 g ON g.ticker = s.ticker AND g.date = s.date",
    "blocks": "SELECT date, ntile(7) OVER (ORDER BY date) AS block FROM (SELECT DISTINCT date FROM features) d",
}

MARKET_QUERIES = {
    "event_study_car": "SELECT ticker, pos, n_est, round(beta, 4) + 0.0 AS beta, round(r2, 4) + 0.0 AS r2, round(car, 4) + 0.0 AS car, round(t_stat, 3) + 0.0 AS t_stat FROM cars",
    "event_study_summary": "SELECT t.ticker, count(*) AS n, round(avg(c.car * t.direction), 5) + 0.0 AS mean_car, round(median(c.car * t.direction), 5) + 0.0 AS median_car, round(stddev_samp(c.car * t.direction), 5) AS sd, round(avg(c.car * t.direction) / nullif(stddev_samp(c.car * t.direction) / sqrt(count(*)), 0.0), 3) + 0.0 AS t_stat, round(avg(CASE WHEN c.car * t.direction > 0 THEN 1.0 ELSE 0.0 END), 5) AS pct_positive FROM scorable t JOIN anchorday d ON d.date = t.transaction_date JOIN cars c ON c.ticker = t.ticker AND c.pos = d.day GROUP BY t.ticker",
    "event_zscores": "SELECT theme, hour, intensity, round(z, 5) + 0.0 AS z FROM zscored",
    "forward_excess": "SELECT ticker, date, round(y21, 5) + 0.0 AS y21 FROM forward",
    "forward_excess_long": "SELECT ticker, date, round(y126, 5) + 0.0 AS y126 FROM forward126",
    "momentum_vol": "SELECT ticker, date, round(mom_20, 5) + 0.0 AS mom_20, round(mom_120, 5) + 0.0 AS mom_120, round(vol_60, 5) AS vol_60 FROM momentum WHERE n >= 130",
    "earnings_surprise": "SELECT ticker, report_date, round((eps_actual - eps_estimate) / nullif(abs(eps_estimate), 0.0), 5) + 0.0 AS surprise FROM earnings",
    "features_politician": "SELECT ticker, date, round(net_ratio_90, 5) + 0.0 AS net_ratio_90, n_buyers_90, n_members_90, round(buy_share_90, 5) AS buy_share_90, round(log_gross_90, 5) AS log_gross_90 FROM politician",
    "features_lobbying": "SELECT ticker, date, round(ln(1 + near), 5) AS log_lobby_12m, CASE WHEN far > 0 THEN round((near - far) / far, 4) + 0.0 ELSE 0.0 END AS lobby_yoy FROM lobbyweek",
    "cross_sectional_z": "SELECT ticker, date, round(z_flow, 4) + 0.0 AS z_flow, round(z_mom_20, 4) + 0.0 AS z_mom_20, round(z_mom_120, 4) + 0.0 AS z_mom_120 FROM crossed",
    "factor_scores": "SELECT ticker, date, round(z_flow, 4) + 0.0 AS z_flow, round(z_momentum, 4) + 0.0 AS z_momentum, round(score, 4) + 0.0 AS score FROM composite",
    "walk_forward_splits": "SELECT CAST(t.block - 1 AS INT) AS fold, min(t.date) AS test_from, max(t.date) AS test_to, SHIFT[min(t.date); -36] AS train_before, count(*) AS n_test FROM blocks t WHERE t.block > 1 GROUP BY t.block",
    "spearman_ic": "SELECT count(*) AS n, round(corr(a, b), 5) AS ic FROM (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY round(y21, 8)) + (count(*) OVER (PARTITION BY round(y21, 8)) - 1) / 2.0 AS b FROM composite) x",
    "quintile_spread": "SELECT CAST(greatest(ceil((r - 1) * 5.0 / (n - 1)), 1) - 1 AS INT) AS quintile, count(*) AS n, round(avg(y21), 5) + 0.0 AS mean_y FROM (SELECT y21, row_number() OVER (ORDER BY score, date, ticker) AS r, count(*) OVER () AS n FROM composite) x GROUP BY CAST(greatest(ceil((r - 1) * 5.0 / (n - 1)), 1) - 1 AS INT)",
    "rank_picks": "SELECT ticker, round(score, 4) + 0.0 AS score, CAST(row_number() OVER (ORDER BY score DESC, ticker) AS INT) AS place FROM composite WHERE date = (SELECT max(date) FROM composite)",
}
