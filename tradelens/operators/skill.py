"""Returns after trades, disclosure lag, and skill scores shrunk by an empirical Bayes prior."""

from __future__ import annotations

MIN_TRADES = 5

SKILL_VIEWS = {
    # Excess over the benchmark after h days, signed by the trade; as-of prices are equi-joins on the dense panel. Rounded so that
    # a trade that moved as the benchmark did is no hit, however its zero comes out.
    "entries": """
SELECT t.txn_id, t.member_id, t.ticker, t.amount_est, t.direction, h.horizon_days,
  greatest(t.transaction_date, s.lo) AS d0, greatest(SHIFT[t.transaction_date; h.horizon_days], s.lo) AS d1
FROM scorable t CROSS JOIN (VALUES (30), (90), (180), (365)) AS h(horizon_days) CROSS JOIN span s""",
    "entered": "SELECT e.*, p.px AS px0, p.bpx AS bpx0 FROM entries e JOIN relative p ON p.ticker = e.ticker AND p.date = e.d0 WHERE p.px > 0 AND p.bpx > 0",
    "returns": """
SELECT e.txn_id, e.member_id, e.ticker, e.amount_est, e.horizon_days, round(((p.px / e.px0 - 1) - (p.bpx / e.bpx0 - 1)) * e.direction, 12) + 0.0 AS excess_return
FROM entered e JOIN relative p ON p.ticker = e.ticker AND p.date = e.d1 WHERE p.px IS NOT NULL AND p.bpx IS NOT NULL""",
    "stats": """
SELECT horizon_days, member_id, count(*) AS n_scored, avg(excess_return) AS mean_excess, stddev_samp(excess_return) AS sd_excess,
  avg(CASE WHEN excess_return > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
  sum(excess_return * greatest(amount_est, 1.0)) / sum(greatest(amount_est, 1.0)) AS dollar_wtd_excess
FROM returns WHERE member_id IS NOT NULL GROUP BY horizon_days, member_id""",
    "eligible": f"""
SELECT s.*, r.reached FROM stats s JOIN (SELECT horizon_days, max(CASE WHEN n_scored >= {MIN_TRADES} THEN 1 ELSE 0 END) AS reached FROM stats GROUP BY horizon_days) r ON r.horizon_days = s.horizon_days
WHERE r.reached = 0 OR s.n_scored >= {MIN_TRADES}""",
    # The noise of members without a spread of their own is taken from the median spread; sums keep it to one grouping.
    "prior": """
SELECT horizon_days, mu, sd, greatest(seen - (coalesce(known, 0.0) + sd * sd * unknown) / n, 1e-9) AS tau2 FROM (
  SELECT horizon_days, median(sd_excess) AS sd, sum(mean_excess * n_scored) / sum(n_scored) AS mu, coalesce(var_samp(mean_excess), 0.0) AS seen,
    sum(sd_excess * sd_excess / n_scored) AS known, sum(CASE WHEN sd_excess IS NULL THEN 1.0 / n_scored ELSE 0.0 END) AS unknown, count(*) AS n
  FROM eligible GROUP BY horizon_days) x""",
    "shrunk": """
SELECT s.*, p.mu, p.mu + p.tau2 / (p.tau2 + coalesce(s.sd_excess, p.sd) * coalesce(s.sd_excess, p.sd) / s.n_scored) * (s.mean_excess - p.mu) AS shrunk_excess,
  s.mean_excess / nullif(s.sd_excess / sqrt(s.n_scored), 0.0) AS t_stat
FROM stats s JOIN prior p ON s.horizon_days = p.horizon_days""",
    "scores": """
SELECT *, least(greatest(1.0 + (shrunk_excess - mu) / (2 * CASE WHEN spread = 0 THEN 1.0 ELSE spread END), 0.25), 2.0) AS weight
FROM (SELECT s.*, p.spread FROM shrunk s JOIN (SELECT horizon_days, stddev_samp(shrunk_excess) AS spread FROM shrunk GROUP BY horizon_days) p ON p.horizon_days = s.horizon_days) x""",
    "scores90": "SELECT member_id, weight, n_scored, mean_excess, shrunk_excess, hit_rate FROM scores WHERE horizon_days = 90",
    "legs": """
SELECT t.txn_id, t.member_id, t.ticker, t.filing_delay_days AS lag_days, t.direction,
  greatest(t.transaction_date, s.lo) AS d0, greatest(t.filed_date, s.lo) AS df, greatest(SHIFT[t.filed_date; 90], s.lo) AS d1
FROM scorable t CROSS JOIN span s WHERE t.filed_date >= t.transaction_date""",
    "opened": "SELECT e.*, p.px AS px0, p.bpx AS bpx0 FROM legs e JOIN relative p ON p.ticker = e.ticker AND p.date = e.d0 WHERE p.px > 0 AND p.bpx > 0",
    "disclosed": "SELECT e.*, p.px AS pxf, p.bpx AS bpxf FROM opened e JOIN relative p ON p.ticker = e.ticker AND p.date = e.df WHERE p.px > 0 AND p.bpx > 0",
    "split": """
SELECT e.txn_id, e.member_id, e.ticker, e.lag_days, ((e.pxf / e.px0 - 1) - (e.bpxf / e.bpx0 - 1)) * e.direction AS pre,
  ((p.px / e.pxf - 1) - (p.bpx / e.bpxf - 1)) * e.direction AS post
FROM disclosed e JOIN relative p ON p.ticker = e.ticker AND p.date = e.d1 WHERE p.px > 0 AND p.bpx > 0""",
    # The post-disclosure edge of members with enough trades, shrunk as the scores are; a spread needs two trades, these have more.
    "edges": f"""
SELECT member_id, count(*) AS n_scored, avg(pre) AS mean_pre, avg(post) AS mean_post, stddev_samp(post) AS sd_post, avg(CASE WHEN post > 0 THEN 1.0 ELSE 0.0 END) AS post_hit_rate, median(lag_days) AS median_lag
FROM split WHERE member_id IS NOT NULL GROUP BY member_id HAVING count(*) >= {MIN_TRADES}""",
    "edgeprior": """
SELECT sum(mean_post * n_scored) / sum(n_scored) AS mu, greatest(coalesce(var_samp(mean_post), 0.0) - avg(sd_post * sd_post / n_scored), 1e-9) AS tau2 FROM edges""",
    "edgeshrunk": "SELECT e.*, p.mu, p.mu + p.tau2 / (p.tau2 + e.sd_post * e.sd_post / e.n_scored) * (e.mean_post - p.mu) AS shrunk_post FROM edges e CROSS JOIN edgeprior p",
    "edgespread": "SELECT CASE WHEN stddev_samp(shrunk_post) = 0 THEN 1.0 ELSE stddev_samp(shrunk_post) END AS spread FROM edgeshrunk",
    "aged": """
SELECT t.ticker, t.direction, a.age_days, greatest(SHIFT[t.filed_date; a.age_days], s.lo) AS d0, greatest(SHIFT[t.filed_date; a.age_days + 90], s.lo) AS d1
FROM (SELECT * FROM trades WHERE ticker IS NOT NULL AND ticker_confidence >= 0.7 AND direction <> 0 AND filed_date IS NOT NULL) t CROSS JOIN (VALUES (0), (15), (30), (45), (60), (75), (90), (105), (120), (135), (150), (165), (180)) AS a(age_days) CROSS JOIN span s""",
    "aged_entered": "SELECT e.*, p.px AS px0, p.bpx AS bpx0 FROM aged e JOIN relative p ON p.ticker = e.ticker AND p.date = e.d0 WHERE p.px > 0 AND p.bpx > 0",
    "ages": """
SELECT e.age_days, ((p.px / e.px0 - 1) - (p.bpx / e.bpx0 - 1)) * e.direction AS excess
FROM aged_entered e JOIN relative p ON p.ticker = e.ticker AND p.date = e.d1 WHERE p.px > 0 AND p.bpx > 0""",
    "curve": "SELECT age_days, count(*) AS n, avg(excess) AS mean_excess, avg(excess) / nullif(stddev_samp(excess) / sqrt(count(*)), 0.0) AS t_stat FROM ages GROUP BY age_days HAVING count(*) >= 30",
}

SKILL_QUERIES = {
    "asof_price": "SELECT t.txn_id, round(p.px, 7) + 0.0 AS px, round(p.bpx, 7) + 0.0 AS bench_px FROM trades t CROSS JOIN span s LEFT JOIN relative p ON p.ticker = t.ticker AND p.date = greatest(t.filed_date, s.lo)",
    "price_panel_ffill": "SELECT ticker, date, round(px, 7) + 0.0 AS px FROM panel",
    "trade_returns": "SELECT txn_id, horizon_days, round(excess_return, 5) + 0.0 AS excess_return FROM returns",
    "member_scores": """
SELECT horizon_days, s.member_id, n_scored, round(mean_excess, 5) + 0.0 AS mean_excess, round(sd_excess, 5) + 0.0 AS sd_excess, round(hit_rate, 5) AS hit_rate,
  round(dollar_wtd_excess, 5) + 0.0 AS dollar_wtd_excess, round(shrunk_excess, 5) + 0.0 AS shrunk_excess, round(t_stat, 4) + 0.0 AS t_stat, round(weight, 4) AS weight, n_trades
FROM scores s JOIN (SELECT member_id, count(*) AS n_trades FROM trades GROUP BY member_id) c ON s.member_id = c.member_id""",
    "timing_decompose": "SELECT txn_id, lag_days, round(pre, 5) + 0.0 AS pre, round(post, 5) + 0.0 AS post, round(pre + post, 5) + 0.0 AS total, CASE WHEN abs(pre + post) > 1e-9 THEN round(post / (pre + post), 3) + 0.0 END AS capturable_share FROM split",
    "timing_summary": """
SELECT count(*) AS n, round(avg(pre), 6) + 0.0 AS mean_pre, round(avg(post), 6) + 0.0 AS mean_post, round(avg(pre + post), 6) + 0.0 AS mean_total,
  round(avg(pre) / nullif(stddev_samp(pre) / sqrt(count(*)), 0.0), 4) AS t_pre, round(avg(post) / nullif(stddev_samp(post) / sqrt(count(*)), 0.0), 4) AS t_post,
  round(avg(CASE WHEN post > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_post, CAST(median(lag_days) AS DOUBLE) AS median_lag,
  CASE WHEN abs(avg(pre) + avg(post)) > 1e-12 THEN round(avg(pre) / (avg(pre) + avg(post)), 6) END AS share_before,
  CASE WHEN avg(post) / nullif(stddev_samp(post) / sqrt(count(*)), 0.0) > 2 THEN 'positive' WHEN avg(post) / nullif(stddev_samp(post) / sqrt(count(*)), 0.0) < -2 THEN 'negative'
    WHEN avg(pre) > 0 AND avg(post) <= 0 THEN 'before disclosure' ELSE 'not distinguishable' END AS verdict FROM split""",
    "fit_decay": "SELECT age_days, n, round(mean_excess, 6) + 0.0 AS mean_excess, round(t_stat, 4) + 0.0 AS t_stat FROM curve",
    "decay_half_life": """
SELECT count(*) AS n_ages, CASE WHEN count(*) >= 3 AND regr_slope(ln(mean_excess), CAST(age_days AS DOUBLE)) < 0 THEN round(-ln(2.0) / regr_slope(ln(mean_excess), CAST(age_days AS DOUBLE)), 3) END AS half_life_days
FROM curve WHERE mean_excess > 0""",
    "capturable_scores": """
SELECT member_id, n_scored, round(mean_post, 6) + 0.0 AS mean_post, round(mean_pre, 6) + 0.0 AS mean_pre, round(sd_post, 6) AS sd_post, round(post_hit_rate, 6) AS post_hit_rate, CAST(median_lag AS DOUBLE) AS median_lag,
  round(mean_post / nullif(sd_post / sqrt(n_scored), 0.0), 4) + 0.0 AS t_post, round(shrunk_post, 6) + 0.0 AS shrunk_post,
  CASE WHEN w.spread IS NOT NULL THEN round(least(greatest(1.0 + (shrunk_post - mu) / (2 * w.spread), 0.25), 2.0), 4) END AS capturable_weight
FROM edgeshrunk e CROSS JOIN edgespread w""",
}
