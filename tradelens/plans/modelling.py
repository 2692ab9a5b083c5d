"""The model's panel over the test tables, with filing and with trade timing, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.operators import model_panel
from tradelens.plans.dialect import duckdb_text, parts
from tradelens.plans.world import ALL_VIEWS, kept, view

_TARGETS = """
SELECT a.ticker, a.date, b.px / a.px - 1 - (d.px / c.px - 1) AS y_63 FROM daily a JOIN daily b ON b.ticker = a.ticker AND b.day = a.day + 63 JOIN benchday c ON c.day = a.day JOIN benchday d ON d.day = a.day + 63
JOIN (SELECT max(date) AS date FROM tradingdays GROUP BY year(date), month(date)) m ON m.date = a.date WHERE a.ticker <> 'BENCH'"""
_WEIGHED = "SELECT t.ticker, t.member_id, t.transaction_date, t.filed_date, t.direction, t.amount_est, t.filing_delay_days AS delay, coalesce(s.weight, 1.0) AS mweight FROM trades t LEFT JOIN scores90 s ON s.member_id = t.member_id WHERE t.ticker_confidence >= 0.7 AND t.direction <> 0"
_DEALT = _WEIGHED.replace("FROM trades t ", "FROM (SELECT /*+ REPARTITION(PARTS, member_id) */ * FROM trades WHERE ticker_confidence >= 0.7 AND direction <> 0) t ")
FEATURES = [f"{c}_{b}" for b in model_panel.BACKS for c in ("n_members", "n_trades", "n_buyers", "n_sellers", "log_gross", "net_ratio", "wnet_ratio", "buy_share", "mean_delay", "max_mweight")] + ["mom_20", "mom_120", "vol_60", "log_lobby_12m", "lobby_yoy"]


def _built(disclosed: bool):
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        prices = view(spark, sf_dir, "SELECT ticker, date, px FROM daily WHERE ticker <> 'BENCH'")
        weighed = kept(spark, sf_dir, "weighed", lambda spark, sf_dir: view(spark, sf_dir, _DEALT))  # read twice, and by both panels
        lobbying = view(spark, sf_dir, "SELECT ticker, period_end, sum(coalesce(amount, 0.0)) AS amount FROM lobbying GROUP BY ticker, period_end")
        return model_panel.build(view(spark, sf_dir, _TARGETS), weighed, prices, lobbying, disclosed, parts(spark, f"{sf_dir}/lineitem.parquet"))

    return make


def _panel(spark: SparkSession, sf_dir: str, disclosed: bool) -> DataFrame:
    rows = kept(spark, sf_dir, f"model_panel_{disclosed}", _built(disclosed))
    return rows.select("ticker", "date", *[(F.round(c, 4) + 0.0).alias(c) for c in ["y_63", *FEATURES]])


def model_panel_disclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel from what had been filed by each date."""
    return _panel(spark, sf_dir, True)


def model_panel_traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel from trades on their own dates, which nobody could see then."""
    return _panel(spark, sf_dir, False)


def _sql(known: str) -> str:
    """The same rows by one join of all trades within 180 days, and conditions for each look-back."""
    parts = []
    for b in model_panel.BACKS:
        when = lambda x, b=b: f"CASE WHEN {known} > SHIFT[a.date; -{b}] THEN {x} END"
        gross = f"coalesce(sum({when('amount_est')}), 0.0)"
        parts += [
            f"CAST(count(DISTINCT {when('member_id')}) AS DOUBLE) AS n_members_{b}", f"CAST(count({when('1')}) AS DOUBLE) AS n_trades_{b}",
            f"CAST(count(DISTINCT {when('CASE WHEN direction > 0 THEN member_id END')}) AS DOUBLE) AS n_buyers_{b}", f"CAST(count(DISTINCT {when('CASE WHEN direction < 0 THEN member_id END')}) AS DOUBLE) AS n_sellers_{b}",
            f"ln(1 + {gross}) AS log_gross_{b}", f"coalesce(sum({when('amount_est * direction')}) / nullif({gross}, 0.0), 0.0) AS net_ratio_{b}", f"coalesce(sum({when('amount_est * direction * mweight')}) / nullif({gross}, 0.0), 0.0) AS wnet_ratio_{b}",
            f"coalesce(avg({when('CASE WHEN direction > 0 THEN 1.0 ELSE 0.0 END')}), 0.5) AS buy_share_{b}", f"avg({when('delay')}) AS mean_delay_{b}", f"coalesce(max({when('mweight')}), 1.0) AS max_mweight_{b}",
        ]
    return duckdb_text(f"""
SELECT ticker, date, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in ['y_63', *FEATURES])} FROM (
SELECT g.*, CASE WHEN h.n > 30 THEN CASE WHEN h.n > 21 THEN h.px / h.p20 - 1 ELSE 0.0 END END AS mom_20, CASE WHEN h.n > 30 THEN h.px / h.p0 - 1 END AS mom_120, CASE WHEN h.n > 30 THEN h.vol END AS vol_60,
  ln(1 + l.near) AS log_lobby_12m, CASE WHEN l.far > 0 THEN (l.near - l.far) / l.far ELSE 0.0 END AS lobby_yoy
FROM (SELECT a.ticker, a.date, a.y_63, {', '.join(parts)} FROM aims a LEFT JOIN moded t ON t.ticker = a.ticker AND {known} <= a.date AND {known} > SHIFT[a.date; -180] GROUP BY a.ticker, a.date, a.y_63) g
JOIN (SELECT ticker, date, px, count(*) OVER (PARTITION BY ticker ORDER BY date ROWS 129 PRECEDING) AS n, lag(px, 20) OVER w AS p20, first_value(px) OVER (PARTITION BY ticker ORDER BY date ROWS 129 PRECEDING) AS p0, stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING) AS vol
  FROM (SELECT *, px / lag(px) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM daily) r WINDOW w AS (PARTITION BY ticker ORDER BY date)) h ON h.ticker = g.ticker AND h.date = g.date
JOIN (SELECT a.ticker, a.date, coalesce(sum(CASE WHEN period_end > SHIFT[a.date; -365] THEN amount END), 0.0) AS near, coalesce(sum(CASE WHEN period_end <= SHIFT[a.date; -365] THEN amount END), 0.0) AS far
  FROM aims a LEFT JOIN lobbying o ON o.ticker = a.ticker AND period_end <= a.date AND period_end > SHIFT[a.date; -730] GROUP BY a.ticker, a.date) l ON l.ticker = g.ticker AND l.date = g.date) v""", ALL_VIEWS | {"aims": _TARGETS, "moded": _WEIGHED})


MODEL_QUERIES = {f.__name__: f for f in (model_panel_disclosed, model_panel_traded)}
MODEL_ORACLES = {"model_panel_disclosed": _sql("filed_date"), "model_panel_traded": _sql("transaction_date")}
