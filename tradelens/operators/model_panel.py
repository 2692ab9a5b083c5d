"""The model's monthly panel, as of when trades were filed or as of when they were made, for three look-backs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.operators.panel import as_of, seen_counts, sums_at

#: Days that features look back, and trading days to the target.
BACKS, AHEAD = (30, 90, 180), 63


def known_at(trades: DataFrame, disclosed: bool) -> DataFrame:
    """trades with known_at: the day from which a trade may be seen, its filing (the trade itself where that is missing) or the trade."""
    return trades.withColumn("known_at", F.coalesce("filed_date", "transaction_date") if disclosed else F.col("transaction_date")).filter("known_at is not null")


def _trade_features(asked: DataFrame, trades: DataFrame, parts: int | None = None) -> DataFrame:
    """What trades (ticker, member_id, known_at, direction, amount_est, delay, mweight) show in each look-back."""
    signed = F.col("amount_est") * F.col("direction")
    sums = {
        "n": F.lit(1.0), "buys": (F.col("direction") > 0).cast("double"), "gross": F.col("amount_est"), "net": signed, "wnet": signed * F.col("mweight"),
        "delay": F.coalesce(F.col("delay").cast("double"), F.lit(0.0)), "delayed": F.col("delay").isNotNull().cast("double"),
    }
    daily = trades.groupBy("ticker", F.col("known_at").alias("day")).agg(*[F.sum(v).alias(k) for k, v in sums.items()], F.max("mweight").alias("most"))
    out = sums_at(asked, daily, [*sums], [0, *BACKS])
    side = F.signum(F.col("direction")).cast("int")
    members = seen_counts(asked, trades, "known_at", side, {"n_members": None, "n_buyers": 1, "n_sellers": -1}, list(BACKS), parts)
    # a member's weight is one for all trades, or the largest of those in the look-back: of the days' largest ones
    month = lambda d: F.year(d) * 12 + F.month(d)
    most = daily.select(F.col("ticker").alias("t_ticker"), "day", "most", F.explode(F.sequence(month(F.col("day")), month(F.date_add("day", max(BACKS))))).alias("m"))  # a row for each day
    near = asked.join(most, (F.col("ticker") == F.col("t_ticker")) & (month(F.col("date")) == F.col("m")) & (F.col("day") <= F.col("date")) & (F.col("day") > F.date_sub("date", max(BACKS))))
    weighed = near.groupBy("ticker", "date").agg(*[F.max(F.when(F.col("day") > F.date_sub("date", b), F.col("most"))).alias(f"max_mweight_{b}") for b in BACKS])
    members = members.join(weighed, ["ticker", "date"], "left")
    joined = out.join(members, ["ticker", "date"], "left")
    columns: list[Column] = []
    for b in BACKS:
        of = lambda c, b=b: F.col("s_0")[c] - F.col(f"s_{b}")[c]
        gross = F.when(of("n") > 0.5, of("gross")).otherwise(0.0)
        columns += [F.coalesce(f"{c}_{b}", F.lit(0.0)).alias(f"{c}_{b}") for c in ("n_members", "n_buyers", "n_sellers")]
        columns += [
            F.round(of("n")).alias(f"n_trades_{b}"), F.log1p(F.greatest(gross, F.lit(0.0))).alias(f"log_gross_{b}"),
            *[F.when(gross > 1e-9, of(c) / gross).otherwise(0.0).alias(f"{name}_{b}") for c, name in (("net", "net_ratio"), ("wnet", "wnet_ratio"))],
            F.when(of("n") > 0.5, of("buys") / of("n")).otherwise(0.5).alias(f"buy_share_{b}"),
            F.when(of("delayed") > 0.5, of("delay") / of("delayed")).alias(f"mean_delay_{b}"), F.coalesce(f"max_mweight_{b}", F.lit(1.0)).alias(f"max_mweight_{b}"),
        ]
    return joined.select("ticker", "date", *columns)


def _price_features(prices: DataFrame) -> DataFrame:
    """Momentum and volatility of the last 130 prices (ticker, date, px) of each day, null with 30 or fewer of them."""
    by = Window.partitionBy("ticker").orderBy("date")
    last = by.rowsBetween(-129, 0)
    moved = prices.withColumn("ret", F.col("px") / F.lag("px").over(by) - 1)
    found = moved.select("ticker", "date", "px", F.count("px").over(last).alias("n"), F.lag("px", 20).over(by).alias("p20"), F.first("px").over(last).alias("p0"), F.stddev_samp("ret").over(by.rowsBetween(-59, 0)).alias("vol"))
    enough = lambda v: F.when(F.col("n") > 30, v)
    return found.select("ticker", "date", enough(F.when(F.col("n") > 21, F.col("px") / F.col("p20") - 1).otherwise(0.0)).alias("mom_20"), enough(F.col("px") / F.col("p0") - 1).alias("mom_120"), enough(F.col("vol")).alias("vol_60"))


def build(targets: DataFrame, trades: DataFrame, prices: DataFrame, lobbying: DataFrame, disclosed: bool = True, deals: int | None = None) -> DataFrame:
    """ticker, date, y_63 and all features for the rows of targets (ticker, date, y_63: the excess after AHEAD trading days).

    trades: ticker, member_id, transaction_date, filed_date, direction, amount_est, delay, mweight; prices: ticker, date, px;
    lobbying: ticker, period_end, amount. Rows without a target are left out. deals: partitions of members.
    """
    rows = targets.filter(F.col("y_63").isNotNull())
    asked = rows.select("ticker", "date")
    spent = lobbying.groupBy("ticker", F.col("period_end").alias("day")).agg(F.sum(F.coalesce("amount", F.lit(0.0))).alias("amount"), F.lit(1.0).alias("n"))
    at = sums_at(asked, spent, ["amount", "n"], [0, 365, 730])
    over = lambda a, b: F.when(F.col(f"s_{a}.n") - F.col(f"s_{b}.n") > 0.5, F.col(f"s_{a}.amount") - F.col(f"s_{b}.amount")).otherwise(0.0)
    near, far = over(0, 365), over(365, 730)
    lobbied = at.select("ticker", "date", F.log1p(near).alias("log_lobby_12m"), F.when(far > 0, (near - far) / far).otherwise(0.0).alias("lobby_yoy"))
    parts = [rows, _trade_features(asked, known_at(trades, disclosed), deals), _price_features(prices), lobbied]
    return reduce(lambda a, b: a.join(b, ["ticker", "date"], "left"), parts)
