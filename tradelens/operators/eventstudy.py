"""Event studies from running sums: one pass by ticker gives the market model of every day, so an event is a lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trading days of the estimation window from the event, and observations that a fit needs.
ESTIMATION, LEAST = (-250, -30), 40


def running_sums(moves: DataFrame, n_days: DataFrame) -> DataFrame:
    """ticker, day (0, 1, 2 ... to the last) and s: sums up to the day of 1, x, y, xx, xy and yy.

    moves (ticker, day, ret, market) are the days on which a ticker and the market have a return; n_days has one row with
    the last day. A day without a return adds nothing.
    """
    last = n_days.toDF("last")
    days = moves.select("ticker").distinct().crossJoin(F.broadcast(last)).select("ticker", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("day"))
    both = days.join(moves.select("ticker", "day", F.col("market").alias("x"), F.col("ret").alias("y"), F.lit(1.0).alias("n")), ["ticker", "day"], "left")
    upto = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda v: F.sum(F.coalesce(v, F.lit(0.0))).over(upto)
    x, y = F.col("x"), F.col("y")
    sums = {"n": F.col("n"), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    return both.select("ticker", "day", F.struct(*[of(v).alias(k) for k, v in sums.items()]).alias("s"))


def market_model(sums: DataFrame, window: tuple[int, int] = (0, 20), estimation: tuple[int, int] = ESTIMATION, least: int = LEAST) -> DataFrame:
    """ticker, day, n_est, alpha, beta, r2, car, t_stat and n_event for each day that can be an event.

    The model is fitted on the estimation window (its end excluded), which must begin on the first trading day or later and
    have least observations; the event window (both ends included) must end on the last day or before. car sums what the
    model doesn't explain; t_stat is null where the fit leaves no spread.
    """
    by = Window.partitionBy("ticker").orderBy("day")
    at = lambda k: F.lag("s", -k).over(by) if k < 0 else F.lead("s", k).over(by)
    ends = {"e1": at(estimation[1] - 1), "e0": at(estimation[0] - 1), "w1": at(window[1]), "w0": at(window[0] - 1)}
    cut = sums.select("ticker", "day", *[v.alias(k) for k, v in ends.items()]).filter(F.col("e0").isNotNull() & F.col("w1").isNotNull() & F.col("w0").isNotNull())
    est = lambda c: F.col("e1")[c] - F.col("e0")[c]
    n = est("n")
    centred = lambda a, b, ab: est(ab) - est(a) * est(b) / n
    fit = cut.filter(n >= least).select(
        "ticker", "day", n.cast("long").alias("n_est"), (est("x") / n).alias("mx"), (est("y") / n).alias("my"),
        centred("x", "x", "xx").alias("sxx"), centred("x", "y", "xy").alias("sxy"), centred("y", "y", "yy").alias("syy"),
        *[(F.col("w1")[c] - F.col("w0")[c]).alias(f"w{c}") for c in ("n", "x", "y")],
    )
    spread = F.when(F.col("sxx") > 1e-18, F.col("sxx"))
    fit = fit.withColumn("beta", F.col("sxy") / spread).withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    rest = F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0))
    car = F.col("wy") - F.col("alpha") * F.col("wn") - F.col("beta") * F.col("wx")
    noise = F.sqrt(rest / (F.col("n_est") - 2)) * F.sqrt("wn")
    r2 = 1 - rest / F.when(F.col("syy") > 1e-18, F.col("syy"))
    return fit.filter(F.col("beta").isNotNull() & (F.col("wn") > 0)).select(
        "ticker", "day", "n_est", "alpha", "beta", r2.alias("r2"), car.alias("car"), F.try_divide(car, F.when(noise > 1e-12, noise)).alias("t_stat"), F.col("wn").cast("long").alias("n_event"),
    )


def study_trades(trades: DataFrame, anchors: DataFrame, model: DataFrame) -> DataFrame:
    """trades (ticker, transaction_date, direction) with the model of the first trading day on or after, and signed_car.

    anchors (date, day) has that day for each calendar day; trades without a model are left out.
    """
    dated = trades.join(anchors.withColumnRenamed("date", "transaction_date"), "transaction_date")
    return dated.join(model, ["ticker", "day"]).withColumn("signed_car", F.col("car") * F.col("direction"))


def summary(studied: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean_car, median_car, sd, t_stat and pct_positive of signed_car."""
    x = F.col("signed_car")
    t = F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x).cast("double")))
    return studied.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean_car"), F.median(x).alias("median_car"), F.stddev_samp(x).alias("sd"), t.alias("t_stat"), F.avg((x > 0).cast("double")).alias("pct_positive"))


def exploded_tickers(json: Column) -> Column:
    """The tickers of a JSON list, each once a row; a text that is no such list has none."""
    return F.explode(F.from_json(json, "array<string>"))


def study_policy_events(events: DataFrame, anchors: DataFrame, model: DataFrame) -> DataFrame:
    """key (event_id:ticker), event_id, event_date, ticker, category, title and the model's columns.

    events (event_id, event_date, tickers: JSON list, category, title); model is that of the window from 5 days before to 20
    after. A ticker that an event names twice is studied twice; lists that can't be read have no tickers.
    """
    each = events.select("event_id", "event_date", "category", "title", exploded_tickers(F.col("tickers")).alias("ticker"))
    dated = each.join(anchors.withColumnRenamed("date", "event_date"), "event_date").join(model, ["ticker", "day"])
    return dated.select(F.concat_ws(":", "event_id", "ticker").alias("key"), "event_id", "event_date", "ticker", "category", "title", "day", "n_est", "alpha", "beta", "r2", "car", "t_stat")
