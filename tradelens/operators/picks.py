"""Ranked picks with what they rest on, and the record of how picks turned out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.scalars import rationale
from tradelens.operators.weights import NAMES, fit_weights, predicted

#: Calendar days to a trading day, dates before the first rebalance, rows of a fit, and periods of a yearly figure.
CALENDAR, FIRST, LEAST, PERIODS = 1.45, 30, 100, 3


def held_days(horizon: int) -> int:
    return int(horizon * CALENDAR)


def generate(scores: DataFrame, weights: DataFrame, summary: DataFrame, top_n: int = 10) -> DataFrame:
    """The best and the worst picks (end: top, bottom) of the last date for each horizon of weights (horizon_days, weights).

    Each has its place, score, percentile, expected excess, confidence, the factors' shares (attribution) and the rationale.
    summary is that of the backtest; a horizon that it lacks has the lowest confidence and no expected excess.
    """
    last = scores.join(F.broadcast(scores.agg(F.max("date").alias("date"))), "date")
    parts = F.create_map(*[x for k, c in enumerate(NAMES) for x in (F.lit(c), F.col(c) * F.col("weights")[k])])
    found = last.crossJoin(F.broadcast(weights.select("horizon_days", "weights"))).withColumn("attribution", parts)  # a row for each horizon
    found = found.withColumn("score", F.aggregate(F.map_values("attribution"), F.lit(0.0), lambda a, x: a + x))
    each = Window.partitionBy("horizon_days")
    found = found.withColumns({"n": F.count(F.lit(1)).over(each), "best": F.row_number().over(each.orderBy(F.desc("score"), "ticker")), "worst": F.row_number().over(each.orderBy("score", F.desc("ticker")))})
    columns = ["date", "horizon_days", "ticker", "score", "n", "attribution", "best"]
    both = found.filter(F.col("best") <= top_n).select(*columns, F.lit("top").alias("end"), F.col("best").alias("place")).unionByName(found.filter(F.col("worst") <= top_n).select(*columns, F.lit("bottom").alias("end"), F.col("worst").alias("place")))
    joined = both.join(F.broadcast(summary.select("horizon_days", "expected_scale", "confidence")), "horizon_days", "left")
    percentile = 1 - (F.col("best") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    return joined.select(F.col("date").alias("as_of"), "horizon_days", "end", "place", "ticker", "score", percentile.alias("percentile"), (F.col("score") * F.col("expected_scale")).alias("expected_excess"), F.coalesce("confidence", F.lit(0.1)).alias("confidence"), "attribution", rationale(F.col("attribution")).alias("rationale"))


def resolve(picks: DataFrame, panel: DataFrame, mode: str = "live") -> DataFrame:
    """picks (as_of, horizon_days, ticker, place, score) with what became of them by the price panel (ticker, date, px, bpx).

    A pick is resolved when its exit is within the panel and all four prices are there; nothing about it changes.
    """
    exit_ = F.expr(f"date_add(as_of, cast(floor(horizon_days * {CALENDAR}) as int))")
    own = picks.select("as_of", "horizon_days", "ticker", "place", "score").withColumn("exit", exit_)
    at = lambda day, px, bpx: panel.filter("px > 0 and bpx > 0").select("ticker", F.col("date").alias(day), F.col("px").alias(px), F.col("bpx").alias(bpx))
    priced = own.join(at("as_of", "p0", "b0"), ["ticker", "as_of"], "left").join(at("exit", "p1", "b1"), ["ticker", "exit"], "left")
    realised, bench = F.col("p1") / F.col("p0") - 1, F.col("b1") / F.col("b0") - 1
    ok = F.col("p0").isNotNull() & F.col("p1").isNotNull()
    return priced.select("as_of", "horizon_days", "ticker", "place", "score", F.lit(mode).alias("mode"), F.when(ok, realised).alias("realised_return"), F.when(ok, bench).alias("benchmark_return"), F.when(ok, realised - bench).alias("excess_return"), ok.alias("resolved"))


def simulate(scores: DataFrame, panel: DataFrame, horizon: int, step: int = 4, top_n: int = 10, first: int = FIRST, n_boot: int = 12) -> DataFrame:
    """Picks at every step-th date, with weights fitted to rows whose outcome was known by then, and what became of them."""
    y = f"y_{horizon}"
    order = F.row_number().over(Window.orderBy("date")) - 1
    dates = scores.select("date").distinct().withColumn("k", order)  # one row for each date
    rebalance = dates.filter((F.col("k") >= first) & ((F.col("k") - first) % step == 0)).select(F.col("date").alias("as_of"))
    known = scores.filter(F.col(y).isNotNull()).join(F.broadcast(rebalance), F.col("date") <= F.date_sub("as_of", held_days(horizon) + 5))
    weights = fit_weights(known.select("as_of", "ticker", "date", *NAMES, y), ["as_of"], y, n_boot=n_boot).filter(F.col("n") >= LEAST)
    scored = predicted(scores.withColumn("as_of", F.col("date")), weights, ["as_of"])
    place = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("pred"), "ticker"))
    chosen = scored.withColumn("place", place).filter(F.col("place") <= top_n)
    return resolve(chosen.select("as_of", F.lit(horizon).alias("horizon_days"), "ticker", "place", F.col("pred").alias("score")), panel, "backtested")


def baskets(history: DataFrame) -> DataFrame:
    """mode, horizon_days, as_of, pick and bench (mean returns of the resolved picks), n."""
    return history.filter("resolved").groupBy("mode", "horizon_days", "as_of").agg(F.avg("realised_return").alias("pick"), F.avg("benchmark_return").alias("bench"), F.count(F.lit(1)).alias("n"))


def curve(history: DataFrame) -> DataFrame:
    """The baskets that could be held one after the other, with the growth of 1 in picks and benchmark.

    A basket is taken when the one before is closed; the fold over a mode's and horizon's dates is in their order.
    """
    periods = F.array_sort(F.collect_list(F.struct("as_of", "pick", "bench", "n")))
    listed = baskets(history).groupBy("mode", "horizon_days").agg(periods.alias("periods"))  # one entry for each rebalance date
    kept = "array<struct<as_of:date,pick:double,bench:double,n:bigint,picks:double,benchmark:double>>"

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        free = last.isNull() | (x["as_of"] >= F.date_add(last["as_of"], F.floor(F.col("horizon_days") * CALENDAR).cast("int")))
        grown = F.struct(x["as_of"].alias("as_of"), x["pick"].alias("pick"), x["bench"].alias("bench"), x["n"].alias("n"), (F.coalesce(last["picks"], F.lit(1.0)) * (1 + x["pick"])).alias("picks"), (F.coalesce(last["benchmark"], F.lit(1.0)) * (1 + x["bench"])).alias("benchmark"))
        return F.when(free, F.concat(acc, F.array(grown))).otherwise(acc)

    chained = F.aggregate("periods", F.array().cast(kept), step)
    return listed.select("mode", "horizon_days", F.inline(chained))


def scoreboard(history: DataFrame) -> DataFrame:
    """For each mode and horizon: hit rate, excess, t, cumulative and yearly returns of what could be held, best and worst pick."""
    own = history.filter("resolved").groupBy("mode", "horizon_days").agg(
        F.count(F.lit(1)).alias("n_picks"), F.avg((F.col("excess_return") > 0).cast("double")).alias("hit_rate"), F.avg("excess_return").alias("mean_excess"), F.median("excess_return").alias("median_excess"),
        F.try_divide(F.avg("excess_return"), F.stddev_samp("excess_return") / F.sqrt(F.count(F.lit(1)))).alias("t_stat"),
        F.max_by("ticker", F.struct("excess_return", "ticker")).alias("best_pick"), F.min_by("ticker", F.struct("excess_return", "ticker")).alias("worst_pick"),
    )
    periods = baskets(history).groupBy("mode", "horizon_days").agg(F.count(F.lit(1)).alias("n_periods"), F.min("as_of").alias("first_period"), F.max("as_of").alias("last_period"), F.avg((F.col("pick") > F.col("bench")).cast("double")).alias("periods_beating_benchmark"))
    chain = curve(history).groupBy("mode", "horizon_days").agg(F.count(F.lit(1)).alias("n_chained"), (F.max_by("picks", "as_of") - 1).alias("cumulative_return"), (F.max_by("benchmark", "as_of") - 1).alias("benchmark_cumulative_return"))
    years = F.col("n_chained") * F.col("horizon_days") * CALENDAR / 365.25
    yearly = F.pow(1 + F.col("cumulative_return"), 1 / years) - F.pow(1 + F.col("benchmark_cumulative_return"), 1 / years)
    return own.join(periods, ["mode", "horizon_days"]).join(chain, ["mode", "horizon_days"]).withColumn("annualized_excess", F.when(F.col("n_chained") >= PERIODS, yearly))
