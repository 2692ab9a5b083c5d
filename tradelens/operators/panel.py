"""The panel of features by week and ticker as of what was filed, published or traded by then, and its factors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The features of each factor.
FACTORS = {
    "politician_flow": ["net_ratio_90", "wnet_ratio_90", "n_buyers_90", "buy_share_90"],
    "politician_conviction": ["log_gross_90", "n_members_90", "max_mweight_90"],
    "politician_freshness": ["decayed_net_flow", "days_since_last_filing"],
    "lobbying": ["log_lobby_12m", "lobby_yoy"],
    "earnings": ["last_surprise", "days_since_earnings", "earnings_soon", "surprise_trend"],
    "events": ["conflict_x_sector", "tariffs_x_sector", "energy_x_sector", "health_x_sector", "ai_x_sector", "monetary_x_sector", "event_beta"],
    "momentum": ["mom_20", "mom_120", "vol_60"],
}
FEATURES = [c for columns in FACTORS.values() for c in columns]
#: The sectors that a theme touches.
THEME_SECTORS = {
    "conflict": ["Industrials", "Energy", "Aerospace & Defense"], "tariffs": ["Industrials", "Consumer Cyclical", "Technology"],
    "energy": ["Energy", "Utilities", "Industrials"], "health": ["Healthcare"], "ai": ["Technology", "Communication Services"],
    "monetary": ["Financial Services", "Real Estate", "Utilities"],
}


def _week(date: Column) -> Column:
    return F.floor(F.datediff(date, F.lit("1970-01-05").cast("date")) / 7).cast("int")


def _visible(facts: DataFrame, date: str, days: int) -> DataFrame:
    """facts once for each week in which they can be up to days old: an equi-join replaces the range join."""
    return facts.withColumn("wk", F.explode(F.sequence(_week(F.col(date)), _week(F.date_add(date, days)) + 1)))


def as_of(spine: DataFrame, facts: DataFrame, keys: list[str], date: str) -> DataFrame:
    """spine (keys, date) with fact: the struct of the last row of facts on or before the date, in one pass over both."""
    struct = F.struct(*[F.col(c) for c in facts.columns if c not in keys])
    known = facts.groupBy(*keys, F.col(date).alias("date")).agg(F.max(struct).alias("fact")).withColumn("asks", F.lit(0))
    both = spine.select(*keys, "date").distinct().withColumn("fact", F.lit(None).cast(known.schema["fact"].dataType)).withColumn("asks", F.lit(1)).unionByName(known)
    order = Window.partitionBy(*keys).orderBy("date", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("fact", F.last("fact", ignorenulls=True).over(order)).filter("asks = 1").drop("asks")


def sums_at(asked: DataFrame, daily: DataFrame, columns: list[str], backs: list[int]) -> DataFrame:
    """ticker, date and s_b for each b of backs: struct of the running sums of daily (ticker, day, columns) up to b days before.

    One pass: the running sums and all asked days are ordered together by ticker.
    """
    upto = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    facts = daily.select("ticker", "day", *[F.sum(c).over(upto).alias(c) for c in columns])
    asks = asked.select("ticker", "date", F.explode(F.array(*map(F.lit, backs))).alias("back")).withColumn("at", F.date_sub("date", F.col("back")))
    found = as_of(asks.select("ticker", F.col("at").alias("date")), facts, ["ticker"], "day").withColumnRenamed("date", "at")
    value = F.struct(*[F.coalesce(F.col("fact")[c], F.lit(0.0)).alias(c) for c in columns])
    return asks.join(found.select("ticker", "at", value.alias("s")), ["ticker", "at"]).groupBy("ticker", "date").agg(*[F.max(F.when(F.col("back") == b, F.col("s"))).alias(f"s_{b}") for b in backs])


def seen_counts(asked: DataFrame, trades: DataFrame, day: str, side: Column, kinds: dict[str, int | None], backs: list[int], parts: int | None = None) -> DataFrame:
    """ticker, date and name_b for each of kinds and backs: the members with such a trade in the b days up to the date.

    kinds: the side of the trades that count, or None for all. A trade counts from its day until the member's next one of the
    kind, or until it is b days old, so each member counts once; the counts are running sums of these steps. A trade gives a
    few steps, whatever b is, and they are added up by ticker and day before they are dealt. parts: into
    how many partitions members are dealt.
    """
    own = trades.filter("member_id is not null").select("ticker", "member_id", F.col(day).alias("day"), side.alias("side"))
    own = own.repartition(parts, "member_id") if parts else own
    following = lambda *by: F.lead("day").over(Window.partitionBy("ticker", "member_id", *by).orderBy("day"))
    own = own.withColumns({"any": following(), "same": following("side")})
    step = lambda at, what, n, counts: F.when(counts, F.struct(at.alias("day"), F.lit(what).alias("what"), F.lit(n).alias("n")))
    steps = []
    for name, kind in kinds.items():
        counts = F.lit(True) if kind is None else F.col("side") == kind
        until = F.col("any" if kind is None else "same")
        steps += [step(F.col("day"), name, 1, counts), *[step(F.least(until, F.date_add("day", b)), f"{name}_{b}", -1, counts) for b in backs]]
    each = own.select("ticker", F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull())).alias("s")).groupBy("ticker", "s.day", "s.what").agg(F.sum("s.n").alias("n"))
    columns = [f"{name}_{b}" for name in kinds for b in backs]
    wide = each.groupBy("ticker", "day").agg(*[F.coalesce(F.sum(F.when(F.col("what").isin(c, c.rsplit("_", 1)[0]), F.col("n"))), F.lit(0)).cast("double").alias(c) for c in columns])
    return sums_at(asked, wide, columns, [0]).select("ticker", "date", *[F.col(f"s_0.{c}").alias(c) for c in columns])


def politician_features(spine: DataFrame, trades: DataFrame, half_life: float | None = None, parts: int | None = None) -> DataFrame:
    """Nine features of trades (ticker, member_id, filed_date, direction, amount_est, mweight) filed by each date."""
    asked = spine.withColumn("wk", _week(F.col("date")))

    def joined(facts: DataFrame, days: int) -> DataFrame:
        seen = _visible(facts, "filed_date", days).withColumnsRenamed({"ticker": "t_ticker", "wk": "t_wk"})
        return asked.join(seen, (F.col("ticker") == F.col("t_ticker")) & (F.col("wk") == F.col("t_wk")) & (F.col("filed_date") <= F.col("date")) & (F.col("filed_date") > F.date_sub("date", days)), "left")

    # Sums need a row for each day of a ticker, which doesn't grow with a day's trades.
    signed = F.col("amount_est") * F.col("direction")
    daily = trades.groupBy("ticker", "filed_date").agg(
        F.sum("amount_est").alias("gross"), F.sum(signed).alias("net"), F.sum(signed * F.col("mweight")).alias("wnet"), F.max("mweight").alias("most"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("direction") > 0).alias("n_buys"),
    )
    near = F.col("filed_date") > F.date_sub("date", 90)
    sums = lambda x: F.sum(F.when(near, F.col(x)))
    age = F.datediff("date", "filed_date")
    decay = F.lit(1.0) if not half_life or half_life <= 0 else F.pow(F.lit(0.5), age / half_life)
    out = joined(daily, 270).groupBy("ticker", "date").agg(
        F.coalesce(F.try_divide(sums("net"), sums("gross")), F.lit(0.0)).alias("net_ratio_90"),
        F.coalesce(F.try_divide(sums("wnet"), sums("gross")), F.lit(0.0)).alias("wnet_ratio_90"),
        F.coalesce(F.try_divide(sums("n_buys"), sums("n")), F.lit(0.5)).alias("buy_share_90"),
        F.log1p(F.coalesce(sums("gross"), F.lit(0.0))).alias("log_gross_90"),
        F.coalesce(F.max(F.when(near, F.col("most"))), F.lit(1.0)).alias("max_mweight_90"),
        F.coalesce(F.try_divide(F.sum(F.col("wnet") * decay), F.sum(F.col("gross") * decay)), F.lit(0.0)).alias("decayed_net_flow"),
    )
    members = seen_counts(spine.select("ticker", "date").distinct(), trades, "filed_date", (F.col("direction") > 0).cast("int"), {"n_buyers": 1, "n_members": None}, [90], parts)
    out = out.join(members, ["ticker", "date"])
    last = as_of(spine, trades.select("ticker", "filed_date").distinct(), ["ticker"], "filed_date")
    since = F.coalesce(F.datediff("date", F.col("fact.filed_date")).cast("double"), F.lit(365.0))
    return out.join(last.select("ticker", "date", since.alias("days_since_last_filing")), ["ticker", "date"]).select("ticker", "date", "net_ratio_90", "wnet_ratio_90", "n_buyers_90", "n_members_90", "buy_share_90", "log_gross_90", "max_mweight_90", "decayed_net_flow", "days_since_last_filing")


def lobbying_features(spine: DataFrame, lobbying: DataFrame) -> DataFrame:
    """The year's spend of lobbying (ticker, period_end, amount) and its change against the year before."""
    daily = lobbying.groupBy("ticker", "period_end").agg(F.sum("amount").alias("amount"))
    seen = _visible(daily, "period_end", 730).withColumnsRenamed({"ticker": "t_ticker", "wk": "t_wk"})
    asked = spine.withColumn("wk", _week(F.col("date")))
    joined = asked.join(seen, (F.col("ticker") == F.col("t_ticker")) & (F.col("wk") == F.col("t_wk")) & (F.col("period_end") <= F.col("date")) & (F.col("period_end") > F.date_sub("date", 730)), "left")
    near = F.col("period_end") > F.date_sub("date", 365)
    a, b = (F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0.0)) for c in (near, ~near))
    return joined.groupBy("ticker", "date").agg(F.log1p(a).alias("log_lobby_12m"), F.when(b > 0, (a - b) / b).otherwise(0.0).alias("lobby_yoy"))


def earnings_features(spine: DataFrame, earnings: DataFrame) -> DataFrame:
    """What the reports (ticker, report_date, surprise) up to each date say."""
    order = Window.partitionBy("ticker").orderBy("report_date")
    four, gaps = order.rowsBetween(-3, 0), order.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.datediff("report_date", F.lag("report_date").over(order))
    facts = earnings.withColumn("gap", F.when((gap > 45) & (gap < 200), gap)).select(
        "ticker", "report_date", "surprise",
        F.when(F.count("surprise").over(four) >= 2, F.avg("surprise").over(four)).alias("trend"),
        F.coalesce(F.expr("percentile(gap, 0.5)").over(gaps), F.lit(91.0)).alias("cadence"),
    )
    clip = lambda x: F.coalesce(F.least(F.greatest(x, F.lit(-2.0)), F.lit(2.0)), F.lit(0.0))
    since = F.datediff("date", F.col("fact.report_date")).cast("double")
    # a null passes greatest and least, so it is caught before
    only = lambda c: F.when(F.col(c).isNotNull(), clip(F.col(c))).otherwise(0.0)
    return as_of(spine, facts, ["ticker"], "report_date").select(
        "ticker", "date", only("fact.surprise").alias("last_surprise"), F.coalesce(since, F.lit(180.0)).alias("days_since_earnings"),
        F.when(F.col("fact.cadence") - since <= 21, 1.0).otherwise(0.0).alias("earnings_soon"), only("fact.trend").alias("surprise_trend"),
    )


def theme_panel(themes: DataFrame) -> DataFrame:
    """themes (theme, date, z) filled forward to every calendar day; long, not wide."""
    until = F.coalesce(F.date_sub(F.lead("date").over(Window.partitionBy("theme").orderBy("date")), 1), F.col("last"))
    last = themes.agg(F.max("date").alias("last"))
    return themes.filter("z is not null").crossJoin(F.broadcast(last)).withColumn("until", until).select("theme", F.explode(F.sequence("date", "until")).alias("date"), "z")


def event_features(spine: DataFrame, themes: DataFrame, sectors: DataFrame, exposed: dict[str, list[str]] | None = None) -> DataFrame:
    """Each theme's last z (theme, date, z) where the ticker's sector is exposed to it, and the sum of their sizes."""
    exposed = exposed or THEME_SECTORS
    dates = spine.select("date").distinct().withColumn("theme", F.explode(F.array(*[F.lit(t) for t in exposed])))
    at = as_of(dates, themes.filter("z is not null").withColumnRenamed("date", "date_of"), ["theme"], "date_of")
    wide = at.groupBy("date").agg(*[F.coalesce(F.max(F.when(F.col("theme") == t, F.col("fact.z"))), F.lit(0.0)).alias(f"z_{t}") for t in exposed])
    of = spine.join(sectors.groupBy("ticker").agg(F.min("sector").alias("sector")), "ticker", "left").join(wide, "date")
    hit = lambda t: F.when(F.col("sector").isin(exposed[t]), F.col(f"z_{t}")).otherwise(0.0)
    return of.select("ticker", "date", *[hit(t).alias(f"{t}_x_sector") for t in exposed], reduce(lambda a, b: a + b, [F.abs(hit(t)) for t in exposed]).alias("event_beta"))


def build(spine: DataFrame, trades: DataFrame, lobbying: DataFrame, earnings: DataFrame, themes: DataFrame, sectors: DataFrame, momentum: DataFrame, targets: DataFrame, half_life: float | None = None, exposed: dict[str, list[str]] | None = None, include_unlabelled: bool = False, deals: int | None = None) -> DataFrame:
    """ticker, date, all FEATURES and the columns of targets (ticker, date, y_...), for the rows of spine with enough history.

    Rows without any target are left out, or kept for ranking where include_unlabelled is true. deals: partitions of members.
    """
    parts = [politician_features(spine, trades, half_life, deals), lobbying_features(spine, lobbying), earnings_features(spine, earnings), event_features(spine, themes, sectors, exposed), momentum.select("ticker", "date", "mom_20", "mom_120", "vol_60")]
    out = reduce(lambda a, b: a.join(b, ["ticker", "date"]), parts).join(targets, ["ticker", "date"], "left")
    y = [c for c in targets.columns if c not in ("ticker", "date")]
    return out if include_unlabelled else out.filter(F.coalesce(*y).isNotNull())


def standardised(panel: DataFrame, columns: list[str]) -> DataFrame:
    """columns as z scores within each date, clipped at 3; 0 where a date has no spread or the value is null."""
    by_date = panel.groupBy("date").agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}"))), F.lit(0.0))
    rest = [c for c in panel.columns if c not in columns]
    return panel.join(by_date, "date").select(*rest, *[F.least(F.greatest(z(c), F.lit(-3.0)), F.lit(3.0)).alias(c) for c in columns])


def factor_scores(panel: DataFrame) -> DataFrame:
    """ticker, date, the seven factors (the mean of their features' z scores) and the targets."""
    z = standardised(panel, FEATURES)
    rest = [c for c in panel.columns if c not in FEATURES]
    return z.select(*rest, *[(reduce(lambda a, b: a + b, [F.col(c) for c in columns]) / len(columns)).alias(f) for f, columns in FACTORS.items()])
