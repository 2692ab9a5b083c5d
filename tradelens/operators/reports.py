"""How sources agree, whether the store is healthy, and who sits where the companies they trade lobby."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The committees that a lobbying issue concerns.
ISSUE_COMMITTEES = {
    "DEF": ["HSAS", "SSAS", "HSAP", "SSAP"],
    "HCR": ["HSIF", "SSHR", "HSWM"],
    "MMM": ["HSIF", "SSCM"],
    "TAX": ["HSWM", "SSFI"],
    "BAN": ["HSBA", "SSBK"],
    "ENG": ["HSIF", "SSEG"],
    "TEC": ["HSIF", "SSCM", "HSSY"],
    "TRD": ["HSWM", "SSFI"],
    "AGR": ["HSAG", "SSAF"],
    "TRA": ["HSPW", "SSCM"],
    "ENV": ["HSII", "SSEV"],
}


def reconcile(trades: DataFrame, own: tuple[str, ...] = ("house", "senate")) -> DataFrame:
    """One row: pairs of own and vendors' trades (source, member_id, ticker, transaction_date) that agree, and trades of one side only.

    Trades are counted by key on each side first, so a key with many trades costs one row.
    """
    keys = ["member_id", "ticker", "transaction_date"]
    ours = F.col("source").isin(*own)
    known = trades.filter("ticker is not null and member_id is not null and transaction_date is not null and source is not null")
    sides = known.groupBy(*keys).agg(F.count_if(ours).alias("o"), F.count_if(~ours).alias("v"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    undated = trades.filter("ticker is not null and member_id is not null and transaction_date is null and source is not null").agg(F.count_if(ours).alias("uo"), F.count_if(~ours).alias("uv"))
    one = sides.agg(total(F.col("o") * F.col("v")).alias("agree"), total(F.when(F.col("o") == 0, F.col("v"))).alias("vendor_only"), total(F.when(F.col("v") == 0, F.col("o"))).alias("ours_only"))
    return one.crossJoin(undated).select("agree", (F.col("vendor_only") + F.col("uv")).alias("vendor_only"), (F.col("ours_only") + F.col("uo")).alias("ours_only"))  # one row each


def health(members: DataFrame, filings: DataFrame, trades: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """One row of counts: members, filings and those that failed, trades with and without ticker and member, dates, and the rows of others."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = trades.agg(
        F.count(F.lit(1)).alias("transactions"), F.count("ticker").alias("transactions_with_ticker"), F.count_if(F.col("member_id").isNull()).alias("transactions_unlinked_member"),
        F.countDistinct("ticker").alias("distinct_tickers"), F.max("transaction_date").alias("latest_trade_date"),
    )
    out = out.crossJoin(filings.agg(F.count(F.lit(1)).alias("filings"), F.count_if(F.col("parse_status") == "failed").alias("filings_failed"), F.max("filed_date").alias("latest_filed_date")))
    for name, df in {"members": members, **others}.items():
        out = out.crossJoin(count(df, name))  # one row each
    return out


def blocking_problems(prices: DataFrame, trades: DataFrame, runs: DataFrame, benchmark: str) -> DataFrame:
    """problem: what makes results meaningless: no prices, none of the benchmark, no trades, or errors of the newest runs (source, status, note, finished_at)."""
    n = prices.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ticker") == benchmark).alias("b")).crossJoin(trades.agg(F.count(F.lit(1)).alias("t")))
    found = F.array_compact(F.array(
        F.when(F.col("n") == 0, "no prices: no return, score or prediction is defined"),
        F.when((F.col("n") > 0) & (F.col("b") == 0), f"no prices of the benchmark {benchmark}: no excess return is defined"),
        F.when(F.col("t") == 0, "no trades were read"),
    ))
    newest = runs.agg(F.max("finished_at").alias("newest"))
    failed = runs.filter("status = 'error'").join(newest, F.col("finished_at") >= F.col("newest"))
    return n.select(F.explode(found).alias("problem")).unionByName(failed.select(F.concat(F.lit("stage "), "source", F.lit(" failed: "), F.substring(F.coalesce("note", F.lit("no detail")), 1, 160)).alias("problem")))


def lobbied_issues(filings: DataFrame, activities: DataFrame) -> DataFrame:
    """ticker, issue_code, spend: of filings (filing_uuid, ticker, amount) with their activities (filing_uuid, issue_code, description, entity).

    Repeated activities count once; a filing counts once for each of its activities.
    """
    return filings.filter("ticker is not null").join(activities.distinct(), "filing_uuid").groupBy("ticker", F.upper("issue_code").alias("issue_code")).agg(F.sum(F.coalesce("amount", F.lit(0.0))).alias("spend"))


def lobbied_lines(lines: DataFrame, *near: str) -> DataFrame:
    """The same of lines that are a filing and an activity of it in one (filing_uuid, ticker, amount, issue_code): a filing has the largest amount of its lines.

    near: columns that a filing's lines share; lines that are dealt by them already stay where they are.
    """
    filing = [*near, "filing_uuid", "ticker"]
    once = lines.filter("ticker is not null").groupBy(*filing, "issue_code").agg(F.max("amount").alias("amount"))
    whole = once.withColumn("amount", F.max("amount").over(Window.partitionBy(*filing)))
    return whole.groupBy("ticker", F.upper("issue_code").alias("issue_code")).agg(F.sum(F.coalesce("amount", F.lit(0.0))).alias("spend"))


def committee_alignment(trades: DataFrame, members: DataFrame, filings: DataFrame, activities: DataFrame, memberships: DataFrame, limit: int = 50, issues: dict[str, list[str]] | None = None) -> DataFrame:
    """Members who traded a company while on a committee that the company's lobbying concerns: which, how much, and the spend.

    filings: filing_uuid, ticker, amount; activities: filing_uuid, issue_code, description, entity, where repeated rows count
    once; memberships: member_id, committee_id. The spend counts each filing once for each of its activities. Volumes are
    ordered to four digits, so that equal ones are, however their sums come out.
    """
    return aligned(trades, members, lobbied_issues(filings, activities), memberships, limit, issues)


def aligned(trades: DataFrame, members: DataFrame, lobbied: DataFrame, memberships: DataFrame, limit: int = 50, issues: dict[str, list[str]] | None = None) -> DataFrame:
    """The same of what companies spent by issue (ticker, issue_code, spend; a pair may have several rows). Trades that are dealt by member are dealt no more."""
    spark = trades.sparkSession
    concerns = spark.createDataFrame([(i, c) for i, cs in (issues or ISSUE_COMMITTEES).items() for c in cs], "issue_code string, committee_id string")
    # a row for each company and committee, read from the lobbying once and sent whole, so that members and their trades stay
    spent = lobbied.groupBy("ticker").agg(F.sum("spend").alias("lobby_spend"), F.collect_set("issue_code").alias("codes"))
    issues_of = spent.select("ticker", "lobby_spend", F.explode("codes").alias("issue_code"))
    targets = F.broadcast(issues_of.join(F.broadcast(concerns), "issue_code").select("ticker", "lobby_spend", "committee_id").distinct())  # the map is fixed and small
    volume = trades.filter("ticker is not null and member_id is not null and ticker_confidence >= 0.6").groupBy("ticker", "member_id").agg(F.count(F.lit(1)).alias("n_trades"), F.sum(F.coalesce("amount_est", F.lit(0.0))).alias("volume"))
    hit = volume.join(memberships.distinct(), "member_id").join(targets, ["ticker", "committee_id"]).groupBy("ticker", "member_id", "n_trades", "volume", "lobby_spend").agg(F.array_join(F.sort_array(F.collect_set("committee_id")), ",").alias("matched_committees"))
    out = hit.join(members.select("member_id", "full_name", "chamber"), "member_id")
    return out.select("member_id", "full_name", "chamber", "ticker", "matched_committees", "n_trades", "volume", "lobby_spend").orderBy(F.desc("lobby_spend"), F.desc(F.round("volume", 4)), "ticker", "member_id").limit(limit)


def last_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    """Each source's newest run, the newest first."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("finished_at")))
    return runs.withColumn("_k", place).filter("_k = 1").drop("_k").orderBy(F.desc("finished_at"), "source").limit(limit)
