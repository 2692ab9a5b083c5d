"""Documents for the site: nested rows of each view, and documents by member that are written and read by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.functions.scalars import finite
from tradelens.sources.staging import numbered

#: Trades in a page of a member's document, and partitions of documents that are written by key.
PAGE, BUCKETS = 1000, 64
#: The buckets of filing delays by their last day, in their order.
DELAYS = [(-1, "<0"), (15, "0-15"), (30, "16-30"), (45, "31-45"), (90, "46-90"), (180, "91-180"), (None, "180+")]


def delay_bucket(days: Column) -> Column:
    out = F.lit(DELAYS[-1][1])
    for last, name in reversed(DELAYS[:-1]):
        out = F.when(days <= last, name).otherwise(out)
    return out


def delay_view(trades: DataFrame) -> DataFrame:
    """bucket, place and n of the trades with a delay, in the order of the buckets."""
    counts = trades.filter("filing_delay_days is not null").groupBy(delay_bucket(F.col("filing_delay_days")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(name) for _, name in DELAYS]), F.col("bucket")).cast("int")
    return counts.select("bucket", place.alias("place"), "n")


def events_view(studied: DataFrame, trades: DataFrame, members: DataFrame, limit: int = 100) -> DataFrame:
    """The events of trades (key: txn_id as text) with the largest t in size, with the trade and the member, if known."""
    found = studied.filter("scope = 'txn' and t_stat is not null").orderBy(F.desc(F.abs("t_stat")), "key").limit(limit)
    own = trades.select(F.col("txn_id").cast("string").alias("key"), "ticker", "direction", "member_id")
    return found.drop("ticker").join(own, "key", "left").join(members.select("member_id", "full_name"), "member_id", "left")


def summary_view(trades: DataFrame) -> DataFrame:
    """One row: trades with a ticker, their volume, members and tickers, and mean, upper median and late share of the delays.

    The median comes from counts by delay, so no row is ranked by itself.
    """
    named = trades.filter("ticker is not null").agg(F.count(F.lit(1)).alias("n_transactions"), F.coalesce(F.sum("amount_est"), F.lit(0.0)).alias("gross_volume"), F.count_distinct("member_id").alias("n_members"), F.count_distinct("ticker").alias("n_tickers"))
    counts = trades.filter("filing_delay_days is not null").groupBy("filing_delay_days").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.agg(F.sort_array(F.collect_list(F.struct("filing_delay_days", "n"))).alias("c"), F.sum("n").alias("n"), F.sum(F.col("filing_delay_days") * F.col("n")).alias("days"), F.sum(F.when(F.col("filing_delay_days") > 45, F.col("n")).otherwise(0)).alias("late"))  # a row for each number of days
    walk = F.aggregate("c", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("at")), lambda s, x: F.struct((s["upto"] + x["n"]).alias("upto"), F.coalesce(s["at"], F.when(s["upto"] + x["n"] > F.floor(F.col("n") / 2), x["filing_delay_days"])).alias("at")))
    delays = listed.select(F.try_divide("days", "n").alias("mean_disclosure_delay"), walk["at"].alias("median_disclosure_delay"), F.try_divide("late", "n").alias("pct_filed_late"))
    return named.crossJoin(delays)  # one row each


def member_documents(members: DataFrame, scores: DataFrame, trades: DataFrame, page_rows: int = PAGE) -> DataFrame:
    """member_id, page, member, scores (by horizon) and trades (newest first) for each member: a row for each page of trades.

    A member with many trades has many pages, so no document grows beyond page_rows; one without trades has one empty page.
    """
    placed = numbered(trades.filter("member_id is not null"), F.desc_nulls_last("transaction_date"), "txn_id", keys=["member_id"])
    own = F.struct(*[c for c in trades.columns if c != "member_id"])
    pages = placed.withColumn("page", F.floor((F.col("place") - 1) / page_rows).cast("int")).groupBy("member_id", "page").agg(F.sort_array(F.collect_list(F.struct("place", own.alias("t")))).alias("p"))
    pages = pages.select("member_id", "page", F.transform("p", lambda x: x["t"]).alias("trades"))
    kept = F.struct(*[c for c in scores.columns if c != "member_id"])
    scored = scores.groupBy("member_id").agg(F.sort_array(F.collect_list(kept)).alias("scores"))  # a row for each horizon
    whole = members.select("member_id", F.struct(*members.columns).alias("member")).join(scored, "member_id", "left").join(pages, "member_id", "left")
    empty = F.array().cast(pages.schema["trades"].dataType)
    return whole.select("member_id", F.coalesce("page", F.lit(0)).alias("page"), "member", "scores", F.coalesce("trades", empty).alias("trades"))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_by_key(documents: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> None:
    """Documents dealt by key to partitions, so that one of them is read from one partition."""
    documents.withColumn("bucket", _bucket(F.col(key), buckets)).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_by_key(spark: SparkSession, key: str, value: object, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The documents of one key: none where it is unknown. Only the key's partition is read."""
    bucket = spark.range(1).select(_bucket(F.lit(value), buckets)).first()[0]
    return spark.read.parquet(path).filter((F.col("bucket") == bucket) & (F.col(key) == value)).drop("bucket")


def listed(rows: DataFrame, name: str = "rows") -> DataFrame:
    """One row with all rows as an array of structs, in their order; for views of a bounded number of rows."""
    place = F.monotonically_increasing_id()
    return rows.withColumn("_place", place).agg(F.sort_array(F.collect_list(F.struct("_place", F.struct(*rows.columns).alias("r")))).alias("a")).select(F.transform("a", lambda x: x["r"]).alias(name))


def _safe(value: Column, kind) -> Column:
    """value with numbers that JSON lacks as null, at any depth."""
    if kind.typeName() in ("double", "float"):
        return finite(value)
    if kind.typeName() == "array":
        return F.transform(value, lambda x: _safe(x, kind.elementType))
    if kind.typeName() == "struct":
        return F.when(value.isNotNull(), F.struct(*[_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def json_documents(documents: DataFrame) -> DataFrame:
    """value: each row as a JSON text, nulls included."""
    body = F.struct(*[_safe(F.col(f.name), f.dataType).alias(f.name) for f in documents.schema])
    return documents.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def export_site(views: dict[str, DataFrame], folder: str, note: str = "Public disclosure data. Trade dates are self-reported by filers.") -> None:
    """Each view's document as JSON in its own folder, and meta: when it was made and what is in it."""
    for name, df in views.items():
        json_documents(df).write.mode("overwrite").text(f"{folder}/api/{name}")
    spark = next(iter(views.values())).sparkSession
    meta = spark.range(1).select(F.current_timestamp().alias("generated_at"), F.lit(note).alias("note"), F.array(*[F.lit(n) for n in views]).alias("views"))
    json_documents(meta).write.mode("overwrite").text(f"{folder}/api/meta")
