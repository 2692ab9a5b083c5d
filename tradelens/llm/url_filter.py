"""Rules on hosts and paths of urls, as a sort-merge range join with DataFrame functions alone.

A host's labels in reverse, each followed by a dot, are its canonical key: a host and its subdomains are then the
interval from the key to the key with "/" for its last dot. Intervals of rules nest. Urls and the ends of intervals are
sorted together by range, and a sweep over them carries the stack of rules whose interval is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelens.llm.shared import ascii_lower, cut, partitions

URL = "^(?s)(?:(?!://).)*://([^/?#]*)([^?#]*)"
#: The stacks with which partitions begin are broadcast while there are no more partitions than this, else joined by shuffle.
FEW_PARTS = 20_000
STACK = "array<struct<size:int,host_size:int,path:string,rule:string,verdict:string>>"


def canonical(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs as a table; a rule is host/path."""
    return spark.createDataFrame(rules, "verdict string, rule string")


def boundaries(rules: DataFrame) -> DataFrame:
    """The ends of the rules' intervals: key, side (0 closes, 1 opens) and the stack that is active from there on."""
    parsed = rules.select(
        ascii_lower(F.regexp_extract("rule", "^([^/]*)", 1)).alias("host"), F.regexp_extract("rule", "^[^/]*(?s)(.*)$", 1).alias("path"), "rule", "verdict"
    ).distinct()
    entry = F.struct(F.length("rule").alias("size"), F.length("host").alias("host_size"), "path", "rule", "verdict")
    hosts = parsed.groupBy(canonical(F.col("host")).alias("key")).agg(F.collect_list(entry).alias("own"))
    # The rules that enclose a host are those of its shorter keys.
    labels = F.split(F.expr("left(key, length(key) - 1)"), "\\.")
    above = hosts.select("key", labels.alias("labels")).filter("size(labels) > 1")
    above = above.select("key", F.explode(F.expr("transform(sequence(1, size(labels) - 1), i -> concat(array_join(slice(labels, 1, i), '.'), '.'))")).alias("outer"))
    outer = above.join(hosts.select(F.col("key").alias("outer"), F.col("own").alias("theirs")), "outer").groupBy("key").agg(F.flatten(F.collect_list("theirs")).alias("theirs"))
    nested = hosts.join(outer, "key", "left").withColumn("theirs", F.coalesce(F.col("theirs").cast(STACK), F.array().cast(STACK)))
    opens = nested.select("key", F.lit(1).alias("side"), F.concat("theirs", F.col("own").cast(STACK)).alias("stack"))
    closes = nested.select(F.expr("concat(left(key, length(key) - 1), '/')").alias("key"), F.lit(0).alias("side"), F.col("theirs").alias("stack"))
    return opens.unionByName(closes)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages (page_id, url); more columns are left out.

    A rule fits its host and the subdomains when the url's path starts with the rule's. Of those that fit, the longest
    rule wins, at a tie the one with the longer host. Without one, rule is null and the verdict is default. A null url, or
    one without "://", has an empty host and path. Repeated rows each get a row; empty tables give empty results, and
    without rules everything gets the default.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    urls = pages.select("page_id", ascii_lower(F.regexp_extract(url, URL, 1)).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))
    urls = urls.select(canonical(F.col("host")).alias("key"), F.lit(2).alias("side"), "page_id", "host", "path", F.lit(None).cast(STACK).alias("stack"))
    ends = boundaries(rules).select("key", "side", F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    # Ranges split a frequent host by the pages' ids; the partition is written down before it is used as a key.
    n = partitions(pages)
    swept = cut(urls.unionByName(ends).repartitionByRange(n, "key", "side", "page_id").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy("key", "side", "page_id")
    here = F.last("stack", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # What is open where a partition begins: the last stack of those before it. One row for each partition.
    last = swept.groupBy("part").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.struct("key", "side"))).alias("last"))
    before = last.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    active = swept.withColumn("here", here).filter("side = 2").join(F.broadcast(before) if n <= FEW_PARTS else before, "part", "left")
    best = F.array_max(F.filter(F.coalesce("here", "before"), lambda r: F.col("path").startswith(r["path"])))
    return active.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
