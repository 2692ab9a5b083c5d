"""Exact duplicates by content-defined chunk recipes, with DataFrame functions alone.

A normalised text is cut into chunks where its own characters say so, each chunk becomes an identifier, and texts are
compared as ordered lists of identifiers. Long texts move once at most, when identifiers are verified; after that only
lists of numbers move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.shared import cut, keyed

#: A chunk has MIN to MAX characters and ends where a word ends in a mark, a space follows and a mark begins the next.
MIN, MAX = 512, 8191
#: Marks: every eighth code point of Latin-1. Other scripts are cut at MAX, which equal texts share too.
MARKS = "".join(f"\\x{c:02X}" for c in range(0x21, 0x100) if c % 8 == 3)
CHUNK = f"(?s).{{{MIN},{MAX}}}?[{MARKS}] (?=[{MARKS}])|.{{1,{MAX + 1}}}"
#: A group of more copies than this is joined to its rows by a broadcast of its one row.
HOT_GROUP = 50_000


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null counts as empty. Only texts that have a run meet a regular expression."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t))[0]


def exact_dedup(docs: DataFrame, fingerprint: Callable[[Column], Column] = lambda c: F.xxhash64(c)) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs (doc_id, text; more columns are left out).

    Texts are equal when identical after white space is normalised; null counts as the empty text, and all empty texts
    are one group. The smallest doc_id of a group stays. Rows that repeat the kept doc_id are all marked kept, as an id
    can't tell them apart. A null doc_id never stays unless its group has no other, and then kept is false. Any other
    columns don't matter. An empty table gives an empty result.

    fingerprint maps a chunk to a number. Where two different chunks share one, the identifiers are extended by the
    chunk's rank among them, so the comparison is of contents, whatever the fingerprint.
    """
    chunked = docs.select("doc_id", normalised(F.col("text")).alias("text")).select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)).alias("chunks")
    )
    # Verification: every chunk's content is brought together with those of its fingerprint, each distinct one once.
    contents = chunked.select(F.explode_outer("chunks").alias("chunk")).filter("chunk is not null").select(fingerprint(F.col("chunk")).alias("fp"), "chunk").distinct()
    clashes = contents.groupBy("fp").count().filter("count > 1").select("fp")
    if clashes.isEmpty():
        recipe = F.transform("chunks", lambda c: fingerprint(c))
        recipes = chunked.select("doc_id", recipe.alias("recipe"), F.sha2("text", 256).alias("text_sha256"))
    else:
        recipes = _extended(chunked, contents, clashes, fingerprint)
    recipes = cut(recipes)

    groups = recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = cut(groups)
    hot = groups.filter(F.col("group_size") > HOT_GROUP)
    if hot.isEmpty():
        joined = recipes.join(groups, "recipe", "left")
    else:
        # The rows of a large group must not meet in one task. There is one such group for HOT_GROUP rows at most.
        named = recipes.join(F.broadcast(hot.withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"})), "recipe", "left").withColumn("rest", F.col("hot_size").isNull())
        cold = groups.filter(F.col("group_size") <= HOT_GROUP)
        columns = ["doc_id", "text_sha256", "keep_id", "group_size"]
        large = named.filter(~F.col("rest")).select("doc_id", "text_sha256", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"))
        joined = named.filter("rest").drop("hot_id", "hot_size", "rest").join(cold, "recipe", "left").select(*columns).unionByName(large)
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.col("doc_id").isNotNull()).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))).alias("kept"),
        "text_sha256",
    )


def _extended(chunked: DataFrame, contents: DataFrame, clashes: DataFrame, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """Recipes whose identifiers are (fingerprint, rank of the content among those that share it)."""
    ranks = contents.join(clashes, "fp", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("fp").orderBy("chunk")))
    keyed = chunked.withColumn("row", F.monotonically_increasing_id())
    keyed = cut(keyed)
    pieces = keyed.select("row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("fp", fingerprint(F.col("chunk")))
    named = pieces.join(ranks, ["fp", "chunk"], "left").select("row", F.struct("pos", "fp", F.coalesce("rank", F.lit(0)).alias("rank")).alias("part"))
    lists = named.groupBy("row").agg(F.sort_array(F.collect_list("part")).alias("recipe"))
    empty = F.array().cast("array<struct<pos:int,fp:bigint,rank:int>>")
    lists = lists.select("row", F.col("recipe").cast("array<struct<pos:int,fp:bigint,rank:int>>").alias("recipe"))
    return keyed.join(lists, "row", "left").select("doc_id", F.coalesce("recipe", empty).alias("recipe"), F.sha2("text", 256).alias("text_sha256"))


def exact_duplicates_dropped(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts.

    Rows are told apart by a number of their own, not by doc_id: a row that is repeated stays once, a text that is unique
    stays whatever other texts have its doc_id, and so do unique texts without one. Of a group the row with the smallest
    doc_id stays, one without an id only where none has one, and of those the first by number.
    """
    rows, key = keyed(docs)
    ids = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("row")).alias("doc_id"), "text")
    gone = exact_dedup(ids).filter("not kept").select(F.col("doc_id.row").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)
