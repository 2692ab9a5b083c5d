"""What the corpus operators share: reading tables, cutting lineage, whitespace rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.sources.staging import shared_folder, staged

#: The white space that separates words: the space and the controls 0x09 to 0x0D.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay."""
    return F.translate(text, UPPER, LOWER)


#: Bytes of the texts that a classifier is fitted to, unless its caller says otherwise.
MAX_BYTES = 128_000_000


def bounded_sample(docs: DataFrame, chosen: DataFrame, label: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text and label of the chosen (doc_id, label; bounded rows), whole texts of at most max_bytes in all.

    Those with the smallest hashes of their ids come first; a text that doesn't fit any more is left out, and those after
    it still count. Of several texts of one doc_id the smallest counts. The sizes alone, a row for each chosen id, are
    added up on the driver.
    """
    found = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min(label).alias(label)))
    fits, room = [], max_bytes
    for row in found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if row["size"] <= room:
            fits.append((row["doc_id"],))
            room -= row["size"]
    ids = found.sparkSession.createDataFrame(fits, f"doc_id {found.schema['doc_id'].dataType.simpleString()}")
    return found.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text", label)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared checkpoint folder, so lost executors lose no work.

    The folder is the session's spark.checkpoint.dir.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: compressed, and read by column."""
    return staged(df)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, in a column whose name docs doesn't have, from a table that keeps the numbers."""
    name = "_".join(["row", *docs.columns])
    return written(docs.withColumn(name, F.monotonically_increasing_id())), name


def partitions(df: DataFrame) -> int:
    """As many partitions as the shuffle setting or the scan has, whichever is more; it grows with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
