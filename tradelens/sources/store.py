"""Writing: rows by key, whole partitions, key-value pairs, JSON exports, and checks of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelens.functions.scalars import finite


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """old and new by key, each key once: new rows replace old ones, or are ignored where the key is there.

    Of several new rows of one key the greatest stays, so the result doesn't depend on their order.
    """
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    order = [F.desc("_new") if replace else F.asc("_new"), *[F.desc(c) for c in new.columns if c not in keys]]
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k", "_new")


def changed(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True) -> int:
    """How many keys of new an upsert writes."""
    found = new.select(*keys).distinct()
    return found.count() if replace else found.join(old, keys, "left_anti").count()


def preserved(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """new with column as old has it for the keys that old has: what was first stays."""
    before = old.select(key, F.col(column).alias("_before"))
    return new.join(before, key, "left").withColumn(column, F.coalesce("_before", column)).drop("_before")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes df by partition; those that df has replace what was there, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def updated(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with the columns of changes for the keys that it has."""
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    return df.join(new, keys, "left").select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def set_values(old: DataFrame, values: DataFrame) -> DataFrame:
    """The key-value table (k, v: JSON) with new values."""
    return upsert(old, values, ["k"])


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON texts (value), in which numbers that aren't finite are null."""
    safe = [finite(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def export(views: dict[str, DataFrame], folder: str) -> None:
    """Each view as JSON lines in its own folder, and a table of their names and row counts."""
    rows = []
    for name, df in views.items():
        json_rows(df).write.mode("overwrite").text(f"{folder}/{name}")
        rows.append((name, df.count()))
    spark = next(iter(views.values())).sparkSession
    spark.createDataFrame(rows, "view string, n_rows long").write.mode("overwrite").json(f"{folder}/meta")


def run_log(spark: SparkSession, source: str, status: str, n_rows: int, note: str | None = None) -> DataFrame:
    """One row of the log of runs, to be appended."""
    row = spark.createDataFrame([(source, status, n_rows, note)], "source string, status string, n_rows long, note string")
    return row.withColumn("finished_at", F.current_timestamp())


def check_integrity(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key the parent lacks."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
