"""Query texts with the few expressions that Spark and DuckDB write differently.

A query names the views that it needs; those and the views they need in turn are put in front of it, so each text is one
statement. Spark plans it as a whole, and views that are used twice are exchanged once where plans agree.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tradelens.sources.staging import fingerprint, staged

#: name: (Spark's form, DuckDB's form); arguments are separated by semicolons.
FORMS = {
    "DAYS": ("datediff({0}, {1})", "CAST(date_diff('day', {1}, {0}) AS INTEGER)"),
    "SHIFT": ("date_add({0}, CAST({1} AS INT))", "({0} + CAST({1} AS INTEGER))"),
    "WEEKDAY": ("weekday({0})", "(isodow({0}) - 1)"),
    "WEEK_START": ("CAST(date_trunc('week', {0}) AS DATE)", "CAST(date_trunc('week', {0}) AS DATE)"),
    "EACH_DAY": ("explode(sequence({0}, {1}))", "CAST(unnest(generate_series({0}, {1}, INTERVAL 1 DAY)) AS DATE)"),
    "EACH_INT": ("explode(sequence({0}, {1}))", "unnest(generate_series({0}, {1}))"),
    "LAST_KNOWN": ("last_value({0}) IGNORE NULLS", "last_value({0} IGNORE NULLS)"),
    "SHA1": ("sha1({0})", "sha1({0})"),
    "HOUR_START": ("date_trunc('hour', {0})", "date_trunc('hour', {0})"),
    "NUMBER_IN": ("CAST(regexp_extract({0}, '[0-9]+', 0) AS INT)", "CAST(regexp_extract({0}, '[0-9]+', 0) AS INTEGER)"),
    "MEMBERS_IN": ("size(collect_set({0}) {1})", "len(list_distinct(list({0}) {1}))"),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Decimal literals are written as doubles, which both sides then keep through every aggregate.
_DOUBLE = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")
_FORM = re.compile(r"\b(" + "|".join(FORMS) + r")\[([^\[\]]*)\]")


def _written(text: str, dialect: int) -> str:
    while (new := _FORM.sub(lambda m: FORMS[m[1]][dialect].format(*[a.strip() for a in m[2].split(";")]), text)) != text:
        text = new
    return _DOUBLE.sub((r"\1D", r"CAST(\1 AS DOUBLE)")[dialect], text)


def statement(query: str, views: dict[str, str], dialect: int) -> str:
    """The query with its views in front; views are ordered, each may use those before it."""
    needed, text = [], query
    for name in reversed(views):
        if re.search(rf"\b{name}\b", text):
            needed.append(name)
            text += "\n" + views[name]
    kind = "AS MATERIALIZED" if dialect else "AS"
    ctes = ",\n".join(f"{n} {kind} ({views[n].strip()})" for n in reversed(needed))
    return _written(f"WITH {ctes}\n{query.strip()}" if ctes else query.strip(), dialect)


def _named(name: str, text: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def spark_frame(spark: SparkSession, sf_dir: str, query: str, views: dict[str, str], stored: frozenset[str] = frozenset()) -> DataFrame:
    """The query's rows. Tables and stored views stand in the text as {name}, so the caller's own views keep their names.

    A stored view that the query needs is computed once and read from its table by every other query.
    """
    inner, held, text = {}, [], query
    for name in reversed(views):
        if _named(name, text):
            if name in stored:
                held.append(name)
            else:
                inner[name] = views[name]
                text += "\n" + views[name]
    text = statement(query, {n: views[n] for n in views if n in inner}, 0)
    frames = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES if _named(name, text)}
    frames |= {name: stored_view(spark, sf_dir, name, views, stored) for name in held}
    if _named("PARTS", text):
        text = re.sub(r"\bPARTS\b", str(parts(spark, f"{sf_dir}/lineitem.parquet")), text)
    for name in frames:
        text = re.sub(rf"\b{name}\b", f"{{{name}}}", text)
    return spark.sql(text, **frames)


def parts(spark: SparkSession, path: str, each: int = 2 << 20) -> int:
    """A number of partitions for facts of the file or folder at path: the session's, or one for each so many bytes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


_STORED: dict[tuple[str, str, str, str], DataFrame] = {}


def stored_view(spark: SparkSession, sf_dir: str, name: str, views: dict[str, str], stored: frozenset[str]) -> DataFrame:
    """The view's rows from a table in the shared folder, written when first needed for these files as they are now."""
    seen = fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES if _named(t, statement(f"SELECT * FROM {name}", views, 0))])
    key = (spark.sparkContext.applicationId, sf_dir, name, f"{views[name]}|{seen}")
    if key not in _STORED:
        before = dict(list(views.items())[: list(views).index(name) + 1])
        _STORED[key] = staged(spark_frame(spark, sf_dir, f"SELECT * FROM {name}", before, stored - {name}), name)
    return _STORED[key]


def duckdb_text(query: str, views: dict[str, str]) -> str:
    return statement(query, views, 1)
