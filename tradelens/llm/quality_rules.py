"""Quality rules of documents and of the hosts they come from, with DataFrame functions alone.

Rules are measured on every whole text. Their failures are counted by host, each host's rates are shrunk towards what
hosts have in common (an empirical beta prior), and hosts that surely fail a rule far more often than hosts commonly do
lose all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.shared import SPACES, cut

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rule name: what makes a document fail it.
BASE_RULES = {"short": "n_words < 20", "repetitive": "100 * n_repeat_words > 30 * n_words"}
HOST_RULES = BASE_RULES | {"symbols": "10 * n_symbols > word_chars and n_words > 0", "lines": "4 * n_dup_lines > n_lines and n_lines > 3"}
#: A host goes when the odds of failing a rule are over FACTOR times the common odds, even at SDS standard deviations of
#: the posterior under its shrunk rate.
FACTOR, SDS = 3.0, 3.0


def _let(value: Column, use) -> Column:
    """use(value) with value computed once for the row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _paired(of: Column, gap: int) -> Column:
    """For each hash in of: one of it and of the hash gap places on, as long as there is one."""
    return _let(of, lambda h: F.zip_with(F.slice(h, F.lit(1), F.greatest(F.size(h) - gap, F.lit(0))), F.slice(h, F.lit(gap + 1), F.greatest(F.size(h) - gap, F.lit(0))), lambda a, b: F.xxhash64(a, b)))


def _covered(places: Column) -> Column:
    """Words under windows that begin at the places given, which ascend."""
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n"), p.alias("at"))
    start = F.struct(F.lit(0).cast("int").alias("n"), F.lit(-WINDOW).cast("int").alias("at"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words in windows found twice or more.

    Hashes of windows tell texts without any repetition; only for the others the windows themselves are sorted and
    compared, so a hash that two windows share by chance changes nothing.
    """

    def exact(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("t"), i.cast("int").alias("i")))

        def repeated(s: Column) -> Column:
            n = F.size(s)
            same = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: F.when(a["t"] == b["t"], F.array(a["i"], b["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull()))))

        return _covered(_let(F.sort_array(windows), repeated))

    any_repeat = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((F.size(words) < WINDOW + 1) | ~any_repeat, F.lit(0)).otherwise(_let(words, exact))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of each text; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "source", text.alias("text"))
    flat = F.trim(F.regexp_replace("text", SPACES, " "))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    base = base.select("doc_id", "source", "text", F.when(F.length(flat) == 0, F.array().cast("array<string>")).otherwise(F.split(flat, " ")).alias("words"))
    eight = _paired(_paired(_paired(F.transform("words", lambda w: F.xxhash64(w)), 1), 2), 4)
    count_dup = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup"))
    out = base.select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, count_dup).alias("lines"),
        _repeat_words(F.col("words"), eight).cast("long").alias("n_repeat_words"),
    )
    return out.select("doc_id", "source", "n_words", "word_chars", "n_symbols", F.col("lines.n_dup").cast("long").alias("n_dup_lines"), "n_repeat_words", F.col("lines.n_lines").cast("long").alias("n_lines"))


def host_verdicts(measured: DataFrame, rules: dict[str, str] = HOST_RULES, factor: float = FACTOR, sds: float = SDS) -> DataFrame:
    """source, n_docs, a shrunk rate for each rule and host_kept.

    The prior's mean and weight are fitted to the hosts' rates by their moments: the spread of rates beyond what chance
    gives for their sizes. Without any such spread, or with one host, hosts are shrunk wholly to the common rate and stay.
    """
    counts = [F.sum(F.when(F.expr(r), 1).otherwise(0)).alias(f"f_{k}") for k, r in rules.items()]
    hosts = measured.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *counts)
    fits = []
    for k in rules:
        fits += [F.avg(F.col(f"f_{k}") / F.col("n_docs")).alias(f"m_{k}"), F.var_pop(F.col(f"f_{k}") / F.col("n_docs")).alias(f"v_{k}"), F.avg(1 / F.col("n_docs")).alias("chance")]
    prior = hosts.agg(*{str(c): c for c in fits}.values())
    joined = hosts.crossJoin(F.broadcast(prior))  # the prior is one row
    rates, bad = [], []
    for k in rules:
        m, v, f = F.col(f"m_{k}"), F.col(f"v_{k}"), F.col(f"f_{k}")
        spread = F.greatest(v - m * (1 - m) * F.col("chance"), F.lit(0.0))
        weight = F.when(spread > 0, F.greatest(m * (1 - m) / spread - 1, F.lit(0.0)))
        rate = F.when(weight.isNull(), m).otherwise((f + weight * m) / (F.col("n_docs") + weight))
        least = F.greatest(rate - sds * F.sqrt(rate * (1 - rate) / (F.col("n_docs") + weight + 1)), F.lit(0.0))
        rates.append(rate.alias(f"rate_{k}"))
        bad.append(F.coalesce(least * (1 - m) > factor * m * (1 - least), F.lit(False)))
    return joined.select("source", "n_docs", *rates, (~F.array_contains(F.array(*bad), True)).alias("host_kept"))


def quality(docs: DataFrame, factor: float = FACTOR) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the host's verdict for every row of docs (doc_id, text, source).

    A document is kept unless it fails a base rule or its host's verdict is bad. A null source is a host of its own.
    A null or empty text has no words and fails as short. Very long texts are measured
    whole. Repeated rows count each; more columns are left out; an empty table gives an empty result.
    """
    measured = cut(measures(docs))
    # Hosts are far fewer than documents, but their table is joined by whichever way its size allows.
    hosts = host_verdicts(measured, factor=factor).select(F.col("source").alias("host"), "host_kept")
    failed = F.expr(" or ".join(f"({r})" for r in BASE_RULES.values()))
    joined = measured.join(hosts, measured["source"].eqNullSafe(hosts["host"]), "left").withColumn("base_failed", failed)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"), F.coalesce("host_kept", F.lit(True)).alias("host_kept"))
