"""Prices from several providers in turn: what a run would ask and get, as a fold over the answers in the order of asking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Errors after which a provider that gave nothing yet is left, and words of answers that refuse the asker.
PATIENCE = 6
REFUSALS = ["exceeded", "limit", "denied", "forbidden", "captcha", "too many requests", "unavailable"]


def provider_order(first: str, known: tuple[str, ...] = ("stooq", "yahoo", "fmp")) -> list[str]:
    """The configured provider, then the others."""
    return [first] * (first in known) + [p for p in known if p != first]


def csv_outcome(body: Column) -> Column:
    """(outcome, note) of an answer that should be CSV: refused where its beginning says so, empty without a head with a date, else rows."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 400))
    refused = F.exists(F.array(*[F.lit(w) for w in REFUSALS]), lambda w: F.contains(head, w))
    outcome = F.when(refused, "refused").when(~F.contains(F.lower(F.substring_index(F.coalesce(body, F.lit("")), "\n", 1)), F.lit("date")), "empty").otherwise("rows")
    return F.struct(outcome.alias("outcome"), F.when(refused, F.translate(F.trim(F.substring(body, 1, 200)), "\n", " ")).alias("note"))


_STATE = "struct<dead:array<string>,misses:array<int>,wins:array<int>,asked:int,stopped:boolean,got:array<struct<ticker:string,provider:string,n_rows:bigint>>,none:array<string>,calls:array<int>,now:struct<provider:string,n_rows:bigint>>"


def _set(values: Column, at: int, value: Column) -> Column:
    return F.transform(values, lambda x, k: F.when(k == at, value).otherwise(x))


def replay(answers: DataFrame, order: list[str], patience: int = PATIENCE) -> DataFrame:
    """One row: what a run over answers gets when it asks the providers of order in turn for each ticker.

    answers: place (of the ticker in the run), ticker, provider, outcome (rows, empty, refused or error), n_rows and note. A
    provider that refuses is left at once, one that has given nothing after patience errors in a row as well, and the run
    stops when all are left. A ticker without an answer of a provider counts as empty there. The fold goes over a run's
    tickers, which its budget bounds.

    got: tickers with the provider that gave them; none: asked in vain; calls and wins by provider; dead: why each was left.
    """
    answer = F.struct("provider", "outcome", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "note")
    by_ticker = answers.groupBy("place", "ticker").agg(F.collect_list(answer).alias("a"))
    listed = by_ticker.agg(F.sort_array(F.collect_list(F.struct("place", "ticker", "a"))).alias("tickers"))
    zeros, nulls = F.array(*[F.lit(0)] * len(order)), F.array(*[F.lit(None).cast("string")] * len(order))
    start = F.struct(nulls.alias("dead"), zeros.alias("misses"), zeros.alias("wins"), F.lit(0).alias("asked"), F.lit(False).alias("stopped"), F.array().alias("got"), F.array().alias("none"), zeros.alias("calls"), F.lit(None).alias("now")).cast(_STATE)

    def ask(s: Column, x: Column, k: int) -> Column:
        """The state after provider k was asked for ticker x, if it is alive and nothing has come yet."""
        a = F.get(F.filter(x["a"], lambda y: y["provider"] == order[k]), F.lit(0))
        failed = s["misses"][k] + 1
        left = F.when(a["outcome"] == "refused", F.coalesce(a["note"], F.lit("refused"))).when((a["outcome"] == "error") & (failed >= patience) & (s["wins"][k] == 0), F.concat(failed.cast("string"), F.lit(" consecutive errors, last: "), F.coalesce(a["note"], F.lit(""))))
        came = F.coalesce((a["outcome"] == "rows") & (a["n_rows"] > 0), F.lit(False))
        misses = F.when(came, 0).when(a["outcome"] == "error", failed).otherwise(s["misses"][k])
        after = {
            "dead": _set(s["dead"], k, F.coalesce(s["dead"][k], left)), "misses": _set(s["misses"], k, misses), "wins": _set(s["wins"], k, s["wins"][k] + came.cast("int")), "calls": _set(s["calls"], k, s["calls"][k] + 1),
            "now": F.when(came, F.struct(F.lit(order[k]).alias("provider"), a["n_rows"].alias("n_rows"))),
        }
        return F.when(s["now"].isNull() & s["dead"][k].isNull(), _with(s, after)).otherwise(s)

    def step(s: Column, x: Column) -> Column:
        now = F.array(_with(s, {"asked": s["asked"] + 1, "now": F.lit(None).cast("struct<provider:string,n_rows:bigint>")}))
        of = lambda k: lambda t: ask(t, x, k)
        for k in range(len(order)):
            now = F.transform(now, of(k))
        ended = lambda t: _with(t, {
            "got": F.when(t["now"].isNull(), t["got"]).otherwise(F.concat(t["got"], F.array(F.struct(x["ticker"].alias("ticker"), t["now"]["provider"].alias("provider"), t["now"]["n_rows"].alias("n_rows"))))),
            "none": F.when(t["now"].isNull(), F.concat(t["none"], F.array(x["ticker"]))).otherwise(t["none"]), "stopped": F.forall(t["dead"], lambda d: d.isNotNull()),
        })
        return F.when(s["stopped"], s).otherwise(F.transform(now, ended)[0])

    end = listed.select(F.aggregate("tickers", start, step).alias("s"))
    named = lambda values: F.map_from_arrays(F.array(*[F.lit(p) for p in order]), values)
    return end.select("s.asked", "s.got", "s.none", named(F.col("s.wins")).alias("wins"), named(F.col("s.calls")).alias("calls"), F.map_filter(named(F.col("s.dead")), lambda _, v: v.isNotNull()).alias("dead"))


def _with(s: Column, new: dict[str, Column]) -> Column:
    fields = ["dead", "misses", "wins", "asked", "stopped", "got", "none", "calls", "now"]
    return F.struct(*[new.get(f, s[f]).alias(f) for f in fields]).cast(_STATE)


def sync_report(replayed: DataFrame, benchmark: str, benchmark_rows: int) -> DataFrame:
    """The row of replay with rows, tickers_with_data and status: a run that fetched nothing never calls itself ok.

    benchmark_rows is how many prices of the benchmark the store has afterwards.
    """
    rows = F.aggregate("got", F.lit(0).cast("long"), lambda s, x: s + x["n_rows"])
    found = F.size("got")
    left = F.concat(F.lit("Providers retired: "), F.coalesce(F.nullif(F.array_join(F.transform(F.map_entries("dead"), lambda e: F.concat_ws(" ", e["key"], e["value"])), ", "), F.lit("")), F.lit("none")))
    missing = F.concat(F.lit(f"FAILED: no data for benchmark {benchmark}: no excess return is defined. "), left)
    nothing = F.concat(F.lit("FAILED: fetched 0 rows across "), F.col("asked").cast("string"), F.lit(" tickers. "), left)
    few = F.concat(F.lit("DEGRADED: only "), found.cast("string"), F.lit("/"), F.col("asked").cast("string"), F.lit(" tickers returned data. "), left)
    status = F.when(F.col("asked") == 0, "ok").when(F.lit(benchmark_rows == 0), missing).when(rows == 0, nothing).when(found < F.greatest(F.lit(3.0), F.col("asked") * 0.2), few).otherwise("ok")
    return replayed.withColumns({"rows": rows, "tickers_with_data": found, "status": status})
