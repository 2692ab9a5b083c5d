"""Which ticker an asset's text names, and which member a filer's name is; both as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.scalars import ASSET_CODES, classify_asset, norm_person, normalize_name, spaced, strip_noise

_CODES = [*ASSET_CODES]
#: Words that many companies share, beside those that names lose anyway.
GENERIC = ["international", "technologies", "technology", "systems", "solutions", "industries", "enterprises"]
#: Tokens of more companies than this tell none.
GENERIC_FROM = 40


def _tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: ~w.isin(GENERIC) & (F.length(w) > 2)))


def resolve_tickers(assets: DataFrame, companies: DataFrame) -> DataFrame:
    """id, ticker, confidence and asset_type for every row of assets (id, text), by companies (ticker, title).

    An explicit symbol counts most (0.99, or 0.70 where it is not known), then the same name (0.90), then names that share
    enough of their rare words (up to 0.85). A bond, cash or real estate without a symbol has no ticker. Without any match
    the ticker is null with confidence 0. Ties go to the smaller ticker.
    """
    text = spaced(F.coalesce("text", F.lit("")))
    symbols = F.concat(F.regexp_extract_all(text, F.lit(r"[(\[]\s*([A-Z][A-Z.\-]{0,6})\s*[)\]]"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?i)\bticker\s*[:\-]?\s*([a-z][a-z.\-]{0,6})\b"), F.lit(1)))
    head = strip_noise(F.element_at(F.split(text, r"[(\[\-–—,]"), 1))
    base = assets.select("id", classify_asset(text).alias("asset_type"), F.filter(F.transform(symbols, lambda s: F.regexp_replace(F.upper(s), r"^[.\-]+|[.\-]+$", "")), lambda s: ~s.isin("", *_CODES)).alias("symbols"), normalize_name(head).alias("name"))

    listed = companies.select(F.upper("ticker").alias("ticker"), normalize_name(F.col("title")).alias("title"))
    known = listed.select("ticker").distinct().withColumn("known", F.lit(True))
    given = base.select("id", F.posexplode("symbols").alias("pos", "ticker")).join(known, "ticker", "left").filter(F.col("known") | F.col("ticker").rlike(r"^[A-Z][A-Z.\-]{0,5}$"))
    explicit = given.groupBy("id").agg(F.min_by(F.struct("ticker", F.when(F.col("known"), 0.99).otherwise(0.70).alias("confidence")), "pos").alias("best")).select("id", "best.*")

    open_ = base.filter("asset_type not in ('bond', 'cash', 'real_estate') and name <> ''").join(explicit.select("id"), "id", "left_anti")
    named = open_.join(listed.filter("title <> ''").groupBy(F.col("title").alias("name")).agg(F.min("ticker").alias("ticker")), "name").select("id", "ticker", F.lit(0.90).alias("confidence"))

    mine = open_.join(named.select("id"), "id", "left_anti").select("id", _tokens(F.col("name")).alias("mine"))
    theirs = listed.select("ticker", _tokens(F.col("title")).alias("theirs"))
    index = theirs.select("ticker", "theirs", F.explode("theirs").alias("token"))
    rare = index.groupBy("token").agg(F.count_distinct("ticker").alias("df")).filter(F.col("df") <= GENERIC_FROM)
    scored = mine.select("id", "mine", F.explode("mine").alias("token")).join(rare, "token").join(index.distinct(), "token").groupBy("id", "mine", "ticker", "theirs").agg(F.sum(1 / F.sqrt("df")).alias("score"))
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "ticker"))).filter("k = 1")
    both = F.size(F.array_intersect("mine", "theirs"))
    jaccard, held = both / F.size(F.array_union("mine", "theirs")), both / F.size("theirs")
    similar = best.filter((jaccard >= 0.6) | ((held >= 1) & (F.col("score") >= 0.5))).select("id", "ticker", F.least(F.lit(0.85), 0.55 + F.greatest(jaccard, held * 0.8) * 0.35).alias("confidence"))

    found = explicit.unionByName(named).unionByName(similar)
    return base.select("id", "asset_type").join(found, "id", "left").select("id", "ticker", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "asset_type")


def match_members(filers: DataFrame, members: DataFrame, aliases: DataFrame) -> DataFrame:
    """id and member_id for every row of filers (id, name, chamber, state, district).

    An alias (alias_norm, member_id) decides at once. Otherwise the members with the same last name are narrowed by
    chamber, state and district, each only if that leaves any; the one that is left counts, or the only one whose first
    name begins alike. Anything else stays null.
    """
    keyed = filers.withColumn("key", norm_person(F.col("name")))
    direct = keyed.join(aliases.groupBy("alias_norm").agg(F.min("member_id").alias("member_id")), F.col("key") == F.col("alias_norm")).select("id", "member_id")
    rest = keyed.join(direct.select("id"), "id", "left_anti").filter("key <> ''")
    parts = F.split("key", " ")
    rest = rest.select("id", parts[0].alias("last"), F.substring(F.get(parts, F.lit(1)), 1, 3).alias("first"), "chamber", "state", "district")
    of = members.select("member_id", F.lower("last_name").alias("last"), F.lower("first_name").alias("their_first"), F.col("chamber").alias("their_chamber"), F.col("state").alias("their_state"), F.col("district").alias("their_district"))
    found = rest.join(of, "last")
    each = Window.partitionBy("id")
    for mine, theirs in (("chamber", "their_chamber"), ("state", "their_state"), ("district", "their_district")):
        fits = F.coalesce(F.upper(F.col(mine).cast("string")) == F.upper(F.col(theirs).cast("string")), F.lit(False))
        found = found.withColumn("fits", fits).withColumn("any", F.max("fits").over(each)).filter("fits or not any")
    begins = F.coalesce(F.col("their_first").startswith(F.col("first")), F.lit(False))
    one = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("member_id").alias("only"), F.count_if(begins).alias("n_first"), F.min(F.when(begins, F.col("member_id"))).alias("first_only"))
    named = one.select("id", F.when(F.col("n") == 1, F.col("only")).when(F.col("n_first") == 1, F.col("first_only")).alias("member_id"))
    return filers.select("id").join(direct.unionByName(named), "id", "left").select("id", "member_id")
