"""Feeds as files: indexes of filings, vendors' trades, prices, people, committees, lobbying, earnings and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelens.functions.scalars import first_number, geo_mid, norm_person, parse_amount, parse_date, period_dates, relative_change
from tradelens.sources.filings import direction

#: Kinds of filings by their letter in the House's index.
FILING_KINDS = {"P": "ptr", "O": "annual", "A": "amendment", "C": "candidate", "T": "termination", "B": "blind_trust", "X": "extension", "D": "annual"}
_PRICES = ["ticker", "date", "open", "high", "low", "close", "adj_close", "volume"]


def _field(row: Column, *names: str) -> Column:
    """The first of the fields of a map that isn't empty."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(row, F.lit(n))), F.lit("")) for n in names])


def filing_index(spark: SparkSession, path: str) -> DataFrame:
    """The House's yearly index (XML, a Member element for each filing)."""
    schema = "Prefix string, Last string, First string, Suffix string, FilingType string, StateDst string, Year int, FilingDate string, DocID string"
    raw = spark.read.format("xml").option("rowTag", "Member").schema(schema).load(path).filter("DocID is not null")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FILING_KINDS.items() for x in kv]), F.col("FilingType")), F.lit("other"))
    name = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in ("Prefix", "First", "Last", "Suffix")])
    return raw.select(F.concat(F.lit("house:"), "DocID").alias("filing_id"), F.col("DocID").alias("doc_id"), name.alias("filer_name_raw"), kind.alias("filing_type"), F.substring("StateDst", 1, 2).alias("state"), F.regexp_replace(F.substring("StateDst", 3, 2), "^0+", "").alias("district"), F.col("Year").alias("filing_year"), parse_date(F.col("FilingDate")).alias("filed_date"))


def search_rows(rows: DataFrame) -> DataFrame:
    """The Senate's search results (first, last, office, link, filed) as filings; the link tells id and kind."""
    doc = F.regexp_extract("link", r"/search/view/(\w+)/([0-9A-Za-z-]+)/", 2)
    return rows.filter(doc != "").select(F.concat(F.lit("senate:"), doc).alias("filing_id"), doc.alias("doc_id"), F.regexp_extract("link", r"/search/view/(\w+)/", 1).alias("filing_type"), F.concat_ws(" ", "first", "last").alias("filer_name_raw"), parse_date(F.col("filed")).alias("filed_date"))


def unread(index: DataFrame, known: DataFrame, budget: int | None = None) -> DataFrame:
    """Filings of index that known (doc_id) lacks, the newest first; a run takes budget of them."""
    todo = index.join(known.select("doc_id"), "doc_id", "left_anti").orderBy(F.desc("filing_year"), F.desc("filed_date"), "doc_id")
    return todo if budget is None else todo.limit(budget)


def vendor_trades(rows: DataFrame) -> DataFrame:
    """Vendors' rows (json: text) in one form, whatever their fields are called; rows without a date are left out."""
    r = F.from_json("json", "map<string,string>")
    kind = F.lower(F.coalesce(_field(F.col("r"), "type", "transactionType", "Transaction"), F.lit("")))
    buys, sells = kind.contains("purchase") | kind.isin("p", "buy"), kind.contains("sale") | kind.isin("s", "sell")
    sold = F.when(kind.contains("partial"), "sell_partial").when(kind.contains("full"), "sell_full").otherwise("sell")
    named = F.when(buys, "buy").when(sells, sold).when(kind.contains("exchange"), "exchange").otherwise("other")
    amount = parse_amount(_field(F.col("r"), "amount", "range", "Range"))
    low, high = (first_number(_field(F.col("r"), *x)) for x in (("amountFrom", "low"), ("amountTo", "high")))
    person = F.coalesce(_field(F.col("r"), "name", "representative", "Representative"), F.nullif(F.trim(F.concat_ws(" ", _field(F.col("r"), "firstName"), _field(F.col("r"), "lastName"))), F.lit("")))
    out = rows.select(r.alias("r"), "json").select(
        F.upper(_field(F.col("r"), "symbol", "ticker", "Ticker")).alias("ticker"), F.coalesce(_field(F.col("r"), "assetDescription", "asset_description", "assetName", "Company", "symbol"), F.lit("")).alias("asset_name_raw"),
        parse_date(_field(F.col("r"), "transactionDate", "transaction_date", "TransactionDate", "date")).alias("transaction_date"), parse_date(_field(F.col("r"), "filingDate", "disclosureDate", "dateRecieved", "Filed")).alias("filed_date"),
        F.lower(F.coalesce(_field(F.col("r"), "owner"), F.lit("self"))).alias("owner"), named.alias("txn_type"), direction(named).alias("direction"),
        F.coalesce(amount["low"], low).alias("amount_low"), F.coalesce(amount["high"], high).alias("amount_high"), F.coalesce(amount["est"], geo_mid(low, high)).alias("amount_est"),
        person.alias("member_name"), F.lower(_field(F.col("r"), "chamber", "Chamber")).alias("chamber"), F.col("json").alias("raw"),
    )
    return out.filter("transaction_date is not null")


def price_csv(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """Daily prices from CSV (Date, Open, High, Low, Close, Volume); rows that don't fit are left out."""
    raw = spark.read.csv(path, header=True, mode="DROPMALFORMED", schema="Date date, Open double, High double, Low double, Close double, Volume double")
    return raw.filter("Date is not null and Close is not null").select(F.lit(ticker.upper()).alias("ticker"), F.col("Date").alias("date"), F.col("Open").alias("open"), F.col("High").alias("high"), F.col("Low").alias("low"), F.col("Close").alias("close"), F.col("Close").alias("adj_close"), F.col("Volume").alias("volume"))


def price_chart(rows: DataFrame) -> DataFrame:
    """Daily prices from charts of parallel arrays (ticker, json); days without a close are left out."""
    arrays = "array<double>"
    schema = f"chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:{arrays},high:{arrays},low:{arrays},close:{arrays},volume:{arrays}>>,adjclose:array<struct<adjclose:{arrays}>>>>>>"
    one = F.get(F.from_json("json", schema)["chart"]["result"], F.lit(0))
    quote = F.get(F.col("c.indicators.quote"), F.lit(0))
    adjusted = F.get(F.col("c.indicators.adjclose"), F.lit(0))["adjclose"]
    days = F.arrays_zip(F.col("c.timestamp").alias("t"), *[quote[x].alias(x) for x in ("open", "high", "low", "close", "volume")], adjusted.alias("adj"))
    each = rows.select("ticker", one.alias("c")).filter("c is not null").select("ticker", F.explode(days).alias("d")).filter("d.close is not null")
    return each.select(F.upper("ticker").alias("ticker"), F.to_date(F.timestamp_seconds("d.t")).alias("date"), "d.open", "d.high", "d.low", "d.close", F.coalesce("d.adj", "d.close").alias("adj_close"), "d.volume").select(*_PRICES)


def price_history(rows: DataFrame) -> DataFrame:
    """Daily prices from a list of days (ticker, json: {"historical": [...]})."""
    schema = "historical array<struct<date:string,open:double,high:double,low:double,close:double,adjClose:double,volume:double>>"
    each = rows.select("ticker", F.explode(F.from_json("json", schema)["historical"]).alias("d")).filter("d.close is not null")
    return each.select(F.upper("ticker").alias("ticker"), parse_date(F.col("d.date")).alias("date"), "d.open", "d.high", "d.low", "d.close", F.coalesce("d.adjClose", "d.close").alias("adj_close"), "d.volume").filter("date is not null")


def first_provider(feeds: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all feeds by key, from the first feed that has the key; provider is its place."""
    both = reduce(lambda a, b: a.unionByName(b), [df.withColumn("provider", F.lit(k)) for k, df in enumerate(feeds)])
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*["provider", *[c for c in rest if c != "provider"]])).alias("best"))
    return best.select(*keys, "best.*")


def fetch_order(benchmark: str, universe: DataFrame, trades: DataFrame) -> DataFrame:
    """Tickers in the order in which prices are fetched: the benchmark, the universe by rank, then by number of trades."""
    spark = trades.sparkSession
    first = spark.createDataFrame([(benchmark, 0, 0)], "ticker string, kind int, place long")
    listed = universe.select("ticker", F.lit(1).alias("kind"), F.col("rank").cast("long").alias("place"))
    traded = trades.filter("ticker is not null and ticker_confidence >= 0.6").groupBy("ticker").agg(F.lit(2).alias("kind"), (-F.count(F.lit(1))).alias("place"))
    return first.unionByName(listed).unionByName(traded).groupBy("ticker").agg(F.min(F.struct("kind", "place")).alias("at")).orderBy("at.kind", "at.place", "ticker").select("ticker")


def fetch_status(fetched: DataFrame, attempted: int, benchmark: str) -> DataFrame:
    """One row: ok, FAILED or DEGRADED by the rows (ticker) that came; nothing to fetch is ok."""
    n = fetched.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.count_if(F.col("ticker") == benchmark).alias("n_benchmark"))
    status = F.when(F.lit(attempted == 0), "ok").when((F.col("n_benchmark") == 0) | (F.col("n_rows") == 0), "FAILED").when(F.col("n_tickers") < max(3, attempted * 0.2), "DEGRADED").otherwise("ok")
    return n.select(status.alias("status"), "n_rows", "n_tickers")


def legislators(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Members by their last term, and their aliases (alias_norm, member_id)."""
    schema = "id struct<bioguide:string>, name struct<first:string,last:string,nickname:string,official_full:string>, terms array<struct<type:string,start:date,end:date,state:string,district:int,party:string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).filter("id.bioguide is not null and size(terms) > 0").withColumn("t", F.try_element_at("terms", F.lit(-1)))
    full = F.coalesce("name.official_full", F.concat_ws(" ", "name.first", "name.last"))
    members = raw.select(F.col("id.bioguide").alias("member_id"), full.alias("full_name"), F.col("name.first").alias("first_name"), F.col("name.last").alias("last_name"), F.when(F.col("t.type") == "sen", "senate").otherwise("house").alias("chamber"), F.col("t.party").alias("party"), F.col("t.state").alias("state"), F.col("t.district").cast("string").alias("district"), F.col("t.start").alias("term_start"), F.col("t.end").alias("term_end"))
    names = F.array(full, F.concat_ws(" ", "name.first", "name.last"), F.concat_ws(" ", "name.nickname", "name.last"))
    aliases = raw.select(F.col("id.bioguide").alias("member_id"), F.explode(F.array_distinct(F.transform(names, norm_person))).alias("alias_norm")).filter("alias_norm <> ''")
    return members, aliases.groupBy("alias_norm").agg(F.min("member_id").alias("member_id"))


def committees(spark: SparkSession, committees_path: str, membership_path: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Committees with their sub-committees, and memberships of known members in them; a rank without one is its place."""
    raw = spark.read.schema("thomas_id string, name string, type string, subcommittees array<struct<thomas_id:string,name:string>>").json(committees_path, multiLine=True)
    own = raw.select(F.col("thomas_id").alias("committee_id"), "name", F.lit(None).cast("string").alias("parent_id"))
    sub = raw.select(F.col("thomas_id").alias("parent_id"), F.explode("subcommittees").alias("s")).select(F.concat("parent_id", "s.thomas_id").alias("committee_id"), "s.name", "parent_id")
    both = own.unionByName(sub)
    held = spark.read.text(membership_path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<struct<bioguide:string,title:string,rank:int>>>")).alias("committee_id", "people"))
    each = held.select("committee_id", F.posexplode("people").alias("at", "p")).select(F.col("p.bioguide").alias("member_id"), "committee_id", F.coalesce("p.title", F.lit("Member")).alias("role"), F.coalesce("p.rank", F.col("at") + 1).alias("rank"))
    return both, each.join(members.select("member_id"), "member_id", "left_semi").join(both.select("committee_id"), "committee_id", "left_semi")


def executives(spark: SparkSession, path: str) -> DataFrame:
    """Officials (name, role) of a list with an id made of their names."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-|-$", "")
    return spark.read.schema("name string, role string, party string").json(path, multiLine=True).filter("name is not null").select(F.concat(F.lit("exec-"), slug).alias("member_id"), F.col("name").alias("full_name"), F.lit("executive").alias("chamber"), "role", "party")


def lobbying(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lobbying filings and their activities by entity, from pages' rows (json); the amount is the first of income and expenses."""
    schema = "filing_uuid string, filing_year int, filing_period string, filing_type string, dt_posted string, income string, expenses string, registrant struct<name:string>, client struct<id:string,name:string>, lobbying_activities array<struct<general_issue_code:string,description:string,government_entities:array<struct<name:string>>>>"
    raw = rows.select(F.from_json("json", schema).alias("r")).select("r.*").filter("filing_uuid is not null").dropDuplicates(["filing_uuid"])
    real = lambda c: F.nullif(F.col(c), F.lit("0.00"))
    period = period_dates(F.col("filing_period"), F.col("filing_year"))
    filings = raw.select("filing_uuid", "filing_year", "filing_period", "filing_type", F.to_date(F.substring("dt_posted", 1, 10)).alias("dt_posted"), period["start"].alias("period_start"), period["end"].alias("period_end"), F.col("registrant.name").alias("registrant_name"), F.col("client.name").alias("client_name"), F.col("client.id").alias("client_id"), first_number(real("income"), real("expenses")).alias("amount"))
    each = raw.select("filing_uuid", F.explode("lobbying_activities").alias("a")).select("filing_uuid", F.col("a.general_issue_code").alias("issue_code"), F.col("a.description").alias("description"), F.explode_outer("a.government_entities.name").alias("entity"))
    return filings, each.distinct()


def earnings(rows: DataFrame) -> DataFrame:
    """Reports from rows (ticker, json: a list of objects) of any of the providers' spellings, with their surprises."""
    r = F.explode(F.from_json("json", "array<map<string,string>>"))
    get = lambda *n: _field(F.col("r"), *n)
    actual, expected = first_number(get("eps", "actual", "epsActual")), first_number(get("epsEstimated", "estimate", "consensusForecast"))
    revenue, forecast = first_number(get("revenue")), first_number(get("revenueEstimated"))
    out = rows.select("ticker", r.alias("r")).select("ticker", parse_date(get("date", "period", "dateReported")).alias("report_date"), get("fiscalDateEnding", "fiscalQtrEnd", "period").alias("fiscal_period"), actual.alias("eps_actual"), expected.alias("eps_estimate"), relative_change(actual, expected).alias("surprise_pct"), relative_change(revenue, forecast).alias("rev_surprise_pct"), F.coalesce(get("time"), F.lit("unknown")).alias("time_of_day"))
    return out.filter("report_date is not null")


def theme_timeline(rows: DataFrame) -> DataFrame:
    """theme, date, intensity from timelines (theme, json: {"timeline": [{"data": [{"date", "value"}]}]})."""
    data = F.get(F.from_json("json", "timeline array<struct<data:array<struct<date:string,value:double>>>>")["timeline"], F.lit(0))["data"]
    return rows.select("theme", F.explode(data).alias("d")).select("theme", F.to_date(F.substring("d.date", 1, 8), "yyyyMMdd").alias("date"), F.col("d.value").alias("intensity")).filter("date is not null and intensity is not null")


def sector_labels(rows: DataFrame) -> DataFrame:
    """ticker, sector, industry from profiles (ticker, json: a list of one)."""
    p = F.get(F.from_json("json", "array<struct<sector:string,industry:string>>"), F.lit(0))
    return rows.select(F.upper("ticker").alias("ticker"), p["sector"].alias("sector"), p["industry"].alias("industry")).filter("sector is not null")


def ticker_map(rows: DataFrame) -> DataFrame:
    """ticker, title from a map of numbers to companies (json)."""
    return rows.select(F.explode(F.map_values(F.from_json("json", "map<string,struct<ticker:string,title:string>>"))).alias("c")).select(F.upper("c.ticker").alias("ticker"), "c.title").filter("ticker is not null").distinct()
