"""Exchange notices: titles to symbols, schedules and state, and the notice in force at a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words and forms of the exchange's titles, and the days that its rules name.
ENDS = "거래지원 종료"
CANCELLED = ["종료 결정 철회", "종료 철회", "종료 취소", "결정 취소"]
TRANSFERS = ["출금", "입금"]
SCHEDULE = r"\d{1,2}/\d{1,2}\s+\d{1,2}:\d{2}"
SYMBOL = r"\(([A-Z0-9][A-Z0-9.\-]{0,19})\)"
MARKETS = r"(KRW|BTC|USDT)(?:\s*,\s*(?:KRW|BTC|USDT))*\s*마켓"
HOME = "KRW"
UNDATED_DAYS, PAST_DAYS, FUTURE_DAYS = 45, 30, 300


def last_schedule(title: Column) -> Column:
    """The last `M/D h:m` that can be the end: not one with `~` behind it, which starts something, and not one whose nearest
    word before it is of transfers rather than of the end. Null without any."""
    pieces = F.split(title, rf"(?<!\d)(?={SCHEDULE})")
    places = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
    found = F.transform(places, lambda k: F.struct(F.get(pieces, k).alias("piece"), F.array_join(F.slice(pieces, F.lit(1), k), "").alias("before")))
    of_transfers = rf"(?s)({'|'.join(TRANSFERS)})(?!.*{ENDS})"
    good = F.filter(found, lambda x: ~x["piece"].rlike(rf"^{SCHEDULE}\s*~") & ~x["before"].rlike(of_transfers))
    return F.regexp_extract(F.get(good, F.size(good) - 1)["piece"], f"^{SCHEDULE}", 0)


def parsed(notices: DataFrame) -> DataFrame:
    """One row a symbol of each notice (title, listed_at) of an end of trading: symbol, title, listed_at, ends_at, cancelled, and
    undated_until. Titles of other things, without symbols, or for other markets only have no rows.

    Titles name no year: it is that of the listing, the next one for an end over 30 days before it, the last one for an end over 300
    days after it. A notice that cancels has no end; one without a schedule, or whose schedule is no date, holds for 45 days.
    """
    symbols = F.array_distinct(F.regexp_extract_all(F.substring_index("title", ENDS, 1), F.lit(SYMBOL), 1))
    markets = F.regexp_extract("title", MARKETS, 0)
    own = notices.withColumn("symbols", symbols).where(F.col("title").contains(ENDS) & (F.size("symbols") > 0) & ((markets == "") | markets.contains(HOME)))
    numbers = F.transform(F.regexp_extract_all(last_schedule(F.col("title")), F.lit(r"\d+"), 0), lambda x: x.cast("int"))
    at = lambda year: F.try_make_timestamp(year, F.get("numbers", 0), F.get("numbers", 1), F.get("numbers", 2), F.get("numbers", 3), F.lit(0))
    year, listed = F.year("listed_at"), F.col("listed_at")
    days = lambda n: F.make_dt_interval(days=F.lit(n))
    ends = F.when(at(year) < listed - days(PAST_DAYS), at(year + 1)).when(at(year) > listed + days(FUTURE_DAYS), at(year - 1)).otherwise(at(year))
    out = own.withColumns({"numbers": numbers, "cancelled": F.col("title").rlike("|".join(CANCELLED))}).withColumn("ends_at", F.when(~F.col("cancelled"), ends))
    undated = F.when(~F.col("cancelled") & F.col("ends_at").isNull(), listed + days(UNDATED_DAYS))
    return out.select(F.explode("symbols").alias("symbol"), "title", "listed_at", "ends_at", "cancelled", undated.alias("undated_until"))


def in_force(candidates: DataFrame, parsed_: DataFrame) -> DataFrame:
    """candidates (symbol, decided_at) with active: whether the latest notice listed until then holds (of several at one instant, the
    one that ends last). One sort of both sides by symbol and time; no notice meets a candidate but the one that decides."""
    until = F.coalesce("ends_at", "undated_until")
    a = parsed_.select("symbol", F.col("listed_at").alias("at"), F.lit(0).alias("kind"), F.struct(until.alias("until")).alias("notice"), *[F.lit(None).cast(t).alias(c) for c, t in candidates.dtypes if c != "symbol"])
    b = candidates.select("symbol", F.col("decided_at").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(dict(a.dtypes)["notice"]).alias("notice"), *[c for c in candidates.columns if c != "symbol"])
    w = Window.partitionBy("symbol").orderBy("at", "kind", F.asc_nulls_first("notice.until")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("last", F.last("notice", ignorenulls=True).over(w)).where("kind = 1")
    return both.select(*candidates.columns, F.coalesce(F.col("last.until") > F.col("decided_at"), F.lit(False)).alias("active"))
