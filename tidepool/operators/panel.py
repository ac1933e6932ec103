"""Which symbols a panel has, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.series import last_rows, series


def panel_summary(bars: DataFrame) -> DataFrame:
    """One row: days, first and last date, symbols, and symbols on the last date."""
    last = bars.agg(F.max("date").alias("_last"))
    return bars.join(F.broadcast(last)).agg(
        F.count_distinct("date").alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_distinct("symbol").alias("symbols"), F.count_distinct(F.when(F.col("date") == F.col("_last"), F.col("symbol"))).alias("in_latest"),
    )


def missing_symbols(bars: DataFrame, universe: DataFrame, stale: int = 5) -> DataFrame:
    """(symbol, reason) of names of the universe that have no column, no value, or none in the last `stale` dates."""
    dates = bars.select("date").distinct().withColumn("_back", F.row_number().over(Window.orderBy(F.desc("date"))) - 1)
    last = bars.join(dates, "date").groupBy("symbol").agg(F.min(F.when(F.col("close").isNotNull(), F.col("_back"))).alias("_age"), F.count("*").alias("_rows"))
    reason = F.when(F.col("_rows").isNull(), F.lit("absent")).when(F.col("_age").isNull(), F.lit("empty")).when(F.col("_age") > stale, F.lit("stale"))
    return universe.select("symbol").distinct().join(last, "symbol", "left").select("symbol", reason.alias("reason")).where("reason is not null")


def symbols_with_prices(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """(pos, symbol, priced) for each name of the universe (pos, symbol)."""
    priced = bars.where("close is not null").select("symbol").distinct().withColumn("_p", F.lit(True))
    return universe.join(priced, "symbol", "left").select("pos", "symbol", F.coalesce("_p", F.lit(False)).alias("priced"))


def unpriced_holdings(holdings: DataFrame, bars: DataFrame) -> DataFrame:
    """(book_id, symbol) that are held, but have no price at all."""
    return holdings.where("units > 0").select("book_id", "symbol").join(bars.where("close is not null").select("symbol").distinct(), "symbol", "left_anti").select("book_id", "symbol")


def compose_index(*lists: DataFrame) -> DataFrame:
    """(pos, symbol) of several lists (pos, symbol) one after the other; a symbol keeps its first place.

    The distinct symbols are numbered in one task: an index has thousands.
    """
    all_ = None
    for k, one in enumerate(lists):
        part = one.select(F.struct(F.lit(k).alias("list"), F.col("pos")).alias("_at"), "symbol")
        all_ = part if all_ is None else all_.unionByName(part)
    first = all_.groupBy("symbol").agg(F.min("_at").alias("_at"))
    return first.select((F.row_number().over(Window.orderBy("_at", "symbol")) - 1).alias("pos"), "symbol")


def largest_k(weights: DataFrame, k: int = 5) -> DataFrame:
    """The k largest weights of each book with their rank; Spark keeps k rows a task before the shuffle."""
    order = Window.partitionBy("book_id").orderBy(F.desc("weight"), "symbol")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def percentile_in_group(rows: DataFrame, column: str, name: str, *keys: str) -> DataFrame:
    """Average-tie rank over the count, from -1 to 1; null values and groups of one score 0."""
    x = F.col(column)
    have = F.count(x).over(Window.partitionBy(*keys))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(x.asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / 2
    return rows.withColumn(name, F.when(x.isNull() | (have <= 1), F.lit(0.0)).otherwise(2 * rank / have - 1))


def rank_in_trailing_window(rows: DataFrame, column: str, name: str, n: int = 10) -> DataFrame:
    """The share of a symbol's last n values that are not above the current one; 0.5 for a first row."""
    w = last_rows(series("symbol"), n)
    seen = F.collect_list(column).over(w)
    share = F.size(F.filter(seen, lambda x: x <= F.col(column))) / F.size(seen)
    return rows.withColumn(name, F.when(F.count(column).over(w) <= 1, F.lit(0.5)).otherwise(share))


def transitions(rows: DataFrame, label: str) -> DataFrame:
    """(symbol, changes): how often a symbol's label differs from its last one."""
    before = F.lag(label).over(series("symbol"))
    return rows.withColumn("_c", F.when(F.col(label) != before, 1).otherwise(0)).groupBy("symbol").agg(F.sum("_c").alias("changes"))
