"""Bars on shared calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.series import ffill, ffill_bounded, series


def week_label(date: Column) -> Column:
    """The Friday that ends a date's week."""
    return F.next_day(F.date_sub(date, 1), "FRI")


def resample_weekly(bars: DataFrame) -> DataFrame:
    """Weekly bars: first open, highest high, lowest low, last close and volume; weeks with a null in any go."""
    first = F.min_by("open", F.when(F.col("open").isNotNull(), F.col("date")))
    last = F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date")))
    return bars.groupBy("symbol", week_label(F.col("date")).alias("week")).agg(
        first.alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last.alias("close"), F.sum("volume").alias("volume")
    ).dropna()


def calendar_of(bars: DataFrame) -> DataFrame:
    return bars.select("date").distinct()


def warmup_skip(panel: DataFrame, bars: int = 200) -> DataFrame:
    """The panel without the first `bars` dates of its own calendar.

    Only the distinct dates, a few thousand, are ranked in one task.
    """
    ranked = calendar_of(panel).withColumn("_n", F.row_number().over(Window.orderBy("date")))
    return panel.join(ranked.where(F.col("_n") > bars).select("date"), "date", "left_semi")


def every_date(symbols: DataFrame, dates: DataFrame) -> DataFrame:
    """Each symbol with each date.

    Dates are days, a few hundred a year whatever the number of rows, so their
    side is broadcast; the result is as large as the aligned panel itself.
    """
    return symbols.crossJoin(F.broadcast(dates))


def align_calendar(rows: DataFrame, columns: list[str], limit: int = 5) -> DataFrame:
    """Every symbol on every date of the calendar, each column carried over at most `limit` rows of a gap."""
    grid = every_date(rows.select("symbol").distinct(), calendar_of(rows))
    w = series("symbol")
    return grid.join(rows, ["symbol", "date"], "left").select("symbol", "date", *[ffill_bounded(F.col(c), w, limit).alias(c) for c in columns])


def fill_report(rows: DataFrame, filled: DataFrame, column: str) -> DataFrame:
    """(symbol, original, repaired): values that were there, and values that filling added."""
    both = filled.select("symbol", "date", F.col(column).alias("after")).join(rows.select("symbol", "date", F.col(column).alias("before")), ["symbol", "date"], "left")
    return both.groupBy("symbol").agg(F.count("before").alias("original"), F.sum(F.when(F.col("before").isNull() & F.col("after").isNotNull(), 1).otherwise(0)).alias("repaired"))


def weekly_onto_daily(daily: DataFrame, weekly: DataFrame, columns: list[str]) -> DataFrame:
    """Weekly values from their Friday on; a week whose Friday has no daily row is lost, so nothing is known early."""
    labelled = weekly.select("symbol", F.col("week").alias("date"), *columns)
    w = series("symbol")
    return daily.join(labelled, ["symbol", "date"], "left").select(*daily.columns, *[ffill(F.col(c), w).alias(c) for c in columns])


def align_to(prices: DataFrame, dates: DataFrame, columns: list[str]) -> DataFrame:
    """Prices on another calendar's dates, gaps filled with the last price on such a date."""
    grid = every_date(prices.select("symbol").distinct(), dates.select("date").distinct())
    w = series("symbol")
    return grid.join(prices, ["symbol", "date"], "left").select("symbol", "date", *[ffill(F.col(c), w).alias(c) for c in columns])


def fill_holes(batch: DataFrame, recovered: DataFrame, columns: list[str]) -> DataFrame:
    """`batch` with nulls filled, and absent symbols added, from a second source, on the batch's dates."""
    dates = batch.select("date").distinct()
    second = recovered.join(dates, "date", "left_semi").select("symbol", "date", *[F.col(c).alias(f"_{c}") for c in columns])
    return batch.join(second, ["symbol", "date"], "full").select("symbol", "date", *[F.coalesce(c, f"_{c}").alias(c) for c in columns])
