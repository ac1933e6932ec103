"""Whether there is enough to work with: flags and counts, one row per book, symbol or panel, which the caller acts on."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.sources.bars import number


def is_priced(price: Column) -> Column:
    """Whether a value is a finite number over 0; false, never null."""
    return F.coalesce(number(price) > 0, F.lit(False))


def since(values: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows of `values` (book_id, date, ...) on or after their book's anchor (book_id, anchor); books without one go."""
    return values.join(anchors.select("book_id", "anchor"), "book_id").where("date >= anchor").drop("anchor")


def empty_since(values: DataFrame, anchors: DataFrame) -> DataFrame:
    """(book_id, anchor) of the books that have no row on or after their anchor."""
    return anchors.select("book_id", "anchor").join(since(values, anchors).select("book_id").distinct(), "book_id", "left_anti").select("book_id", "anchor")


def estimable(returns: DataFrame, least_dates: int = 20) -> DataFrame:
    """(book_id, names, dates, estimable) of complete returns.

    A sample covariance of n names has full rank only with more than n dates;
    fewer than `least_dates` or than two names estimate nothing either.
    """
    counts = returns.groupBy("book_id").agg(F.count_distinct("symbol").alias("names"), F.count_distinct("date").alias("dates"))
    enough = (F.col("names") >= 2) & (F.col("dates") > F.col("names")) & (F.col("dates") >= least_dates)
    return counts.withColumn("estimable", enough)


def enough_history(rows: DataFrame, least: int, key: str = "symbol", keys: DataFrame | None = None) -> DataFrame:
    """(key, dates, enough) : whether a key has at least `least` dates.

    With `keys`, one row for each of its distinct keys, with no dates for those
    without rows; other keys are left out.
    """
    counts = rows.groupBy(key).agg(F.count_distinct("date").alias("dates"))
    if keys is not None:
        counts = keys.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("dates", F.lit(0)).alias("dates"))
    return counts.withColumn("enough", F.col("dates") >= least)


def panel_checks(bars: DataFrame, universe: DataFrame, start: str, end: str, many: int = 10_000) -> DataFrame:
    """One row (names, failed, no_names, reversed_range, no_prices, all_failed, many_names) of a universe's bars in a range of dates.

    `many_names` is a warning: over `many` names, more than one should put into one book.
    """
    inside = bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & is_priced(F.col("close")))
    names = universe.select("symbol").distinct().join(inside.select("symbol").distinct().withColumn("_p", F.lit(1)), "symbol", "left")
    counts = names.agg(F.count("*").alias("names"), (F.count("*") - F.count("_p")).alias("failed"))
    return counts.select(
        "names", "failed", (F.col("names") == 0).alias("no_names"), F.lit(date.fromisoformat(start) > date.fromisoformat(end)).alias("reversed_range"),
        (F.col("names") == F.col("failed")).alias("no_prices"), ((F.col("names") > 0) & (F.col("names") == F.col("failed"))).alias("all_failed"), (F.col("names") > many).alias("many_names"),
    )


def failed_share(bars: DataFrame, universe: DataFrame, most: float = 0.5) -> DataFrame:
    """One row (names, failed, share, too_many): the part of a universe's names without any close, and whether it is over `most`."""
    have = bars.where("close is not null").select("symbol").distinct().withColumn("_p", F.lit(1))
    counts = universe.select("symbol").distinct().join(have, "symbol", "left").agg(F.count("*").alias("names"), (F.count("*") - F.count("_p")).alias("failed"))
    share = F.when(F.col("names") > 0, F.col("failed") / F.col("names"))
    return counts.select("names", "failed", share.alias("share"), F.coalesce(share > most, F.lit(False)).alias("too_many"))


def date_back(dates: DataFrame, end: str, rows: int) -> DataFrame:
    """One row (start): the date `rows` dates of the calendar before the last one up to `end`, or its first; null without any."""
    before = dates.select("date").where(F.col("date") <= F.lit(end).cast("date")).distinct()
    ranked = before.withColumn("_back", F.row_number().over(Window.orderBy(F.desc("date"))) - 1)
    return ranked.where(F.col("_back") <= rows).agg(F.min("date").alias("start"))
