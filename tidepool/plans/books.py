"""From bars to a sized book, for any number of books in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.allocation import cap_weights, equal_risk_contributions, hierarchical_risk_parity, inverse_variance, select_top, size_positions
from tidepool.operators.asof import book_at, pair_moments_by_date, prices_at
from tidepool.operators.calendar import align_to, resample_weekly
from tidepool.operators.diagnostics import book_stats
from tidepool.operators.returns import coverage, complete_cases, pair_moments, returns_matrix, returns_of, tail_dates
from tidepool.sources.scratch import materialise


def book_prices(bars: DataFrame, book: str | Column = "all", fill: bool = False) -> DataFrame:
    """(book_id, symbol, date, close) of weekly bars, all symbols in one book or in books by a column; with `fill`, on all weeks, gaps carried over."""
    weekly = resample_weekly(bars).select("symbol", F.col("week").alias("date"), "close")
    if fill:
        weekly = align_to(weekly, weekly, ["close"])
    return weekly.select((F.lit(book) if isinstance(book, str) else book).alias("book_id"), "symbol", "date", "close")


def last_prices(prices: DataFrame) -> DataFrame:
    return prices.groupBy("symbol").agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("price"))


def inverse_variance_book(prices: DataFrame, names: int = 10, cap: float = 0.12, capital: float = 100_000.0, lookback: int = 252, least: float = 0.8) -> DataFrame:
    """A capped, sized inverse-variance book of each book_id's prices."""
    prices = materialise(prices)
    pairs = materialise(pair_moments(materialise(returns_matrix(prices, lookback, least))))
    weights = cap_weights(select_top(inverse_variance(pairs), names), cap)
    return size_positions(weights, last_prices(prices), capital)


#: The weights of a book from its pairs of names.
METHODS = {
    "equal": lambda pairs: pairs.where("si = sj").select("book_id", F.col("si").alias("symbol"), (1 / F.count("*").over(Window.partitionBy("book_id"))).alias("weight")),
    "inverse_variance": inverse_variance,
    "equal_risk": equal_risk_contributions,
    "hierarchical": hierarchical_risk_parity,
}


def books_by_method(prices: DataFrame, names: int = 10, cap: float = 0.12, capital: float = 100_000.0, lookback: int = 252, least: float = 0.8) -> DataFrame:
    """A capped, sized book of each book_id by each method: one estimate of the pairs serves all."""
    prices = materialise(prices)
    pairs = materialise(pair_moments(materialise(returns_matrix(prices, lookback, least))))
    weights = None
    for method, solve in METHODS.items():
        own = solve(pairs).select(F.concat_ws("/", "book_id", F.lit(method)).alias("book_id"), "symbol", "weight")
        weights = own if weights is None else weights.unionByName(own)
    return size_positions(cap_weights(select_top(weights, names), cap), last_prices(prices), capital)


def books_by_date(
    prices: DataFrame, as_of: DataFrame, method: str = "inverse_variance", names: int = 10, cap: float = 0.12, capital: float = 100_000.0, lookback: int = 252, least: float = 0.8
) -> DataFrame:
    """(book_id, as_of, symbol, price, weight, units, value): each book of `prices` on each date of `as_of` (book_id, as_of), by what was known then.

    All dates share one estimate by segments; each is a book of its own to the
    method.  Dates before a book has an estimate have no rows.
    """
    prices, as_of = materialise(prices), materialise(as_of)
    pairs, _ = pair_moments_by_date(prices, as_of, lookback, least)
    pairs = materialise(pairs.select(book_at().alias("book_id"), "si", "sj", "n", "cov", "corr"))
    weights = cap_weights(select_top(METHODS[method](pairs), names), cap)
    at = prices_at(prices, as_of).select(book_at().alias("book_id"), "symbol", "price")
    dates = as_of.select(book_at().alias("_at"), "book_id", "as_of").distinct()
    sized = size_positions(weights, at, capital).withColumnRenamed("book_id", "_at")
    return sized.join(dates, "_at").select("book_id", "as_of", "symbol", "price", "weight", "units", "value")


def audited_book(
    prices: DataFrame, method: str = "inverse_variance", names: int = 10, cap: float = 0.12, capital: float = 100_000.0, lookback: int = 252, least: float = 0.8, periods: int = 252
) -> tuple[DataFrame, DataFrame]:
    """(book, stats): a sized book of each book_id, and one row of figures for each from the stages that made it."""
    prices = materialise(prices)
    recent = materialise(tail_dates(returns_of(prices), lookback))
    covered = materialise(coverage(recent, least))
    pairs = materialise(pair_moments(materialise(complete_cases(recent, covered))))
    solved = materialise(METHODS[method](pairs))
    book = materialise(size_positions(cap_weights(select_top(solved, names), cap), last_prices(prices), capital))
    return book, book_stats(prices, covered, pairs, solved, book, names, cap, capital, periods)
