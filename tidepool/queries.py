"""The registered queries of the market operators, and their SQL.

Symbols are the 25 brands of the line items, or brand and supplier nation for
many short series with gaps.  Ratios are rounded to six decimals on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidepool.functions.series import (
    drawdown, ffill, moving_average, moving_std, pct_change, rebase, rolling_slope, rolling_zscore, series, with_ewm, with_rsi,
)
from tidepool.operators import allocation, calendar, checks, diagnostics, panel, performance, profile, returns
from tidepool.plans.books import audited_book, book_prices, books_by_date, books_by_method, inverse_variance_book, last_prices
from tidepool.sources.bars import benchmark_series, daily_bars, load_bars, panel_from_wide
from tidepool.sources.scratch import materialise, shared_folder
from tidepool.sources.snapshots import read_snapshots, write_snapshots
from tidepool.streaming.bars import event_bars

Query = Callable[[SparkSession, str], DataFrame]


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def _w() -> WindowSpec:
    return series("symbol")


def _series_query(**named: Callable[[WindowSpec], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = daily_bars(spark, sf_dir).select("symbol", "date", *[f(_w()).alias(n) for n, f in named.items()])
        return _round(rows, *named)

    return query


def flagship_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sized inverse-variance book of the brands, from weekly bars."""
    return _round(inverse_variance_book(book_prices(daily_bars(spark, sf_dir), fill=True), least=0.3), "price", "weight", "value")


def q_daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(daily_bars(spark, sf_dir, by_nation=True), "open", "high", "low", "close")


def q_load_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily_bars(spark, sf_dir)
    # every fifth volume is no number, so that its row goes
    volume = F.when(F.pmod(F.col("volume"), F.lit(5)) == 0, F.lit("n/a")).otherwise(F.col("volume").cast("string"))
    rows = load_bars(bars.withColumn("volume", volume))
    return _round(rows, "open", "high", "low", "close")


def q_resample_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(calendar.resample_weekly(daily_bars(spark, sf_dir, by_nation=True)), "open", "high", "low", "close")


def q_ewm_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_ewm(daily_bars(spark, sf_dir).select("symbol", "date", "close"), ["symbol"], {"ema9": ("close", 0.2), "ema21": ("close", 2 / 22)})
    return _round(rows.drop("close"), "ema9", "ema21")


def q_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(with_rsi(daily_bars(spark, sf_dir).select("symbol", "date", "close"), ["symbol"]).drop("close"), "rsi")


def q_align_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_bars(spark, sf_dir, by_nation=True).select("symbol", "date", "close", "volume")
    return _round(calendar.align_calendar(rows, ["close", "volume"]), "close")


def q_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_bars(spark, sf_dir, by_nation=True).select("symbol", "date", "close")
    return calendar.fill_report(rows, calendar.align_calendar(rows, ["close"]), "close")


def q_weekly_onto_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily_bars(spark, sf_dir, by_nation=True)
    weekly = calendar.resample_weekly(bars).select("symbol", "week", F.col("close").alias("weekly_close"))
    return _round(calendar.weekly_onto_daily(bars.select("symbol", "date"), weekly, ["weekly_close"]), "weekly_close")


def q_warmup_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.warmup_skip(daily_bars(spark, sf_dir).select("symbol", "date", "volume"), 200)


def q_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily_bars(spark, sf_dir, by_nation=True)
    grid = calendar.every_date(bars.select("symbol").distinct(), calendar.calendar_of(bars)).join(bars.select("symbol", "date", "close"), ["symbol", "date"], "left")
    return _round(grid.select("symbol", "date", ffill(F.col("close"), _w()).alias("close")), "close")


def _weekly_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(book_prices(daily_bars(spark, sf_dir)))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(returns.pair_moments(materialise(returns.returns_matrix(_weekly_book(spark, sf_dir), least=0.3))))


def _nation_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book for each supplier's nation, gaps carried over."""
    return book_prices(daily_bars(spark, sf_dir, by_nation=True), F.split("symbol", "[|]")[1], fill=True)


def _nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(returns.pair_moments(materialise(returns.returns_matrix(materialise(_nation_prices(spark, sf_dir)), least=0.3))))


def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = book_prices(daily_bars(spark, sf_dir, by_nation=True))
    return _round(returns.coverage(returns.tail_dates(returns.returns_of(prices, pad=False), 252)), "coverage")


def q_returns_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(returns.returns_matrix(_weekly_book(spark, sf_dir), least=0.3), "r", places=9)


def q_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_pairs(spark, sf_dir).drop("sq", "iij", "ijj"), "cov", "corr", places=9)


def q_shrunk_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(returns.shrunk_covariance(_pairs(spark, sf_dir)), "shrinkage", "cov", places=8)


def q_correlation_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(returns.correlation_distance(_pairs(spark, sf_dir)), "dist")


def q_inverse_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(allocation.inverse_variance(_pairs(spark, sf_dir)), "weight")


def q_equal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(allocation.equal_weights(_weekly_book(spark, sf_dir)), "weight")


def q_risk_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _weekly_book(spark, sf_dir)
    return _round(allocation.risk_contributions(_pairs(spark, sf_dir), allocation.equal_weights(prices)), "share")


def q_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = returns.rank_z(returns.momentum(_weekly_book(spark, sf_dir)), "momentum")
    return _round(rows, "momentum", "z")


def q_momentum_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _weekly_book(spark, sf_dir)
    z = returns.rank_z(returns.momentum(prices), "momentum")
    return _round(allocation.momentum_tilt(allocation.equal_weights(prices), z), "weight")


def q_cap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(allocation.cap_weights(allocation.inverse_variance(_pairs(spark, sf_dir)), 0.041), "weight")


def q_erc_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the shrunk covariances of one book a nation."""
    return _round(allocation.equal_risk_contributions(returns.shrunk_covariance(_nation_pairs(spark, sf_dir))), "weight")


def q_erc_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variance parts of the equal-risk book: all the same."""
    pairs = _pairs(spark, sf_dir)
    return _round(allocation.risk_contributions(pairs, materialise(allocation.equal_risk_contributions(pairs))), "share")


def q_hrp_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(allocation.hierarchical_risk_parity(_nation_pairs(spark, sf_dir)), "weight")


def q_ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.ward_clusters(returns.correlation_distance(_nation_pairs(spark, sf_dir)))


def q_silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = returns.correlation_distance(_nation_pairs(spark, sf_dir))
    return _round(allocation.silhouettes(d, materialise(allocation.ward_clusters(d))), "silhouette")


def _book_returns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    weekly = calendar.resample_weekly(daily_bars(spark, sf_dir)).withColumnRenamed("week", "date")
    return weekly.select(F.col("symbol").alias("book_id"), "date", pct_change(F.col("close"), _w()).alias("r")), _benchmark(weekly)


def _benchmark(weekly: DataFrame) -> DataFrame:
    """Returns of the weekly mean close."""
    mean = weekly.groupBy("date").agg(F.avg("close").alias("close"))
    return mean.select("date", pct_change(F.col("close"), Window.partitionBy(F.lit(1)).orderBy("date")).alias("b")).where("b is not null")


METRICS = (
    "total_return", "cagr", "volatility", "max_drawdown", "sharpe", "sortino", "calmar", "var_95", "var_99", "cvar_95", "win_rate", "best", "worst", "skewness",
    "kurtosis", "profit_factor", "beta", "benchmark_return", "alpha", "alpha_period", "correlation", "r_squared", "tracking_error", "info_ratio", "treynor", "daily_volatility",
    "up_capture", "down_capture",
)


def q_performance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, b = _book_returns(spark, sf_dir)
    return _round(performance.performance_metrics(r, b, periods=52), *METRICS)


def q_value_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = calendar.resample_weekly(daily_bars(spark, sf_dir)).withColumnRenamed("week", "date")
    held = weekly.groupBy("symbol").agg(F.min_by("close", "date").alias("c")).select(F.lit("all").alias("book_id"), "symbol", F.floor(F.lit(4000.0) / F.col("c")).alias("units"))
    return _round(performance.value_book(weekly.select("symbol", "date", "close"), held), "value", places=4)


def q_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_bars(spark, sf_dir)
    return _round(rows.select("symbol", "date", drawdown(F.col("close"), _w()).alias("drawdown"), rebase(F.col("close"), _w()).alias("rebased")), "drawdown", "rebased")


def q_rolling_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_bars(spark, sf_dir).withColumn("pos", F.row_number().over(_w()).cast("double"))
    return _round(rows.select("symbol", "date", rolling_slope(F.col("volume"), F.col("pos"), _w()).alias("slope")), "slope")


def q_volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = calendar.resample_weekly(daily_bars(spark, sf_dir)).withColumnRenamed("week", "date")
    return _round(profile.volume_profile(bars), "poc", "val", "vah")


def q_panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.panel_summary(daily_bars(spark, sf_dir, by_nation=True))


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All brands, and one that nobody sells, by all nations: more names than have bars."""
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand").distinct().unionByName(spark.range(1).select(F.lit("Brand#00").alias("p_brand")))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    return brands.crossJoin(F.broadcast(nations)).select(F.concat_ws("|", "p_brand", F.col("n_nationkey").cast("string")).alias("symbol"), F.col("n_nationkey").alias("pos"))


def q_missing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.missing_symbols(daily_bars(spark, sf_dir, by_nation=True), _universe(spark, sf_dir))


def q_symbols_with_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.symbols_with_prices(daily_bars(spark, sf_dir, by_nation=True), _universe(spark, sf_dir))


def q_unpriced_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _universe(spark, sf_dir).select(F.lit("all").alias("book_id"), "symbol", F.col("pos").cast("double").alias("units"))
    return panel.unpriced_holdings(held, daily_bars(spark, sf_dir, by_nation=True))


def q_compose_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    one = parts.where("p_size <= 10").groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_partkey").alias("pos"))
    two = parts.groupBy(F.col("p_type").alias("symbol")).agg(F.min("p_partkey").alias("pos"))
    return panel.compose_index(one, two.unionByName(one))


def q_largest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily_bars(spark, sf_dir, by_nation=True)
    weights = bars.groupBy(F.split("symbol", "[|]")[1].alias("book_id"), "symbol").agg(F.sum("volume").alias("weight"))
    return panel.largest_k(weights)


def q_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(panel.percentile_in_group(daily_bars(spark, sf_dir).select("symbol", "date", "volume"), "volume", "p", "date").drop("volume"), "p")


def q_rank_in_trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(panel.rank_in_trailing_window(daily_bars(spark, sf_dir).select("symbol", "date", "volume"), "volume", "p").drop("volume"), "p")


def q_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = daily_bars(spark, sf_dir).select("symbol", "date", F.when(F.col("close") > F.col("open"), "up").otherwise("down").alias("side"))
    return panel.transitions(up, "side")


def q_holding_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = materialise(returns.returns_matrix(_weekly_book(spark, sf_dir), least=0.3))
    weights = materialise(allocation.inverse_variance(materialise(returns.pair_moments(r))))
    labels = weights.select("book_id", "symbol", F.substring("symbol", 7, 1).cast("int").alias("cluster"))
    return _round(diagnostics.holding_diagnostics(r, weights, 52, labels), "weight", "volatility", "corr_to_book")


def q_book_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return _round(diagnostics.book_risk(pairs, materialise(allocation.inverse_variance(pairs)), 52), "volatility", "concentration", "dispersion")


def q_cluster_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations ordered by the Ward clusters of the best silhouette."""
    pairs = _nation_pairs(spark, sf_dir)
    d = returns.correlation_distance(pairs)
    labels = materialise(allocation.best_clusters(d, materialise(allocation.ward_clusters(d))))
    return _round(diagnostics.cluster_matrix(pairs, labels), "corr")


def q_equal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _weekly_book(spark, sf_dir)
    return diagnostics.equal_units(allocation.equal_weights(prices), last_prices(prices), 100_000.0)


def q_books_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(books_by_method(_nation_prices(spark, sf_dir), least=0.3), "price", "weight", "value")


def _rebalances(prices: DataFrame) -> DataFrame:
    """Every seventh Friday of each book's calendar, and the last one."""
    dates = prices.select("book_id", "date").distinct().withColumn("back", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("date"))) - 1)
    return dates.where("back % 7 = 0").select("book_id", F.col("date").alias("as_of"))


def q_books_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-variance books of the brands every seven weeks, each from the 104 weeks before it."""
    prices = _weekly_book(spark, sf_dir)
    return _round(books_by_date(prices, _rebalances(prices), lookback=104, least=0.3), "price", "weight", "value")


def q_hrp_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive halving of the names' own order in place of the tree's."""
    pairs = _pairs(spark, sf_dir)
    names = pairs.where("si = sj").select("book_id", F.col("si").alias("symbol"))
    order = names.withColumn("pos", F.row_number().over(Window.partitionBy("book_id").orderBy("symbol")))
    return _round(allocation.hierarchical_risk_parity(pairs, order), "weight")


def q_book_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a book of the brands, of which every fifth has no prices from 1997 on; its map as text."""
    prices = _weekly_book(spark, sf_dir).where("not (symbol like '%5' and date >= '1997-01-01')")
    _, stats = audited_book(prices, names=22, cap=0.05, least=0.3, periods=52)
    text = F.array_join(F.transform(F.map_entries("left_out"), lambda e: F.concat_ws("=", e["key"], F.format_number(e["value"], 4))), ",")
    figures = ("effective_cap", "max_weight", "deployed", "cash", "volatility", "concentration_solved", "dispersion_solved", "concentration_held", "dispersion_held")
    return _round(stats.withColumn("left_out", text), *figures)


def q_cluster_matrix_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations with the first digits of brands as clusters."""
    pairs = _pairs(spark, sf_dir)
    labels = pairs.where("si = sj").select("book_id", F.col("si").alias("symbol"), (-F.substring("si", 7, 1).cast("int")).alias("cluster"))
    return _round(diagnostics.cluster_matrix(pairs, labels), "corr")


def q_write_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = calendar.resample_weekly(daily_bars(spark, sf_dir)).withColumnRenamed("week", "date")
    bars = _round(bars, "open", "high", "low", "close")
    folder = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    write_snapshots(bars, folder)
    return read_snapshots(bars, folder)


def q_panel_from_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long bars from a wide table of closes and volumes by brand."""
    bars = daily_bars(spark, sf_dir)
    wide = bars.groupBy("date").pivot("symbol").agg(F.first("close").alias("close"), F.first("volume").alias("volume"))
    wide = wide.toDF(*["date" if c == "date" else "|".join(reversed(c.rsplit("_", 1))) for c in wide.columns])
    rows = panel_from_wide(wide).where("close is not null").select("symbol", "date", "close", "volume")
    return _round(rows, "close")


def q_benchmark_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(benchmark_series(daily_bars(spark, sf_dir), "Brand#11"), "close")


def q_align_to_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily_bars(spark, sf_dir, by_nation=True).select("symbol", "date", "close")
    return _round(calendar.align_to(bars, benchmark_series(daily_bars(spark, sf_dir), "Brand#11"), ["close"]), "close")


def q_fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose close is missing where the volume is odd, on days of odd numbers, from all bars."""
    bars = daily_bars(spark, sf_dir, by_nation=True).select("symbol", "date", "close", "volume")
    batch = bars.where("day(date) % 2 = 1").withColumn("close", F.when(F.col("volume") % 2 == 0, F.col("close")))
    second = bars.select("symbol", "date", (F.col("close") + 1).alias("close"), F.lit(-1.0).alias("volume"))
    return _round(calendar.fill_holes(batch.where("volume % 3 <> 0"), second, ["close", "volume"]), "close")


def q_leaf_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.leaf_order(returns.correlation_distance(_nation_pairs(spark, sf_dir)))


def _volume_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily_bars(spark, sf_dir, by_nation=True).groupBy(F.split("symbol", "[|]")[1].alias("book_id"), "symbol").agg(F.sum("volume").alias("v"))
    return bars.select("book_id", "symbol", (F.col("v") / F.sum("v").over(Window.partitionBy("book_id"))).alias("weight"))


def q_select_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(allocation.select_top(_volume_weights(spark, sf_dir), 7), "weight")


def q_size_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = last_prices(_nation_prices(spark, sf_dir)).where("symbol not like 'Brand#1%'")
    return _round(allocation.size_positions(_volume_weights(spark, sf_dir), prices, 100_000.0), "price", "weight", "value")


def q_rank_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_bars(spark, sf_dir, by_nation=True).groupBy(F.split("symbol", "[|]")[1].alias("book_id"), "symbol").agg(F.count("*").alias("c"))
    return _round(returns.rank_z(rows.withColumn("c", F.when(F.col("c") % 7 != 0, F.col("c"))), "c"), "z")


def q_order_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = _volume_weights(spark, sf_dir)
    labels = weights.select("book_id", "symbol", F.substring("symbol", 7, 1).cast("int").alias("cluster")).where("cluster < 5")
    return _round(allocation.order_book(weights, labels, 12), "weight")


def _held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weekly closes, a book of all brands, and equal units of the same brands."""
    weekly = calendar.resample_weekly(daily_bars(spark, sf_dir)).withColumnRenamed("week", "date").select("symbol", "date", "close")
    held = weekly.groupBy("symbol").agg(F.min_by("close", "date").alias("c"))
    held = held.select(F.lit("all").alias("book_id"), "symbol", F.floor(F.lit(4000.0) / F.col("c")).alias("units"))
    return weekly, held, held.withColumn("units", F.lit(3.0))


def q_shadow_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly, held, other = _held(spark, sf_dir)
    return _round(performance.value_on(weekly, other, performance.value_book(weekly, held)), "value", places=4)


def q_best_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand with the highest close of each date, or with the lowest on even days."""
    rows = daily_bars(spark, sf_dir).select("date", "symbol", F.when(F.col("volume") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("close")).alias("x"))
    return performance.best_in_row(rows, "date", "symbol", "x", F.day("date") % 2 == 1)


def q_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily_bars(spark, sf_dir, by_nation=True).select(F.split("symbol", "[|]")[1].alias("book_id"), "symbol", "date", "volume")
    anchors = bars.select("book_id").distinct().withColumn("anchor", F.make_date(F.lit(1992) + F.col("book_id").cast("int") % 8, F.lit(7), F.lit(1)))
    return checks.since(bars, anchors)


def q_estimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = book_prices(daily_bars(spark, sf_dir, by_nation=True), F.split("symbol", "[|]")[1])
    return checks.estimable(returns.returns_of(prices, pad=False).where("r is not null"), 260)


def q_enough_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.enough_history(daily_bars(spark, sf_dir, by_nation=True), 60, keys=_universe(spark, sf_dir))


def q_panel_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, names = daily_bars(spark, sf_dir, by_nation=True), _universe(spark, sf_dir)
    return checks.panel_checks(bars, names, "1994-01-01", "1994-01-31", 100).unionByName(checks.panel_checks(bars, names, "1994-01-31", "1994-01-01"))


def q_failed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(checks.failed_share(daily_bars(spark, sf_dir, by_nation=True), _universe(spark, sf_dir), 0.03), "share")


def q_date_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.date_back(daily_bars(spark, sf_dir), "1996-12-31", 252)


def q_silhouettes_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the first digits of brands would do as clusters."""
    d = returns.correlation_distance(_pairs(spark, sf_dir))
    names = d.where("si = sj").select("book_id", F.col("si").alias("symbol"))
    digit = F.substring("symbol", 7, 1).cast("int")
    labels = names.select("book_id", F.lit(5).alias("k"), "symbol", digit.alias("cluster")).unionByName(
        names.select("book_id", F.lit(2).alias("k"), "symbol", F.when(digit < 3, 0).otherwise(1).alias("cluster"))
    )
    return _round(allocation.silhouettes(d, labels), "silhouette")


QUERIES: dict[str, Query] = {
    "panel_from_wide": q_panel_from_wide,
    "benchmark_series": q_benchmark_series,
    "align_to_benchmark": q_align_to_benchmark,
    "fill_holes": q_fill_holes,
    "leaf_order": q_leaf_order,
    "select_top": q_select_top,
    "size_positions": q_size_positions,
    "rank_z": q_rank_z,
    "order_book": q_order_book,
    "shadow_value": q_shadow_value,
    "best_in_row": q_best_in_row,
    "since": q_since,
    "estimable": q_estimable,
    "enough_history": q_enough_history,
    "panel_checks": q_panel_checks,
    "failed_share": q_failed_share,
    "date_back": q_date_back,
    "silhouettes_by_brand": q_silhouettes_by_brand,
    "books_by_method": q_books_by_method,
    "books_by_date": q_books_by_date,
    "hrp_in_order": q_hrp_in_order,
    "book_stats": q_book_stats,
    "cluster_matrix_by_brand": q_cluster_matrix_by_brand,
    "write_snapshots": q_write_snapshots,
    "holding_diagnostics": q_holding_diagnostics,
    "book_risk": q_book_risk,
    "cluster_matrix": q_cluster_matrix,
    "equal_units": q_equal_units,
    "panel_summary": q_panel_summary,
    "missing_symbols": q_missing_symbols,
    "symbols_with_prices": q_symbols_with_prices,
    "unpriced_holdings": q_unpriced_holdings,
    "compose_index": q_compose_index,
    "largest_k": q_largest_k,
    "percentile_rank_row": q_percentile_rank,
    "rank_in_trailing_window": q_rank_in_trailing_window,
    "transitions": q_transitions,
    "stream_bars": event_bars,
    "volume_profile": q_volume_profile,
    "flagship_book": flagship_book,
    "daily_bars": q_daily_bars,
    "load_bars": q_load_bars,
    "resample_weekly": q_resample_weekly,
    "pct_change": _series_query(r=lambda w: pct_change(F.col("close"), w)),
    "moving_average": _series_query(**{f"ma{n}": lambda w, n=n: moving_average(F.col("close"), w, n) for n in (20, 90, 200)}),
    "moving_std": _series_query(dev20=lambda w: moving_std(F.col("close"), w, 20)),
    "rolling_zscore": _series_query(z=lambda w: rolling_zscore(F.col("close"), w)),
    "ewm_mean": q_ewm_mean,
    "rsi": q_rsi,
    "align_calendar": q_align_calendar,
    "fill_report": q_fill_report,
    "weekly_onto_daily": q_weekly_onto_daily,
    "warmup_skip": q_warmup_skip,
    "ffill": q_ffill,
    "drawdown": q_drawdown,
    "rolling_slope": q_rolling_slope,
    "coverage": q_coverage,
    "returns_matrix": q_returns_matrix,
    "covariance": q_covariance,
    "ledoit_wolf": q_shrunk_covariance,
    "correlation_distance": q_correlation_distance,
    "inverse_variance": q_inverse_variance,
    "equal_weights": q_equal_weights,
    "risk_contributions": q_risk_contributions,
    "momentum_12_1": q_momentum,
    "momentum_tilt": q_momentum_tilt,
    "cap_weights": q_cap_weights,
    "erc_weights": q_erc_weights,
    "erc_shares": q_erc_shares,
    "hrp_weights": q_hrp_weights,
    "ward_clusters": q_ward_clusters,
    "silhouettes": q_silhouettes,
    "value_book": q_value_book,
    "performance_metrics": q_performance_metrics,
}

_PRINTS = """prints as (
  select {symbol} as symbol, cast(l_shipdate as date) as date, p_retailprice * (1 - l_discount) as px, l_quantity as q,
    row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) as k
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey),
bars as (
  select symbol, date, arg_min(px, k) as open, max(px) as high, min(px) as low, arg_max(px, k) as close, sum(q) as volume
  from prints group by symbol, date)"""
_BARS = _PRINTS.format(symbol="p_brand")
_MANY = _PRINTS.format(symbol="p_brand || '|' || s_nationkey")
_OHLC = "round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume"
_WEEKLY = """weekly as (
  select symbol, cast(date_trunc('week', date + interval 2 day) as date) + 4 as week, arg_min(open, date) as open, max(high) as high, min(low) as low,
    arg_max(close, date) as close, sum(volume) as volume
  from bars group by 1, 2)"""
_RETURNS = f"""with {_BARS}, {_WEEKLY},
r0 as (select symbol, week as date, close / lag(close) over (partition by symbol order by week) - 1 as r from weekly),
days as (select date from (select distinct date from r0) order by date desc limit 252),
recent as (select r0.* from r0 join days using (date)),
kept as (select symbol from recent group by symbol having count(r) >= 0.3 * (select count(distinct date) from recent)),
rows0 as (select * from recent where symbol in (select symbol from kept) and r is not null),
full_ as (select date from rows0 group by date having count(*) = (select count(*) from kept)),
m as (select * from rows0 where date in (select date from full_))"""
_PAIRS = f"""{_RETURNS},
x as (select symbol, date, r - avg(r) over (partition by symbol) as x from m),
p as (
  select a.symbol as si, b.symbol as sj, count(*) as n, sum(a.x * b.x) / (count(*) - 1) as cov,
    case when sum(a.x * a.x) > 0 and sum(b.x * b.x) > 0 then sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) else 0 end as corr, sum(a.x * a.x * b.x * b.x) as sq,
    sum(a.x * a.x * a.x * b.x) as iij, sum(a.x * b.x * b.x * b.x) as ijj
  from x a join x b using (date) where a.symbol <= b.symbol group by 1, 2)"""
_IVP = f"""{_PAIRS}, v as (select si as symbol, 1 / cov as i from p where si = sj), ivp as (select symbol, i / sum(i) over () as weight from v)"""

_R0 = "r0 as (select symbol, week as date, close / lag(close) over (partition by symbol order by week) - 1 as r from weekly)"
_FILLED_IVP = _IVP.replace(
    _R0,
    f"""grid as (select * from (select distinct week from weekly), (select distinct symbol from weekly)),
filled as (
  select symbol, week, last_value(close ignore nulls) over (partition by symbol order by week rows between unbounded preceding and current row) as close
  from grid left join weekly using (symbol, week)),
{_R0.replace('from weekly', 'from filled')}""",
)


def _capped(source: str, cap: float, key: str = "'all'") -> str:
    """The multiple is looked for among those of every number of names at the cap: the least number after which nobody is over it."""
    return f"""(
  with base as (
    select {key} as book, *, greatest({cap}, 1.0::double / count(*) over (partition by {key})) as most, row_number() over (partition by {key} order by weight desc, symbol) - 1 as k
    from {source}),
  tried as (select book, k, (1 - k * most) / (select sum(weight) from base y where y.book = x.book and y.k >= x.k) as m from base x where weight > 0),
  fit as (
    select book, arg_min(m, k) as m from tried t where not exists (select 1 from base where base.book = t.book and base.k >= t.k and weight * t.m > most) group by book)
  select base.* replace (least(most, weight * m) as weight) from base join fit using (book))"""


#: Correlation distances in one book a nation, gaps carried over.
_NATION_DISTANCES = f"""{_MANY}, {_WEEKLY},
grid as (select * from (select distinct week from weekly), (select distinct symbol from weekly)),
filled as (
  select split_part(symbol, '|', 2) as book_id, symbol, week as date,
    last_value(close ignore nulls) over (partition by symbol order by week rows between unbounded preceding and current row) as close
  from grid left join weekly using (symbol, week)),
r0 as (select book_id, symbol, date, close / lag(close) over (partition by symbol order by date) - 1 as r from filled),
recent as (select * from r0 where date in (select distinct date from r0 order by date desc limit 252)),
kept as (select book_id, symbol from recent group by 1, 2 having count(r) >= 0.3 * (select count(distinct date) from recent)),
many as (select book_id, count(*) as n from kept group by 1),
good as (select recent.* from recent join kept using (book_id, symbol) where r is not null),
full_ as (select book_id, date from good join many using (book_id) group by book_id, date having count(*) = any_value(many.n)),
x as materialized (select book_id, symbol, date, r - avg(r) over (partition by book_id, symbol) as x from good join full_ using (book_id, date)),
p as (
  select book_id, a.symbol as si, b.symbol as sj,
    case when sum(a.x * a.x) > 0 and sum(b.x * b.x) > 0 then sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) else 0 end as corr
  from x a join x b using (book_id, date) where a.symbol < b.symbol group by 1, 2, 3),
d as (select book_id, si, sj, sqrt(greatest(0.0::double, 0.5::double * (1 - corr))) as dist from p)"""


def _rows(expression: str, n: int) -> str:
    name = expression.split("(")[0]
    x = expression[len(name) + 1 : -1]
    over = f"over (partition by symbol order by date rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {over} = {n} then {expression} {over} end"


_WEIGHTED = f"""with {_BARS}, n as (select symbol, date, close, row_number() over (partition by symbol order by date) as k from bars)"""
_MOMENTUM = f"""with {_BARS}, {_WEEKLY},
days as (select week, row_number() over (order by week desc) - 1 as back from (select distinct week from weekly)),
mo as (
  select symbol, max(case when back = 21 then close end) / max(case when back = 273 then close end) - 1 as momentum
  from weekly join days using (week) group by symbol),
z as (
  select symbol, momentum, case when momentum is null or count(momentum) over () < 2 then 0
    else ((rank() over (order by momentum asc nulls last) + (count(*) over (partition by momentum) - 1) / 2.0 - 0.5) / count(momentum) over () - 0.5) * sqrt(12.0) end as z
  from mo)"""

_UNIVERSE = "u as (select distinct p_brand || '|' || n_nationkey as symbol, n_nationkey as pos from (select p_brand from part union select 'Brand#00'), nation)"

_VOLUMES = f"""with {_MANY},
vw as (select split_part(symbol, '|', 2) as book_id, symbol, sum(volume) / sum(sum(volume)) over (partition by split_part(symbol, '|', 2)) as weight from bars group by 1, 2)"""

_LEFT_OUT = _IVP.replace(_WEEKLY, _WEEKLY.replace("weekly as", "weekly0 as") + ", weekly as (select * from weekly0 where not (symbol like '%5' and week >= date '1997-01-01'))")

ORACLE_SQL: dict[str, str] = {
    "books_by_date": f"""with {_BARS}, {_WEEKLY},
r0 as (select symbol, week as date, close / lag(close) over (partition by symbol order by week) - 1 as r from weekly),
cal as (select week as date, row_number() over (order by week) as place, row_number() over (order by week desc) - 1 as back from (select distinct week from weekly)),
rb as (select date as as_of, place as last_, greatest(1, place - 103) as first_ from cal where back % 7 = 0),
rows_ as (select as_of, last_ - first_ + 1 as win, symbol, r0.date, r from rb join cal on place between first_ and last_ join r0 on r0.date = cal.date),
kept as (select as_of, symbol from rows_ group by as_of, symbol having count(r) >= 0.3 * any_value(win) and count(r) > 0),
many as (select as_of, count(*) as n from kept group by as_of),
good as (select rows_.* from rows_ join kept using (as_of, symbol) where r is not null),
full_ as (select as_of, date from good join many using (as_of) group by as_of, date having count(*) = any_value(many.n)),
m as (select good.* from good join full_ using (as_of, date)),
v as (select as_of, symbol, case when var_samp(r) > 0 then 1 / var_samp(r) else 0 end as i from m group by 1, 2),
w0 as (select as_of, symbol, case when sum(i) over (partition by as_of) > 0 then i / sum(i) over (partition by as_of) else 1.0::double / count(*) over (partition by as_of) end as weight from v),
w1 as (select *, row_number() over (partition by as_of order by weight desc, symbol) as k from w0 where weight > 1e-9),
w2 as (select as_of, symbol, weight / sum(weight) over (partition by as_of) as weight from w1 where k <= 10),
w5 as {_capped("w2", 0.12, "as_of")},
px as (select as_of, symbol, arg_max(close, week) as price from rb join weekly on week <= as_of group by 1, 2),
w6 as (select as_of, symbol, price, weight / sum(weight) over (partition by as_of) as weight from w5 join px using (as_of, symbol))
select 'all' as book_id, as_of, symbol, round(price, 6) as price, round(weight, 6) as weight, cast(floor(100000.0::double * weight / price) as bigint) as units,
  round(floor(100000.0::double * weight / price) * price, 6) as value from w6""",
    "leaf_order": f"""with recursive {_NATION_DISTANCES},
edges as materialized (select *, row_number() over (partition by book_id order by dist, si, sj) as k from d),
trees as (
  select book_id, 0::bigint as k, list([symbol]) as parts from (select distinct book_id, symbol from x) group by 1
  union all
  select book_id, k, case when list_contains(u, sj) then parts
    else list_append(list_filter(parts, lambda y: not list_contains(y, si) and not list_contains(y, sj)), case when list_min(u) < list_min(v) then u || v else v || u end) end
  from (
    select t.book_id, t.parts, e.k, e.si, e.sj, list_filter(t.parts, lambda y: list_contains(y, e.si))[1] as u, list_filter(t.parts, lambda y: list_contains(y, e.sj))[1] as v
    from trees t join edges e on e.book_id = t.book_id and e.k = t.k + 1)),
order_ as (select book_id, arg_max(parts, k)[1] as leaves from trees group by 1)
select book_id, unnest(leaves) as symbol, cast(generate_subscripts(leaves, 1) - 1 as integer) as pos from order_""",
    "hrp_in_order": f"""with recursive {_PAIRS[5:]},
nm as (select si as name, row_number() over (order by si) - 1 as k, cov as v from p where si = sj),
f as (select si, sj, cov from p union all select sj, si, cov from p where si < sj),
mm as (select a.k as i, b.k as j, cov / (a.v * b.v) as m from f join nm a on a.name = si join nm b on b.name = sj),
iv as (select a.k as lo, b.k - a.k + 1 as size from nm a join nm b on b.k >= a.k),
va as (
  select lo, size, (select sum(m) from mm where i between lo and lo + size - 1 and j between lo and lo + size - 1)
    / pow((select sum(1 / v) from nm where k between lo and lo + size - 1), 2) as x
  from iv),
tree as (
  select 0::bigint as lo, count(*)::bigint as size, 1.0::double as w from nm having count(*) > 0
  union all
  select case when s.left_ then t.lo else t.lo + t.size // 2 end, case when s.left_ then t.size // 2 else t.size - t.size // 2 end,
    t.w * case when s.left_ then r.x / (l.x + r.x) else l.x / (l.x + r.x) end
  from tree t join va l on l.lo = t.lo and l.size = t.size // 2 join va r on r.lo = t.lo + t.size // 2 and r.size = t.size - t.size // 2, (values (true), (false)) s(left_)
  where t.size > 1)
select 'all' as book_id, name as symbol, round(w / sum(w) over (), 6) as weight from tree join nm on nm.k = lo where size = 1""",
    "book_stats": f"""{_LEFT_OUT},
cov_ as (select symbol, count(r) as obs, count(r) / (select count(distinct date) from recent)::double as coverage from recent group by symbol),
top0 as (select symbol, weight from ivp where weight > 1e-9 order by weight desc, symbol limit 22),
top1 as (select symbol, weight / sum(weight) over () as weight from top0),
capped as {_capped("top1", 0.05)},
last_ as (select symbol, arg_max(close, week) as price from weekly group by symbol),
w as (select symbol, price, weight / sum(weight) over () as weight from capped join last_ using (symbol)),
book as (select *, floor(100000.0::double * weight / price) as units from w),
held as (select *, units * price as value from book where units > 0),
f as (select si, sj, cov from p union all select sj, si, cov from p where si < sj),
rs as (select si, sum(a.weight * b.weight * cov) as c from f join ivp a on a.symbol = si join ivp b on b.symbol = sj group by si),
rh as (select si, sum(a.weight * b.weight * cov) as c from f join held a on a.symbol = si join held b on b.symbol = sj group by si),
k as (select (select count(*) from held) as positions, (select count(*) from cov_ where coverage >= 0.3) as covered, (select count(*) from ivp where weight > 1e-9) as weighted, (select count(distinct symbol) from weekly) as names)
select 'all' as book_id, names, covered, names - covered as uncovered,
  (select coalesce(string_agg(symbol || '=' || printf('%.4f', coverage), ',' order by symbol), '') from cov_ where coverage < 0.3) as left_out,
  (select count(distinct date) from recent) as "window", (select min(obs) from cov_ where coverage >= 0.3) as least_obs, (select max(n) from p) as dates, (select count(*) from p where si = sj and cov > 0) as moving,
  weighted, (select count(*) from book) as sized, positions, 22::bigint as requested, greatest(0, 22 - positions)::bigint as short,
  case when positions >= 22 then 'none' when covered < 22 then 'universe' when weighted < 22 then 'weights' else 'prices' end as cause,
  round(greatest(0.05::double, 1.0::double / (select count(*) from book)), 6) as effective_cap, round((select max(weight) from held), 6) as max_weight, (select arg_max(symbol, row(weight, symbol)) from held) as largest,
  round((select sum(value) from held), 6) as deployed, round(100000.0::double - (select sum(value) from held), 6) as cash, round((select sqrt(sum(c) * 52) from rh), 6) as volatility,
  round((select max(c) * count(*) / sum(c) from rs), 6) as concentration_solved, round((select stddev_pop(c) / avg(c) from rs), 6) as dispersion_solved,
  round((select max(c) * count(*) / sum(c) from rh), 6) as concentration_held, round((select stddev_pop(c) / avg(c) from rh), 6) as dispersion_held
from k""",
    "cluster_matrix_by_brand": f"""{_PAIRS},
l as (select si as symbol, -substr(si, 7, 1)::int as c from p where si = sj),
a as (select symbol, row_number() over o as n, coalesce(c <> lag(c) over o, false) as boundary from l window o as (order by c, symbol)),
f as (select si, sj, corr from p union all select sj, si, corr from p where si < sj)
select 'all' as book_id, cast(i.n as integer) as i, cast(j.n as integer) as j, si, sj, round(corr, 6) as corr, i.boundary from f join a i on i.symbol = si join a j on j.symbol = sj""",
    "panel_from_wide": f"with {_BARS} select symbol, date, round(close, 6) as close, volume from bars",
    "benchmark_series": f"with {_BARS} select date, round(close, 6) as close from bars where symbol = 'Brand#11'",
    "align_to_benchmark": f"""with {_PRINTS.format(symbol="p_brand").replace("prints", "prints1").replace("bars", "bars1")}, {_MANY},
grid as (select * from (select distinct date from bars1 where symbol = 'Brand#11'), (select distinct symbol from bars))
select symbol, date, round(last_value(close ignore nulls) over (partition by symbol order by date rows between unbounded preceding and current row), 6) as close
from grid left join bars using (symbol, date)""",
    "fill_holes": f"""with {_MANY},
batch as (select symbol, date, case when volume % 2 = 0 then close end as close, volume from bars where day(date) % 2 = 1 and volume % 3 <> 0)
select coalesce(b.symbol, r.symbol) as symbol, coalesce(b.date, r.date) as date, round(coalesce(b.close, r.close + 1), 6) as close, coalesce(b.volume, -1.0::double) as volume
from batch b full join (select * from bars where date in (select date from batch)) r on b.symbol = r.symbol and b.date = r.date""",
    "select_top": f"""{_VOLUMES}, t as (select *, row_number() over (partition by book_id order by weight desc, symbol) as k from vw)
select book_id, symbol, round(weight / sum(weight) over (partition by book_id), 6) as weight from t where k <= 7""",
    "size_positions": f"""{_VOLUMES}, {_WEEKLY},
l as (select symbol, arg_max(close, week) as price from weekly where symbol not like 'Brand#1%' group by symbol),
w as (select book_id, symbol, price, weight / sum(weight) over (partition by book_id) as weight from vw join l using (symbol))
select book_id, symbol, round(price, 6) as price, round(weight, 6) as weight, cast(floor(100000.0::double * weight / price) as bigint) as units,
  round(floor(100000.0::double * weight / price) * price, 6) as value from w""",
    "rank_z": f"""with {_MANY}, c0 as (select split_part(symbol, '|', 2) as book_id, symbol, count(*) as n from bars group by 1, 2),
c as (select book_id, symbol, case when n % 7 <> 0 then n end as c from c0)
select book_id, symbol, c, round(case when c is null or count(c) over b < 2 then 0
  else ((rank() over (partition by book_id order by c asc nulls last) + (count(*) over (partition by book_id, c) - 1) / 2.0 - 0.5) / count(c) over b - 0.5) * sqrt(12.0) end, 6) as z
from c window b as (partition by book_id)""",
    "order_book": f"""{_VOLUMES}, l as (select *, substr(symbol, 7, 1)::int as d from vw),
o as (select book_id, symbol, weight, row_number() over (partition by book_id order by case when d < 5 then d end asc nulls last, weight desc, symbol) as pos from l)
select book_id, symbol, round(weight, 6) as weight, cast(pos as integer) as pos from o where pos <= 12""",
    "shadow_value": f"""with {_BARS}, {_WEEKLY},
h as (select symbol, floor(4000.0::double / arg_min(close, week)) as units from weekly group by symbol),
v as (select week as date, count(case when units > 0 then 1 end) as have, sum(close * 3) as value from weekly join h using (symbol) group by week),
st as (select min(date) as s from v where have = (select count(*) from h where units > 0))
select 'all' as book_id, date, round(value, 4) as value from v, st where date >= s and have > 0""",
    "best_in_row": f"""with {_BARS}, s as (select date, symbol, close from bars where volume % 5 <> 0),
b as (select date, case when count(*) < 2 then null when day(date) % 2 = 1 then arg_min(symbol, row(-close, symbol)) else arg_min(symbol, row(close, symbol)) end as best from s group by date)
select date, best from (select distinct date from bars) left join b using (date)""",
    "since": f"""with {_MANY} select split_part(symbol, '|', 2) as book_id, symbol, date, volume from bars where date >= make_date(1992 + split_part(symbol, '|', 2)::int % 8, 7, 1)""",
    "estimable": f"""with {_MANY}, {_WEEKLY},
r as (select split_part(symbol, '|', 2) as book_id, symbol, week, close / lag(close) over (partition by symbol order by week) - 1 as r from weekly),
c as (select book_id, count(distinct symbol) as names, count(distinct week) as dates from r where r is not null group by book_id)
select book_id, names, dates, names >= 2 and dates > names and dates >= 260 as estimable from c""",
    "enough_history": f"with {_MANY}, {_UNIVERSE} select u.symbol, count(distinct date) as dates, count(distinct date) >= 60 as enough from u left join bars on bars.symbol = u.symbol group by u.symbol",
    "panel_checks": f"""with {_MANY}, {_UNIVERSE}, r(a, z) as (values (date '1994-01-01', date '1994-01-31'), (date '1994-01-31', date '1994-01-01')),
c as (select a, z, count(distinct u.symbol) as names, count(distinct bars.symbol) as priced from r cross join u left join bars on bars.symbol = u.symbol and date between a and z group by a, z)
select names, names - priced as failed, names = 0 as no_names, a > z as reversed_range, priced = 0 as no_prices, names > 0 and priced = 0 as all_failed, names > case when a < z then 100 else 10000 end as many_names from c""",
    "failed_share": f"""with {_MANY}, {_UNIVERSE}, c as (select count(*) as names, count(case when symbol not in (select symbol from bars) then 1 end) as failed from u)
select names, failed, round(failed / names::double, 6) as share, failed / names::double > 0.03 as too_many from c""",
    "date_back": f"""with {_BARS}, d as (select date, row_number() over (order by date desc) - 1 as back from (select distinct date from bars where date <= '1996-12-31'))
select min(date) as start from d where back <= 252""",
    "silhouettes_by_brand": f"""{_PAIRS},
d as (select si, sj, case when si = sj then 0 else sqrt(greatest(0, 0.5 * (1 - corr))) end as dist from p),
f as (select si, sj, dist from d where si <> sj union all select sj, si, dist from d where si <> sj),
l as (select si as symbol, 5 as k, substr(si, 7, 1)::int as c from p where si = sj union all select si, 2, case when substr(si, 7, 1)::int < 3 then 0 else 1 end from p where si = sj),
mm as (select a.k, f.si, a.c as ci, b.c as cj, avg(dist) as m from f join l a on a.symbol = f.si join l b on b.symbol = f.sj and b.k = a.k group by 1, 2, 3, 4),
s as (select k, si, max(case when ci = cj then m end) as own, min(case when ci <> cj then m end) as other from mm group by 1, 2)
select 'all' as book_id, k, round(avg(case when own is null or greatest(own, other) = 0 then 0 else (other - own) / greatest(own, other) end), 6) as silhouette from s group by k""",
    "write_snapshots": f"""with {_BARS}, {_WEEKLY} select symbol, week as date, round(round(open, 6), 2) as open, round(round(high, 6), 2) as high, round(round(low, 6), 2) as low,
  round(round(close, 6), 2) as close, volume from weekly""",
    "holding_diagnostics": f"""{_IVP},
b as (select date, sum(r * weight) as b from m join ivp using (symbol) group by date)
select 'all' as book_id, symbol, round(any_value(weight), 6) as weight, round(stddev_samp(r) * sqrt(52.0::double), 6) as volatility, round(corr(r, b), 6) as corr_to_book,
  substr(symbol, 7, 1)::int as cluster
from m join b using (date) join ivp using (symbol) group by symbol""",
    "book_risk": f"""{_IVP},
f as (select si, sj, cov from p union all select sj, si, cov from p where si < sj),
c as (select si, sum(a.weight * b.weight * cov) as c from f join ivp a on a.symbol = si join ivp b on b.symbol = sj group by si),
s as (select c, c / sum(c) over () as share from c)
select 'all' as book_id, count(*) as names, round(sqrt(sum(c) * 52), 6) as volatility, round(max(share) * count(*), 6) as concentration, round(stddev_pop(share) / avg(share), 6) as dispersion from s having count(*) > 0""",
    "equal_units": f"""with {_BARS}, {_WEEKLY}, l as (select symbol, arg_max(close, week) as price from weekly group by symbol)
select 'all' as book_id, symbol, cast(floor(100000.0::double / (select count(*) from l) / price) as bigint) as units from l""",
    "panel_summary": f"""with {_MANY} select count(distinct date) as days, min(date) as first_date, max(date) as last_date, count(distinct symbol) as symbols,
  count(distinct case when date = (select max(date) from bars) then symbol end) as in_latest from bars""",
    "missing_symbols": f"""with {_MANY}, {_UNIVERSE},
d as (select date, row_number() over (order by date desc) - 1 as back from (select distinct date from bars)),
l as (select symbol, min(back) as age from bars join d using (date) group by symbol)
select symbol, case when age is null then 'absent' else 'stale' end as reason from u left join l using (symbol) where age is null or age > 5""",
    "symbols_with_prices": f"with {_MANY}, {_UNIVERSE} select pos, symbol, symbol in (select symbol from bars) as priced from u",
    "unpriced_holdings": f"with {_MANY}, {_UNIVERSE} select 'all' as book_id, symbol from u where pos > 0 and symbol not in (select symbol from bars)",
    "compose_index": """with one as (select p_brand as symbol, min(p_partkey) as pos from part where p_size <= 10 group by 1),
two as (select p_type as symbol, min(p_partkey) as pos from part group by 1),
a as (select symbol, 0 as l, pos from one union all select symbol, 1, pos from two),
f as (select symbol, min(row(l, pos)) as place from a group by symbol)
select cast(row_number() over (order by place, symbol) - 1 as integer) as pos, symbol from f""",
    "largest_k": f"""with {_MANY}, w as (select split_part(symbol, '|', 2) as book_id, symbol, sum(volume) as weight from bars group by 1, 2)
select * from (select *, cast(row_number() over (partition by book_id order by weight desc, symbol) as integer) as rank from w) where rank <= 5""",
    "percentile_rank_row": f"""with {_BARS}
select symbol, date, round(case when count(*) over (partition by date) <= 1 then 0 else
  2 * (rank() over (partition by date order by volume) + (count(*) over (partition by date, volume) - 1) / 2.0::double) / count(*) over (partition by date) - 1 end, 6) as p from bars""",
    "rank_in_trailing_window": f"""with {_BARS}, n as (select *, list(volume) over (partition by symbol order by date rows between 9 preceding and current row) as l from bars)
select symbol, date, round(case when len(l) = 1 then 0.5 else len(list_filter(l, lambda x: x <= volume)) / len(l)::double end, 6) as p from n""",
    "transitions": f"""with {_BARS}, s as (select symbol, date, case when close > open then 'up' else 'down' end as side from bars),
c as (select symbol, case when side <> lag(side) over (partition by symbol order by date) then 1 else 0 end as c from s)
select symbol, cast(sum(c) as bigint) as changes from c group by symbol""",
    "stream_bars": """select event_type as symbol, date_trunc('day', ts)::timestamp as start, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low,
  arg_max(value, row(ts, event_id)) as close, cast(count(*) as double) as volume, count(*) as prints
from events group by 1, 2 having any_value(date_trunc('day', ts)) + interval 1 day <= (select max(ts) from events) - interval 2 hour""",
    "volume_profile": f"""with recursive {_BARS}, {_WEEKLY},
k as (select *, row_number() over (partition by symbol order by week) as k from weekly),
w as (
  select symbol, k, week, min(low) over v as lo, (max(high) over v - min(low) over v) / 60 as step, sum(volume) over v as total
  from k window v as (partition by symbol order by k rows between 89 preceding and current row) qualify count(*) over v = 90),
b as (
  select w.symbol, w.week, k.volume / total as v, least(59, greatest(0, floor((low - lo) / step)))::int as a, least(59, greatest(0, floor((high - lo) / step)))::int as z
  from w join k on k.symbol = w.symbol and k.k between w.k - 89 and w.k where step > 0 and total > 0),
h as (select symbol, week, bin, sum(round(v / (z - a + 1), 12)::decimal(20, 12)) as h from (select *, unnest(range(a, z + 1)) as bin from b) group by 1, 2, 3),
full_ as (
  select symbol, week, list(coalesce(h, 0)::decimal(20, 12) order by n.bin) as h
  from (select symbol, week, unnest(range(60)) as bin from w where step > 0) n left join h using (symbol, week, bin) group by 1, 2),
p as (select symbol, week, h, list_position(h, list_max(h)) - 1 as p from full_),
g as (
  select symbol, week, h, p as lo, p as hi, h[p + 1]::decimal(20, 12) as got from p
  union all
  select symbol, week, h, case when up then lo else lo - 1 end, case when up then hi + 1 else hi end, (got + case when up then h[hi + 2] else h[lo] end)::decimal(20, 12)
  from (select *, lo = 0 or (hi < 59 and h[hi + 2] >= h[lo]) as up from g where got < 0.7 and not (lo = 0 and hi = 59))),
e as (select symbol, week, min(lo) as lo, max(hi) as hi from g group by 1, 2)
select w.symbol, w.week as date, round(w.lo + (p + 0.5) * step, 6) as poc, round(w.lo + e.lo * step, 6) as val, round(w.lo + (e.hi + 1) * step, 6) as vah
from w left join p using (symbol, week) left join e using (symbol, week)""",
    "flagship_book": f"""{_FILLED_IVP},
top0 as (select symbol, weight from ivp where weight > 1e-9 order by weight desc, symbol limit 10),
top1 as (select symbol, weight / sum(weight) over () as weight from top0),
capped as {_capped("top1", 0.12)},
last_ as (select symbol, arg_max(close, week) as price from weekly group by symbol),
w as (select symbol, price, weight / sum(weight) over () as weight from capped join last_ using (symbol))
select 'all' as book_id, symbol, round(price, 6) as price, round(weight, 6) as weight, cast(floor(100000.0::double * weight / price) as bigint) as units,
  round(floor(100000.0::double * weight / price) * price, 6) as value
from w""",
    "daily_bars": f"with {_MANY} select symbol, date, {_OHLC} from bars",
    "load_bars": f"with {_BARS} select symbol, date, {_OHLC} from bars where volume % 5 <> 0",
    "resample_weekly": f"with {_MANY}, {_WEEKLY} select symbol, week, {_OHLC} from weekly",
    "pct_change": f"with {_BARS} select symbol, date, round(close / lag(close) over (partition by symbol order by date) - 1, 6) as r from bars",
    "moving_average": f"with {_BARS} select symbol, date, {', '.join(f'round({_rows("avg(close)", n)}, 6) as ma{n}' for n in (20, 90, 200))} from bars",
    "moving_std": f"with {_BARS} select symbol, date, round({_rows('stddev_samp(close)', 20)}, 6) as dev20 from bars",
    "rolling_zscore": f"with {_BARS} select symbol, date, round((close - {_rows('avg(close)', 20)}) / case when {_rows('stddev_samp(close)', 20)} = 0 then 1 else {_rows('stddev_samp(close)', 20)} end, 6) as z from bars",
    "ewm_mean": f"""{_WEIGHTED}
select a.symbol, a.date, {', '.join(f"round(sum(pow(1 - {al}::double, a.k - b.k) * b.close) / sum(pow(1 - {al}::double, a.k - b.k)), 6) as {nm}" for nm, al in (("ema9", "0.2"), ("ema21", "(2.0::double / 22)")))}
from n a join n b on a.symbol = b.symbol and b.k <= a.k and b.k > a.k - 450 group by a.symbol, a.date""",
    "rsi": f"""{_WEIGHTED},
u as (select *, coalesce(greatest(close - lag(close) over (partition by symbol order by k), 0), 0) as up, coalesce(greatest(lag(close) over (partition by symbol order by k) - close, 0), 0) as down from n),
g as (
  select a.symbol, a.date, a.k, sum(pow(13.0::double / 14, a.k - b.k) * up) / sum(pow(13.0::double / 14, a.k - b.k)) as gain,
    sum(pow(13.0::double / 14, a.k - b.k) * down) / sum(pow(13.0::double / 14, a.k - b.k)) as loss
  from (select symbol, date, k from u) a join u b on a.symbol = b.symbol and b.k <= a.k and b.k > a.k - 560 group by 1, 2, 3)
select symbol, date, round(case when k < 14 then null when loss > 0 then 100 - 100 / (1 + gain / loss) when gain > 0 then 100 end, 6) as rsi from g""",
    "align_calendar": f"""with {_MANY},
grid as (select * from (select distinct date from bars), (select distinct symbol from bars))
select symbol, date, round(last_value(close ignore nulls) over w, 6) as close, last_value(volume ignore nulls) over w as volume
from grid left join bars using (symbol, date) window w as (partition by symbol order by date rows between 5 preceding and current row)""",
    "fill_report": f"""with {_MANY},
grid as (select * from (select distinct date from bars), (select distinct symbol from bars)),
f as (
  select symbol, close, last_value(close ignore nulls) over (partition by symbol order by date rows between 5 preceding and current row) as after
  from grid left join bars using (symbol, date))
select symbol, count(close) as original, cast(sum(case when close is null and after is not null then 1 else 0 end) as bigint) as repaired from f group by symbol""",
    "weekly_onto_daily": f"""with {_MANY}, {_WEEKLY}
select b.symbol, b.date, round(last_value(w.close ignore nulls) over (partition by b.symbol order by b.date rows between unbounded preceding and current row), 6) as weekly_close
from bars b left join weekly w on w.symbol = b.symbol and w.week = b.date""",
    "warmup_skip": f"""with {_BARS}, d as (select date, row_number() over (order by date) as n from (select distinct date from bars))
select symbol, date, volume from bars join d using (date) where n > 200""",
    "ffill": f"""with {_MANY},
grid as (select * from (select distinct date from bars), (select distinct symbol from bars))
select symbol, date, round(last_value(close ignore nulls) over (partition by symbol order by date rows between unbounded preceding and current row), 6) as close
from grid left join bars using (symbol, date)""",
    "drawdown": f"""with {_BARS}
select symbol, date, round((close - max(close) over w) / max(close) over w, 6) as drawdown, round(close / first_value(close) over w * 100, 6) as rebased
from bars window w as (partition by symbol order by date rows between unbounded preceding and current row)""",
    "rolling_slope": f"""with {_BARS}, n as (select *, row_number() over (partition by symbol order by date) as k from bars)
select symbol, date, round(case when count(*) over w = 10 then regr_slope(volume, k) over w end, 6) + 0 as slope
from n window w as (partition by symbol order by date rows between 9 preceding and current row)""",
    "coverage": f"""with {_MANY}, {_WEEKLY},
r as (select symbol, week, close / lag(close) over (partition by symbol order by week) - 1 as r from weekly),
days as (select week from (select distinct week from r) order by week desc limit 252),
t as (select symbol, r, (select count(*) from days) as n from r join days using (week))
select 'all' as book_id, symbol, count(r) as obs, any_value(n) as "window", round(count(r) / any_value(n)::double, 6) as coverage, count(r) / any_value(n)::double >= 0.8 as kept
from t group by symbol""",
    "returns_matrix": f"{_RETURNS} select 'all' as book_id, symbol, date, round(r, 9) as r from m",
    "covariance": f"{_PAIRS} select 'all' as book_id, si, sj, n, round(cov, 9) as cov, round(corr, 9) as corr from p",
    "ledoit_wolf": f"""{_PAIRS},
s as (select si, sj, n, corr, sq, iij, ijj, cov * (n - 1) / n as s from p),
o as (select si as name, s as v from s where si = sj),
t as (
  select s.*, case when si = sj then s else (select avg(corr) from s where si < sj) * sqrt(a.v * b.v) end as target, case when si = sj then 1.0 else 2.0 end as k,
    case when si = sj then sq / n - s * s
      else (select avg(corr) from s where si < sj) * (sqrt(b.v / a.v) * (iij / n - a.v * s) + sqrt(a.v / b.v) * (ijj / n - b.v * s)) end as rho
  from s join o a on a.name = si join o b on b.name = sj),
l as (select least(1, greatest(0, (sum(k * (sq / n - s * s)) - sum(rho)) / (sum(k * (s - target) * (s - target)) * max(n)))) as shrinkage from t)
select 'all' as book_id, si, sj, round(shrinkage, 8) as shrinkage, round(shrinkage * target + (1 - shrinkage) * s, 8) as cov from t, l""",
    "correlation_distance": f"{_PAIRS} select 'all' as book_id, si, sj, round(case when si = sj then 0 else sqrt(greatest(0, 0.5 * (1 - corr))) end, 6) as dist from p",
    "inverse_variance": f"{_IVP} select 'all' as book_id, symbol, round(weight, 6) as weight from ivp",
    "equal_weights": f"with {_BARS} select distinct 'all' as book_id, symbol, round(1.0::double / (select count(distinct symbol) from bars), 6) as weight from bars",
    "risk_contributions": f"""{_PAIRS},
f as (select si, sj, cov from p union all select sj, si, cov from p where si < sj)
select 'all' as book_id, si as symbol, round(sum(cov) / (select sum(cov) from f), 6) as share from f group by si""",
    "momentum_12_1": f"{_MOMENTUM} select 'all' as book_id, symbol, round(momentum, 6) as momentum, round(z, 6) as z from z",
    "momentum_tilt": f"""{_MOMENTUM}, t as (select symbol, case when z >= 0 then 1 + 0.5 * z else 1 / (1 - 0.5 * z) end as t from z)
select 'all' as book_id, symbol, round(t / sum(t) over (), 6) as weight from t""",
    "cap_weights": f"{_IVP} select 'all' as book_id, symbol, round(weight, 6) as weight from {_capped('ivp', 0.041)}",
    "erc_shares": f"{_PAIRS} select 'all' as book_id, si as symbol, round(1.0::double / count(*) over (), 6) as share from p where si = sj",
    "value_book": f"""with {_BARS}, {_WEEKLY},
h as (select symbol, floor(4000.0::double / arg_min(close, week)) as units from weekly group by symbol),
hh as (select * from h where units > 0),
v as (select week as date, sum(units * close) as value, count(*) as have from weekly join hh using (symbol) group by week),
st as (select min(date) as s from v where have = (select count(*) from hh))
select 'all' as book_id, date, round(value, 4) as value from v, st where date >= s""",
    "performance_metrics": f"""with {_BARS}, {_WEEKLY},
r0 as (select symbol as book_id, week as date, close / lag(close) over (partition by symbol order by week) - 1 as r from weekly),
c0 as (select week as date, avg(close) as c from weekly group by week),
b0 as (select date, c / lag(c) over (order by date) - 1 as b from c0),
j as (select r0.*, b from r0 left join b0 using (date) where r is not null),
g as (select *, product(1 + r) over (partition by book_id order by date rows between unbounded preceding and current row) as gr from j),
d as (select *, gr / greatest(1, max(gr) over (partition by book_id order by date rows between unbounded preceding and current row)) - 1 as dd from g),
q as (select *, quantile_cont(r, 0.05) over (partition by book_id) as v95 from d),
a as (
  select book_id, count(*) as n, product(1 + r) - 1 as total, avg(r) as mean, stddev_samp(r) as std, stddev_samp(case when r < 0 then r end) as down, min(dd) as mdd,
    any_value(v95) as v95, quantile_cont(r, 0.01) as v99, avg(case when r <= v95 then r end) as c95, avg(case when r > 0 then 1.0 else 0.0 end) as win, max(r) as best, min(r) as worst,
    skewness(r) as sk, kurtosis(r) as ku, sum(case when r > 0 then r end) as gains, sum(case when r < 0 then -r end) as losses,
    covar_samp(case when b is not null then r end, b) / var_samp(b) as beta, corr(r, b) as co, count(b) as np, stddev_samp(r - b) as te, avg(r - b) as act, product(1 + b) - 1 as bt, product(case when b is not null then 1 + r end) - 1 as pt,
    count(case when r > 0 then 1 end) as wins, count(case when r < 0 then 1 end) as losses_n, count(case when b > 0 then 1 end) as un, count(case when b < 0 then 1 end) as dn,
    product(case when b > 0 then 1 + r end) as ur, product(case when b > 0 then 1 + b end) as ub, product(case when b < 0 then 1 + r end) as dr, product(case when b < 0 then 1 + b end) as db,
    avg(case when b is not null then r end) as mp, avg(b) as mb
  from q group by book_id),
e as (select *, pow(1 + total, 52.0::double / n) - 1 as cagr, sqrt(52.0::double) as root, 0.045::double / 52 as daily from a)
select book_id, n, round(total, 6) as total_return, round(cagr, 6) as cagr, round(std * root, 6) as volatility, round(mdd, 6) as max_drawdown,
  round(case when std > 0 then (mean - daily) / std * root end, 6) as sharpe, round(case when down > 0 then (mean - daily) / down * root end, 6) as sortino,
  round(case when mdd < 0 then cagr / -mdd end, 6) as calmar, round(v95, 6) as var_95, round(v99, 6) as var_99, round(c95, 6) as cvar_95, round(win, 6) as win_rate,
  round(best, 6) as best, round(worst, 6) as worst, round(sk, 6) as skewness, round(ku, 6) as kurtosis,
  round(case when losses > 0 then coalesce(gains, 0) / losses end, 6) as profit_factor, np as n_paired, round(beta, 6) as beta, round(bt, 6) as benchmark_return,
  round(52 * (mp - daily - beta * (mb - daily)), 6) as alpha, round(pt - daily * np - beta * (bt - daily * np), 6) as alpha_period, round(co, 6) as correlation, round(co * co, 6) as r_squared, round(te * root, 6) as tracking_error,
  round(case when te > 0 then act / te * root end, 6) as info_ratio, round(case when abs(beta) > 0 then (mp - daily) * 52 / beta end, 6) as treynor,
  round(std, 6) as daily_volatility, wins as win_days, losses_n as lose_days,
  round(case when un > 0 then 100 * (pow(ur, 1.0::double / un) - 1) / (pow(ub, 1.0::double / un) - 1) end, 6) as up_capture,
  round(case when dn > 0 then 100 * (pow(dr, 1.0::double / dn) - 1) / (pow(db, 1.0::double / dn) - 1) end, 6) as down_capture
from e""",
}
