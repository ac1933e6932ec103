"""Values and returns of books, and their measures against a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_book(prices: DataFrame, holdings: DataFrame) -> DataFrame:
    """(book_id, date, value): units times close, from the first date on which every held name has a price."""
    held = holdings.where("units > 0").select("book_id", "symbol", "units")
    many = held.groupBy("book_id").agg(F.count("*").alias("_names"))
    by_date = prices.join(held, "symbol").groupBy("book_id", "date").agg(F.sum(F.col("units") * F.col("close")).alias("value"), F.count("close").alias("_have"))
    both = by_date.join(many, "book_id")
    start = both.where("_have = _names").groupBy("book_id").agg(F.min("date").alias("_start"))
    return both.join(start, "book_id").where("date >= _start and value is not null").select("book_id", "date", "value")


def value_on(prices: DataFrame, holdings: DataFrame, main: DataFrame) -> DataFrame:
    """(book_id, date, value) of other units of the books of `main` (book_id, date, ...), on the dates that it has."""
    held = holdings.where("units > 0").select("book_id", "symbol", "units")
    values = prices.join(held, "symbol").groupBy("book_id", "date").agg(F.sum(F.col("units") * F.col("close")).alias("value"))
    return values.where("value is not null").join(main.select("book_id", "date"), ["book_id", "date"], "left_semi").select("book_id", "date", "value")


def best_in_row(rows: DataFrame, key: str, name: str, value: str, higher: Column) -> DataFrame:
    """(key, best): the name with the best value of each key, the highest where `higher` holds, else the lowest.

    Null, NaN and infinite values don't compete; with fewer than two others
    there is no best; of equal ones the first name wins.
    """
    x = F.col(value)
    sound = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).withColumn("_x", F.when(higher, -x).otherwise(x))
    found = sound.groupBy(key).agg(F.when(F.count("*") >= 2, F.min_by(name, F.struct("_x", name))).alias("best"))
    return rows.select(key).distinct().join(found, key, "left").select(key, "best")


def performance_metrics(returns: DataFrame, benchmark: DataFrame, risk_free: float = 0.045, least_pairs: int = 2, periods: float = 252) -> DataFrame:
    """One row per book of measures of (book_id, date, r) against (date, b).

    Annual figures are of `periods` periods (52 for weekly returns).  Sharpe and Sortino ratios, value at
    risk by linear quantiles, mean loss beyond it, drawdown from the running
    peak, bias-corrected skewness and excess kurtosis, beta, correlation,
    tracking error and information ratio follow their textbook definitions;
    up and down capture are geometric mean returns over the benchmark's, in per
    cent, on the dates of its gains and losses.  What is undefined is null, as
    is what relates to the benchmark with fewer than `least_pairs` paired dates.
    Rows without a return are left out; a return of -1 is a total loss.
    `alpha_period` is what the book made on paired dates over the risk-free
    return and beta times the benchmark's over it, not annual.  Of several
    values of the benchmark on a date the largest counts.
    """
    rows = returns.where("r is not null").join(benchmark.groupBy("date").agg(F.max("b").alias("b")), "date", "left")
    w = Window.partitionBy("book_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_g", F.product(1 + F.col("r")).over(w))
    rows = rows.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_g").over(w)))
    rows = rows.withColumn("_paired", F.col("b").isNotNull())
    r, b = F.col("r"), F.when(F.col("_paired"), F.col("b"))
    rp = F.when(F.col("_paired"), r)
    n = F.count("*")
    agg = rows.groupBy("book_id").agg(
        n.alias("n"), F.product(1 + r).alias("_grown"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"), F.min(F.col("_g") / F.col("_peak") - 1).alias("max_drawdown"),
        F.percentile(r, F.lit(0.05)).alias("var_95"), F.percentile(r, F.lit(0.01)).alias("var_99"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.max(r).alias("best"), F.min(r).alias("worst"),
        F.skewness(r).alias("_g1"), F.kurtosis(r).alias("_g2"),
        F.sum(F.when(r > 0, r)).alias("_gains"), F.sum(F.when(r < 0, -r)).alias("_losses"),
        F.covar_samp(rp, b).alias("_cov"), F.var_samp(b).alias("_varb"), F.corr(rp, b).alias("correlation"), F.count(b).alias("n_paired"),
        F.stddev_samp(rp - b).alias("_te"), F.avg(rp - b).alias("_active"), F.product(1 + b).alias("_bgrown"), F.product(1 + rp).alias("_pgrown"), F.avg(rp).alias("_mp"), F.avg(b).alias("_mb"),
        F.count(F.when(r > 0, r)).alias("win_days"), F.count(F.when(r < 0, r)).alias("lose_days"),
        *[f(F.when(side, x)).alias(f"_{name}{x_name}") for name, side in (("up", b > 0), ("down", b < 0))
          for x_name, f, x in (("n", F.count, b), ("r", F.product, 1 + r), ("b", F.product, 1 + b))],
    )
    tail = rows.join(agg.select("book_id", "var_95"), "book_id").where("r <= var_95").groupBy("book_id").agg(F.avg("r").alias("cvar_95"))
    k = F.col("n").cast("double")
    root = F.sqrt(F.lit(float(periods)))
    daily = risk_free / periods
    beta = F.when((F.col("n_paired") >= least_pairs) & (F.col("_varb") > 0), F.col("_cov") / F.col("_varb"))
    cagr = F.when(F.col("_grown") >= 0, F.pow("_grown", periods / k) - 1)
    paired = F.col("n_paired") >= least_pairs

    def capture(side: str) -> Column:
        mine, its = (F.when(F.col(f"_{side}{x}") >= 0, F.pow(f"_{side}{x}", 1 / F.col(f"_{side}n")) - 1) for x in "rb")
        return F.when(paired & (F.col(f"_{side}n") > 0), 100 * mine / its)

    return agg.join(tail, "book_id", "left").select(
        "book_id", "n", (F.col("_grown") - 1).alias("total_return"), cagr.alias("cagr"), (F.col("std") * root).alias("volatility"), "max_drawdown",
        F.when(F.col("std") > 0, (F.col("mean") - daily) / F.col("std") * root).alias("sharpe"),
        F.when(F.col("_down") > 0, (F.col("mean") - daily) / F.col("_down") * root).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, cagr / -F.col("max_drawdown")).alias("calmar"),
        "var_95", "var_99", "cvar_95", "win_rate", "best", "worst",
        F.when(k > 2, F.col("_g1") * F.sqrt(k * (k - 1)) / (k - 2)).alias("skewness"),
        F.when(k > 3, ((k + 1) * F.col("_g2") + 6) * (k - 1) / ((k - 2) * (k - 3))).alias("kurtosis"),
        F.when(F.col("_losses") > 0, F.coalesce("_gains", F.lit(0.0)) / F.col("_losses")).alias("profit_factor"),
        "n_paired", beta.alias("beta"), (F.col("_bgrown") - 1).alias("benchmark_return"),
        (periods * (F.col("_mp") - daily - beta * (F.col("_mb") - daily))).alias("alpha"),
        (F.col("_pgrown") - 1 - daily * F.col("n_paired") - beta * (F.col("_bgrown") - 1 - daily * F.col("n_paired"))).alias("alpha_period"),
        F.when(paired, F.col("correlation")).alias("correlation"), F.when(paired, F.col("correlation") * F.col("correlation")).alias("r_squared"), F.when(paired, F.col("_te") * root).alias("tracking_error"),
        F.when(paired & (F.col("_te") > 0), F.col("_active") / F.col("_te") * root).alias("info_ratio"),
        F.when(F.abs(beta) > 0, (F.col("_mp") - daily) * periods / beta).alias("treynor"),
        F.col("std").alias("daily_volatility"), "win_days", "lose_days", capture("up").alias("up_capture"), capture("down").alias("down_capture"),
    )
