"""Daily bars: (symbol, date, open, high, low, close, volume), unique by symbol and date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")


def number(x: Column) -> Column:
    """A finite double, or null: text that is no number, NaN and infinities are null."""
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def load_bars(bars: DataFrame, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The bars of some symbols in an inclusive range of dates, as numbers; rows without close or volume go.

    The filters on symbol and date come first, so that they reach the scan.
    """
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(*symbols))
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    return bars.select("symbol", "date", *[number(F.col(c)).alias(c) for c in FIELDS]).dropna(subset=["close", "volume"])


def benchmark_series(bars: DataFrame, symbol: str) -> DataFrame:
    """(date, close) of one symbol, where it has a close: the calendar that books are valued on."""
    return bars.where(F.col("symbol") == symbol).select("date", number(F.col("close")).alias("close")).dropna(subset=["close"])


def panel_from_wide(wide: DataFrame, separator: str = "|") -> DataFrame:
    """Long bars from a table with a column `date` and one column `field|symbol` for each series."""
    values = [c for c in wide.columns if c != "date"]
    long = wide.unpivot("date", values, "name", "value")
    parts = F.split("name", f"[{separator}]", 2)
    long = long.select("date", parts[0].alias("field"), parts[1].alias("symbol"), number(F.col("value")).alias("value"))
    return long.groupBy("symbol", "date").agg(*[F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in FIELDS])


def bars_of_prints(prints: DataFrame, *order: str) -> DataFrame:
    """Daily bars of prints (symbol, date, price, quantity, and columns that order them).

    One shuffle on symbol and date, with partial minima and maxima before it.
    """
    at = F.struct(*order)
    return prints.groupBy("symbol", "date").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"),
    )


PRINT_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")


def line_item_prints(spark: SparkSession, sf_dir: str, by_nation: bool = False) -> DataFrame:
    """Every line item as a print of its part's brand (or brand and supplier's nation) on its shipping date."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*PRINT_ORDER, "l_shipdate")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_retailprice")
    both = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    symbol = F.col("p_brand")
    if by_nation:
        suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
        both = both.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        symbol = F.concat_ws("|", "p_brand", F.col("s_nationkey").cast("string"))
    return both.select(
        symbol.alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("price"),
        F.col("l_quantity").cast("double").alias("quantity"), *PRINT_ORDER,
    )


def daily_bars(spark: SparkSession, sf_dir: str, by_nation: bool = False) -> DataFrame:
    return bars_of_prints(line_item_prints(spark, sf_dir, by_nation), *PRINT_ORDER)
