"""Expressions over one series: a window partitioned by its key and ordered by date.

Frames count rows, not days.  A statistic of n rows is null unless all n values
are there.  All functions take the same window, so that Spark sorts a table
once for any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 128


def series(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def full(aggregate: Column, x: Column, w: WindowSpec, n: int) -> Column:
    return F.when(F.count(x).over(last_rows(w, n)) == n, aggregate.over(last_rows(w, n)))


def moving_average(x: Column, w: WindowSpec, n: int) -> Column:
    return full(F.avg(x), x, w, n)


def moving_std(x: Column, w: WindowSpec, n: int) -> Column:
    return full(F.stddev_samp(x), x, w, n)


def rolling_zscore(x: Column, w: WindowSpec, n: int = 20) -> Column:
    """Distance from the mean of n rows in their sample deviations; a deviation of 0 counts as 1."""
    std = moving_std(x, w, n)
    return (x - moving_average(x, w, n)) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def ffill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(so_far(w))


def ffill_bounded(x: Column, w: WindowSpec, limit: int = 5) -> Column:
    """The last value, carried over the first `limit` rows of a gap."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(-limit, 0))


def pct_change(x: Column, w: WindowSpec, pad: bool = False) -> Column:
    """x over its last row's value less 1; with `pad`, gaps are filled first."""
    if not pad:
        return x / F.lag(x).over(w) - 1
    before = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return ffill(x, w) / before - 1


def drawdown(growth: Column, w: WindowSpec) -> Column:
    """Distance of a growth line below its running maximum, as a share of it."""
    peak = F.max(growth).over(so_far(w))
    return (growth - peak) / peak


def rebase(x: Column, w: WindowSpec, base: float = 100.0) -> Column:
    first = F.first(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return x / first * base


def rolling_slope(y: Column, position: Column, w: WindowSpec, n: int = 10) -> Column:
    """The least-squares slope of y against row positions over n rows."""
    return F.when(F.count(y).over(last_rows(w, n)) == n, F.regr_slope(y, position).over(last_rows(w, n)))


def with_ewm(df: DataFrame, keys: list[str], means: dict[str, tuple[str, float]], order: str = "date", least: int = 1) -> DataFrame:
    """`df` with exponentially weighted means: name -> (column, alpha).

    The mean at a row is the sum of (1 - alpha) ** age times value over the sum
    of those weights, over all earlier values; nulls age the weights and show
    the carried mean; before `least` values the mean is null.

    Rows are cut into chunks of CHUNK; within one, running sums of values over
    their weight stay far from overflow, and what earlier chunks carry in is a
    decayed running sum of their totals, by lags of 1, 2, 4, ... chunks until a
    weight is 0 as a double.  So the whole past counts, each row costs about the
    same for any alpha, and one sort by key and order serves all means.
    """
    w = series(*keys, order=order)
    rows = df.withColumn("_pos", F.row_number().over(w) - 1)
    rows = rows.withColumn("_chunk", F.floor(F.col("_pos") / CHUNK)).withColumn("_off", F.pmod(F.col("_pos"), F.lit(CHUNK)).cast("double"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    totals, sums = [], []
    for name, (column, alpha) in means.items():
        g, x = F.lit(1 - alpha), F.col(column)
        seen = F.when(x.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
        value = F.coalesce(x, F.lit(0.0))
        for part, v in (("n", value), ("d", seen)):
            totals.append(F.sum(v * F.pow(g, CHUNK - 1 - F.col("_off"))).alias(f"_{part}_{name}"))
            sums.append((f"_l{part}_{name}", F.pow(g, F.col("_off")) * F.sum(v / F.pow(g, F.col("_off"))).over(inside)))
        sums.append((f"_c_{name}", F.sum(seen).over(so_far(w))))
    chunks = rows.groupBy(*keys, "_chunk").agg(*totals)
    cw = series(*keys, order="_chunk")
    totalled = {f"_{p}_{name}": (1 - alpha) ** CHUNK for name, (_, alpha) in means.items() for p in ("n", "d")}
    for step in (2**k for k in range(31)):
        weighed = {c: g**step for c, g in totalled.items() if g**step > 0}
        if not weighed:
            break
        chunks = chunks.withColumns({c: F.col(c) + F.coalesce(F.lag(c, step).over(cw), F.lit(0.0)) * g for c, g in weighed.items()})
    carried = [F.coalesce(F.lag(c).over(cw), F.lit(0.0)).alias(f"_k{c[1:]}") for c in totalled]
    chunks = chunks.select(*keys, "_chunk", *carried)
    rows = rows.withColumns(dict(sums)).join(chunks, [*keys, "_chunk"])
    out = {}
    for name, (column, alpha) in means.items():
        n, d = (F.col(f"_l{p}_{name}") + F.pow(F.lit(1 - alpha), F.col("_off") + 1) * F.col(f"_k{p}_{name}") for p in ("n", "d"))
        out[name] = F.last(F.when(F.col(column).isNotNull() & (F.col(f"_c_{name}") >= least), n / d), ignorenulls=True).over(so_far(w))
    return rows.withColumns(out).select(*df.columns, *means)


def with_rsi(df: DataFrame, keys: list[str], column: str = "close", period: int = 14, name: str = "rsi") -> DataFrame:
    """`df` with Wilder's relative strength index.

    The first row counts as one without gain or loss; null before `period`
    rows; 100 without losses; null without either.
    """
    move = F.col(column) - F.lag(column).over(series(*keys))
    rows = df.withColumn("_up", F.coalesce(F.greatest(move, F.lit(0.0)), F.lit(0.0))).withColumn("_down", F.coalesce(F.greatest(-move, F.lit(0.0)), F.lit(0.0)))
    rows = with_ewm(rows, keys, {"_gain": ("_up", 1 / period), "_loss": ("_down", 1 / period)}, least=period)
    value = F.when(F.col("_loss") > 0, 100 - 100 / (1 + F.col("_gain") / F.col("_loss"))).when(F.col("_gain") > 0, F.lit(100.0))
    return rows.withColumn(name, value).select(*df.columns, name)
