"""Returns by book and symbol: coverage, complete cases, covariances of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.series import pct_change


def tail_dates(rows: DataFrame, n: int, key: str = "book_id", order: str = "date") -> DataFrame:
    """The rows of each book's last n dates; only distinct dates are ranked."""
    dates = rows.select(key, order).distinct()
    last = dates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= n)
    return rows.join(last.select(key, order), [key, order], "left_semi")


def returns_of(prices: DataFrame, pad: bool = True, order: str | None = None) -> DataFrame:
    """(book_id, symbol, date, r) from (book_id, symbol, date, close).

    Of several prices of a symbol on a date the last by column `order` counts,
    without one the highest; both steps share one sort.
    """
    w = Window.partitionBy("book_id", "symbol").orderBy("date", *([order] if order else []), "close")
    single = prices.withColumn("_next", F.lead("date").over(w)).where("_next is null or _next <> date")
    return single.select("book_id", "symbol", "date", pct_change(F.col("close"), w, pad).alias("r"))


def coverage(returns: DataFrame, least: float = 0.8) -> DataFrame:
    """(book_id, symbol, obs, window, coverage, kept): share of the window's dates on which a symbol has a return."""
    dates = returns.groupBy("book_id").agg(F.count_distinct("date").alias("window"))
    counts = returns.groupBy("book_id", "symbol").agg(F.count("r").alias("obs"))
    share = F.col("obs") / F.col("window")
    return counts.join(dates, "book_id").select("book_id", "symbol", "obs", "window", share.alias("coverage"), (share >= least).alias("kept"))


def complete_cases(returns: DataFrame, covered: DataFrame) -> DataFrame:
    """Returns of kept symbols on the dates on which all of them have one: columns go before rows."""
    kept = covered.where("kept").select("book_id", "symbol")
    rows = returns.join(kept, ["book_id", "symbol"], "left_semi").where("r is not null")
    many = kept.groupBy("book_id").agg(F.count("*").alias("_names"))
    dates = rows.groupBy("book_id", "date").agg(F.count("*").alias("_have")).join(many, "book_id").where("_have = _names").select("book_id", "date")
    return rows.join(dates, ["book_id", "date"], "left_semi")


def returns_matrix(prices: DataFrame, lookback: int = 252, least: float = 0.8, order: str | None = None) -> DataFrame:
    """Complete-case returns of each book's last `lookback` dates; of several prices of a date the last by `order` counts."""
    recent = tail_dates(returns_of(prices, order=order), lookback)
    return complete_cases(recent, coverage(recent, least))


def pair_moments(returns: DataFrame) -> DataFrame:
    """(book_id, si, sj, n, cov, corr, sq, iij, ijj) for si <= sj of complete returns; one date alone has no covariance.

    Of centred returns x and y, `sq` is the sum of (x * y) ** 2, `iij` of
    x ** 3 * y, and `ijj` of x * y ** 3.  The self-join is
    an equi-join on book and date, so each date's names meet in one place, and
    sums are partial before the shuffle by pair.
    """
    means = returns.groupBy("book_id", "symbol").agg(F.avg("r").alias("_m"))
    x = returns.join(means, ["book_id", "symbol"]).select("book_id", "date", "symbol", (F.col("r") - F.col("_m")).alias("x"))
    a, b = (x.select("book_id", "date", F.col("symbol").alias(s), F.col("x").alias(v)) for s, v in (("si", "xi"), ("sj", "xj")))
    p = F.col("xi") * F.col("xj")
    sums = a.join(b, ["book_id", "date"]).where("si <= sj").groupBy("book_id", "si", "sj").agg(
        F.count("*").alias("n"), F.sum(p).alias("_p"), F.sum(F.col("xi") * F.col("xi")).alias("_i"), F.sum(F.col("xj") * F.col("xj")).alias("_j"), F.sum(p * p).alias("sq"),
        F.sum(F.col("xi") * F.col("xi") * p).alias("iij"), F.sum(F.col("xj") * F.col("xj") * p).alias("ijj"),
    )
    corr = F.when((F.col("_i") > 0) & (F.col("_j") > 0), F.col("_p") / F.sqrt(F.col("_i") * F.col("_j"))).otherwise(F.lit(0.0))
    return sums.select("book_id", "si", "sj", "n", F.when(F.col("n") > 1, F.col("_p") / (F.col("n") - 1)).alias("cov"), corr.alias("corr"), "sq", "iij", "ijj")


def both_triangles(pairs: DataFrame) -> DataFrame:
    mirrored = pairs.where("si < sj").select("book_id", F.col("sj").alias("si"), F.col("si").alias("sj"), *[c for c in pairs.columns if c not in ("book_id", "si", "sj")])
    return pairs.unionByName(mirrored)


def shrunk_covariance(pairs: DataFrame) -> DataFrame:
    """(book_id, si, sj, shrinkage, cov) shrunk towards constant correlation.

    Ledoit and Wolf, "Honey, I shrunk the sample covariance matrix" (2004).
    Target: own variances, and the mean correlation for all pairs.  Intensity:
    the summed sampling variance of the entries, less their summed covariance
    with the target's, over the squared distance of both, by the number of
    rows, between 0 and 1.
    """
    s = pairs.withColumn("s", F.col("cov") * (F.col("n") - 1) / F.col("n"))
    own = s.where("si = sj").select("book_id", F.col("si").alias("name"), F.col("s").alias("v"))
    s = s.join(own.select("book_id", F.col("name").alias("si"), F.col("v").alias("vi")), ["book_id", "si"]).join(own.select("book_id", F.col("name").alias("sj"), F.col("v").alias("vj")), ["book_id", "sj"])
    mean = s.where("si < sj").groupBy("book_id").agg(F.avg("corr").alias("_rho"))
    s = s.join(mean, "book_id", "left").withColumn("target", F.when(F.col("si") == F.col("sj"), F.col("s")).otherwise(F.col("_rho") * F.sqrt(F.col("vi") * F.col("vj"))))
    twice = F.when(F.col("si") == F.col("sj"), 1.0).otherwise(2.0)
    phi = F.sum(twice * (F.col("sq") / F.col("n") - F.col("s") * F.col("s")))
    own_part = F.col("sq") / F.col("n") - F.col("s") * F.col("s")
    ratio = F.when((F.col("vi") > 0) & (F.col("vj") > 0), F.sqrt(F.col("vj") / F.col("vi")))
    moved = ratio * (F.col("iij") / F.col("n") - F.col("vi") * F.col("s")) + (F.col("ijj") / F.col("n") - F.col("vj") * F.col("s")) / ratio
    rho = F.sum(F.when(F.col("si") == F.col("sj"), own_part).otherwise(F.coalesce(F.col("_rho") * moved, F.lit(0.0))))
    gamma = F.sum(twice * (F.col("s") - F.col("target")) * (F.col("s") - F.col("target")))
    level = s.groupBy("book_id").agg((phi - rho).alias("_phi"), gamma.alias("_gamma"), F.max("n").alias("_t"))
    level = level.select("book_id", F.when(F.col("_gamma") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_phi") / (F.col("_gamma") * F.col("_t"))))).otherwise(F.lit(0.0)).alias("shrinkage"))
    return s.join(level, "book_id").select("book_id", "si", "sj", "shrinkage", (F.col("shrinkage") * F.col("target") + (1 - F.col("shrinkage")) * F.col("s")).alias("cov"))


def correlation_distance(pairs: DataFrame) -> DataFrame:
    """(book_id, si, sj, dist): the root of half of 1 less the correlation, 0 to oneself."""
    d = F.when(F.col("si") == F.col("sj"), F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), 0.5 * (1 - F.col("corr")))))
    return pairs.select("book_id", "si", "sj", d.alias("dist"))


def momentum(prices: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """(book_id, symbol, momentum): the price `skip` dates ago over that of `lookback` dates before, by the book's calendar."""
    dates = prices.select("book_id", "date").distinct().withColumn("_back", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("date"))) - 1)
    at = prices.join(dates.where(F.col("_back").isin(skip, skip + lookback)), ["book_id", "date"])
    out = at.groupBy("book_id", "symbol").agg(F.max(F.when(F.col("_back") == skip, F.col("close"))).alias("_new"), F.max(F.when(F.col("_back") == skip + lookback, F.col("close"))).alias("_old"))
    names = prices.select("book_id", "symbol").distinct()
    return names.join(out, ["book_id", "symbol"], "left").select("book_id", "symbol", F.when(F.col("_old") > 0, F.col("_new") / F.col("_old") - 1).alias("momentum"))


def rank_z(rows: DataFrame, column: str, name: str = "z", key: str = "book_id") -> DataFrame:
    """Average ranks as standard scores of a uniform distribution; null scores 0, and all do if fewer than two have a value."""
    x = F.col(column)
    have = F.count(x).over(Window.partitionBy(key))
    ties = F.count("*").over(Window.partitionBy(key, column))
    rank = F.rank().over(Window.partitionBy(key).orderBy(x.asc_nulls_last())) + (ties - 1) / 2
    z = ((rank - 0.5) / have - 0.5) * F.sqrt(F.lit(12.0))
    return rows.withColumn(name, F.when(x.isNull() | (have < 2), F.lit(0.0)).otherwise(z))
