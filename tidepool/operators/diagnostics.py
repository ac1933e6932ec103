"""What a book is made of: risk of its holdings, and of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.allocation import risk_contributions
from tidepool.operators.returns import both_triangles


def book_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(book_id, date, r): returns of fixed weights on the dates of complete returns."""
    return returns.join(weights.select("book_id", "symbol", "weight"), ["book_id", "symbol"]).groupBy("book_id", "date").agg(F.sum(F.col("r") * F.col("weight")).alias("r"))


def holding_diagnostics(returns: DataFrame, weights: DataFrame, periods: int = 252, labels: DataFrame | None = None) -> DataFrame:
    """(book_id, symbol, weight, volatility, corr_to_book): annual volatility, and correlation with the book's own returns.

    With `labels` (book_id, symbol, cluster), also a holding's cluster.  A
    holding without returns, or without a label, stays with nulls there.
    """
    book = book_returns(returns, weights).withColumnRenamed("r", "_b")
    rows = returns.join(book, ["book_id", "date"]).groupBy("book_id", "symbol").agg((F.stddev_samp("r") * F.sqrt(F.lit(float(periods)))).alias("volatility"), F.corr("r", "_b").alias("corr_to_book"))
    out = weights.select("book_id", "symbol", "weight").join(rows, ["book_id", "symbol"], "left")
    return out if labels is None else out.join(labels.select("book_id", "symbol", "cluster"), ["book_id", "symbol"], "left")


def book_risk(pairs: DataFrame, weights: DataFrame, periods: int = 252) -> DataFrame:
    """(book_id, names, volatility, concentration, dispersion) of a book.

    Concentration is the largest risk share times the names: 1 if all are
    equal.  Dispersion is the population deviation of shares over their mean.
    """
    shares = risk_contributions(pairs, weights).groupBy("book_id").agg(
        F.count("*").alias("names"), (F.max("share") * F.count("*")).alias("concentration"), (F.stddev_pop("share") / F.avg("share")).alias("dispersion")
    )
    w = weights.select("book_id", "symbol", "weight")
    full = both_triangles(pairs.select("book_id", "si", "sj", "cov"))
    both = full.join(w.withColumnsRenamed({"symbol": "si", "weight": "wi"}), ["book_id", "si"]).join(w.withColumnsRenamed({"symbol": "sj", "weight": "wj"}), ["book_id", "sj"])
    variance = both.groupBy("book_id").agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov")).alias("_v"))
    return shares.join(variance, "book_id").select("book_id", "names", F.sqrt(F.greatest(F.lit(0.0), "_v") * periods).alias("volatility"), "concentration", "dispersion")


def book_stats(
    prices: DataFrame, covered: DataFrame, pairs: DataFrame, solved: DataFrame, book: DataFrame, requested: int, cap: float, capital: float, periods: int = 252
) -> DataFrame:
    """One row per book: what each stage had, what the book holds, and why it is short.

    `prices` (book_id, symbol, date, close), `covered` as by `coverage`,
    `pairs` as by `pair_moments`, `solved` weights before selection, `book` as
    by `size_positions`.  Every stage gives rows with its own tag, so one
    grouped sum takes all counts; no stage is run again for its figures.

    `left_out` maps names without coverage to it, `cause` of fewer positions
    than `requested` is `universe` where fewer names are covered, `weights`
    where fewer have a weight, else `prices` (unpriced, or dearer than their
    part of the capital).  Concentration is the largest risk share times the
    names, dispersion the population deviation of shares over their mean, of
    the solved weights and of the held ones.  Books without a row in a stage
    have zero counts and null figures there.
    """
    def tagged(rows: DataFrame, stage: str, value: Column | str, other: Column | None = None) -> DataFrame:
        return rows.select("book_id", F.lit(stage).alias("stage"), "symbol", F.col(value).cast("double").alias("x") if isinstance(value, str) else value.cast("double").alias("x"), (F.lit(None) if other is None else other).cast("double").alias("y"))

    held = book.where("units > 0")
    full = both_triangles(pairs.select("book_id", "si", "sj", "cov"))

    def shares(weights: DataFrame) -> DataFrame:
        """(book_id, symbol, c): parts of the book's variance, not yet over their sum."""
        w = weights.select("book_id", "symbol", "weight")
        rows = full.join(w.withColumnsRenamed({"symbol": "sj", "weight": "wj"}), ["book_id", "sj"]).groupBy("book_id", "si").agg(F.sum(F.col("cov") * F.col("wj")).alias("g"))
        return rows.withColumnRenamed("si", "symbol").join(w, ["book_id", "symbol"]).select("book_id", "symbol", (F.col("weight") * F.col("g")).alias("c"))

    own = pairs.where("si = sj").withColumnRenamed("si", "symbol")
    stages = [
        tagged(prices.where("close is not null").groupBy("book_id", "symbol").agg(F.max("date").alias("d")), "priced", F.lit(1.0)),
        tagged(covered, "covered", "coverage", F.when(F.col("kept"), 1.0).otherwise(0.0)), tagged(covered.where("kept"), "window", "obs", F.col("window")),
        tagged(own, "estimated", "n", F.col("cov")), tagged(solved, "solved", "weight"), tagged(shares(solved), "risk_solved", "c"),
        tagged(book, "sized", "weight"), tagged(held, "held", "value", F.col("weight")), tagged(shares(held), "risk_held", "c"),
    ]
    rows = stages[0]
    for more in stages[1:]:
        rows = rows.unionByName(more)

    def at(stage: str, column: str = "x") -> Column:
        return F.when(F.col("stage") == stage, F.col(column))

    def where(stage: str, test: Column) -> Column:
        return F.count(F.when((F.col("stage") == stage) & test, 1))

    x, y = F.col("x"), F.col("y")
    left_out = F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("stage") == "covered") & (y == 0), F.struct("symbol", "x")))))
    agg = rows.groupBy("book_id").agg(
        F.count(at("priced")).alias("names"), where("covered", y == 1).alias("covered"), left_out.alias("left_out"), F.max(at("window", "y")).cast("long").alias("window"),
        F.min(at("window")).cast("long").alias("least_obs"), F.max(at("estimated")).cast("long").alias("dates"), where("estimated", y > 0).alias("moving"),
        where("solved", x > 1e-9).alias("weighted"), F.count(at("sized")).alias("sized"), F.count(at("held")).alias("positions"), F.sum(at("held")).alias("deployed"),
        F.max(at("held", "y")).alias("max_weight"), F.max_by(F.when(F.col("stage") == "held", F.col("symbol")), F.struct(at("held", "y"), F.col("symbol"))).alias("largest"),
        *[f for side in ("solved", "held") for c in [at(f"risk_{side}")] for f in (
            F.sum(c).alias(f"_{side}"), (F.max(c) * F.count(c) / F.sum(c)).alias(f"concentration_{side}"), (F.stddev_pop(c) / F.avg(c)).alias(f"dispersion_{side}"))],
    )
    short = F.greatest(F.lit(0), F.lit(requested) - F.col("positions")).cast("long")
    cause = F.when(short == 0, "none").when(F.col("covered") < requested, "universe").when(F.col("weighted") < requested, "weights").otherwise("prices")
    volatility = F.sqrt(F.greatest(F.lit(0.0), F.col("_held")) * periods)
    return agg.select(
        "book_id", "names", "covered", (F.col("names") - F.col("covered")).alias("uncovered"), "left_out", "window", "least_obs", "dates", "moving", "weighted", "sized", "positions",
        F.lit(requested).cast("long").alias("requested"), short.alias("short"), cause.alias("cause"), F.when(F.col("sized") > 0, F.greatest(F.lit(float(cap)), 1 / F.col("sized"))).alias("effective_cap"),
        "max_weight", "largest", F.coalesce("deployed", F.lit(0.0)).alias("deployed"), (F.lit(float(capital)) - F.coalesce("deployed", F.lit(0.0))).alias("cash"), volatility.alias("volatility"),
        "concentration_solved", "dispersion_solved", "concentration_held", "dispersion_held",
    )


def cluster_matrix(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(book_id, i, j, si, sj, corr, boundary): correlations in the order of clusters; `boundary` marks rows that start one."""
    order = Window.partitionBy("book_id").orderBy("cluster", "symbol")
    at = labels.select(
        "book_id", "symbol", F.row_number().over(order).alias("n"), F.coalesce(F.col("cluster") != F.lag("cluster").over(order), F.lit(False)).alias("boundary")
    )
    full = both_triangles(pairs.select("book_id", "si", "sj", "corr"))
    rows = at.select("book_id", F.col("symbol").alias("si"), F.col("n").alias("i"), "boundary")
    columns = at.select("book_id", F.col("symbol").alias("sj"), F.col("n").alias("j"))
    return full.join(rows, ["book_id", "si"]).join(columns, ["book_id", "sj"]).select("book_id", "i", "j", "si", "sj", "corr", "boundary")


def equal_units(weights: DataFrame, prices: DataFrame, capital: float) -> DataFrame:
    """(book_id, symbol, units): whole units of an equal-weight book of the same names; no rows for a book with an unpriced name."""
    book = Window.partitionBy("book_id")
    rows = weights.select("book_id", "symbol").join(prices.select("symbol", "price"), "symbol", "left")
    good = F.coalesce(F.col("price") > 0, F.lit(False))
    rows = rows.withColumn("_all", F.min(good).over(book)).withColumn("units", F.floor(F.lit(float(capital)) / F.count("*").over(book) / F.col("price")).cast("long"))
    return rows.where("_all").select("book_id", "symbol", "units")
