"""Estimates of many books on many as-of dates at once.

A book's window on an as-of date is its last dates up to it.  The bounds of all
windows cut the calendar into segments; products of pairs are summed once by
segment, running sums over segments turn them into sums up to each bound, and a
window's sums are the difference of two of them.  So a hundred as-of dates cost
one join of pairs, not a hundred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.returns import returns_of
from tidepool.sources.scratch import materialise

#: Sums of x ** a * y ** b that central moments of pairs are made of.
_POWERS = ((1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (2, 1), (1, 2), (3, 0), (0, 3), (2, 2), (3, 1), (1, 3))
_SUMS = ["_n", *(f"_s{a}{b}" for a, b in _POWERS)]


def book_at(book: str | Column = "book_id", date: str | Column = "as_of") -> Column:
    """The name of a book on a date: `book@date`."""
    return F.concat_ws("@", book, F.date_format(date, "yyyy-MM-dd"))


def windows(calendar: DataFrame, as_of: DataFrame, lookback: int) -> DataFrame:
    """(book_id, as_of, first, last): the places, from 1 and inclusive, of each window in its book's calendar (book_id, date, place).

    `as_of` has (book_id, as_of); a date before the calendar's first has no window.
    """
    dates = calendar.select("book_id", "date", "place", F.lit(None).cast("date").alias("as_of")).unionByName(
        as_of.select("book_id", F.col("as_of").alias("date"), F.lit(None).cast("int").alias("place"), "as_of").distinct()
    )
    upto = Window.partitionBy("book_id").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = dates.withColumn("last", F.max("place").over(upto)).where("as_of is not null and last is not null")
    return found.select("book_id", "as_of", F.greatest(F.lit(1), F.col("last") - lookback + 1).alias("first"), "last")


def _products(returns: DataFrame, *by: str) -> DataFrame:
    """Sums of powers of the returns (r, symbol) of each pair si <= sj that share `by` and a date."""
    on = [*dict.fromkeys([*by, "book_id", "date"])]
    a, b = (returns.select(*on, F.col("symbol").alias(s), F.col("r").alias(x)) for s, x in (("si", "x"), ("sj", "y")))
    x, y = F.col("x"), F.col("y")
    power = {0: lambda v: None, 1: lambda v: v, 2: lambda v: v * v, 3: lambda v: v * v * v}

    def term(p: int, q: int) -> Column:
        parts = [c for c in (power[p](x), power[q](y)) if c is not None]
        return parts[0] * parts[1] if len(parts) > 1 else parts[0]

    sums = [F.sum(term(p, q)).alias(f"_s{p}{q}") for p, q in _POWERS]
    return a.join(b, on).where("si <= sj").groupBy(*by, "si", "sj").agg(F.count("*").cast("double").alias("_n"), *sums)


def _central(sums: DataFrame) -> DataFrame:
    """The columns of `pair_moments` from sums of powers."""
    n = F.col("_n")
    s = {(a, b): F.col(f"_s{a}{b}") for a, b in _POWERS}
    a, b = s[1, 0] / n, s[0, 1] / n
    xx, yy, xy = s[2, 0] - n * a * a, s[0, 2] - n * b * b, s[1, 1] - n * a * b
    # what rounding leaves of a series that does not move is no variance
    moves = (xx > 1e-12 * s[2, 0]) & (yy > 1e-12 * s[0, 2])
    sq = s[2, 2] - 2 * b * s[2, 1] - 2 * a * s[1, 2] + b * b * s[2, 0] + a * a * s[0, 2] + 4 * a * b * s[1, 1] - 3 * n * a * a * b * b
    iij = s[3, 1] - 3 * a * s[2, 1] + 3 * a * a * s[1, 1] - a * a * a * s[0, 1] - b * (s[3, 0] - 3 * a * s[2, 0] + 3 * a * a * s[1, 0] - n * a * a * a)
    ijj = s[1, 3] - 3 * b * s[1, 2] + 3 * b * b * s[1, 1] - b * b * b * s[1, 0] - a * (s[0, 3] - 3 * b * s[0, 2] + 3 * b * b * s[0, 1] - n * b * b * b)
    zero = F.lit(0.0)
    return sums.where("_n > 0").select(
        "book_id", "as_of", "si", "sj", n.cast("long").alias("n"), F.when(n > 1, F.when((F.col("si") != F.col("sj")) | moves, xy / (n - 1)).otherwise(zero)).alias("cov"),
        F.when(moves, xy / F.sqrt(xx * yy)).otherwise(zero).alias("corr"), F.when(moves, sq).otherwise(zero).alias("sq"),
        F.when(moves, iij).otherwise(zero).alias("iij"), F.when(moves, ijj).otherwise(zero).alias("ijj"),
    )


def pair_moments_by_date(prices: DataFrame, as_of: DataFrame, lookback: int = 252, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, coverage) of each book of `prices` on each date of `as_of` (book_id, as_of).

    `pairs` has (book_id, as_of, si, sj, n, cov, corr, sq, iij, ijj): what
    `pair_moments(returns_matrix(...))` gives for the prices up to the date.
    `coverage` has (book_id, as_of, symbol, obs, window, coverage, kept).  Names
    kept on a date but without a return on some day of its window are few; the
    products of such days are taken off again.  As-of dates before the first
    price have no rows.
    """
    rows = materialise(returns_of(prices))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("date"))
    calendar = rows.select("book_id", "date").distinct().withColumn("place", place)
    spans = materialise(windows(calendar, as_of, lookback))
    # a segment ends where a window ends or the day before one begins
    ends = spans.select("book_id", F.col("last").alias("end")).unionByName(spans.select("book_id", (F.col("first") - 1).alias("end"))).where("end > 0").distinct()
    marks = calendar.join(ends.withColumnRenamed("end", "place"), ["book_id", "place"], "left_semi").select("book_id", "place", F.lit(1).alias("mark"))
    order = Window.partitionBy("book_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cut = calendar.join(marks, ["book_id", "place"], "left").withColumn("segment", F.coalesce(F.sum("mark").over(order), F.lit(0)).cast("int"))
    cut = materialise(cut.select("book_id", "date", "place", "segment"))
    last = cut.select("book_id", F.col("place").alias("last"), F.col("segment").alias("upto"))
    before = cut.select("book_id", (F.col("place") + 1).alias("first"), F.col("segment").alias("from_"))
    spans = spans.join(last, ["book_id", "last"]).join(before, ["book_id", "first"], "left").withColumn("from_", F.coalesce("from_", F.lit(-1)))
    spans = materialise(spans.withColumn("window", F.col("last") - F.col("first") + 1))

    present = materialise(rows.where("r is not null").join(cut, ["book_id", "date"]).select("book_id", "date", "symbol", "r", "segment"))
    counts = present.groupBy("book_id", "symbol", "segment").agg(F.count("*").alias("n"))
    names = rows.select("book_id", "symbol").distinct()
    seen = _differences(counts, names.join(spans.select("book_id", "as_of", "from_", "upto"), "book_id"), ["book_id", "symbol"], ["n"])
    share = F.col("obs") / F.col("window")
    covered = seen.withColumnRenamed("n", "obs").join(spans.select("book_id", "as_of", "window"), ["book_id", "as_of"])
    covered = materialise(covered.select("book_id", "as_of", "symbol", "obs", "window", share.alias("coverage"), (share >= least).alias("kept")))

    kept = covered.where("kept and obs > 0").select("book_id", "as_of", "symbol", (F.col("obs") < F.col("window")).alias("gaps"))
    used = present.join(kept.select("book_id", "symbol").distinct(), ["book_id", "symbol"], "left_semi")
    by_segment = _products(used, "book_id", "segment")
    a, b = (kept.select("book_id", "as_of", F.col("symbol").alias(s)) for s in ("si", "sj"))
    wanted = a.join(b, ["book_id", "as_of"]).where("si <= sj").join(spans.select("book_id", "as_of", "from_", "upto"), ["book_id", "as_of"])
    whole = _differences(by_segment, wanted, ["book_id", "si", "sj"], _SUMS)

    # days of a window on which a kept name has no return
    gappy = kept.where("gaps").join(spans.select("book_id", "as_of", "first", "last"), ["book_id", "as_of"])
    days = gappy.join(cut.select("book_id", "date", "place"), "book_id").where("place between first and last").select("book_id", "as_of", "symbol", "date")
    bad = days.join(present.select("book_id", "symbol", "date"), ["book_id", "symbol", "date"], "left_anti").select("book_id", "as_of", "date").distinct()
    off = bad.join(present, ["book_id", "date"]).join(kept.select("book_id", "as_of", "symbol"), ["book_id", "as_of", "symbol"], "left_semi")
    off = _products(off, "book_id", "as_of").select("book_id", "as_of", "si", "sj", *[(-F.col(c)).alias(c) for c in _SUMS])
    sums = whole.unionByName(off).groupBy("book_id", "as_of", "si", "sj").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return _central(sums), covered


def _differences(segments: DataFrame, wanted: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, as_of, values): sums over the segments after `from_` and up to `upto` of each row of `wanted`, 0 without any.

    Bounds stand among the segments as rows of their own, so that one running
    sum serves all of them; a window takes the sum at its end less that before it.
    """
    bounds = wanted.select(*key, "as_of", F.explode(F.array(F.struct(F.col("upto").alias("segment"), F.lit(1).alias("sign")), F.struct(F.col("from_").alias("segment"), F.lit(-1).alias("sign")))).alias("b"))
    nothing = [F.lit(0).cast(segments.schema[c].dataType).alias(c) for c in values]
    rows = segments.select(*key, F.lit(None).cast("date").alias("as_of"), "segment", F.lit(0).alias("sign"), *values).unionByName(
        bounds.select(*key, "as_of", "b.segment", "b.sign", *nothing)
    )
    running = Window.partitionBy(*key).orderBy("segment").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.withColumns({c: F.sum(c).over(running) for c in values}).where("sign <> 0")
    return sums.groupBy(*key, "as_of").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in values])


def prices_at(prices: DataFrame, as_of: DataFrame) -> DataFrame:
    """(book_id, as_of, symbol, price): the last close at or before each as-of date, where there is one."""
    names = prices.select("book_id", "symbol").distinct().join(as_of.select("book_id", "as_of").distinct(), "book_id")
    asked = names.select("book_id", "symbol", F.col("as_of").alias("date"), F.lit(None).cast("double").alias("close"), "as_of")
    rows = prices.select("book_id", "symbol", "date", "close", F.lit(None).cast("date").alias("as_of")).unionByName(asked)
    upto = Window.partitionBy("book_id", "symbol").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("price", F.last("close", ignorenulls=True).over(upto)).where("as_of is not null and price is not null")
    return found.select("book_id", "as_of", "symbol", "price")
