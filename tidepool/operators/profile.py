"""Rolling volume profile: where in the price range the volume of recent bars lies.

For each bar, the range of the last `window` bars is cut into `bins` equal
bins; each bar's volume is spread evenly over the bins between its low and
high.  The point of control is the centre of the fullest bin; the value area
grows from it to the heavier neighbour, upwards where equal, until it holds
the share `area` of all volume.

A symbol's bars are cut into slices of consecutive bars, each with the bars
before it that its first windows reach back to, so the work of one symbol is
spread, too, and a bar is moved once or twice.  In a slice, a bar's part of a
histogram is two edges of a step function, added up for all windows at once.
Parts are whole numbers of 1e-12 of the volume, so that sums taken in
different orders find the same fullest bin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.series import series

UNIT = 1e12


def profile_windows(low: np.ndarray, high: np.ndarray, volume: np.ndarray, bins: int, area: float) -> np.ndarray:
    """(poc, val, vah) of each window, a row of bars; NaN without a range or volume."""
    rows = len(low)
    seen = ~(np.isnan(low) & np.isnan(high)).all(axis=1)
    lo = np.where(np.isnan(low), np.inf, low).min(axis=1)
    hi = np.where(np.isnan(high), -np.inf, high).max(axis=1)
    total = np.nansum(volume, axis=1)
    good = seen & (hi > lo) & np.isfinite(hi - lo) & (total > 0)
    step = np.where(good, hi - lo, 1.0) / bins
    low_edge = np.where(good, lo, 0.0)

    def bin_of(x: np.ndarray) -> np.ndarray:
        at = np.floor((x - low_edge[:, None]) / step[:, None])
        return np.clip(np.nan_to_num(at), 0, bins - 1).astype(np.int64)

    a, z = bin_of(low), bin_of(high)
    part = np.rint(volume / np.where(good, total, 1.0)[:, None] / (z - a + 1) * UNIT)
    counted = good[:, None] & ~np.isnan(low) & ~np.isnan(high) & ~np.isnan(volume)
    row = np.broadcast_to(np.arange(rows)[:, None], low.shape)[counted] * (bins + 1)
    # sums stay far below 2 ** 53, so they are exact
    edges = np.bincount(row + a[counted], part[counted], rows * (bins + 1)) - np.bincount(row + z[counted] + 1, part[counted], rows * (bins + 1))
    hist = np.cumsum(edges.reshape(rows, bins + 1), axis=1)[:, :bins]
    every = np.arange(rows)
    p = hist.argmax(axis=1)
    first, last, got = p.copy(), p.copy(), hist[every, p]
    for _ in range(bins - 1):
        grow = (got < area * UNIT) & ((first > 0) | (last < bins - 1))
        if not grow.any():
            break
        above, below = hist[every, np.minimum(last + 1, bins - 1)], hist[every, np.maximum(first - 1, 0)]
        up = (first == 0) | ((last < bins - 1) & (above >= below))
        got = got + np.where(grow, np.where(up, above, below), 0)
        last, first = last + (grow & up), first - (grow & ~up)
    out = np.stack((lo + (p + 0.5) * step, lo + first * step, lo + (last + 1) * step), axis=1)
    out[~good] = np.nan
    return out


def volume_profile(bars: DataFrame, window: int = 90, bins: int = 60, area: float = 0.7, slice_bars: int = 1000) -> DataFrame:
    """(symbol, date, poc, val, vah) for every bar with a full window; null without a range or volume.

    Bars without high or low are in no bin, but count in the volume.
    """
    size = max(slice_bars, window)
    k = F.row_number().over(series("symbol")) - 1
    rows = bars.select("symbol", "date", *[F.col(c).cast("double").alias(c) for c in ("low", "high", "volume")], k.alias("k"))
    own = F.floor(F.col("k") / size)
    reached = F.when(F.pmod(F.col("k"), F.lit(size)) > size - window, F.array(own, own + 1)).otherwise(F.array(own))
    sliced = rows.withColumn("slice", F.explode(reached))

    def profiles(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        low, high, volume = (pdf[c].to_numpy(dtype=float) for c in ("low", "high", "volume"))
        ends = np.flatnonzero((pdf["k"].to_numpy() // size == pdf["slice"].to_numpy()) & (np.arange(len(pdf)) >= window - 1))
        out = pdf.iloc[ends][["symbol", "date"]].reset_index(drop=True)
        found = np.empty((0, 3))
        if ends.size:
            found = profile_windows(*(np.lib.stride_tricks.sliding_window_view(x, window)[ends - window + 1] for x in (low, high, volume)), bins, area)
        return out.assign(poc=found[:, 0], val=found[:, 1], vah=found[:, 2])

    kinds = dict(rows.dtypes)
    return sliced.groupBy("symbol", "slice").applyInPandas(profiles, f"symbol {kinds['symbol']}, date {kinds['date']}, poc double, val double, vah double")
