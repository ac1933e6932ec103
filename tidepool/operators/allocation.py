"""Long-only weights of many books at once, from pairs (book_id, si, sj, ...).

Each book's work is a few grouped sums; only linkage and the iterative solution
hold one book's matrix in a task, so they grow with the number of books and are
meant for up to about two thousand names a book.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepool.operators.returns import both_triangles, correlation_distance
from tidepool.sources.scratch import materialise


def _book() -> WindowSpec:
    return Window.partitionBy("book_id")


def equal_weights(names: DataFrame) -> DataFrame:
    """(book_id, symbol, weight): one over the book's names."""
    return names.select("book_id", "symbol").distinct().withColumn("weight", 1 / F.count("*").over(_book()))


def inverse_variance(pairs: DataFrame) -> DataFrame:
    """Weights by one over variance; names without variance get none, and if all are such, weights are equal."""
    own = pairs.where("si = sj").select("book_id", F.col("si").alias("symbol"), F.when(F.col("cov") > 0, 1 / F.col("cov")).otherwise(F.lit(0.0)).alias("_i"))
    total = F.sum("_i").over(_book())
    return own.select("book_id", "symbol", F.when(total > 0, F.col("_i") / total).otherwise(1 / F.count("*").over(_book())).alias("weight"))


def risk_contributions(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(book_id, symbol, share): each name's part of the book's variance; equal parts where there is none."""
    w = weights.select("book_id", "symbol", "weight")
    full = both_triangles(pairs.select("book_id", "si", "sj", "cov"))
    rows = full.join(w.withColumnsRenamed({"symbol": "sj", "weight": "wj"}), ["book_id", "sj"]).groupBy("book_id", "si").agg(F.sum(F.col("cov") * F.col("wj")).alias("_g"))
    rows = rows.withColumnRenamed("si", "symbol").join(w, ["book_id", "symbol"]).withColumn("_c", F.col("weight") * F.col("_g"))
    total = F.sum("_c").over(_book())
    return rows.select("book_id", "symbol", F.when(total > 0, F.col("_c") / total).otherwise(1 / F.count("*").over(_book())).alias("share"))


def momentum_tilt(weights: DataFrame, scores: DataFrame, strength: float = 0.5) -> DataFrame:
    """Weights times a score of z, made to sum to one: 1 + s for s = strength * z from 0 up, else 1 / (1 - s), as tilted indices do."""
    z = scores.select("book_id", "symbol", "z")
    s = strength * F.coalesce("z", F.lit(0.0))
    t = weights.join(z, ["book_id", "symbol"], "left").withColumn("_t", F.col("weight") * F.when(s >= 0, 1 + s).otherwise(1 / (1 - s)))
    total = F.sum("_t").over(_book())
    return t.select("book_id", "symbol", F.when(total > 0, F.col("_t") / total).otherwise(F.col("weight")).alias("weight"))


def select_top(weights: DataFrame, n: int) -> DataFrame:
    """The n largest weights of a book, by symbol where equal, made to sum to one."""
    order = Window.partitionBy("book_id").orderBy(F.desc("weight"), "symbol")
    top = weights.where("weight > 1e-9").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n)
    return top.select("book_id", "symbol", (F.col("weight") / F.sum("weight").over(_book())).alias("weight"))


def cap_weights(weights: DataFrame, cap: float) -> DataFrame:
    """Weights of at most `cap` (or equal parts, if that is more): the smaller of the cap and one common multiple of the weight.

    Names below the cap so keep their proportions.  From the largest weight
    down, a name is at the cap if the multiple that the names from it on would
    have takes it over; that multiple rises up to the last such name and falls
    after it, so one sorted window finds it.  If all names with a weight are at
    the cap, what is left goes to the others in equal parts.
    """
    down = _book().orderBy(F.desc("_b"), "symbol")
    w = weights.select("book_id", "symbol", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("_b"))
    w = w.withColumn("_top", F.greatest(F.lit(float(cap)), 1 / F.count("*").over(_book()))).select(
        "*", (F.row_number().over(down) - 1).alias("_k"), F.sum("_b").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_rest")
    )
    w = w.withColumn("_m", F.when(F.col("_b") > 0, F.greatest(1 - F.col("_k") * F.col("_top"), F.lit(0.0)) / F.col("_rest")))
    w = w.withColumn("_over", F.coalesce(F.col("_m") * F.col("_b") > F.col("_top"), F.lit(False)))
    free = F.max(F.when(~F.col("_over"), F.col("_m"))).over(_book())
    left = F.greatest(1 - F.sum(F.when(F.col("_over"), F.col("_top")).otherwise(F.lit(0.0))).over(_book()), F.lit(0.0))
    shared = F.when(free.isNotNull(), F.col("_b") * free).otherwise(left / F.sum(F.when(F.col("_b") > 0, 0).otherwise(1)).over(_book()))
    return w.select("book_id", "symbol", F.when(F.col("_over"), F.col("_top")).otherwise(shared).alias("weight"))


def size_positions(weights: DataFrame, prices: DataFrame, capital: float) -> DataFrame:
    """(book_id, symbol, price, weight, units, value): whole units of the names with a price over 0; prices may be by book, too."""
    on = [c for c in ("book_id", "symbol") if c in prices.columns]
    priced = weights.join(prices.where((F.col("price") > 0) & (F.col("price") < float("inf"))).select(*on, "price"), on)
    w = priced.withColumn("weight", F.col("weight") / F.sum("weight").over(_book()))
    units = F.floor(F.lit(float(capital)) * F.col("weight") / F.col("price"))
    return w.select("book_id", "symbol", "price", "weight", units.cast("long").alias("units"), (units * F.col("price")).alias("value"))


def _matrix(pdf: pd.DataFrame, value: str) -> tuple[list[str], np.ndarray]:
    names = sorted(set(pdf["si"]))
    at = {s: k for k, s in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    i, j = pdf["si"].map(at).to_numpy(), pdf["sj"].map(at).to_numpy()
    m[i, j] = m[j, i] = pdf[value].to_numpy()
    return names, m


def _spread(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Weights x of some of n names, made to sum to one; equal weights if there are none."""
    w = np.zeros(n)
    w[at] = x
    return w / w.sum() if at.size else np.full(n, 1 / max(n, 1))


def equal_risk_contributions(pairs: DataFrame, sweeps: int = 5000, tolerance: float = 1e-10) -> DataFrame:
    """Weights whose parts of the variance are equal, by cyclic coordinate descent.

    Each coordinate is the positive root of a quadratic, so weights stay
    positive; started from one over volatility, normalised at the end.  It ends
    when no name's part differs from an equal one by more than `tolerance` of
    it, or after `sweeps`.  `pairs` may be a sample or a shrunk covariance.  Names without variance get no
    weight, and if all are such, weights are equal.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, whole = _matrix(pdf, "cov")
        moving = np.flatnonzero(np.diag(whole) > 0)
        s, n = whole[np.ix_(moving, moving)], moving.size
        a = np.diag(s)
        x = 1 / np.sqrt(a)
        for _ in range(sweeps):
            # each part of the variance is 1 / n at the solution
            if not n or np.max(np.abs(n * x * (s @ x) - 1)) <= tolerance:
                break
            for i in range(n):
                b = s[i] @ x - s[i, i] * x[i]
                x[i] = (-b + np.sqrt(b * b + 4 * a[i] / n)) / (2 * a[i])
        return pd.DataFrame({"book_id": pdf["book_id"].iloc[0], "symbol": names, "weight": _spread(x, moving, len(names))})

    return pairs.select("book_id", "si", "sj", "cov").groupBy("book_id").applyInPandas(solve, "book_id string, symbol string, weight double")


def single_linkage_order(d: np.ndarray) -> list[int]:
    """The leaves of the single-linkage tree, left to right: at each merge the group with the first name goes first.

    The tree's merges are the edges of a minimum spanning tree by length, so n
    names take n * n steps; of equal edges those of the first names come first.
    """
    n = len(d)
    near, source, out = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        out[at] = False
        closer = out & (d[at] < near)
        near[closer], source[closer] = d[at][closer], at
        at = int(np.argmin(np.where(out, near, np.inf)))
        edges.append((near[at], min(at, source[at]), max(at, source[at])))
    group = list(range(n))
    leaves: dict[int, list[int]] = {i: [i] for i in range(n)}
    for _, i, j in sorted(edges):
        a, b = sorted((group[i], group[j]))
        for k in leaves[b]:
            group[k] = a
        leaves[a] += leaves.pop(b)
    return leaves.get(0, [])


def _halves(pos: str, names: str) -> Column:
    """The parts of recursive halving that hold place `pos` (from 0) of `names`, below the whole, with their sibling.

    Halving goes by place alone, so that all levels are known at once.
    """
    start = "named_struct('at', cast(0 as int), 'size', cast({n} as int), 'path', cast(array() as array<struct<at:int,size:int,other:int,others:int>>))"
    step = (
        "if(s.size < 2, s, if({p} - s.at < s.size div 2,"
        " named_struct('at', s.at, 'size', cast(s.size div 2 as int), 'path', concat(s.path, array(named_struct('at', s.at, 'size', cast(s.size div 2 as int),"
        " 'other', cast(s.at + s.size div 2 as int), 'others', cast(s.size - s.size div 2 as int))))),"
        " named_struct('at', cast(s.at + s.size div 2 as int), 'size', cast(s.size - s.size div 2 as int), 'path', concat(s.path, array(named_struct("
        " 'at', cast(s.at + s.size div 2 as int), 'size', cast(s.size - s.size div 2 as int), 'other', s.at, 'others', cast(s.size div 2 as int)))))))"
    )
    levels = f"sequence(1, 1 + cast(ceil(log2(greatest({names}, 2))) as int))"
    return F.expr(f"aggregate({levels}, {start.format(n=names)}, (s, k) -> {step.format(p=pos)}).path")


def hierarchical_risk_parity(pairs: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Weights by recursive halving of the single-linkage order of correlation distances, or of `order` (book_id, symbol, pos).

    The halves share their parent's weight by the variance of the other's
    inverse-variance portfolio.  Names without variance get no weight, and if
    all are such, weights are equal.  All books and all levels go in one plan:
    a part's variance is a grouped sum over the pairs that lie in it (a pair
    lies in about one part below the whole), and a name's weight the product
    of its parts' shares.  Only the linkage holds a book's distances in a task.
    """
    pairs = materialise(pairs.select("book_id", "si", "sj", "cov", "corr"))
    own = pairs.where("si = sj").select("book_id", F.col("si").alias("symbol"), F.when(F.col("cov") > 0, F.col("cov")).alias("v"))
    moving = own.where("v is not null")
    if order is None:
        a, b = (moving.select("book_id", F.col("symbol").alias(s)) for s in ("si", "sj"))
        order = leaf_order(correlation_distance(pairs.join(a, ["book_id", "si"], "left_semi").join(b, ["book_id", "sj"], "left_semi")))
    placed = moving.join(order.select("book_id", "symbol", "pos"), ["book_id", "symbol"])
    by_place = Window.partitionBy("book_id").orderBy("pos", "symbol")
    placed = placed.withColumn("_at", F.row_number().over(by_place) - 1).withColumn("_n", F.count("*").over(_book()))
    placed = materialise(placed.select("book_id", "symbol", "v", _halves("_at", "_n").alias("path")))

    i, j = (placed.select("book_id", F.col("symbol").alias(s), F.col("v").alias(f"v{s}"), F.col("path").alias(f"path{s}")) for s in ("si", "sj"))
    inner = pairs.join(i, ["book_id", "si"]).join(j, ["book_id", "sj"])
    part = F.when(F.col("si") == F.col("sj"), 1.0).otherwise(2.0) * F.col("cov") / (F.col("vsi") * F.col("vsj"))
    inner = inner.select("book_id", part.alias("m"), F.explode(F.array_intersect("pathsi", "pathsj")).alias("part"))
    among = inner.groupBy("book_id", "part.at", "part.size").agg(F.sum("m").alias("m"))
    steps = placed.select("book_id", "symbol", "v", F.explode("path").alias("part"))
    total = steps.groupBy("book_id", "part.at", "part.size").agg(F.sum(1 / F.col("v")).alias("i"))
    variance = materialise(among.join(total, ["book_id", "at", "size"]).select("book_id", "at", "size", (F.col("m") / (F.col("i") * F.col("i"))).alias("variance")))
    mine = steps.select("book_id", "symbol", "part.*").join(variance, ["book_id", "at", "size"])
    other = variance.select("book_id", F.col("at").alias("other"), F.col("size").alias("others"), F.col("variance").alias("its"))
    both = F.col("variance") + F.col("its")
    share = F.when(both > 0, F.col("its") / both).otherwise(F.lit(0.5))
    solved = mine.join(other, ["book_id", "other", "others"]).groupBy("book_id", "symbol").agg(F.product(share).alias("_w"))
    # a book's only name that moves has no parts
    rows = own.join(solved, ["book_id", "symbol"], "left").withColumn("_w", F.when(F.col("v").isNull(), 0.0).otherwise(F.coalesce("_w", F.lit(1.0))))
    sum_ = F.sum("_w").over(_book())
    return rows.select("book_id", "symbol", F.when(sum_ > 0, F.col("_w") / sum_).otherwise(1 / F.count("*").over(_book())).alias("weight"))


def leaf_order(distances: DataFrame) -> DataFrame:
    """(book_id, symbol, pos): the place of each name in its book's single-linkage tree, from 0."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf, "dist")
        order = single_linkage_order(d)
        return pd.DataFrame({"book_id": pdf["book_id"].iloc[0], "symbol": [names[k] for k in order], "pos": np.arange(len(order), dtype=np.int32)})

    return distances.select("book_id", "si", "sj", "dist").groupBy("book_id").applyInPandas(solve, "book_id string, symbol string, pos int")


def order_book(weights: DataFrame, labels: DataFrame | None = None, most: int = 40) -> DataFrame:
    """(book_id, symbol, weight, pos): the first `most` names of each book by weight, or by cluster (labels) and then weight."""
    rows, by = weights.select("book_id", "symbol", "weight"), [F.desc("weight"), F.col("symbol")]
    if labels is not None:
        rows, by = rows.join(labels.select("book_id", "symbol", "cluster"), ["book_id", "symbol"], "left"), [F.asc_nulls_last("cluster"), *by]
    return rows.withColumn("pos", F.row_number().over(_book().orderBy(*by))).where(F.col("pos") <= most).select("book_id", "symbol", "weight", "pos")


def ward_labels(d: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """For 2 to `most` clusters, labels by Ward's linkage on rows of distances, numbered by first member."""
    n = len(d)
    own = (d * d).sum(axis=1)
    sq = np.maximum(0.0, own[:, None] + own[None, :] - 2 * (d @ d.T))
    # equal rows are at distance 0 whatever the rounding
    sq[sq <= 1e-13 * np.maximum(own[:, None], own[None, :])] = 0.0
    np.fill_diagonal(sq, np.inf)
    size, label, out = np.ones(n), np.arange(n), {}
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        k = int(alive.sum())
        if 2 <= k <= most:
            out[k] = np.unique(label, return_inverse=True)[1]
        i, j = divmod(int(np.argmin(sq)), n)
        i, j = min(i, j), max(i, j)
        rest = alive.copy()
        rest[[i, j]] = False
        total = size[i] + size[j] + size[rest]
        new = ((size[i] + size[rest]) * sq[i, rest] + (size[j] + size[rest]) * sq[j, rest] - size[rest] * sq[i, j]) / total
        sq[i, rest] = sq[rest, i] = new
        sq[j, :] = sq[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == label[j]] = label[i]
    return out


def ward_clusters(distances: DataFrame, most: int = 8) -> DataFrame:
    """(book_id, k, symbol, cluster) for every number of clusters k from 2 to `most`, less than the names."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf, "dist")
        found = ward_labels(d, min(most, len(names) - 1)) if len(names) > 2 else {}
        parts = [pd.DataFrame({"book_id": pdf["book_id"].iloc[0], "k": k, "symbol": names, "cluster": v}) for k, v in sorted(found.items())]
        none = pd.DataFrame({"book_id": np.array([], object), "k": np.array([], np.int32), "symbol": np.array([], object), "cluster": np.array([], np.int32)})
        return pd.concat(parts, ignore_index=True).astype({"book_id": object, "symbol": object}) if parts else none

    return distances.select("book_id", "si", "sj", "dist").groupBy("book_id").applyInPandas(solve, "book_id string, k int, symbol string, cluster int")


def silhouettes(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """(book_id, k, silhouette): mean over names of how much nearer their own cluster is than the next; 0 for a name on its own."""
    full = both_triangles(distances)
    a = labels.select("book_id", "k", F.col("symbol").alias("si"), F.col("cluster").alias("ci"))
    b = labels.select("book_id", "k", F.col("symbol").alias("sj"), F.col("cluster").alias("cj"))
    near = full.where("si <> sj").join(b, ["book_id", "sj"]).groupBy("book_id", "k", "si", "cj").agg(F.avg("dist").alias("m")).join(a, ["book_id", "k", "si"])
    s = near.groupBy("book_id", "k", "si").agg(F.max(F.when(F.col("ci") == F.col("cj"), F.col("m"))).alias("own"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("m"))).alias("other"))
    value = F.when(F.col("own").isNull() | (F.greatest("own", "other") == 0), F.lit(0.0)).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return s.groupBy("book_id", "k").agg(F.avg(value).alias("silhouette"))


def best_clusters(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """(book_id, k, symbol, cluster) of each book's k with the best silhouette, the smallest if several; one cluster for books that have no labels."""
    best = silhouettes(distances, labels).groupBy("book_id").agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))
    names = distances.where("si = sj").select("book_id", F.col("si").alias("symbol"))
    chosen = labels.join(best, ["book_id", "k"]).select("book_id", "symbol", "k", "cluster")
    rows = names.join(chosen, ["book_id", "symbol"], "left")
    return rows.select("book_id", F.coalesce("k", F.lit(1)).alias("k"), "symbol", F.coalesce("cluster", F.lit(0)).alias("cluster"))
