"""Series, calendars, covariances and allocations against plain code on small fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.functions.series import moving_average, pct_change, series, with_ewm, with_rsi
from tidepool.operators import allocation, asof, calendar, checks, diagnostics, performance, profile, returns
from tidepool.sources.bars import load_bars, number, panel_from_wide

START = dt.date(2024, 1, 1)  # a Monday


def days(n):
    return [START + dt.timedelta(days=k) for k in range(n)]


def close_frame(spark, **by_symbol):
    rows = [(s, d, None if x is None else float(x)) for s, xs in by_symbol.items() for d, x in zip(days(len(xs)), xs)]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def column(df, name, symbol="a"):
    return [r[name] for r in df.where(F.col("symbol") == symbol).orderBy("date").collect()]


def test_numbers_at_the_source(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "v string")
    assert [r[0] for r in df.select(number(F.col("v"))).collect()] == [1.5, None, None, None, None]


def test_load_and_wide_panel(spark):
    wide = spark.createDataFrame([("2024-01-01", 1.0, 2.0, 10.0, float("nan")), ("2024-01-02", 3.0, 4.0, 5.0, 7.0)], ["date", "close|a", "close|b", "volume|a", "volume|b"])
    long = panel_from_wide(wide.withColumn("date", F.to_date("date")))
    assert {(r.symbol, str(r.date), r.close, r.volume) for r in load_bars(long).collect()} == {("a", "2024-01-01", 1.0, 10.0), ("a", "2024-01-02", 3.0, 5.0), ("b", "2024-01-02", 4.0, 7.0)}
    assert load_bars(long, ["a"], "2024-01-02", "2024-01-02").count() == 1


def test_rsi_edges(spark):
    rows = with_rsi(close_frame(spark, a=range(1, 21), b=[5] * 40), ["symbol"])
    assert column(rows, "rsi") == [None] * 13 + [100.0] * 7 and column(rows, "rsi", "b") == [None] * 40


@pytest.mark.parametrize("alpha", [0.2, 2 / 22, 1 / 14])
def test_ewm_matches_pandas(spark, alpha):
    rng = np.random.default_rng(1)
    x = [None if rng.random() < 0.1 else float(v) for v in rng.normal(100, 5, 700)]
    x[0] = None
    got = column(with_ewm(close_frame(spark, a=x, b=[1.0, 2.0]), ["symbol"], {"m": ("close", alpha)}), "m")
    want = pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=True).mean()
    assert got[0] is None and np.allclose(got[1:], want[1:], rtol=1e-12)


def test_full_windows_and_padding(spark):
    df = close_frame(spark, a=[1, 2, None, 4, 5, 6])
    w = series("symbol")
    got = df.select("symbol", "date", moving_average(F.col("close"), w, 2).alias("m"), pct_change(F.col("close"), w).alias("r"), pct_change(F.col("close"), w, True).alias("p"))
    assert column(got, "m") == [None, 1.5, None, None, 4.5, 5.5]
    assert column(got, "r") == [None, 1.0, None, None, 0.25, pytest.approx(0.2)]
    assert column(got, "p") == [None, 1.0, 0.0, 1.0, 0.25, pytest.approx(0.2)]


def test_fill_stops_after_five(spark):
    gaps = {"g4": 4, "g5": 5, "g6": 6, "g9": 9}
    rows = [("all", d, 1.0) for d in days(20)] + [(s, d, 2.0) for s, g in gaps.items() for k, d in enumerate(days(20)) if k == 3 or k > 3 + g]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    got = calendar.align_calendar(df, ["close"])
    for s, g in gaps.items():
        have = column(got, "close", s)
        assert have[:3] == [None] * 3 and have[4 : 4 + g] == [2.0] * min(g, 5) + [None] * max(0, g - 5)
    report = {r.symbol: r.repaired for r in calendar.fill_report(df, got, "close").collect()}
    assert report == {"all": 0, "g4": 4, "g5": 5, "g6": 5, "g9": 5}


def test_week_without_a_friday_is_lost(spark):
    rows = [("a", d, float(k), float(k), float(k), float(k), 1.0) for k, d in enumerate(days(21)) if k != 11]  # the second Friday is missing
    bars = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    weekly = calendar.resample_weekly(bars).select("symbol", "week", F.col("close").alias("w"))
    got = column(calendar.weekly_onto_daily(bars, weekly, ["w"]), "w")
    assert got == [None] * 4 + [4.0] * 13 + [18.0] * 3


def returns_frame(spark, matrix, names="abcdefgh"):
    rows = [("k", names[j], days(len(matrix))[i], None if np.isnan(x) else float(x)) for i, row in enumerate(matrix) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "book_id string, symbol string, date date, r double")


def test_coverage_goes_before_complete_cases(spark):
    x = np.random.default_rng(2).normal(size=(10, 3))
    x[:3, 0] = np.nan  # 70 %
    x[:2, 1] = np.nan  # 80 %
    df = returns_frame(spark, x)
    covered = returns.coverage(df)
    assert {r.symbol: r.kept for r in covered.collect()} == {"a": False, "b": True, "c": True}
    got = returns.complete_cases(df, covered)
    assert got.select("symbol").distinct().count() == 2 and got.select("date").distinct().count() == 8


def test_covariance_and_shrinkage_match_numpy(spark):
    x = np.random.default_rng(3).normal(size=(60, 4)) @ np.random.default_rng(4).normal(size=(4, 4))
    pairs = returns.pair_moments(returns_frame(spark, x))
    full = {(r.si, r.sj): r for r in allocation.both_triangles(pairs).collect()}
    c, rho = np.cov(x.T), np.corrcoef(x.T)
    for i, a in enumerate("abcd"):
        for j, b in enumerate("abcd"):
            assert full[a, b].cov == pytest.approx(c[i, j]) and full[a, b]["corr"] == pytest.approx(rho[i, j])
    z = x - x.mean(0)
    s = z.T @ z / len(z)
    sd = np.sqrt(np.diag(s))
    target = rho[np.triu_indices(4, 1)].mean() * np.outer(sd, sd)
    np.fill_diagonal(target, np.diag(s))
    pi = np.array([[((z[:, i] * z[:, j] - s[i, j]) ** 2).mean() for j in range(4)] for i in range(4)])
    theta = np.array([[((z[:, i] ** 2 - s[i, i]) * (z[:, i] * z[:, j] - s[i, j])).mean() for j in range(4)] for i in range(4)])
    r = rho[np.triu_indices(4, 1)].mean()
    pull = sum(r / 2 * (sd[j] / sd[i] * theta[i, j] + sd[i] / sd[j] * theta[j, i]) for i in range(4) for j in range(4) if i != j) + np.trace(pi)
    level = min(1, max(0, (pi.sum() - pull) / ((s - target) ** 2).sum() / len(z)))
    assert 0 < level < 1
    got = {(r.si, r.sj): r for r in returns.shrunk_covariance(pairs).collect()}
    assert all(got["abcd"[i], "abcd"[j]].cov == pytest.approx(level * target[i, j] + (1 - level) * s[i, j]) for i in range(4) for j in range(i, 4))


def test_constant_series_has_no_correlation(spark):
    x = np.column_stack([np.zeros(6), np.arange(6.0)])
    assert {(r.si, r.sj): r["corr"] for r in returns.pair_moments(returns_frame(spark, x)).collect()}["a", "a"] == 0.0


def test_equal_risk_and_hierarchical_weights(spark):
    x = np.random.default_rng(5).normal(size=(80, 5)) * [1, 2, 3, 4, 5]
    x[:, 1] += x[:, 0]
    pairs = returns.pair_moments(returns_frame(spark, x))
    erc = allocation.equal_risk_contributions(pairs)
    assert all(r.share == pytest.approx(0.2, abs=1e-8) for r in allocation.risk_contributions(pairs, erc).collect())
    hrp = [r.weight for r in allocation.hierarchical_risk_parity(pairs).collect()]
    assert sum(hrp) == pytest.approx(1) and min(hrp) > 0
    flat = pairs.withColumn("cov", F.when(F.col("si") == F.col("sj"), F.col("cov")).otherwise(F.lit(0.0)))
    vol = 1 / x.std(axis=0, ddof=1)
    got = {r.symbol: r.weight for r in allocation.equal_risk_contributions(flat).collect()}
    assert [got[s] for s in "abcde"] == pytest.approx(list(vol / vol.sum()))
    ivp = {r.symbol: r.weight for r in allocation.inverse_variance(pairs).collect()}
    assert [ivp[s] for s in "abcde"] == pytest.approx(list(vol**2 / (vol**2).sum()))


def test_clusters_join_what_moves_together(spark):
    base = np.random.default_rng(6).normal(size=(100, 2))
    x = np.column_stack([base[:, 0], base[:, 0], base[:, 0] * 2 + 0.01 * base[:, 1], base[:, 1], base[:, 1] * 3])
    d = returns.correlation_distance(returns.pair_moments(returns_frame(spark, x)))
    labels = allocation.ward_clusters(d)
    two = {r.symbol: r.cluster for r in labels.where("k = 2").collect()}
    assert two == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1}
    best = max(allocation.silhouettes(d, labels).collect(), key=lambda r: r.silhouette)
    assert best.k == 2 and 0.9 < best.silhouette <= 1


def test_best_clusters_by_silhouette(spark):
    groups = {"three": [0, 0, 0, 1, 1, 2, 2], "two": [0, 0, 1, 1], "pair": [0, 0], "one": [0]}
    rows = [(b, f"s{i}", f"s{j}", 0.0 if i == j else 0.1 if g[i] == g[j] else 0.8) for b, g in groups.items() for i in range(len(g)) for j in range(i, len(g))]
    d = spark.createDataFrame(rows, "book_id string, si string, sj string, dist double")
    got = allocation.best_clusters(d, allocation.ward_clusters(d)).orderBy("book_id", "symbol").collect()
    assert {b: [r.cluster for r in got if r.book_id == b] for b in groups} == groups
    assert {(r.book_id, r.k) for r in got} == {("three", 3), ("two", 2), ("pair", 1), ("one", 1)}
    matrix = diagnostics.cluster_matrix(d.withColumn("corr", 1 - F.col("dist")), allocation.best_clusters(d, allocation.ward_clusters(d)))
    assert {(r.book_id, r.i) for r in matrix.where("boundary").collect()} == {("three", 4), ("three", 6), ("two", 3)} and matrix.where("book_id in ('one', 'pair')").count() == 5


def test_ewm_carries_the_whole_past(spark):
    rng = np.random.default_rng(5)
    long = [50.0] * 700 + list(rng.normal(5, 1, 1500))
    gap = [1.0, 3.0] + [None] * 3000 + [7.0, None]
    df = close_frame(spark, a=long, b=gap)
    got = with_ewm(df, ["symbol"], {"slow": ("close", 0.002), "fast": ("close", 0.3)}).collect()
    for symbol, xs in (("a", long), ("b", gap)):
        rows = sorted((r for r in got if r.symbol == symbol), key=lambda r: r.date)
        for name, alpha in (("slow", 0.002), ("fast", 0.3)):
            want = pd.Series(xs, dtype=float).ewm(alpha=alpha, adjust=True, ignore_na=False).mean()
            assert [r[name] for r in rows] == pytest.approx(want.tolist(), rel=1e-9)


def test_single_linkage_order():
    d = np.array([[0, 9, 1, 9], [9, 0, 9, 2], [1, 9, 0, 9], [9, 2, 9, 0.0]])
    assert allocation.single_linkage_order(d) == [0, 2, 1, 3]


def capped_one_by_one(w, cap):
    """The largest is held at the cap and the rest scaled, until none is over it."""
    top, held = max(cap, 1 / len(w)), set()
    while True:
        rest = [i for i in range(len(w)) if i not in held]
        total, left = sum(w[i] for i in rest), 1 - top * len(held)
        got = {i: left * w[i] / total if total else left / len(rest) for i in rest}
        over = [i for i in rest if got[i] > top * (1 + 1e-12)]
        if not over:
            return [top if i in held else got[i] for i in range(len(w))]
        held.add(max(over, key=lambda i: w[i]))


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12).filter(any), st.floats(0.01, 1))
@settings(max_examples=12, deadline=None)
def test_capped_weights(spark, parts, cap):
    w = [p / sum(parts) for p in parts]
    rows = [("k", f"s{i:02}", x) for i, x in enumerate(w)] + [("other", "x", 1.0)]
    got = {(r.book_id, r.symbol): r.weight for r in allocation.cap_weights(spark.createDataFrame(rows, "book_id string, symbol string, weight double"), cap).collect()}
    assert got.pop(("other", "x")) == 1 and [got["k", f"s{i:02}"] for i in range(len(w))] == pytest.approx(capped_one_by_one(w, cap), abs=1e-9)
    assert sum(got.values()) == pytest.approx(1) and max(got.values()) <= max(cap, 1 / len(parts)) + 1e-12


def test_what_no_weight_can_take_goes_in_equal_parts(spark):
    w = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 0.0), ("k", "c", None), ("k", "d", 0.0)], "book_id string, symbol string, weight double")
    assert {r.symbol: r.weight for r in allocation.cap_weights(w, 0.4).collect()} == pytest.approx({"a": 0.4, "b": 0.2, "c": 0.2, "d": 0.2})
    assert allocation.cap_weights(w.limit(0), 0.4).collect() == []


def test_cap_below_equal_parts_is_relaxed(spark):
    w = spark.createDataFrame([("k", f"s{i}", 0.125) for i in range(8)], "book_id string, symbol string, weight double")
    assert {r.weight for r in allocation.cap_weights(w, 0.1).collect()} == {0.125}


def test_selection_sizes_and_tilt(spark):
    w = spark.createDataFrame([("k", "a", 0.4), ("k", "b", 0.4), ("k", "c", 0.2), ("k", "d", 0.0)], "book_id string, symbol string, weight double")
    assert {(r.symbol, r.weight) for r in allocation.select_top(w, 2).collect()} == {("a", 0.5), ("b", 0.5)}
    prices = spark.createDataFrame([("a", 7.0), ("b", 0.0), ("c", 3.0), ("d", None)], "symbol string, price double")
    assert {(r.symbol, r.units) for r in allocation.size_positions(w, prices, 100.0).collect()} == {("a", 9), ("c", 11)}
    z = spark.createDataFrame([("k", "a", 2.0), ("k", "b", -4.0), ("k", "c", 0.0)], "book_id string, symbol string, z double")
    assert {r.symbol: round(r.weight, 6) for r in allocation.momentum_tilt(w, z).collect()} == {"a": 0.705882, "b": 0.117647, "c": 0.176471, "d": 0.0}


def test_rank_scores(spark):
    df = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 2.0), ("k", "c", 2.0), ("k", "d", None)], "book_id string, symbol string, m double")
    got = {r.symbol: r.z for r in returns.rank_z(df, "m").collect()}
    assert got["d"] == 0 and got["b"] == got["c"] and got["a"] == pytest.approx((0.5 / 3 - 0.5) * 12**0.5)


def test_performance_matches_numpy(spark):
    rng = np.random.default_rng(7)
    r, b = rng.normal(0.001, 0.02, 150), rng.normal(0.001, 0.01, 150)
    df = spark.createDataFrame([("k", d, float(x)) for d, x in zip(days(150), r)] + [("one", START, 0.1)], "book_id string, date date, r double")
    bench = spark.createDataFrame([(d, float(x)) for d, x in zip(days(150), b)], "date date, b double")
    got = {m.book_id: m for m in performance.performance_metrics(df, bench).collect()}
    m, s = got["k"], pd.Series(r)
    growth = np.cumprod(1 + r)
    assert m.total_return == pytest.approx(growth[-1] - 1) and m.volatility == pytest.approx(r.std(ddof=1) * 252**0.5)
    assert m.max_drawdown == pytest.approx((growth / np.maximum(1, np.maximum.accumulate(growth)) - 1).min())
    assert m.sharpe == pytest.approx((r.mean() - 0.045 / 252) / r.std(ddof=1) * 252**0.5)
    assert m.var_95 == pytest.approx(np.quantile(r, 0.05)) and m.cvar_95 == pytest.approx(r[r <= np.quantile(r, 0.05)].mean())
    assert m.skewness == pytest.approx(s.skew()) and m.kurtosis == pytest.approx(s.kurt())
    assert m.beta == pytest.approx(np.cov(r, b)[0, 1] / b.var(ddof=1)) and m.correlation == pytest.approx(np.corrcoef(r, b)[0, 1])
    assert got["one"].volatility is None and got["one"].sharpe is None


def test_a_total_loss_stays_one(spark):
    r = [0.01, -1.0, 0.02, 0.03, -0.01, 0.02]
    df = spark.createDataFrame([("k", d, x) for d, x in zip(days(6), r)], "book_id string, date date, r double")
    bench = spark.createDataFrame([(d, x) for d, x in zip(days(6), [0.01, -0.02, 0.01, -0.01, 0.02, 0.0])], "date date, b double")
    m = performance.performance_metrics(df, bench).collect()[0]
    assert (m.total_return, m.max_drawdown, m.cagr, m.worst) == (-1.0, -1.0, -1.0, -1.0) and (m.win_days, m.lose_days) == (4, 2)
    up, down = 1.01 * 1.02 * 0.99, 0.0
    assert m.up_capture == pytest.approx(100 * (up ** (1 / 3) - 1) / ((1.01 * 1.01 * 1.02) ** (1 / 3) - 1))
    assert m.down_capture == pytest.approx(100 * (down - 1) / ((0.98 * 0.99) ** 0.5 - 1))
    few = performance.performance_metrics(df, bench, least_pairs=7).collect()[0]
    assert few.n_paired == 6 and few.beta is None and few.up_capture is None and few.correlation is None and few.total_return == -1.0


def test_names_without_variance_get_no_weight(spark):
    x = np.column_stack([np.zeros(30), np.random.default_rng(9).normal(size=(30, 2))])
    pairs = returns.pair_moments(returns_frame(spark, x))
    flat = returns.pair_moments(returns_frame(spark, np.zeros((6, 2))))
    for solve in (allocation.inverse_variance, allocation.equal_risk_contributions, allocation.hierarchical_risk_parity):
        w = {r.symbol: r.weight for r in solve(pairs).collect()}
        assert w["a"] == 0 and sum(w.values()) == pytest.approx(1) and w["b"] > 0
        assert {r.weight for r in solve(flat).collect()} == {0.5}


def plain_parity(names, cov, order):
    """Halving written as a recursion on names."""
    def risk(part):
        w = {i: 1 / cov[i, i] for i in part}
        return sum(w[i] * w[j] * cov[i, j] for i in part for j in part) / sum(w.values()) ** 2

    def split(part):
        if len(part) == 1:
            return {part[0]: 1.0}
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        a, b = risk(left), risk(right)
        return {i: v * b / (a + b) for i, v in split(left).items()} | {i: v * a / (a + b) for i, v in split(right).items()}

    return {names[i]: v for i, v in split(order).items()}


def plain_linkage(d):
    """Merges of the two nearest groups, found by trying all pairs of groups."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        _, a, b = min((min(d[i, j] for i in p for j in q), x, y) for x, p in enumerate(groups) for y, q in enumerate(groups) if x < y)
        groups[a] += groups.pop(b)
        groups.sort(key=min)
    return groups[0]


def test_hierarchical_weights_match_a_plain_recursion(spark):
    x = np.random.default_rng(12).normal(size=(60, 8)) * np.arange(1, 9)
    x[:, 3] += 2 * x[:, 6]
    x[:, 1] -= x[:, 7]
    cov, d = np.cov(x.T), np.sqrt(np.maximum(0, 0.5 * (1 - np.corrcoef(x.T))))
    np.fill_diagonal(d, 0)
    order = plain_linkage(d)
    assert allocation.single_linkage_order(d) == order
    pairs = returns.pair_moments(returns_frame(spark, x))
    got = {r.symbol: r.weight for r in allocation.hierarchical_risk_parity(pairs).collect()}
    assert got == pytest.approx(plain_parity("abcdefgh", cov, order))
    places = sorted((r.pos, r.symbol) for r in allocation.leaf_order(returns.correlation_distance(pairs)).collect())
    assert [s for _, s in places] == ["abcdefgh"[k] for k in order]


def test_ward_matches_distances_taken_one_by_one():
    d = np.random.default_rng(13).random((30, 30))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    groups, found = [[i] for i in range(30)], {}
    while len(groups) > 1:
        if len(groups) <= 5:
            found[len(groups)] = sorted(map(sorted, groups))
        cost = lambda p, q: len(p) * len(q) / (len(p) + len(q)) * ((d[p].mean(axis=0) - d[q].mean(axis=0)) ** 2).sum()
        _, a, b = min((cost(p, q), x, y) for x, p in enumerate(groups) for y, q in enumerate(groups) if x < y)
        groups[a] += groups.pop(b)
    labels = allocation.ward_labels(d, 5)
    assert {k: sorted([np.flatnonzero(v == c).tolist() for c in range(k)]) for k, v in labels.items()} == found
    big = np.random.default_rng(14).random((700, 700))
    assert set(allocation.ward_labels(big + big.T, 3)) == {2, 3}


def test_holes_are_filled_and_never_overwritten(spark):
    batch = close_frame(spark, a=[1, None, 3], b=[None, 5, 6])
    second = close_frame(spark, a=[9, 8, 7, 6], c=[1, None, 2, 4])
    got = {(r.symbol, (r.date - START).days): r.close for r in calendar.fill_holes(batch, second, ["close"]).collect()}
    assert got == {("a", 0): 1, ("a", 1): 8, ("a", 2): 3, ("b", 0): None, ("b", 1): 5, ("b", 2): 6, ("c", 0): 1, ("c", 1): None, ("c", 2): 2}


def test_checks_of_a_panel(spark):
    bars, names = close_frame(spark, a=[1, 2], b=[None, 0]), spark.createDataFrame([("a",), ("b",), ("z",)], "symbol string")
    one = checks.panel_checks(bars, names, "2024-01-01", "2024-01-02").collect()[0]
    assert tuple(one) == (3, 2, False, False, False, False, False)
    assert checks.panel_checks(bars, names, "2024-01-01", "2024-01-02", many=2).collect()[0].many_names
    assert tuple(checks.panel_checks(bars, names.limit(0), "2024-01-02", "2024-01-01").collect()[0]) == (0, 0, True, True, True, False, False)
    assert sorted(map(tuple, checks.enough_history(bars, 2).collect())) == [("a", 2, True), ("b", 2, True)]
    some = names.where("symbol <> 'b'").unionByName(names.where("symbol = 'z'"))
    assert sorted(map(tuple, checks.enough_history(bars, 2, keys=some).collect())) == [("a", 2, True), ("z", 0, False)]
    assert checks.enough_history(bars.limit(0), 2).collect() == [] and not checks.enough_history(bars.limit(0), 1, keys=names).where("enough").count()
    assert tuple(checks.failed_share(bars, names).collect()[0]) == (3, 1, pytest.approx(1 / 3), False)
    assert tuple(checks.failed_share(bars, names.limit(0)).collect()[0]) == (0, 0, None, False)
    values = spark.createDataFrame([("k", START), ("m", START)], "book_id string, date date")
    anchors = spark.createDataFrame([("k", START), ("m", days(2)[1])], "book_id string, anchor date")
    assert [r.book_id for r in checks.since(values, anchors).collect()] == ["k"] and [r.book_id for r in checks.empty_since(values, anchors).collect()] == ["m"]
    x = np.random.default_rng(1).normal(size=(25, 3))
    assert [r.estimable for r in checks.estimable(returns_frame(spark, x)).collect()] == [True] and not checks.estimable(returns_frame(spark, x[:3])).collect()[0].estimable
    assert checks.date_back(bars, "2024-01-02", 1).collect()[0].start == START and checks.date_back(bars, "2020-01-01", 1).collect()[0].start is None


def test_best_of_a_row(spark):
    rows = spark.createDataFrame([("x", "a", 1.0, True), ("x", "b", 2.0, True), ("y", "a", 1.0, False), ("y", "b", 1.0, False), ("z", "a", 1.0, True), ("z", "b", float("nan"), True), ("w", "a", None, True)], "k string, n string, v double, high boolean")
    assert {r.k: r.best for r in performance.best_in_row(rows, "k", "n", "v", F.col("high")).collect()} == {"x": "b", "y": "a", "z": None, "w": None}


def test_a_book_starts_when_all_it_holds_is_priced(spark):
    prices = close_frame(spark, a=[1, 2, 3, 4], b=[None, None, 10, 10])
    held = spark.createDataFrame([("k", "a", 2.0), ("k", "b", 1.0), ("k", "zz", 0.0)], "book_id string, symbol string, units double")
    assert [(r.date, r.value) for r in performance.value_book(prices, held).orderBy("date").collect()] == [(days(3)[2], 16.0), (days(4)[3], 18.0)]


def plain_profile(bars, bins=60):
    lo, hi = min(b[1] for b in bars if b[1] is not None), max(b[0] for b in bars if b[0] is not None)
    total, step, hist = sum(b[2] for b in bars), (hi - lo) / bins, np.zeros(bins)
    for h, low, v in bars:
        if h is not None and low is not None:
            a, z = (int(min(bins - 1, max(0, np.floor((x - lo) / step)))) for x in (low, h))
            hist[a : z + 1] += v / (z - a + 1)
    hist = np.round(hist / total, 10)
    p = int(hist.argmax())
    a = z = p
    while hist[a : z + 1].sum() < 0.7 - 1e-9 and (a > 0 or z < bins - 1):
        if a == 0 or (z < bins - 1 and hist[z + 1] >= hist[a - 1]):
            z += 1
        else:
            a -= 1
    return lo + (p + 0.5) * step, lo + a * step, lo + (z + 1) * step


def test_volume_profile_matches_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    low = rng.integers(100, 160, 110)
    rows = [("a", d, float(x + rng.integers(1, 9)), float(x), float(rng.integers(1, 50))) for d, x in zip(days(110), low)]
    rows[50] = (*rows[50][:2], None, None, 40.0)
    bars = spark.createDataFrame(rows, "symbol string, date date, high double, low double, volume double")
    got = {r.date: (r.poc, r["val"], r.vah) for r in profile.volume_profile(bars).collect()}
    assert len(got) == 21
    for k in range(89, 110):
        assert got[rows[k][1]] == pytest.approx(plain_profile([r[2:] for r in rows[k - 89 : k + 1]]))
    sliced = {r.date: (r.poc, r["val"], r.vah) for r in profile.volume_profile(bars, slice_bars=93).collect()}
    assert sliced == got
    flat = bars.withColumn("high", F.lit(1.0)).withColumn("low", F.lit(1.0))
    assert {r.poc for r in profile.volume_profile(flat).collect()} == {None}


def gappy_prices(spark, seed=4):
    """Two books of six names: one starts late, one ends early, some have gaps, one never moves."""
    rng = np.random.default_rng(seed)
    rows = []
    for book in ("x", "y"):
        for k, name in enumerate("abcdef"):
            p = 100 * np.cumprod(1 + rng.normal(0.001, 0.03, 90))
            for n, d in enumerate(days(90)):
                if (k == 1 and n < 40) or (k == 2 and n > 70) or (k in (3, 4) and rng.random() < 0.06) or (book == "y" and n % 5 == 4):
                    continue
                rows.append((book, name, d, 50.0 if k == 5 else float(p[n])))
    return spark.createDataFrame(rows, "book_id string, symbol string, date date, close double")


@pytest.mark.parametrize("lookback,least", [(30, 0.8), (50, 0.3)])
def test_moments_by_date_are_those_of_each_date(spark, lookback, least):
    prices = gappy_prices(spark).cache()
    dates = [START - dt.timedelta(days=5), *(START + dt.timedelta(days=k) for k in (1, 25, 44, 45, 63, 78, 89, 400))]
    as_of = spark.createDataFrame([(b, d) for b in "xy" for d in dates] + [("x", dates[3])], "book_id string, as_of date")
    pairs, covered = asof.pair_moments_by_date(prices, as_of, lookback, least)
    each = as_of.distinct().join(prices, "book_id").where("date <= as_of").select(asof.book_at().alias("book_id"), "symbol", "date", "close")
    recent = returns.tail_dates(returns.returns_of(each), lookback)
    want_covered = {(r.book_id, r.symbol): (r.obs, r.window, r.kept) for r in returns.coverage(recent, least).collect()}
    got_covered = {(r.b, r.symbol): (r.obs, r.window, r.kept) for r in covered.withColumn("b", asof.book_at()).collect()}
    assert {k: v for k, v in got_covered.items() if v[0] or k in want_covered} == want_covered
    want = {(r.book_id, r.si, r.sj): r for r in returns.pair_moments(returns.returns_matrix(each, lookback, least)).collect()}
    got = {(r.b, r.si, r.sj): r for r in pairs.withColumn("b", asof.book_at()).collect()}
    # a single complete date has no covariance
    assert {k for k, r in want.items() if r.n > 1} == {k for k, r in got.items() if r.n > 1} and len(want) > 100
    for k, r in want.items():
        if r.n > 1:
            assert got[k].n == r.n
            for c in ("cov", "corr", "sq", "iij", "ijj"):
                assert getattr(got[k], c) == pytest.approx(getattr(r, c), rel=1e-7, abs=1e-12), (k, c)
    last = {(r.book_id, r.as_of, r.symbol): r.price for r in asof.prices_at(prices, as_of).collect()}
    plain = {}
    for r in sorted(prices.collect(), key=lambda r: r.date):
        for d in dates:
            if r.date <= d:
                plain[r.book_id, d, r.symbol] = r.close
    assert last == plain


def test_the_last_price_of_a_date_counts(spark):
    rows = [("b", "a", 0, 10.0, 1), ("b", "a", 0, 11.0, 0), ("b", "a", 1, 12.0, 5), ("b", "a", 1, 9.0, 6), ("b", "a", 2, 18.0, 1)]
    prices = spark.createDataFrame([(b, s, days(3)[d], c, k) for b, s, d, c, k in rows], "book_id string, symbol string, date date, close double, seq int")
    assert [r.r for r in returns.returns_of(prices, order="seq").orderBy("date").collect()] == [None, pytest.approx(-0.1), pytest.approx(1.0)]
    assert [r.r for r in returns.returns_of(prices).orderBy("date").collect()] == [None, pytest.approx(12 / 11 - 1), pytest.approx(0.5)]
    assert [(r.obs, r.window) for r in returns.coverage(returns.returns_of(prices)).collect()] == [(2, 3)]


def test_a_benchmark_date_counts_once(spark):
    r = spark.createDataFrame([("x", d, v) for d, v in zip(days(4), (0.1, -0.05, 0.02, 0.03))], "book_id string, date date, r double")
    b = spark.createDataFrame([(days(4)[k], v) for k, v in ((0, 0.05), (1, -0.02), (1, -0.04), (2, 0.01))], "date date, b double")
    m = performance.performance_metrics(r, b, periods=52).collect()[0]
    assert (m.n, m.n_paired) == (4, 3) and m.total_return == pytest.approx(1.1 * 0.95 * 1.02 * 1.03 - 1)
    x, y = np.array([0.1, -0.05, 0.02]), np.array([0.05, -0.02, 0.01])
    beta = np.cov(x, y)[0, 1] / np.var(y, ddof=1)
    free = 0.045 / 52 * 3
    assert m.volatility == pytest.approx(np.std([0.1, -0.05, 0.02, 0.03], ddof=1) * np.sqrt(52))
    assert m.alpha_period == pytest.approx(np.prod(1 + x) - 1 - free - beta * (np.prod(1 + y) - 1 - free))


def test_short_books_say_why(spark):
    from tidepool.plans.books import audited_book

    prices = gappy_prices(spark)
    _, stats = audited_book(prices, names=3, lookback=30, least=0.8, capital=10_000.0)
    got = {r.book_id: r for r in stats.collect()}
    x = got["x"]
    assert (x.names, x.covered, x.uncovered, x.cause, x.short) == (6, 6 - len(x.left_out), len(x.left_out), "none", 0) and "c" in x.left_out
    assert x.deployed + x.cash == pytest.approx(10_000.0) and x.dates <= x.least_obs <= x.window == 30
    for requested, cause in ((6, "universe"), (5, "weights")):
        _, stats = audited_book(prices, names=requested, lookback=30, least=0.8)
        r = [r for r in stats.collect() if r.book_id == "x"][0]
        assert r.covered == 5 and r.cause == cause and r.short == requested - r.positions
    _, poor = audited_book(prices, names=3, lookback=30, least=0.8, capital=1.0)
    assert {(r.positions, r.cause, r.deployed) for r in poor.collect()} == {(0, "prices", 0.0)}


def test_holdings_keep_their_row_without_returns_or_label(spark):
    r = returns_frame(spark, np.random.default_rng(2).normal(size=(30, 2)))
    book, names = r.first().book_id, sorted(x.symbol for x in r.select("symbol").distinct().collect())
    weights = spark.createDataFrame([(book, names[0], 0.5), (book, names[1], 0.3), (book, "none", 0.2)], "book_id string, symbol string, weight double")
    labels = spark.createDataFrame([(book, names[0], 3), (book, "none", 1), ("other", names[1], 2)], "book_id string, symbol string, cluster int")
    got = {x.symbol: (x.volatility is None, x.cluster) for x in diagnostics.holding_diagnostics(r, weights, labels=labels).collect()}
    assert got == {names[0]: (False, 3), names[1]: (False, None), "none": (True, 1)}
    assert "cluster" not in diagnostics.holding_diagnostics(r, weights).columns
