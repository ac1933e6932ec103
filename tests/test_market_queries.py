"""The market queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from tidepool import queries

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
#: Queries that find nothing in the smallest tables: too few weeks have all names, or none is priced.
THIN = {
    "holding_diagnostics", "returns_matrix", "covariance", "ledoit_wolf", "correlation_distance", "inverse_variance", "risk_contributions", "cap_weights", "erc_shares",
    "value_book", "book_risk", "silhouettes_by_brand", "shadow_value", "books_by_date", "hrp_in_order", "book_stats", "cluster_matrix_by_brand",
}


def plain(rows, names):
    def text(v):
        return "" if v is None else f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(text(v) for _, v in sorted(zip(names, r))) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    data = LARGER if name in THIN else DATA
    got = driver.queries()[name](spark, data)
    rows = got.collect()
    assert rows
    if name not in queries.ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "nation", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(rows, got.columns) == plain(want.fetchall(), names)


def test_flagship(spark):
    assert driver.entry(spark).count() >= 1
