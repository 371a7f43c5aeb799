import duckdb
import pytest

from landsift.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).fetchdf()[list(got.columns)]
    rows = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).map(lambda v: float(v) if hasattr(v, "__float__") and not isinstance(v, str) else v).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
