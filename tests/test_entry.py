import duckdb
import pytest

from ferrule.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df_rows):
    return sorted(repr(tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r)) for r in df_rows)


@pytest.mark.parametrize("name", ["bgp_filter", "chain_join", "anti_corr_filter", "set_string", "path_inverse", "stratified_neg", "demand_slice", "msg_envelopes"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows(tuple(r) for r in got.select(*names).collect()) == rows(want)


def test_projection_covers_all_orders(spark):
    n = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").distinct().count()
    assert QUERIES["query_projection_all"](spark, SF).select("o").distinct().count() == n > 200
    test_same_rows_as_sql(spark, "query_projection_all")
