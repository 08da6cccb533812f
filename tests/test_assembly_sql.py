"""The SQL of designs and PCR states the query's rules: a primer must bind once, and its own complement never does."""

import duckdb
import pytest

from strandlake.plans import all_queries

# The constructs of parts 54249 (designs) and 117932 (PCR) have a primer that is its own complement.
PARTS = [1, 2, 10, 15, 20, 113, 54249, 117932]


@pytest.mark.parametrize("name, refused", [("assembly_products", 54249), ("assembly_primers", 54249), ("assembly_verified", 54249), ("pcr_products", 117932)])
def test_sql_refuses_what_the_query_refuses(spark, tmp_path, name, refused):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CAST(k AS BIGINT) AS p_partkey, 'p' || k AS p_name FROM (SELECT unnest({PARTS}) AS k)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet')")
    query = all_queries()[name]
    df = query.run(spark, str(tmp_path))
    cur = con.execute(query.sql)
    columns = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want
    told = [r for r in want if r.startswith(f"({refused},")]
    assert all("not unique" in r for r in told) and bool(told) == (name in ("assembly_products", "pcr_products"))
