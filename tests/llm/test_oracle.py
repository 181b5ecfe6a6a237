import os

import duckdb
import pytest
from voxelspark.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", oracle.oracle_sql())
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    want = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_other_queries_return_every_row(spark, name):
    table = "pages" if name.split("_")[0] in ("op2", "op9") else "documents"
    assert queries.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_plans_of_native_operators_have_no_python(spark):
    for name in ("op2_url_filter", "op8_host_rules"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
