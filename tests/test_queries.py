import os
import subprocess
import sys

import duckdb
import pytest
import __spark_entry__
from voxelspark import queries

SF = "/root/testdata/sf0.01"  # the smallest one has but two X planes of events


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    return "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_against_sql(spark, db, name):
    got = queries.queries()[name](spark, SF)
    want = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(map(plain, r)) for r in got.select(*(f"`{n}`" for n in names)).collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_other_queries_run(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["x", "y", "v", "out_idx"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_text_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for d, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f not in (".git", "llm", "__pycache__")]
        for n in names:
            if n.endswith(".py") and n != "corpus_pipeline.py":
                to = tmp_path / os.path.relpath(d, root) / n
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_bytes(open(os.path.join(d, n), "rb").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


@pytest.mark.parametrize("name", ["raw_restore_scan", "raw_line_z", "raw_slice_y", "raw_size_and_format"])
def test_raw_files_of_tables_that_end_inside_a_plane(spark, tmp_path, name):
    con = duckdb.connect()
    for t, n in (("embeddings", 481), ("events", 9987)):
        con.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet' ORDER BY 1 LIMIT {n}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = queries.queries()[name](spark, str(tmp_path))
    want = con.execute(queries.oracle_sql()[name])
    names = [f"`{d[0]}`" for d in want.description]
    assert sorted(tuple(map(plain, r)) for r in got.select(*names).collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("rows", [["(1, 7, 1)", "(2, 14, 7)"], ["(1, 7, 1)", "(1, 7, 1)", "(1, 8, 1)"], ["(1, 307, 1)", "(1, 907, 1)", "(41, 7, 1)", "(3, 300007, 7)"], []])
def test_read_plan_costs_of_plans_with_and_without_reads(spark, tmp_path, rows):
    con = duckdb.connect()
    values = ", ".join(rows or ["(1, 1, 1)"])
    con.execute(f"COPY (SELECT CAST(s AS BIGINT) AS l_suppkey, CAST(p AS BIGINT) AS l_partkey, CAST(n AS BIGINT) AS l_linenumber FROM (VALUES {values}) t(s, p, n) WHERE {bool(rows)}) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = queries.queries()["read_plan_costs"](spark, str(tmp_path))
    want = con.execute(queries.oracle_sql()["read_plan_costs"])
    assert [tuple(got.select(*(f"`{d[0]}`" for d in want.description)).first())] == want.fetchall()
