"""Every registered query of the raster engine against its SQL, and the registry without the training-data subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

from rasterloom.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    tidy = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in queries.ORACLE_SQL:
        want = duck.sql(queries.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())


def test_extent_string_of_large_keys(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT unnest([-11813, 0, 11808, 11813, 11823, 59998, 60001, 123456788, 9007199254740, 90071992547413]) AS s_suppkey) TO '{tmp_path}/supplier.parquet'")
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    want = con.sql(queries.ORACLE_SQL["extent_string"])
    got = queries.QUERIES["extent_string"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_entry_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "rasterloom.llm" or name.startswith("rasterloom.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
