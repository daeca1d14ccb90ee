"""Every query against its SQL on the smallest tables, and contracts of the entry module."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
import verify

REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con(root):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for path in Path(root).glob("*.parquet"):
        c.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, root, con, name):
    df = entry_points.queries()[name](spark, root)
    got = verify.rows_of(df.columns, df.collect())
    sql = entry_points.oracle_sql().get(name)
    if sql is not None:
        made = con.execute(sql)
        columns = [c[0] for c in made.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == verify.rows_of(columns, made.fetchall())


def test_found_columns(spark, root):
    want = {
        "p1_found": [("patient_id_a", "string"), ("patient_id_b", "string")],
        "p2_found": [("table_name", "string"), ("field_name", "string"), ("row_id", "bigint")],
        "p3_found": [("record_id", "bigint"), ("entry_no", "int"), ("owner", "string"), ("owner_no", "int"), ("kind", "string"), ("item_no", "int")],
        "p4_found": [("row_id", "bigint"), ("field_name", "string")],
        "p5_found": [("sample_id", "string"), ("protein_id", "string")],
        "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")],
        "p10_found": [("doc_id", "bigint")],
    }
    have = entry_points.queries()
    for name, columns in want.items():
        if name in have:
            df = have[name](spark, root)
            assert df.dtypes == columns and df.count() == df.distinct().count()


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_works_without_the_training_data_subpackage():
    code = "import sys; sys.modules['medlattice.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "medlattice").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
