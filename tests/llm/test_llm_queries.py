"""Every query of the package on the smallest tables; those with SQL against it."""

import glob
import os

import duckdb
import pytest

from corpusmill.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": {"field", "record_row", "defect"}, "p2_found": {"question_row", "field", "issue", "language"}, "p3_found": {"field", "record_row"}, "p4_found": {"course_id", "question_type"},
    "p5_found": {"question_row", "field"}, "p6_found": {"question_row_a", "question_row_b"}, "p7_found": {"item_kind", "item_key"}, "p8_ids": {"doc_id", "ids"}, "p10_found": {"doc_id", "category"},
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    rows = df.collect()
    assert set(df.columns) == COLUMNS.get(name, set(df.columns))
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for f in glob.glob(f"{FOLDER}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        want = con.sql(queries.oracle_sql()[name]).df()
        assert sorted(map(tuple, (r.asDict().values() for r in rows))) == sorted(want[df.columns].itertuples(index=False, name=None))
