"""Every query of the core against its SQL in another engine, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from corpusmill.plans import queries, registry  # noqa: F401

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, float):
            return f"{v:.5f}"
        if isinstance(v, pd.Timestamp):
            return str(v.tz_localize(None))
        return str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, engine, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    if name in registry.oracle_sql():
        want = engine.sql(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_documents_with_ids_beyond_32_bits(spark, tmp_path):
    ids = [1, 2**31 - 1, 2**31, 180_000_000_016, 2**63 - 1]
    docs = [(i, "ds000001_ch02_s03", "ocw_logic", None if n % 2 else "T", "u" if n % 2 else None, f"text  {n} ") for n, i in enumerate(ids)]
    folder = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id bigint, doc_key string, course_id string, title string, source_url string, text string").write.parquet(folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    got = registry.queries()["ing3_documents"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(registry.oracle_sql()["ing3_documents"]).df())
    assert sorted(got["doc_id"]) == sorted(f"ocw_logic_ch{i:02d}_s00" for i in ids)
