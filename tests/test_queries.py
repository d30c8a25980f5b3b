"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from framescope.plans import captures, catalogue, evidence, recorded  # noqa: F401

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF_DIR).toPandas()
    assert len(found)
    if name in catalogue.ORACLE_SQL:
        wanted = duck.execute(catalogue.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert plain(found) == plain(wanted)


def test_whole_citations_cite_every_turn(spark, duck):
    found = catalogue.QUERIES["q42_citations"](spark, SF_DIR).toPandas()
    assert found.n.sum() == duck.execute("SELECT count(*) FROM conversations WHERE text IS NOT NULL").fetchone()[0]
    assert 0 < found.valid.sum() < found.n.sum()
