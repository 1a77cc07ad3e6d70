"""Every query with SQL gives the SQL's rows."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from parlance.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("" if pd.isna(x) else format(x, ".6g") if isinstance(x, float) else str(x) for x in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, db, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(catalog.ORACLES[name]).df())


def test_story_limit(spark):
    from parlance.sources import ingest

    lines = spark.createDataFrame([(i, "One two three. Four five six.") for i in range(5)], "section_idx long, value string")
    assert ingest.story_turns(lines, limit=2).count() == 4 and ingest.story_turns(lines).count() == 10


def test_entry_works_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    with monkeypatch.context() as m:
        for name in ("parlance.llm", "parlance.llm.entry", "corpus_pipeline"):
            m.setitem(sys.modules, name, None)
        alone = importlib.reload(__spark_entry__)
        assert set(alone.queries()) == set(catalog.QUERIES) and set(alone.oracle_sql()) == set(catalog.ORACLES)
    importlib.reload(__spark_entry__)

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
