import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry_module  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def ordered(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(lambda v: v.notna(), None)
    return sorted(map(repr, frame.apply(lambda col: [
        float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in col
    ]).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, duck, sf_dir, name):
    found = entry_module.queries()[name](spark, sf_dir).toPandas()
    assert len(found) > 0
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return
    expected = duck.execute(sql).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert ordered(pd.DataFrame(found)) == ordered(expected)


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.columns == ["row_id", "label", "guess", "similarity"]
    assert result.count() > 0
