import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from text_odd import ODD, SCHEMA  # noqa: E402


@pytest.fixture
def make_docs(spark):
    def make(rows, partitions=3):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s",
                 None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(data, SCHEMA).repartition(partitions)

    return make


@pytest.fixture
def write_sf(tmp_path):
    def write(docs):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def odd_docs(make_docs):
    return make_docs(ODD)
