import sys
from pathlib import Path

import pytest

sys.path.append(str(Path(__file__).parent))

from plain import SF  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    """(doc_id, text) of the smallest table."""
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def odd(spark):
    import plain

    return plain.odd_docs(spark)


@pytest.fixture(scope="session")
def none(spark):
    import plain

    return plain.empty_docs(spark)
