import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from samples import DOCS, ODD  # noqa: E402


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""

    def make(rows, odd=True):
        rows = [*rows, *(ODD if odd else [])]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    return make
