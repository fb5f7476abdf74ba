import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import local_session  # noqa: E402

C = datetime(2025, 7, 1)


def at(days: float = 0, **parts) -> datetime:
    """A moment relative to the cutoff 2025-07-01."""
    return C + timedelta(days=days, **parts)


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=3, memory="4g")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    def make(schema, rows):
        return spark.createDataFrame(rows, schema)
    return make


def rows(df, *cols):
    """Sorted tuples of the chosen columns."""
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
