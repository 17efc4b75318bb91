"""One session for all tests; the shared folder is a temporary one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from synthspark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "tests", shuffle_partitions=4, checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from synthspark.plans.registry import Tables

    return Tables(spark, SMALL)


def rows(df, *order):
    """Collected rows as tuples, sorted by the given columns or by all."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
