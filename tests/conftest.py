import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from axonframe.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def lines(spark):
    """Points table from a list of vertex lists; the list position is the streamline id."""

    def make(streamlines):
        rows = [
            (n, p, float(x), float(y), float(z))
            for n, line in enumerate(streamlines)
            for p, (x, y, z) in enumerate(line)
        ]
        return spark.createDataFrame(rows, "streamline_id long, point_idx int, x double, y double, z double")

    return make
