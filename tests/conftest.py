import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pointweave.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def mixed_points(n: int = 300, seed: int = 0) -> np.ndarray:
    """Clustered points with duplicates, points on cell borders and negative coordinates."""
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-1, 1, (6, 2))
    cloud = centres[rng.integers(0, 6, n)] + rng.normal(0, 0.05, (n, 2))
    cloud[: n // 10] = cloud[n // 10: 2 * (n // 10)]
    cloud[n // 2: n // 2 + 30] = np.round(cloud[n // 2: n // 2 + 30], 1)
    return cloud


def as_table(spark, points, id="id", x="x", y="y"):
    rows = [(i, float(p[0]), float(p[1])) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, f"{id} bigint, {x} double, {y} double")


@pytest.fixture(scope="session")
def cloud():
    return mixed_points()


@pytest.fixture(scope="session")
def cloud_table(spark, cloud):
    return as_table(spark, cloud).repartition(3).persist()
