import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablelearn.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


FLOWERS = ["stem (cm)", "leaf (cm)", "petal (cm)", "bud (cm)"]


@pytest.fixture(scope="session")
def flowers_csv(tmp_path_factory):
    """150 flowers of three overlapping kinds, with awkward column names."""
    rng = np.random.default_rng(5)
    lines = [",".join([*FLOWERS, "target"])]
    for i in range(150):
        kind = i % 3
        centre = np.array([5 + 0.4 * kind, 3 - 0.1 * kind, 1.5 + 1.6 * kind, 0.3 + 0.5 * kind])
        x = np.maximum(centre + rng.normal(scale=[0.4, 0.3, 0.5, 0.25]), 0.1)
        lines.append(",".join([*[f"{v:.1f}" for v in x], str(kind)]))
    path = tmp_path_factory.mktemp("data") / "flowers.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="session")
def flowers(spark, flowers_csv):
    df = spark.read.csv(flowers_csv, header=True, inferSchema=True).coalesce(1)
    df = df.selectExpr("*", "row_number() over (order by `stem (cm)`, `leaf (cm)`, `petal (cm)`, `bud (cm)`) as id")
    return df.selectExpr("*", "id % 5 = 0 as held").cache()
