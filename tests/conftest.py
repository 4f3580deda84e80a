import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from opsframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "8", shuffle_partitions="4")


@pytest.fixture
def cells(spark):
    """Evaluate column functions on literal cells: ``cells(["a"], fn)`` gives one value per cell."""
    def run(values, *functions):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, c string").repartition(2)
        out = rows.select("i", *[f("c").alias(f"f{n}") for n, f in enumerate(functions)]).orderBy("i").collect()
        return [r[1] if len(functions) == 1 else tuple(r[1:]) for r in out]

    return run
