import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from watchfloor.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "watchfloor-tests")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions over a single constant row."""
    from pyspark.sql import functions as F

    def run(column, **values):
        frame = spark.range(1)
        for name, value in values.items():
            kind = None
            if isinstance(value, list):
                frame = frame.withColumn(name, F.array(*[F.lit(v) for v in value]).cast("array<string>"))
                continue
            frame = frame.withColumn(name, F.lit(value) if kind is None else F.lit(value).cast(kind))
        return frame.select(column.alias("out")).first().out

    return run
