import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from hearthmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(8, "hearthmark-tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": folder})
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate expressions over one row of named values."""
    from pyspark.sql import functions as F

    def evaluate(*expressions, **values):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
        row = df.select(*[e.alias(f"x{i}") for i, e in enumerate(expressions)]).first()
        return row[0] if len(expressions) == 1 else tuple(row)

    return evaluate
