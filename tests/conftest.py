import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from faultlens.session import build_session
    session = build_session(8, 4)
    yield session


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named strings."""
    def run(expr, **cols):
        from pyspark.sql import Row
        from pyspark.sql import types as Ty
        schema = Ty.StructType([Ty.StructField(k, Ty.StringType()) for k in cols]) if cols else None
        df = spark.createDataFrame([Row(**cols)], schema) if cols else spark.range(1)
        return df.select(expr.alias("v")).first().v
    return run
