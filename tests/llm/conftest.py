import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from helpers import SCHEMA, awkward_docs  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward_docs(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns with names that the operators use inside."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("z").alias(c) for c in ("key", "part", "bucket", "words", "line", "hash", "component", "first", "kept", "score", "gram", "removed", "label_id")])
