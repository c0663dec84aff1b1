import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from brute import DOCS  # noqa: E402

EXTRA = "score double, digest string, keep_id long, fp long, component string, toxic string, blob int, shard string, n int, id string, key string, held_out string, lang string, source string"
@pytest.fixture(scope="session")
def docs(spark):
    """Documents with null, empty, blank, very long and repeated texts, and extra columns with names the operators use."""
    none = (None,) * len(EXTRA.split(","))
    return spark.createDataFrame([(i, t, *none) for i, t in DOCS], f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
