import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# One session for the whole run, created before test modules build their
# patterns (Column objects need an active session).
_SPARK = (SparkSession.builder.master("local[4]")
          .config("spark.sql.shuffle.partitions", "4")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidemark-test-"))
          .getOrCreate())
_SPARK.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(_SPARK)
    yield _SPARK


@pytest.fixture(scope="session")
def chars(spark):
    def make(text, key="k"):
        rows = [(key, i, c) for i, c in enumerate(text)]
        return spark.createDataFrame(rows, "key string, pos long, ch string")
    return make
