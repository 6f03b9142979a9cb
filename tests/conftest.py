import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("seqrec-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqrec-test-ckpt-"))
    yield s


F1_ROWS = [(1, 10, 5, 100), (2, 10, 4, 101), (1, 11, 3, 105), (3, 12, 4, 106), (1, 12, 4, 105),
           (2, 12, 5, 150), (2, 11, 2, 155), (3, 10, 3, 300), (1, 13, 5, 400), (2, 13, 4, 402),
           (1, 14, 2, 404), (3, 11, 5, 500), (1, 11, 4, 86900), (2, 14, 3, 200000),
           (3, 13, 4, 200010), (1, 15, 3, 200020)]


def ratings_df(spark, rows, shift=0):
    data = [(u, i, float(r), ts + shift, k) for k, (u, i, r, ts) in enumerate(rows)]
    return spark.createDataFrame(data, "user_id bigint, item_id bigint, rating double, ts bigint, event_id bigint")


@pytest.fixture(scope="session")
def f1(spark):
    return ratings_df(spark, F1_ROWS)
