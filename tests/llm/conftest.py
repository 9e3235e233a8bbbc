import tempfile

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    """The shared folder of the session, where the run names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-tests-"))
    return spark.sparkContext.getCheckpointDir()


@pytest.fixture()
def documents(spark):
    def make(rows, extra=False):
        """Rows of (doc_id, text[, lang]); with ``extra`` also columns named like results and intermediates."""
        rows = [(*r, None)[:3] for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        if extra:
            names = ["id", "key", "n", "score", "component", "shard", "size", "ids", "words", "label", "row"]
            df = df.select("*", *[F.lit("x").alias(c) for c in names])
        return df

    return make
