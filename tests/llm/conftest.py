import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, an empty and a very long text, ties and repeated rows."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen. "
    rows = [
        (1, text * 3, "en", "a", 10), (2, text * 3, "en", "a", 10), (2, text * 3, "en", "a", 10), (3, None, None, None, None), (None, text * 3, "en", "b", None),
        (None, None, None, None, None), (4, "", "fr", "b", 0), (5, " \t\n", "fr", "b", 3), (6, text * 4000, "en", "c", 1), (7, "é ü ß 漢字 \U0001f600 \x00", "de", "", 1), (7, "another", "de", "", 1),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
