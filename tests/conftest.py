import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def column(spark):
    """Apply a column function to a list of texts."""

    def run(function, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, x string").orderBy("i")
        return [r[0] for r in df.select(function("x").alias("y")).collect()]

    return run
