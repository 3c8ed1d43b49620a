import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables in many short jobs: fewer tasks each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
