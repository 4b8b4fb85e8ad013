import pytest
from pyspark.sql import functions as F

from deskline.operators.skew import frequent_keys, join_on_key


@pytest.fixture(scope="module")
def tables(spark):
    # Key 7 holds a third of the rows, null another part, the rest is thin.
    many = spark.range(3000).select(
        F.col("id").alias("n"),
        F.when(F.col("id") < 1000, 7).when(F.col("id") < 1300, F.lit(None)).otherwise(F.col("id")).cast("bigint").alias("key"),
    )
    one = spark.range(0, 2500).select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("v"))
    return many, one


def test_frequent_keys(tables):
    many, _ = tables
    assert set(frequent_keys(many, "key")) == {7, None}
    assert frequent_keys(many.where("key > 1300"), "key") == []
    assert frequent_keys(many.where("false"), "key") == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_plain_join(tables, how):
    many, one = tables
    split = join_on_key(many, one, "key", how)
    plain = many.join(one, "key", how)
    assert split.columns == plain.columns
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0
