import pytest
from pyspark.sql import functions as F

from casegrain.llm import shared


def test_only_mounted_folders_are_opened():
    assert shared.mounted("/mnt/shared/x y") == "/mnt/shared/x y"
    assert shared.mounted("file:///mnt/shared/x%20y") == "/mnt/shared/x y"
    for uri, store in (("hdfs://a/b", "file:///"), ("/mnt/shared", "hdfs://name"), ("s3a://b/c", "file:///")):
        with pytest.raises(RuntimeError, match="mounts"):
            shared.mounted(uri, store)


def test_plain_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "t", "y")], "`doc id` int, `te.xt` string, text string")
    rows = shared.plain(df, "doc id", "te.xt").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, ""), (None, "t")]
    row = df.select(shared.whole_row(df).alias("row")).select("row.*")
    assert row.columns == df.columns


def test_remainder_is_crc32_of_the_decimal_text(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 7, -3, 10**12)] + [(None,)], "i long")
    for r in df.select("i", shared.remainder(F.col("i"), 7).alias("r")).collect():
        assert r["r"] == zlib.crc32(b"" if r["i"] is None else str(r["i"]).encode()) % 7
