"""What several of the operators need: plain input columns, shared files, packed arrays."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.workspace import fresh_path

#: Words are what stands between the ASCII blanks; this is their pattern for Spark's functions.
WORD = r"[^\x20\x09-\x0D]+"


def column(name: str) -> Column:
    """A column by its plain name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one.

    All other columns stay behind, so none of theirs can clash with an operator's own.
    """
    return docs.select(
        column(id_col).cast("long").alias("doc_id"),
        F.coalesce(column(text_col), F.lit("")).alias("text"),
    )


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, out of the way of an operator's own columns."""
    return F.struct(*[column(c).alias(c) for c in docs.columns])


def remainder(id_column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; of the empty text for a null id."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % divisor


def mounted(uri: str, default_store: str = "file:///") -> str:
    """The path under which tasks open a shared folder's files themselves.

    An address without a scheme lies in the default store.
    """
    parsed = urlparse(uri)
    scheme = parsed.scheme or urlparse(default_store).scheme or "file"
    if scheme != "file":
        raise RuntimeError(
            f"{uri}: tasks open these files themselves, so spark.checkpoint.dir has to be a "
            "folder that every executor mounts"
        )
    return unquote(parsed.path) if parsed.scheme else uri


def mounted_folder(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new shared folder: its address for Spark and its path for tasks."""
    uri = fresh_path(spark, name)
    path = mounted(uri, spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///"))
    os.makedirs(path, exist_ok=True)
    return uri, path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
