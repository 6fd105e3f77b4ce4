"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id sorts and groups as this key.
NULL_KEY = -(2**63)
#: ASCII white space separates words of this kind (Java and Python syntax).
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process, as in tests."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_of(doc_id: str | Column = "doc_id") -> Column:
    """doc_id as a key that is never null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(c.cast("long"), F.lit(NULL_KEY))


def id_of(key: str = "key") -> Column:
    return F.when(F.col(key) != NULL_KEY, F.col(key))


def ascii_lower(text: Column) -> Column:
    """A-Z only; a null text counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
