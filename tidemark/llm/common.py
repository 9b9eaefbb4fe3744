"""Helpers that the corpus operators share: tables, word splitting, held-out folds, shared storage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS_AT_ONCE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_at_once(spark: SparkSession) -> None:
    """From now on a session sends Python at most TEXTS_AT_ONCE rows in one Arrow batch, or fewer where it is set so. A batch is held several times at once, by
    the executor and its worker as it is written and as it returns, outside the heap: by default of 10,000 rows, whole texts. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS_AT_ONCE:
        spark.conf.set(key, str(TEXTS_AT_ONCE))


def shuffles_go(spark: SparkSession) -> None:
    """From now on the shuffle files of a query of this session go as it ends. Else they stay until the driver happens to collect its garbage, the later the more
    data there is for one of its objects."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z lower-cased: exactly what bytes.split() cuts at."""
    return text.lower().split()


def utf8(column: pa.Array) -> list[bytes]:
    """Arrow strings as UTF-8 bytes; null becomes empty."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    jsc = spark.sparkContext._jsc.sc()
    root = spark.conf.get("spark.checkpoint.dir", None) or (jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    drop_folder(df.sparkSession, df.stored_at)
