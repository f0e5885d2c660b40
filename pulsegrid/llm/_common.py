"""Helpers shared by the corpus operators: reading, staging and text rules.

Every operator takes a DataFrame with an integer ``doc_id`` and a string
``text``; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word is a run of anything but ASCII white space.
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent (tests in one process) a temporary folder
    of this machine is taken.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: later stages read the files, whichever executors
    have been lost meanwhile.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that no plan reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/staged/" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words(text: str | None) -> list[str]:
    return WORD_RE.findall(text) if text else []


def keyed_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of some columns of an Arrow batch as Python tuples."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def record(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc_mod(n: int):
    """crc32 of the decimal doc_id modulo n, in Spark."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
