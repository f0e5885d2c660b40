"""One function over many sessions, with results as a Parquet dataset by session."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def encode_path(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("/"), F.lit("___")), F.lit(":"), F.lit("---"))


def decode_path(name: Column) -> Column:
    plain = F.regexp_replace(name, r"\.(pkl|h5|parquet)$", "")
    return F.replace(F.replace(plain, F.lit("___"), F.lit("/")), F.lit("---"), F.lit(":"))


def run(sessions: DataFrame, func: Callable[..., pd.DataFrame], schema: str, path: str, overwrite: bool = False, skip_if_error: bool = False, n_tasks: int | None = None, **kwargs) -> DataFrame:
    """Apply ``func(session, **kwargs)`` to each distinct session and append the frames to ``path``; returns all results.

    Sessions that ``path`` already holds are skipped unless ``overwrite``.
    ``skip_if_error``: a session that fails leaves one row with its ``error``,
    to be tried again by the next run.
    """
    spark = sessions.sparkSession
    todo = sessions.select("session").distinct()
    if not overwrite and (done := _existing(spark, path)) is not None:
        todo = todo.join(done.where("error is null").select("session").distinct(), "session", "left_anti")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in frame["session"]:
                try:
                    yield func(s, **kwargs).assign(session=s, error=None)
                except Exception:
                    if not skip_if_error:
                        raise
                    yield pd.DataFrame({"session": [s], "error": [traceback.format_exc()]})

    ddl = f"session string, error string, {schema}"
    order = [c.split()[0] for c in ddl.split(", ")]
    shaped = lambda fs: (f.reindex(columns=order) for f in work(fs))
    out = todo.repartition(n_tasks or spark.sparkContext.defaultParallelism, "session").mapInPandas(shaped, ddl)
    writer = out.write.partitionBy("session").mode("overwrite" if overwrite else "append")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    return load_results(spark, path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) and len(fs.listStatus(p)) > 1 else None


def load_results(spark: SparkSession, path: str, file_name: bool = False) -> DataFrame:
    """All results; with the name of the file that a row came from on request. Nothing there is an error."""
    found = _existing(spark, path)
    if found is None:
        raise ValueError(f"no results in {path}")
    return found.select("*", F.col("_metadata.file_name").alias("save_file")) if file_name else found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; where no cluster names one, on this machine."""
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that executors share")
        base = f"{tempfile.gettempdir()}/pulsegrid-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own and read back: what several branches of a plan need is made once, and lost executors cost no more than a read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nested_rows(value, path: str = "") -> list[tuple[str, str, str]]:
    """A nested result of dictionaries, lists, arrays and plain values as (path, kind, JSON) of its leaves; lists of unequal parts nest."""
    import json

    import numpy as np

    if isinstance(value, dict):
        return [("" + path, "dict", json.dumps(list(value)))] + [r for k, v in value.items() for r in nested_rows(v, f"{path}/{k}")]
    if isinstance(value, np.ndarray) and value.dtype != object:
        return [(path, f"array {value.dtype.str} {','.join(map(str, value.shape))}", json.dumps(value.ravel().tolist()))]
    if isinstance(value, (list, tuple, np.ndarray)):
        return [(path, "list", str(len(value)))] + [r for i, v in enumerate(value) for r in nested_rows(v, f"{path}/{i}")]
    return [(path, "value", json.dumps(value.item() if hasattr(value, "item") else value))]


def nested_value(rows: list[tuple[str, str, str]]):
    """The result that :func:`nested_rows` took apart."""
    import json

    import numpy as np

    at = {p: (k, v) for p, k, v in rows}

    def build(path: str):
        kind, text = at[path]
        if kind == "dict":
            return {k: build(f"{path}/{k}") for k in json.loads(text)}
        if kind == "list":
            return [build(f"{path}/{i}") for i in range(int(text))]
        if kind.startswith("array"):
            _, dtype, shape = kind.split(" ")
            return np.array(json.loads(text), dtype).reshape([int(n) for n in shape.split(",") if n])
        return json.loads(text)

    return build("")


def run_nested(sessions: DataFrame, func: Callable[..., object], path: str, **kwargs) -> DataFrame:
    """Like :func:`run` for functions that return nested results: (session, error, path, kind, value), a row a leaf."""
    rows = lambda s, **kw: pd.DataFrame(nested_rows(func(s, **kw)), columns=["path", "kind", "value"])
    return run(sessions, rows, "path string, kind string, value string", path, **kwargs)
