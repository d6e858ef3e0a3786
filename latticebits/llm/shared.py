"""Session helpers: the shared folder, lineage cuts through written tables, input columns."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """For sessions on one machine that name no folder (tests): removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="latticebits-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on a local master may it be unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{_own_folder()}"


def arrow_uri(path: str) -> str:
    """A Spark path as a URI that pyarrow's file systems know."""
    return re.sub("^s3[an]:", "s3:", path)


_open = threading.local()  # .paths: a list for each scratch that is open in this thread


@contextmanager
def scratch(spark: SparkSession):
    """Paths handed out inside are removed at the end, whatever happens, but for those that were told to stay."""
    _open.paths = [*getattr(_open, "paths", []), []]
    try:
        yield
    finally:
        for path in _open.paths.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stay(path: str) -> str:
    """Keep a path beyond the scratch it was made in; an outer scratch still removes it."""
    opened = getattr(_open, "paths", [])
    for n, paths in enumerate(opened):
        if path in paths:
            paths.remove(path)
            if n:
                opened[n - 1].append(path)
            break
    return path


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "paths", []):
        _open.paths[-1].append(path)
    return path


def written(df: DataFrame, name: str, path: str | None = None, *, result: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and a lost executor loses nothing.
    A result outlives the scratch it is made in."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(stay(path) if result else path)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns (also ones named as an operator's own) never meet them."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_first(c: str) -> Column:
    return F.col(c).asc_nulls_first()
