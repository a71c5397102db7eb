"""Results that are kept as Parquet while their inputs stay the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def signature(spark: SparkSession, paths: Sequence[str], **parameters) -> str:
    """A digest of the sizes and times of all input files and of the parameters. Files are listed by Spark's own
    file system, so any store will do."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    told = []
    for path in paths:
        place = hadoop.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in system.globStatus(place) or []:
            held = system.listStatus(status.getPath()) if status.isDirectory() else [status]
            told += [[s.getPath().toString(), s.getLen(), s.getModificationTime()] for s in held]
    return hashlib.sha256(json.dumps([sorted(told), parameters], sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under ``folder``/``key``, built and written first if there is none. A table without its
    success mark, as a broken run leaves it, is written anew."""
    path = f"{folder.rstrip('/')}/{key}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
