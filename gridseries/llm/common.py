"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.session import scratch_folder

#: Words of a text: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Later steps depend on the files alone, so a lost executor costs no earlier
    work and several readers share one computation.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(name: str) -> Column:
    """A string key that tells null from every text, for joins and windows."""
    return F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit("n"))


def smallest_hashes(df: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """The ``rows`` rows of smallest hash of ``keys``: a sample that reruns agree on.

    A threshold from the number of rows leaves little more than the sample before
    it is ordered, so no task passes on more than its share.
    """
    share = min(1.0, (1.2 * rows + 1000) / max(1, df.count()))
    hashed = df.withColumn("_hash", F.pmod(F.xxhash64(*keys), F.lit(2**40)))
    return hashed.where(F.col("_hash") < int(share * 2**40)).orderBy("_hash", *df.columns).limit(rows).drop("_hash")


class BoundedCache(dict):
    """Values of a pure function by key; emptied when it holds ``limit`` keys."""

    def __init__(self, function: Callable, limit: int = 400_000):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value


def word_hashes(words: list[bytes], cache: BoundedCache) -> np.ndarray:
    """64-bit hashes of words; ``cache`` is ``hash_cache()`` of the calling task."""
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def hash_cache() -> BoundedCache:
    return BoundedCache(xxhash.xxh3_64_intdigest)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` neighbouring word hashes; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out
