"""What the operators of this package share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delivered_once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per ``key`` with ``columns``: repeated deliveries are equal but for their
    time of arrival, so the rows are told apart by the columns asked for. Rows whose key
    is null are left out. Where deliveries differ after all, the smallest value stands."""
    cols = [c for c in columns if c != key]
    row = F.struct(*[F.col(c) for c in cols])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key))
        .agg(F.min(row).alias("_row"))
        .select(F.col(key), *[F.col("_row")[c].alias(c) for c in cols])
    )


def hash_unit(*cols: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone, the same in every engine:
    the first 52 bits of the md5 of seed and values, joined by dashes (nulls are skipped)."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def word_hashes(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A positive 62-bit number of each word, above those of Chinese pairs."""
    if not len(start):
        return np.empty(0, np.int64)
    before = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(before, length)
    power = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()) - 1, 0x9E3779B97F4A7C15, np.uint64)))
    h = np.add.reduceat((points[np.repeat(start, length) + place].astype(np.uint64) + np.uint64(7)) * power[place], before)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(2)) | np.uint64(1 << 61)).astype(np.int64)
