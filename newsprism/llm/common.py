"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Hashable, Sequence
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def position(df: DataFrame, name: str) -> int:
    """Place of the column ``name``: an exact match, else the first that differs only in case."""
    columns = df.columns
    if name in columns:
        return columns.index(name)
    for i, column in enumerate(columns):
        if column.lower() == name.lower():
            return i
    raise ValueError(f"column {name!r} is missing; there are {columns}")


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with columns named by place, so that no name can clash; undo with ``toDF(*df.columns)``."""
    return df.toDF(*[f"_in{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> Column:
    """The column ``name`` of ``df`` inside ``by_place(df)``."""
    return F.col(f"_in{position(df, name)}")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the wanted columns (new name = old name), whatever else ``df`` holds."""
    return by_place(df).select(*[place(df, old).alias(new) for new, old in columns.items()])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def crc_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null for null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def hash_fraction(columns: Sequence[Column], salt: int) -> Column:
    """A repeatable value in [0, 1) drawn from the columns."""
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 30)) / float(1 << 30)


T = TypeVar("T")
_STATE: dict[Hashable, object] = {}


def worker_state(key: Hashable, build: Callable[[], T]) -> T:
    """What one Python worker keeps between tasks (a model, words met so far): that of the last key only.

    A worker that turns to another operator or model first gives back the memory of the one before.
    """
    if key not in _STATE:
        if _STATE:
            _STATE.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform.startswith("linux"):
                ctypes.CDLL(None).malloc_trim(0)
        _STATE[key] = build()
    return _STATE[key]
