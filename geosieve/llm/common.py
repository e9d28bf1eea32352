"""Helpers that several operators of this folder share: batches of texts, span hashes, tables written between jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from geosieve.sizing import checkpoint_dir

SPACE = " \t\n\x0b\x0c\r"  # what separates words: the ASCII white space that bytes.split() knows as well
SLICE_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE]] = True
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared checkpoint folder: computed once, and it outlives lost executors."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts make wide rows; this bounds what one Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, a null text as an empty one."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[slice]:
    """Runs of texts of about ``limit`` bytes, so that the arrays made from them stay small."""
    begin = size = 0
    for i, x in enumerate(texts):
        size += len(x) + 64
        if size >= limit:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_ODD, _ODD_INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n`` of them."""
    return _powers(1 << max(21, int(n).bit_length()))


def span_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums, for span_hashes()."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal spans hash alike wherever they stand."""
    down = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of all texts, and where each text's words begin (n + 1)."""
    joined = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _IS_SPACE[joined]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1  # begins and ends of words by turns: a space is first and last
    starts, ends = edges[0::2], edges[1::2]
    hashes = span_hashes(span_sums(_BYTE_VALUES[joined]), starts, ends)
    offsets = np.cumsum([1] + [len(x) + 1 for x in texts])
    return hashes, np.searchsorted(starts, offsets)
