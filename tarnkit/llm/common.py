"""Helpers shared by the corpus operators: staging, let-bindings, byte arithmetic.

Texts reach the numpy helpers as one byte buffer and an array of offsets, taken
straight from the Arrow column, and are worked on in runs of whole documents of
about RUN_BYTES; a longer document makes a run of its own.
"""

from __future__ import annotations

import hashlib
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
NEWLINE = 10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row whatever the optimiser merges."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine only where there are no others."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tarnkit-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start there."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, out=out)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._table(b, n + (n >> 3)) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


def gram_hash(data: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """A hash of the k bytes from each place on, for places that have as many.

    It only chooses places and routes rows: long strings can be made to collide, so
    whatever decides a result compares bytes, exact codes or digests."""
    up, down = powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    n = max(0, len(data) - k + 1)
    return mix((sums[k : k + n] - sums[:n]) * down[:n])


def run_key() -> bytes:
    """A random key for the digests of one run; it is part of the plan, so tasks that are tried again use the same."""
    return secrets.token_bytes(16)


def digest(body: bytes | memoryview, key: bytes = b"") -> int:
    """A 64-bit digest of bytes; with a run's key nobody can make two collide on purpose."""
    return int.from_bytes(hashlib.blake2b(body, digest_size=8, key=key).digest(), "little")


def integer_ids(docs: DataFrame) -> None:
    """Refuse a doc_id that isn't a whole number: the operator names its results by it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be an integer; it is {kind}")


def in_place(docs: DataFrame, work: Callable) -> DataFrame:
    """docs.mapInArrow(work) with the same columns, whatever their names: work counts on places, not on names."""
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return numbered.mapInArrow(work, numbered.schema).toDF(*docs.columns)


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Exact codes of spans that are sorted and apart: equal spans, and no others, share a
    code, a place in the table that comes along (which holds what lies between spans too)."""
    edges = np.empty(2 * len(start), np.int32)
    edges[::2], edges[1::2] = start, end
    parts = pa.Array.from_buffers(pa.binary(), max(0, len(edges) - 1), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    coded = parts.dictionary_encode()
    return coded.indices.to_numpy()[::2].astype(np.int64), coded.dictionary


def codes(values: np.ndarray) -> np.ndarray:
    """Equal integers get one small code, in the order of their first places."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def space_mask(data: np.ndarray) -> np.ndarray:
    """True at the bytes of [\\x20\\x09-\\x0D]."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes other than white space; none crosses a row."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~space_mask(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    return np.flatnonzero(solid & (before | edge[:-1])), np.flatnonzero(solid & (after | edge[1:])) + 1


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def codes_of(column: pa.Array) -> np.ndarray:
    """codes of a column of any kind."""
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def later_copies(keys: np.ndarray) -> np.ndarray:
    """True at each occurrence of a code but the first."""
    flag = np.ones(len(keys), bool)
    flag[np.unique(keys, return_index=True)[1]] = False
    return flag
