"""Byte-level text kernels shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64, for prefix polynomials.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Text bytes handled at once by the numpy kernels; rows and bytes of a slice of a batch; bytes of a batch between the JVM and a Python worker.
CHUNK_BYTES = 1 << 18
SLICE_ROWS, SLICE_BYTES = 1000, 1 << 21
BATCH_BYTES = 1 << 22

#: Bytes to words: A-Z to a-z; ASCII letters, digits and all non-ASCII bytes stay; the rest is a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and about ``size`` bytes (a larger row is alone), so that what a task makes of texts stays small."""
    for b in batches:
        each = max(1, b.nbytes // max(1, len(b)))
        step = max(1, min(rows, size // each))
        for at in range(0, len(b), step):
            part = b.slice(at, step)
            if len(part) > 1 and part.nbytes > 2 * size:
                yield from slices(iter([part]), max(1, len(part) // 2), size)
            else:
                yield part


_state: dict[tuple[str, Hashable], Any] = {}


def worker_state(owner: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, kept in this worker until another owner or key asks: a worker serves many stages and holds the state of one."""
    if (owner, key) not in _state:
        _state.clear()
        _trim()
        _state[owner, key] = make()
    return _state[owner, key]


def _trim() -> None:
    """Give freed memory back to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with memory bounded by bytes: batches of at most BATCH_BYTES, and freed memory returned when a task ends.

    The bound is the session's ``spark.sql.execution.arrow.maxBytesPerBatch``, which is lowered where it is higher.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name)) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    # mapInArrow reads dots and backquotes in names as syntax
    names = df.columns if any(set(c) & {".", "`"} for c in df.columns) else None
    if names:
        df = df.toDF(*(f"c{i}" for i in range(len(names))))

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.rename_columns(names) for b in batches) if names else run(batches)
        finally:
            _trim()

    return df.mapInArrow(released, schema)


def every(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names: dots and backquotes in them are no syntax."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores before them until no column of ``df`` has one."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``limit`` bytes; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_P, _P_INV):
            t = np.full(size, base, U64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=U64))
        _powers[size] = tuple(tables)
    return _powers[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the space-separated words of ``texts``, and each text's number of words.

    Texts must have no white space other than the space character.
    """
    buf = b" ".join([b"", *texts, b""])
    a = np.frombuffer(buf, np.uint8)
    on = a != 32
    step = np.flatnonzero(on[1:] != on[:-1])
    starts, ends = step[0::2] + 1, step[1::2] + 1
    power, inverse = _power_tables(len(a))
    total = np.cumsum((a.astype(U64) + U64(1)) * power[: len(a)], dtype=U64)
    hashes = mix((total[ends - 1] - total[starts - 1]) * inverse[starts] + (ends - starts).astype(U64))
    bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds))
    return hashes, counts


_GRAM = [U64(c | 1) for c in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0xF1357AEA2E62A9C5, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingles(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of the word n-grams of each text.

    ``texts`` are normalised by WORD_TABLE. A text of fewer than ``n`` words,
    but not none, has one shingle of all its words; one of none has none.
    """
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        w, counts = word_hashes(texts[lo:hi])
        if len(w) >= n:
            g = w[: len(w) - n + 1] * _GRAM[0]
            for k in range(1, n):
                g = mix(g) + w[k : len(w) - n + 1 + k] * _GRAM[k]
            g = mix(g)
        at = 0
        for c in counts.tolist():
            if c >= n:
                out.append(np.unique(g[at : at + c - n + 1]))
            elif c:
                h = np.array([c], U64)
                for x in w[at : at + c]:
                    h = mix(h) + x
                out.append(mix(h))
            else:
                out.append(np.empty(0, U64))
            at += c
    return out


def split_likely(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``column`` may be among ``ids`` (one column), and those for which it surely isn't.

    A bitmap of hashed ids, 16 bits an id and 16 MB at most whatever their number, goes to every
    task, so that a join that follows shuffles little else than its matches.
    """
    n = ids.count()
    bits = 1 << min(27, max(15, (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    bucket, data = unused(rows, "bucket", "bits")
    maps = (
        ids.select(place(F.col(ids.columns[0])).alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias(bucket))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(data))
    )
    at = F.bitmap_bit_position(place(F.col(column)))
    byte = F.conv(F.hex(F.substring(data, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2, F.lit(0))
    marked = rows.withColumn(bucket, F.bitmap_bucket_number(place(F.col(column)))).join(F.broadcast(maps), bucket, "left")
    return marked.where(bit == 1).select(*every(rows)), marked.where(bit == 0).select(*every(rows))
