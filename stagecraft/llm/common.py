"""Shared helpers: Arrow text buffers, vectorised word splitting and 64-bit
rolling hashes, tables written to the shared checkpoint folder.

Hashes are polynomials modulo 2**64 over a fixed byte table, finished by a
bit mixer.  Keys that decide a result join two independent 64-bit values.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.session import checkpoint_dir

#: Rows whose id is null count as one document that sorts after all others.
NULL_ID = (1 << 63) - 1
#: Bytes of text that one vectorised step handles.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer (one-to-one on 64-bit values)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_tables.get("pow", ()))
    if have < n:
        size = max(n, CHUNK * 2 + 1024)
        for name, base in (("pow", _BASE), ("inv", _INV)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _tables[name] = np.cumprod(t)
    return _tables["pow"], _tables["inv"]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span`` takes the hash of any run of values."""
    n = len(values)
    pw, _ = _powers(n + 1)
    out = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * pw[:n], out=out[1:])
    return out


def span(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hash of values[start:end] for arrays of starts and ends."""
    _, inv = _powers(len(pre))
    return (pre[end] - pre[start]) * inv[start]


def rolling(pre: np.ndarray, k: int) -> np.ndarray:
    """Unmixed hashes of all runs of ``k`` values."""
    n = len(pre) - 1
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    _, inv = _powers(n + 1)
    return (pre[k:] - pre[:-k]) * inv[: n - k + 1]


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    for a, b in ranges:
        t[a:b + 1] = False
    return t


#: Word bytes of ``[^\x20\x09-\x0D]+`` (UTF-8; all separators are one byte).
PLAIN_WORD = _separators((0x20, 0x20), (0x09, 0x0D))
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM_WORD = _separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Byte table that lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, next row, bytes, offsets) of slices with about ``limit`` bytes;
    a longer text is a slice of its own."""
    data, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def word_bounds(data: np.ndarray, off: np.ndarray, table: np.ndarray):
    """Starts, ends (bytes) of all words and the word offsets of each text."""
    w = table[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    edge = off[:-1][off[:-1] < n]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool = False):
    """(hash of every word, word offsets of each text, starts, ends).  A text
    beyond the chunk size is cut at separators, so memory stays bounded."""
    if lower:
        data = LOWER[data]
    starts, ends, woff = word_bounds(data, off, table)
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 2 * CHUNK, "right")))
        a, b = starts[lo], ends[hi - 1]
        pre = prefix(BYTE_VALUE[data[a:b]])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix(span(pre, s, e) + (e - s).astype(np.uint64))
        lo = hi
    return out, woff, starts, ends


_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """``make()``, kept by this worker for its next tasks of the same operator."""
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Drops what an operator that ran before has left in this reused worker, and
    gives memory that is free in its allocators back to the system."""
    _held.clear()
    _tables.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; its worker, which may wait or serve others next,
    gives its memory back once a task's rows are through."""
    def task(batches):
        yield from run(batches)
        forget()

    return task


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that no column of ``df`` has in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared checkpoint folder and read back: one
    computation, no lineage to replay after an executor is lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stagecraft-llm/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``save``, and the folder written, for ``discard``."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stagecraft-llm/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark, path: str) -> None:
    """Deletes a folder of ``written`` that no result reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text): other columns, and any clash of their names, are left behind."""
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def own_rows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, str] | None = None) -> DataFrame:
    """(doc, sub, text), or all columns and (doc, sub) under the names ``keep``: the documents
    are ordered by (doc, sub).  Rows that repeat an id and its text are one
    document (``sub`` is the text's hash), other texts of the id are others.  A row
    without id is a document of its own; these rows are numbered and written."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    doc, sub = keep or ("doc", "sub")

    def rows(own, number):
        return own.select(*([F.col(f"`{c}`") for c in own.columns] if keep else []),
                          F.coalesce(ident.cast("long"), F.lit(NULL_ID)).alias(doc), number.cast("long").alias(sub),
                          *([] if keep else [text.alias("text")]))

    unnamed = save(rows(docs.filter(ident.isNull()), F.monotonically_increasing_id()), "unnamed")
    # What is read from a file may be null for all that Spark knows; these keys are not.
    unnamed = unnamed.withColumns({doc: F.coalesce(doc, F.lit(NULL_ID)), sub: F.coalesce(sub, F.lit(0).cast("long"))})
    return rows(docs.filter(ident.isNotNull()), F.xxhash64(text)).unionByName(unnamed)


def original_id(name: str = "doc_id"):
    return F.when(F.col("doc") == NULL_ID, F.lit(None).cast("long")).otherwise(F.col("doc")).alias(name)
