"""Suffix dedup of bytes by bucket-pointer refinement.

A byte is a duplicate if a 100-byte string that covers it also starts earlier.
``repeats`` samples 32-byte grams and groups the strings by them; whole blocks of
strings that equal an earlier block are judged there.  The positions of the other
blocks are ordered here as far as needed: initial buckets by their first 32 bytes,
then refined by sorting on the bucket pointers of later offsets (32 -> 64 -> 100
bytes), every pass using the pointers of the pass before.  A position alone in its
bucket is final and drops out, with all that reach into it.  Buckets too large for
a task (``repeats.HOT``) are dealt by the hash of the whole string instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.llm import common as C
from stagecraft.llm import repeats as R

LENGTH, GRAM = 100, 32
#: Blocks that are refined together.
LOT = 8192


def bucket_pointers(at: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` positions the place of the last member of its bucket when
    the positions ``at`` are sorted by ``key``; -1 for those alone or not in ``at``."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    count = np.diff(np.append(head, len(key)))
    out = np.full(size, -1, np.int64)
    out[at[order]] = np.repeat(np.where(count > 1, head + count - 1, -1), count)
    return out


def refined(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Bucket pointers of all positions of the texts ``data[off[i]:off[i + 1]]`` by the
    ``length`` bytes that start there; -1 where no other position has the same (or
    fewer bytes are left)."""
    size = len(data)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(size)
    at = np.flatnonzero(left >= gram)
    pointer = bucket_pointers(at, C.mix(C.rolling(C.prefix(C.BYTE_VALUE[data]), gram))[at], size)
    depth = gram
    while depth < length:
        step = min(depth, length - depth)
        at = np.flatnonzero((left >= depth + step) & (pointer >= 0))
        at = at[pointer[at + step] >= 0]
        pointer = bucket_pointers(at, pointer[at] * size + pointer[at + step], size)
        depth += step
    return pointer


def _judge(length: int, gram: int):
    def judge(doc, sub, p, n, body):
        """Spans of strings that are not the first of their refined bucket."""
        data = np.frombuffer(b"".join(body), np.uint8)
        off = np.cumsum([0, *map(len, body)])
        pointer = refined(data, off, length, min(gram, length))
        at = np.flatnonzero(pointer >= 0)
        row = np.searchsorted(off, at, "right") - 1
        bucket, doc, sub, s = pointer[at], doc[row], sub[row], p[row] + at - off[row]
        order = np.lexsort((s, sub, doc, bucket))
        bucket, doc, sub, s = bucket[order], doc[order], sub[order], s[order]
        head = np.searchsorted(bucket, bucket, "left")
        later = (doc != doc[head]) | (sub != sub[head]) | (s != s[head])
        doc, sub, s = doc[later], sub[later], s[later]
        order = np.lexsort((s, sub, doc))
        return R.runs(doc[order], sub[order], s[order], length)

    return judge


def _apply(batches):
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64()] * 4 + [pa.string()]
    schema = pa.schema(list(zip(names, types)))
    for batch in batches:
        ids, spans = batch.column("doc").to_pylist(), batch.column("spans").to_pylist()
        rows: list[list] = [[] for _ in names]
        for lo, hi, data, off in C.chunks(batch.column("text")):
            raw = data.tobytes()
            for i in range(lo, hi):
                a, b = int(off[i - lo]), int(off[i - lo + 1])
                cut = R.covered(spans[i], b - a)
                digest, at = hashlib.sha256(), a
                for s, e in cut:
                    digest.update(raw[at:a + s])
                    at = a + e
                digest.update(raw[at:b])
                for r, v in zip(rows, (ids[i], b - a, sum(e - s for s, e in cut), len(cut), digest.hexdigest())):
                    r.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], schema=schema)


def repeated_bytes(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, sub, spans) of ``common.own_rows``: byte spans covered by a
    ``length``-byte string that also starts earlier (smaller document, or same
    document and earlier start).

    Documents are ordered by id; the texts of one id by their hash; rows without
    id, each a document of its own, come last as they are written.  Null text is
    empty.  Texts under ``length`` bytes have no spans.
    """
    return R.repeated_spans(rows, length, gram, R.byte_tokens, False, np.uint8, _judge(length, gram), LOT)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    the SHA-256 of the bytes that stay.  An empty table gives an empty result."""
    rows = C.own_rows(docs, id_col, text_col)
    out = (rows.join(repeated_bytes(rows), ["doc", "sub"], "left").select("doc", "text", "spans")
           .mapInArrow(_apply, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    return out.select(C.original_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
