"""Substring dedup of words by a relative Lempel-Ziv parse.

A word is a duplicate if a 50-word window that covers it also starts in a smaller
document.  ``repeats`` cuts all documents into reference blocks (the windows owned by
one 12-word gram) and brings the blocks of a gram together.  A block that equals one
of a smaller document is a factor as a whole; every other block is parsed greedily
against all blocks of smaller documents (``factors``): at each window the longest
match among them is one factor, and the next one starts with the first window that
reaches beyond it, so windows across the border of two factors are looked up too.
Factors have 50 words or more; words in none are literals.  Buckets too large for a
task (``repeats.HOT``) are dealt by the hash of the window, where a factor is one
window.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.llm import common as C
from stagecraft.llm import repeats as R

LENGTH, GRAM = 50, 12
#: Blocks that are parsed together.
LOT = 2048


def _common(a: bytes, b: bytes) -> int:
    """Number of equal words (8 bytes each) at the start."""
    n = min(len(a), len(b)) // 8
    other = np.frombuffer(a, np.uint64, n) != np.frombuffer(b, np.uint64, n)
    return int(other.argmax()) if other.any() else n


def factors(doc, body, length: int):
    """Greedy factors of blocks against all blocks of smaller documents.

    ``doc`` numbers the documents of the blocks, ascending; ``body`` holds their words
    as 8-byte hashes.  Returns arrays (block, start, end, reference block, start
    there), in block order; of equally long references any may be named.  The index
    holds, for each window that stands in several documents, what follows from there
    in its block, sorted: the longest match is a neighbour.
    """
    words = np.frombuffer(b"".join(body), np.uint64)
    off = np.cumsum([0, *(len(b) // 8 for b in body)])
    n = np.maximum(np.diff(off) - length + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = off[row] + at
    h = C.mix(C.span(C.prefix(words), start, start + length))
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    head = np.flatnonzero(np.append(True, sorted_h[1:] != sorted_h[:-1])[:len(h)])
    size = np.diff(np.append(head, len(h)))
    shared = doc[row[order[head]]] != doc[row[order[head + size - 1]]]
    kind = np.full(len(h), -1, np.int64)
    kind[order] = np.repeat(np.where(shared, np.arange(len(head)), -1), size)
    found = np.flatnonzero(kind >= 0)
    out: list[tuple[int, int, int, int, int]] = []
    index: dict[int, list[tuple[bytes, int, int]]] = {}
    held: list[tuple[int, bytes, int, int]] = []
    own, last, free = None, -1, 0
    for r, k, c in zip(row[found].tolist(), at[found].tolist(), kind[found].tolist()):
        if r != last:
            if doc[r] != own:
                for window, rest, block, first in held:
                    known = index.setdefault(window, [])
                    place = bisect_left(known, (rest,))
                    if place == len(known) or known[place][0] != rest:
                        known.insert(place, (rest, block, first))
                held, own = [], doc[r]
            last, free = r, 0
        rest = body[r][8 * k:]
        held.append((c, rest, r, k))
        if k < free or c not in index:
            continue
        known = index[c]
        place = bisect_left(known, (rest,))
        best, block, first = max((_common(rest, x), b, f) for x, b, f in known[max(place - 1, 0):place + 1])
        if best >= length:
            out.append((r, k, k + best, block, first))
            free = k + best - length + 1
    return tuple(np.array(out, np.int64).reshape(-1, 5).T)


def _judge(length: int):
    def judge(doc, sub, p, n, body):
        order = np.lexsort((p, sub, doc))
        doc, sub, p = doc[order], sub[order], p[order]
        number = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])))
        block, s, e, _, _ = factors(number, [body[i] for i in order], length)
        return doc[block], sub[block], p[block] + s, p[block] + e

    return judge


def duplicate_words(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, sub, spans) of ``common.own_rows``: word spans covered by a
    ``length``-word window that also starts in a smaller document.  Documents are
    ordered by id; the texts of one id by their hash; rows without id, each a
    document of its own, come last as they are written.  Null text has no words."""
    return R.repeated_spans(rows, length, gram, R.word_tokens, True, np.uint64, _judge(length), LOT)


def _digest(batches):
    names = ["doc", "n_words", "n_removed", "kept_sha256"]
    types = [pa.int64()] * 3 + [pa.string()]
    schema = pa.schema(list(zip(names, types)))
    for batch in batches:
        ids, spans = batch.column("doc").to_pylist(), batch.column("spans").to_pylist()
        rows: list[list] = [[] for _ in names]
        for lo, hi, data, off in C.chunks(batch.column("text")):
            raw = data.tobytes()
            starts, _, woff = C.word_bounds(data, off, C.PLAIN_WORD)
            for i in range(lo, hi):
                n = int(woff[i - lo + 1] - woff[i - lo])
                cut = R.covered(spans[i], n)
                words = raw[off[i - lo]:off[i - lo + 1]].split()
                kept, at = [], 0
                for s, e in cut:
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                for r, v in zip(rows, (ids[i], n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
                    r.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], schema=schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the SHA-256 of the kept words
    joined by one space.  An empty table gives an empty result."""
    rows = C.own_rows(docs, id_col, text_col)
    out = (rows.join(duplicate_words(rows), ["doc", "sub"], "left").select("doc", "text", "spans")
           .mapInArrow(_digest, "doc long, n_words long, n_removed long, kept_sha256 string"))
    return out.select(C.original_id(), "n_words", "n_removed", "kept_sha256")


def cut_words(data: bytes, starts, ends, cut) -> bytes:
    """The text without the words of ``cut`` and the white space after each run."""
    out, at = [], 0
    for s, e in cut:
        out.append(data[at:starts[s]])
        at = int(starts[e]) if e < len(starts) else len(data)
    out.append(data[at:])
    return b"".join(out)


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with duplicate spans cut from the text (layout of the rest kept)
    and ``length_col`` set anew; documents left without a word that had one go."""
    doc, sub, marks = C.fresh(docs, "doc", "sub", "spans")
    rows = C.own_rows(docs, id_col, text_col, keep=(doc, sub))
    spans = duplicate_words(rows.select(F.col(doc).alias("doc"), F.col(sub).alias("sub"), F.col(f"`{text_col}`").cast("string").alias("text")))
    spans = spans.select(F.col("doc").alias(doc), F.col("sub").alias(sub), F.col("spans").alias(marks))
    joined = rows.join(spans, [doc, sub], "left")

    @F.pandas_udf("string")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(t, f):
            if t is None or f is None or not len(f):
                return t
            raw = t.encode()
            data = np.frombuffer(raw, np.uint8)
            starts, ends, _ = C.word_bounds(data, np.array([0, len(data)]), C.PLAIN_WORD)
            return cut_words(raw, starts, ends, R.covered(f, len(starts))).decode()
        for text, found in parts:
            yield text.combine(found, one)
        C.forget()

    out = joined.withColumn(text_col, F.when(F.col(marks).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(marks))))
    out = out.filter(F.col(marks).isNull() | F.col(text_col).rlike(r"[^ \x09-\x0D]")).drop(doc, sub, marks)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(length_col).isNotNull(), F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
