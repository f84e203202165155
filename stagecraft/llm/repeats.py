"""Repeated windows of tokens across a corpus, exactly, with one shuffle of
sampled anchors instead of one of all positions.

A window is ``length`` consecutive tokens of one document.  Each window is owned
by one anchor: the rightmost smallest hash among its ``gram``-token grams.  Equal
windows hold equal anchors at equal offsets, so grouping anchors by their gram
(the initial bucket) brings all equal windows together.  An anchor's block is the
run of windows that it owns.

1. Blocks equal to an earlier block are repeats as a whole (two 64-bit hashes).
2. First blocks in a bucket with one kind of block only have no earlier equal
   window; they are dropped.
3. The rest (the ends of repeated passages) are judged on their own tokens, a whole
   bucket at a time, by the operator's method: ``substring.factors`` parses them
   greedily, ``suffix.refined`` refines their buckets.  Buckets with more than ``HOT``
   blocks are dealt by window hash instead, so no bucket has to fit one task.

Blocks are pre-aggregated by the quarter million (a lot), so a passage that a third
of all documents share sends one row for each of these.  Where a passage ends, each
document has a block of its own: a bucket with more than ``SPLIT`` kinds of blocks
in one lot is split, its blocks are dealt one by one and a single mark goes to the
bucket, whose other blocks are then dealt by window hash too.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.llm import common as C

#: Blocks of one bucket that one task refines; larger buckets are dealt by window.
HOT = 2048
#: Kinds of blocks of one bucket in one lot that are sent to the bucket; more are dealt singly.
SPLIT = 64
#: Tokens of a document that are handled at once; longer ones are cut with overlap.
SEGMENT = 1 << 19
#: Blocks that are pre-aggregated and sent together.
FLUSH = 1 << 18
ANCHOR_SCHEMA = "ah long, ch long, run long, doc long, sub long"
BLOCK_SCHEMA = "ah long, doc long, sub long, p long, n int, body binary"
SPAN_SCHEMA = "doc long, sub long, s long, e long"


def byte_tokens(data: np.ndarray, off: np.ndarray):
    """Tokens are the bytes themselves."""
    return data, off


def word_tokens(data: np.ndarray, off: np.ndarray):
    h, woff, _, _ = C.word_hashes(data, off, C.PLAIN_WORD)
    return h, woff


def _values(tokens: np.ndarray) -> np.ndarray:
    return C.BYTE_VALUE[tokens] if tokens.dtype == np.uint8 else tokens


def segments(tokens: np.ndarray, off: np.ndarray, length: int):
    """(document indexes, first tokens, token array, offsets): documents of at
    least ``length`` tokens, packed; long ones in overlapping pieces."""
    doc, base, parts, size = [], [], [], 0
    for i in np.flatnonzero(np.diff(off) >= length):
        a, b = int(off[i]), int(off[i + 1])
        at = a
        while at + length <= b:
            end = min(b, at + SEGMENT + length - 1)
            doc.append(i)
            base.append(at - a)
            parts.append(tokens[at:end])
            size += end - at
            at += SEGMENT
            if size >= SEGMENT:
                yield np.array(doc), np.array(base), np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                doc, base, parts, size = [], [], [], 0
    if parts:
        yield np.array(doc), np.array(base), np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def owned_blocks(values: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(piece, first window, number of windows, gram hash, block hash) of all anchors."""
    pre = C.prefix(values)
    g = C.mix(C.rolling(pre, gram))
    w = length - gram + 1
    n = len(g)
    low = np.uint64((1 << 24) - 1)
    packed = (g & ~low) | (low - np.arange(n, dtype=np.uint64))
    pad = -n % w
    grid = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    owner = (low - (np.minimum(tail[: n - w + 1], head[w - 1: n]) & low)).astype(np.int64)
    valid = np.zeros(n - w + 1, bool)
    for a, b in zip(off[:-1], off[1:]):
        valid[a: b - length + 1] = True
    at = np.flatnonzero(valid)
    piece = np.searchsorted(off, at, "right") - 1
    own = owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, own, piece = at[first], own[first], piece[first]
    body = C.mix(C.span(pre, start, start + count - 1 + length) + np.uint64(977) * (own - start).astype(np.uint64)
                 + np.uint64(0x51ED270B) * count.astype(np.uint64))
    return piece, start - off[piece], count, g[own], body


def _place(doc, sub, p):
    return C.mix((doc.astype(np.uint64) * np.uint64(31) + sub.astype(np.uint64)) * np.uint64(31) + p.astype(np.uint64))


def _count_bits(length: int, gram: int) -> int:
    """Bits of a block's number of windows."""
    return (length - gram + 1).bit_length()


def _run(p, n, full, wide, bits: int):
    """``p``, ``n`` (of ``bits`` bits), ``full`` and ``wide`` of a block as one number: these
    rows are the largest shuffle, and four columns of a few bits take 32 bytes of each."""
    return ((p << bits | n) << 2) | (full.astype(np.int64) << 1) | wide


def _of_run(bits: int) -> dict:
    """The columns that ``_run`` has packed."""
    run = F.col("run")
    return {"p": F.shiftright(run, bits + 2), "n": F.shiftright(run, 2).bitwiseAND((1 << bits) - 1).cast("int"),
            "full": run.bitwiseAND(2) != 0, "wide": run.bitwiseAND(1) != 0}


def _anchor_rows(tokenise: Callable, length: int, gram: int, across: bool, split: int):
    """One row for each block; its number of windows is 0 for the mark of a bucket that was split."""
    schema = pa.schema([(c, pa.int64()) for c in ("ah", "ch", "run", "doc", "sub")])
    bits = _count_bits(length, gram)

    def run(batches):
        C.forget()
        for batch in batches:
            ids, subs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "sub"))
            found, size = [], 0
            for lo, hi, data, off in C.chunks(batch.column("text")):
                tokens, toff = tokenise(data, off)
                for doc, base, part, poff in segments(tokens, toff, length):
                    piece, start, count, ah, ch = owned_blocks(_values(part), poff, length, gram)
                    found.append((ah, ch, ids[lo + doc[piece]], subs[lo + doc[piece]], start + base[piece], count))
                    size += len(ah)
                    if size >= FLUSH:
                        yield rows(found)
                        found, size = [], 0
            if found:
                yield rows(found)

    def rows(found):
        ah, ch, doc, sub, p, n = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((p, sub, doc, ch, ah))
        ah, ch, doc, sub, p, n = ah[order], ch[order], doc[order], sub[order], p[order], n[order]
        new = np.ones(len(ah), bool)
        new[1:] = (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        other = (doc != doc[head]) | (sub != sub[head])
        full = other if across else other | (p != p[head])
        # A row that is already judged goes anywhere: it must not make its bucket hot.
        key = np.where(full, C.mix(ah + _place(doc, sub, p)), ah)
        bucket = np.ones(len(ah), bool)
        bucket[1:] = ah[1:] != ah[:-1]
        wide = (np.bincount(np.cumsum(bucket) - 1, weights=new) > split)[np.cumsum(bucket) - 1]
        key = np.where(wide & ~full, C.mix(ah ^ C.mix(ch)), key)
        mark = np.flatnonzero(bucket & wide)
        at = np.concatenate([np.lexsort((p, sub, doc)), mark])
        key = np.concatenate([key[at[:len(ah)]], ah[mark]])
        marked = np.arange(len(at)) >= len(ah)
        packed = _run(p[at], np.where(marked, 0, n[at]), full[at] & ~marked, wide[at], bits)
        cols = [C.signed(key), C.signed(ch)[at], packed, doc[at], sub[at]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    return run


def _block_rows(tokenise: Callable, length: int):
    schema = pa.schema([("ah", pa.int64()), ("doc", pa.int64()), ("sub", pa.int64()), ("p", pa.int64()), ("n", pa.int32()), ("body", pa.binary())])

    def run(batches):
        for batch in batches:
            todo = batch.column("todo").to_pylist()
            ids, subs = batch.column("doc").to_pylist(), batch.column("sub").to_pylist()
            for lo, hi, data, off in C.chunks(batch.column("text")):
                tokens, toff = tokenise(data, off)
                ah, doc, sub, p, n, body = [], [], [], [], [], []
                for i in range(lo, hi):
                    text = tokens[toff[i - lo]:toff[i - lo + 1]]
                    for t in todo[i]:
                        if t["p"] + t["n"] - 1 + length <= len(text):
                            ah.append(t["ah"])
                            doc.append(ids[i])
                            sub.append(subs[i])
                            p.append(t["p"])
                            n.append(t["n"])
                            body.append(text[t["p"]:t["p"] + t["n"] - 1 + length].tobytes())
                if ah:
                    yield pa.RecordBatch.from_arrays([pa.array(ah), pa.array(doc), pa.array(sub), pa.array(p), pa.array(n, pa.int32()), pa.array(body, pa.binary())], schema=schema)

    return run


def _window_hashes(doc, sub, p, n, body, length: int, dtype):
    """Per window: document (two columns), start, two hashes."""
    tokens = np.frombuffer(b"".join(body), dtype=dtype)
    off = np.cumsum([0, *(len(b) // np.dtype(dtype).itemsize for b in body)])
    values = _values(tokens)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = off[row] + k
    h = C.mix(C.span(C.prefix(values), start, start + length))
    h2 = C.mix(C.span(C.prefix(C.mix(values + np.uint64(1))), start, start + length))
    return doc[row], sub[row], p[row] + k, h, h2


def runs(doc, sub, s, length: int):
    """Spans of maximal runs of consecutive window starts (sorted by document, start)."""
    if not len(doc):
        return doc, sub, s, s
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (s[1:] > s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], sub[first], s[first], s[last] + length


def _known(d, sub, s, h, h2, across: bool):
    """The windows of one lot in the order of their hashes, and which of them repeat
    an earlier window of the lot."""
    order = np.lexsort((s, sub, d, h2, h))
    h, h2, d, sub, s = h[order], h2[order], d[order], sub[order], s[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    other = (d != d[head]) | (sub != sub[head])
    return d, sub, s, h, h2, other if across else other | (s != s[head])


def _refine(judge: Callable, limit: int):
    """Spans that ``judge`` finds in lots of whole buckets, of ``limit`` blocks or somewhat more."""
    schema = pa.schema([("doc", pa.int64()), ("sub", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])

    def spans(rows):
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in judge(*rows[1:])], schema=schema)

    def run(batches):
        """Rows come sorted by bucket; whole buckets are judged together."""
        held: list = []
        size = 0
        for batch in batches:
            held.append([batch.column("ah").to_numpy(), batch.column("doc").to_numpy(), batch.column("sub").to_numpy(),
                         batch.column("p").to_numpy(), batch.column("n").to_numpy(), batch.column("body").to_pylist()])
            size += batch.num_rows
            if size < limit:
                continue
            ah, doc, sub, p, n = (np.concatenate([x[i] for x in held]) for i in range(5))
            body = [b for x in held for b in x[5]]
            cut = int(np.searchsorted(ah, ah[-1], "left"))
            if cut:
                yield spans((ah[:cut], doc[:cut], sub[:cut], p[:cut], n[:cut], body[:cut]))
            held = [[ah[cut:], doc[cut:], sub[cut:], p[cut:], n[cut:], body[cut:]]]
            size = len(ah) - cut
        if size:
            ah, doc, sub, p, n = (np.concatenate([x[i] for x in held]) for i in range(5))
            yield spans((ah, doc, sub, p, n, [b for x in held for b in x[5]]))

    return run


def _window_rows(length: int, dtype, across: bool):
    schema = pa.schema([("h", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("sub", pa.int64()), ("p", pa.int64()), ("full", pa.bool_())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                b = batch.slice(lo, 2048)
                d, sub, s, h, h2, full = _known(*_window_hashes(b.column("doc").to_numpy(), b.column("sub").to_numpy(), b.column("p").to_numpy(),
                                                                b.column("n").to_numpy(), b.column("body").to_pylist(), length, dtype), across)
                # As with blocks, a window that is already judged goes anywhere.
                h = np.where(full, C.mix(h + _place(d, sub, s)), h)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(h)), pa.array(C.signed(h2)), pa.array(d), pa.array(sub), pa.array(s), pa.array(full)], schema=schema)

    return run


def repeated_spans(docs: DataFrame, length: int, gram: int, tokenise: Callable, across: bool, dtype,
                   judge: Callable, lot: int) -> DataFrame:
    """(doc, sub, spans array<struct<s,e>>) of tokens covered by a repeated window.

    ``docs`` has (doc, sub, text), see ``common.own_rows``.  ``across``: a window
    repeats if it also starts in a smaller document; else also if it starts earlier
    in the same one.  Rows that repeat (doc, sub) are the same document, never
    repeats of each other.  Documents without a repeated window give no row.
    ``judge`` gets (doc, sub, p, n, bodies) of the blocks of some whole buckets, about
    ``lot`` at once, and returns arrays (doc, sub, start, end) of their repeated tokens.
    """
    anchors = docs.mapInArrow(C.released(_anchor_rows(tokenise, length, gram, across, SPLIT)), ANCHOR_SCHEMA).repartition("ah")
    anchors = anchors.select("ah", "ch", "doc", "sub", *[c.alias(k) for k, c in _of_run(_count_bits(length, gram)).items()])
    block, bucket = Window.partitionBy("ah", "ch"), Window.partitionBy("ah")
    at = F.struct("doc", "sub") if across else F.struct("doc", "sub", "p")
    first = F.min(F.when(F.col("n") > 0, at)).over(block)
    judged = (anchors.withColumn("first", first)
              .withColumn("wide", F.max(F.col("wide") & ~F.col("full")).over(bucket))
              .withColumn("kinds", F.col("wide") | (F.min("ch").over(bucket) != F.max("ch").over(bucket)))
              .filter("n > 0")
              .withColumn("dup", F.col("full") | (at > F.col("first")))
              .withColumn("size", F.sum(F.when(F.col("dup"), 0).otherwise(1)).over(bucket))
              .filter(F.col("dup") | F.col("kinds"))
              .select("dup", (F.col("wide") | (F.col("size") > HOT)).alias("hot"), "ah", "doc", "sub", "p", "n"))
    judged = C.save(judged, "repeat-blocks")
    whole = judged.filter("dup").select("doc", "sub", F.col("p").alias("s"), (F.col("p") + F.col("n") - 1 + length).alias("e"))

    todo = (judged.filter(~F.col("dup")).dropDuplicates(["doc", "sub", "p", "ah"])
            .groupBy("doc", "sub").agg(F.collect_list(F.struct("ah", "p", "n", "hot")).alias("todo")))
    # Callers join ``docs`` with the spans by the same keys: both joins read one shuffle of
    # the texts, as long as no filter (here, for keys that may be null) tells them apart.
    bodies = (docs.join(todo, ["doc", "sub"]).select("doc", "sub", "text", "todo"))
    calm = (bodies.withColumn("todo", F.filter("todo", lambda t: ~t["hot"]))
            .mapInArrow(C.released(_block_rows(tokenise, length)), BLOCK_SCHEMA)
            .repartition("ah").sortWithinPartitions("ah")
            .mapInArrow(C.released(_refine(judge, lot)), SPAN_SCHEMA))
    parts = [whole, calm]
    if not judged.filter(~F.col("dup") & F.col("hot")).isEmpty():
        windows = (bodies.withColumn("todo", F.filter("todo", lambda t: t["hot"])).filter(F.size("todo") > 0)
                   .mapInArrow(C.released(_block_rows(tokenise, length)), BLOCK_SCHEMA)
                   .mapInArrow(C.released(_window_rows(length, dtype, across)), "h long, h2 long, doc long, sub long, p long, full boolean"))
        same = Window.partitionBy("h", "h2")
        parts.append(windows.withColumn("first", F.min(at).over(same))
                     .filter(F.col("full") | (at > F.col("first")))
                     .select("doc", "sub", F.col("p").alias("s"), (F.col("p") + length).alias("e")))
    spans = parts[0]
    for x in parts[1:]:
        spans = spans.unionByName(x)
    return spans.groupBy("doc", "sub").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def covered(spans, n: int) -> list[tuple[int, int]]:
    """Disjoint, sorted spans (touching ones merged) within [0, n)."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in (() if spans is None else spans)):
        e = min(e, n)
        if s >= e:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]
