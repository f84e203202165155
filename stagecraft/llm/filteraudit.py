"""Filter interaction audit: what five filters remove, together and one by one.

Which documents repeat a smaller id's text is the only question that rows share.
A counting Bloom sketch answers most of it: every text's hash counts in a few
cells, the tasks' sketches are merged by cell, and a text with a cell that only
it has counted is guaranteed unique.  Only the other texts, the possible
repeats, are shuffled, for the exact smallest id of each full text.

Every row then has a mask of the filters it fails.  The masks' counts (with
those of good and toxic rows) are additive: what a filter removes at any place
in any order is a sum over at most 32 masks a part, so all orders come from one
small table.
"""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.llm import common as C

FILTERS = "ABCDE"
#: Cells that a text counts in, cells a row, and the most cells of a sketch (one
#: bit of each is broadcast: 64 MB).  Beyond that the sketch clears fewer texts
#: and more are shuffled; the result is the same.
HASHES, CELLS_A_ROW, MAX_CELLS = 4, 16, 1 << 29
BLOCK = 1 << 16
#: Cells that a task collects before it writes them out.
FLUSH = 1 << 21

_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#$%&*|")] = 1


def _flags(batches):
    """(doc_id, part, h, mask of A to D); bytes.split() separates at the words' own separators."""
    for batch in batches:
        texts = batch.column("text")
        mask: list[int] = []
        data, off = C.buffers(texts)
        chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        for i in range(len(texts)):
            own = data[off[i]:off[i + 1]]
            words = own.tobytes().split()
            n, distinct = len(words), len(set(words))
            mask.append((n < 100) + 2 * (100 * distinct < 80 * n) + 4 * bool(100 * int(_CAPITAL[own].sum()) > 10 * int(chars[i]))
                        + 8 * bool(_SYMBOL[own].any()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("h"), pa.array(mask, pa.int32())],
                                         names=["doc_id", "part", "h", "mask"])


def cells_of(h: np.ndarray, cells: int) -> np.ndarray:
    """(HASHES, n) different cells of each hash; ``cells`` is a power of two."""
    x = h.astype(np.int64).view(np.uint64)
    first, step = C.mix(x), C.mix(x ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) & np.uint64(cells - 1) for i in range(HASHES)]).astype(np.int64)


def _sketches(cells: int):
    """Partial sketches (block, cells counted once, cells counted more often)."""
    def emit(parts: list[np.ndarray]):
        cell, n = np.unique(np.concatenate(parts), return_counts=True)
        block, start = np.unique(cell // BLOCK, return_index=True)
        once, more = [], []
        for lo, hi in zip(start, [*start[1:], len(cell)]):
            inside, again = (cell[lo:hi] % BLOCK).astype(np.uint16), n[lo:hi] > 1
            once.append(inside[~again].tobytes())
            more.append(inside[again].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
                                          names=["block", "once", "more"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(cells_of(batch.column("h").to_numpy(), cells).ravel())
                held += len(parts[-1])
            if held >= FLUSH:
                yield emit(parts)
                parts, held = [], 0
        if parts:
            yield emit(parts)

    return C.released(run)


def _merged(batches):
    """(block, one bit a cell: counted more than once), from partial sketches streamed by."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, once, more in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "more"))):
            n = counts.setdefault(block, np.zeros(BLOCK, np.uint8))
            one = np.frombuffer(once, np.uint16)
            n[one] = np.minimum(n[one] + 1, 2)
            n[np.frombuffer(more, np.uint16)] = 2
    blocks = sorted(counts)
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([np.packbits(counts[b] > 1).tobytes() for b in blocks], pa.binary())],
                                     names=["block", "again"])


def sketch_cells(rows: int, most: int = MAX_CELLS) -> int:
    """A power of two, CELLS_A_ROW a row or more up to ``most``."""
    return max(BLOCK, min(most, 1 << max(0, (CELLS_A_ROW * rows - 1).bit_length())))


def merged_sketch(hashes: DataFrame, cells: int) -> bytes:
    """One bit for each cell of the merged sketch of column ``h``: counted more than once."""
    parts = hashes.select("h").mapInArrow(_sketches(cells), "block int, once binary, more binary")
    again = np.zeros(cells // 8, np.uint8)
    for r in parts.repartition("block").mapInArrow(C.released(_merged), "block int, again binary").collect():  # cells / 8 bytes at most
        at = r.block * (BLOCK // 8)
        again[at:at + BLOCK // 8] = np.frombuffer(r.again, np.uint8)
    return again.tobytes()


def _possible(shared, cells: int):
    """Whether a text with the hash may stand more than once."""
    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        again = np.frombuffer(shared.value, np.uint8)
        at = cells_of(h.to_numpy(), cells)
        return pd.Series(((again[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0))

    return possible


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                most_cells: int = MAX_CELLS) -> DataFrame:
    """(part, mask, n, good, toxic): rows by the filters they fail (A is 1, B 2, C 4, D 8, E 16).

    Null text is empty, a null part the empty string.  A row without id never
    fails E and makes no other row fail; rows that repeat an id and its text
    count each, none fails E for the other.  An id with several label rows is
    good or toxic if one of them says so.  Without documents there are no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       text.alias("text"), F.xxhash64(text).alias("h"))
    flags, at = C.written(base.mapInArrow(C.released(_flags), "doc_id long, part string, h long, mask int"), "flags")
    cells = sketch_cells(flags.count(), most_cells)
    shared = spark.sparkContext.broadcast(merged_sketch(flags, cells))
    possible = _possible(shared, cells)
    # Exact: the smallest id of each full text among the possible repeats.
    first = (base.select("doc_id", "text", "h").filter(F.col("doc_id").isNotNull()).filter(possible("h"))
             .groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.xxhash64("text").alias("h"), F.lit(True).alias("first")))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality"), F.col("toxic"))
    own = own.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"),
                                                                        F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    # Repeated rows meet before the joins; rows without id join nothing.
    rows = flags.withColumn("possible", possible("h"))
    named = rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "h", "part", "mask", "possible").agg(F.count(F.lit(1)).alias("n"))
    named = named.join(first, ["doc_id", "h"], "left").join(own, "doc_id", "left").select(
        "part", (F.col("mask") + F.when(F.col("possible") & F.col("first").isNull(), 16).otherwise(0)).alias("mask"), "n",
        (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    unnamed = flags.filter(F.col("doc_id").isNull()).select("part", "mask", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("good"),
                                                            F.lit(0).cast("long").alias("toxic"))
    counts = named.unionByName(unnamed).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    out = C.save(counts, "masks")
    C.discard(spark, at)
    shared.destroy()
    return out


def _places() -> str:
    """Every place of every order: the filter's bit, and the bits before it."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return json.dumps([{"filter_order": "".join(o), "step": i + 1, "bit": bit[o[i]], "before": sum(bit[f] for f in o[:i])}
                       for o in permutations(FILTERS) for i in range(len(o))])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                 most_cells: int = MAX_CELLS) -> DataFrame:
    """Per (part, filter_order, step): kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (see ``mask_counts`` for the rows' rules)."""
    masks = mask_counts(docs, labels, id_col, text_col, part_col, most_cells)
    places = F.from_json(F.lit(_places()), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = masks.withColumn("p", F.explode(places)).select("part", "p.*", "mask", "n", "good", "toxic")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(when, of="n"):
        return F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")

    share = F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1))  # orders in which a failing filter stands first
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share.cast("long")).otherwise(0)).cast("long").alias("shapley"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT w.doc_id, part, {'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, false)} AS fails,
    coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON w.doc_id = l.doc_id),
long AS (SELECT part, good, toxic, row_number() OVER () AS r, unnest([{'k': 'A', 'v': fails.A}, {'k': 'B', 'v': fails.B}, {'k': 'C', 'v': fails.C},
    {'k': 'D', 'v': fails.D}, {'k': 'E', 'v': fails.E}]) AS x FROM f),
masks AS (SELECT part, good, toxic, failed, count(*) AS n FROM
  (SELECT r, any_value(part) AS part, any_value(good) AS good, any_value(toxic) AS toxic, coalesce(string_agg(x.k, '' ORDER BY x.k) FILTER (x.v), '') AS failed FROM long GROUP BY r)
  GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
orders AS (SELECT a.k || b.k || c.k || d.k || e.k AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
places AS (SELECT o, CAST(s AS INTEGER) AS step, substr(o, s, 1) AS k, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) t(s)),
hit AS (SELECT part, o, step, k, n, good, toxic, failed, contains(failed, k) AS fails, len(list_filter(string_split(failed, ''), lambda x: x <> '' AND contains(before, x))) > 0 AS earlier
  FROM masks, places),
steps AS (SELECT part, o AS filter_order, step, any_value(k) AS k, sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = k THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT earlier AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails AND NOT earlier AND toxic THEN n ELSE 0 END) AS toxic_lost FROM hit GROUP BY part, o, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM steps"""
