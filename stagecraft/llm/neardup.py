"""Near-duplicate documents by SuperMinHash, banding, verification and grouping.

Each distinct shingle walks the signature slots in the order of its own random
permutation (Fisher-Yates, from the shingle's hash); its value at the j-th slot
is j + r, 0 <= r < 1.  A slot keeps its minimum.  The ranks of one element are
correlated (a permutation), which lowers the variance against independent
hashes; once every slot of a document holds less than j, deeper ranks cannot
win and the walk stops.

Documents with the same shingle set form one class; its smallest id stands for
it.  Class signatures are cut into ``BANDS`` x ``ROWS``; a pair at similarity
0.85 shares no band with probability (1 - 0.85**5)**24 < 1e-6.  In each band
bucket members are first compared with the smallest one (a star, linear), on
full shingle sets.  What then is still in different components of one bucket
goes through an exact prefix join: shingles are ordered by rarity among these
documents, and two documents at the threshold must share one of the rarest
shingles of each (of the shorter n - ceil(170 n / 185) + 1, of the longer
n - ceil(85 n / 100) + 1).  Families of thousands whose members differ too much
meet in common shingles only, so they make no pairs, and no link
between components is lost.  Components come from min-label hooking and pointer
jumping on written tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.llm import common as C

SHINGLE, BANDS, ROWS = 5, 24, 5
SLOTS = BANDS * ROWS
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 85
_STEP = 1 << 15


def shingle_sets(data: np.ndarray, off: np.ndarray):
    """Sorted distinct shingle hashes of every text."""
    h, woff, _, _ = C.word_hashes(data, off, C.PLAIN_WORD, lower=True)
    pre = C.prefix(h)
    grams = C.mix(C.rolling(pre, SHINGLE) + np.uint64(SHINGLE))
    for a, b in zip(woff[:-1], woff[1:]):
        n = int(b - a)
        if n >= SHINGLE:
            yield np.unique(grams[a:b - SHINGLE + 1])
        elif n:
            yield C.mix(C.span(pre, np.array([a]), np.array([b])) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (sets x slots): rank in the high byte, fraction below it."""
    sig = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    flat = sig.reshape(-1)
    doc_of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for lo in range(0, len(items), _STEP):
        x, doc = items[lo:lo + _STEP].copy(), doc_of[lo:lo + _STEP]
        order = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
        row = np.arange(len(x))
        for j in range(slots):
            x = C.mix(x + np.uint64(0x9E3779B97F4A7C15))
            k = j + ((x >> np.uint64(40)) % np.uint64(slots - j)).astype(np.int64)
            slot = order[row, k]
            order[row, k] = order[row, j]
            fraction = C.mix(x ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(8)
            np.minimum.at(flat, doc * slots + slot, np.uint64(j << 56) | fraction)
            # Stop early: deeper ranks start at j + 1.
            first, last = doc[0], doc[-1] + 1
            going = sig[first:last].max(axis=1) >= np.uint64((j + 1) << 56)
            keep = going[doc - first]
            if not keep.all():
                x, doc, order = x[keep], doc[keep], order[keep]
                row = np.arange(len(x))
                if not len(x):
                    break
    return sig


def _signatures(batches):
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])
    C.forget()
    for batch in batches:
        ids = batch.column("doc").to_numpy(zero_copy_only=False)
        for lo, hi, data, off in C.chunks(batch.column("text")):
            sets = list(shingle_sets(data, off))
            sig = super_minhash(sets)
            bands = np.zeros((len(sets), BANDS), np.uint64)
            for r in range(ROWS):
                bands = C.mix(bands * np.uint64(31) + sig[:, r::ROWS][:, :BANDS])
            with np.errstate(over="ignore"):
                d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                d2 = np.array([C.mix(s + np.uint64(7)).sum(dtype=np.uint64) for s in sets], np.uint64)
            offsets = pa.array(np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo:hi]), pa.array([len(s) for s in sets], pa.int64()), pa.array(C.signed(d1)), pa.array(C.signed(d2)),
                 pa.ListArray.from_arrays(offsets, pa.array(C.signed(bands.reshape(-1))))], schema=schema)


def _linked(batches):
    """Pairs (a, b, text_a, text_b) whose full sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        seen: dict[int, np.ndarray] = {}
        keep = []
        ta, tb = batch.column("text_a"), batch.column("text_b")
        for i in range(batch.num_rows):
            if a[i] not in seen:
                seen = {a[i]: next(shingle_sets(*C.buffers(ta.slice(i, 1))))}
            x, y = seen[a[i]], next(shingle_sets(*C.buffers(tb.slice(i, 1))))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], schema=schema)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable.  Union-find by rounds: every
    root takes the smallest label across its links, then pointers are jumped
    until stable.  Each round is written, so nothing is replayed."""
    spark = nodes.sparkSession
    links = C.save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = C.save(links.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "label")
    while True:
        other = label.select(F.col("node").alias("b"), F.col("label").alias("far"))
        reach = (links.join(label.withColumnRenamed("node", "a"), "a").join(other, "b")
                 .filter("far < label").groupBy(F.col("label").alias("root")).agg(F.min("far").alias("to")))
        reach = C.save(reach, "hook")
        if reach.isEmpty():
            break
        hook = reach
        while True:  # a root may hook to a root that hooks itself
            step = (hook.alias("x").join(hook.alias("y"), F.col("x.to") == F.col("y.root"), "left")
                    .select("x.root", F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved")))
            step = C.save(step, "jump")
            hook = step.select("root", "to")
            if step.filter("moved").isEmpty():
                break
        label = C.save(label.join(hook, label["label"] == hook["root"], "left")
                       .select("node", F.coalesce("to", "label").alias("label")), "label")
    return nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    return (pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(C.released(_linked), "a long, b long"))


def _joined(part: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """(b, label) after the links' components are joined, and whether any were."""
    far = part.select(F.col("b").alias("b_"), F.col("label").alias("far"))
    ends = C.save(links.join(part.select(F.col("b").alias("a"), "label"), "a").join(far, F.col("b") == F.col("b_"))
                  .select(F.col("label").alias("a"), F.col("far").alias("b")).filter("a != b").distinct(), "ends")
    if ends.isEmpty():
        return part, False
    roots = components(ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct(), ends)
    moved = part.join(roots.select("node", F.col("label").alias("to")), part["label"] == F.col("node"), "left")
    return C.save(moved.select("b", F.coalesce("to", "label").alias("label")), "part"), True


def _shingle_lists(batches):
    schema = pa.schema([("b", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])
    for batch in batches:
        for lo, hi, data, off in C.chunks(batch.column("text")):
            sets = list(shingle_sets(data, off))
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("b").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(C.signed(np.concatenate(sets))))], schema=schema)


def _prefix_pairs(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of ``rest`` (b, label) in different components that share one of
    their rarest shingles; every pair at the threshold is among them."""
    lists = rest.join(texts, F.col("b") == F.col("doc")).select("b", "label", "text") \
        .mapInArrow(C.released(_shingle_lists), "b long, label long, n long, s array<long>")
    rows = C.save(lists.select("b", "label", "n", F.explode("s").alias("s")), "shingles")
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    order = Window.partitionBy("b").orderBy(F.coalesce("often", F.lit(1).cast("long")), "s")
    rare = rows.join(often, "s", "left").withColumn("k", F.row_number().over(order))
    longer = F.col("n") - F.ceil(F.col("n") * PERCENT / 100.0 - 1e-9) + 1
    shorter = F.col("n") - F.ceil(F.col("n") * (2 * PERCENT) / float(100 + PERCENT) - 1e-9) + 1
    # A shingle of one document only keeps its place in the order but meets nothing.
    rare = C.save(rare.filter((F.col("k") <= longer) & F.col("often").isNotNull())
                  .select("b", "label", "n", "s", "k", (F.col("k") <= shorter).alias("short")), "prefixes")
    # At the first shingle that two share, what follows must still suffice.
    x, y = rare.filter("short").alias("x"), rare.alias("y")
    met = x.join(y, F.expr(f"x.s = y.s and x.label != y.label and (x.n < y.n or x.n = y.n and x.b < y.b) "
                         f"and 100 * x.n >= {PERCENT} * y.n and {100 + PERCENT} * (1 + least(x.n - x.k, y.n - y.k)) >= {PERCENT} * (x.n + y.n)"))
    return met.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over
    links), kept (doc_id = component_id).

    Null, empty and blank texts have no shingles and link with nothing.  A null
    id gives a null component (the row is kept).  Of rows that repeat an id, all
    get that id's component.  An empty table gives an empty result.
    """
    base = C.keyed(docs, id_col, text_col)
    schema = "doc long, n long, d1 long, d2 long, bands array<long>"
    signed = C.save(base.mapInArrow(C.released(_signatures), schema), "signatures")
    real = signed.filter((F.col("n") > 0) & (F.col("doc") != C.NULL_ID))
    classes = C.save(real.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc", "bands")).alias("m"))
                     .select("n", "d1", "d2", F.col("m.doc").alias("rep"), "m.bands"), "classes")
    bands = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    buckets = (bands.groupBy("band", "hash").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("size"))
               .filter("size > 1"))
    member = C.save(bands.join(buckets, ["band", "hash"]).select("band", "hash", "a", F.col("rep").alias("b")), "buckets")
    wanted = member.select(F.col("b").alias("doc")).distinct()
    texts = C.save(base.join(wanted, "doc", "left_semi").dropDuplicates(["doc"]), "texts")
    part = C.save(wanted.select(F.col("doc").alias("b"), F.col("doc").alias("label")), "part")
    part = _joined(part, _verified(member.filter("a < b").select("a", "b").distinct(), texts))[0]
    labelled = member.select("band", "hash", "b").join(part, "b")
    open_ = labelled.groupBy("band", "hash").agg((F.min("label") != F.max("label")).alias("open")).filter("open")
    rest = C.save(labelled.join(open_, ["band", "hash"]).select("b", "label").distinct(), "open")
    if not rest.isEmpty():
        part = _joined(part, _verified(_prefix_pairs(rest, texts), texts))[0]
    # Copies take the component of their class; a class alone is its own.
    whole = (classes.join(part.withColumnRenamed("b", "rep"), "rep", "left")
             .select("n", "d1", "d2", F.coalesce("label", "rep").alias("component")))
    return (signed.select("doc", "n", "d1", "d2").join(whole, ["n", "d1", "d2"], "left")
            .select(C.original_id(), F.col("n").alias("n_shingles"),
                    F.when(F.col("doc") != C.NULL_ID, F.coalesce("component", "doc")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _own_ids(docs: DataFrame, id_col: str, row: str) -> DataFrame:
    """``docs`` and a column ``row`` that no two rows share: the id where one row
    alone has it; rows without id, and rows that share one, are numbered above all
    ids, or all rows are numbered if the ids leave no room there."""
    ident = F.col(f"`{id_col}`").cast("long")
    ids = docs.select(ident.alias("i"))
    shared = C.save(ids.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or i is null").select("i"), "shared-ids")
    top = ids.agg(F.max("i")).first()[0] or 0
    if top >= 1 << 62:
        return C.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    if shared.isEmpty():
        return docs.withColumn(row, ident)
    other, = C.fresh(docs, "shared")
    marked = docs.join(shared.filter("i is not null").select(F.col("i").alias(other)), ident == F.col(other), "left")
    number = F.lit(max(top, 0) + 1) + F.monotonically_increasing_id()
    return C.save(marked.withColumn(row, F.when(ident.isNull() | F.col(other).isNotNull(), number).otherwise(ident)).drop(other), "rows")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows without id, and rows that repeat an id, are documents of their own; they
    come after the other rows, in their written order."""
    row, = C.fresh(docs, "row")
    rows = _own_ids(docs, id_col, row)
    go = near_duplicates(rows, row, text_col).filter("not kept").select(F.col("doc_id").alias(row))
    return rows.join(go, row, "left_anti").select(*docs.columns)
