"""Vector code compression: product codes trained by active-entry Lloyd.

A vector is cut into equal parts; each part position has its own codebook.  A
part keeps the index of its nearest entry and the exact squared distance to it.
After an update only some entries have moved.  A part whose own entry stayed
where it was has nothing new to learn from the entries that stayed (they were
no nearer before, and at an equal distance had a higher index), so it compares
the moved entries with its stored distance.  A part whose entry moved rescans
the codebook.  Both keep the lower index on equal distances, so every round
gives what a full scan gives.

Each round is one narrow pass over the written rows (vector, codes, distances):
no shuffle, no state outside the table.  A task ends with one row of sums per
(part, entry), written with its rows; Spark adds these up, and the driver sees
one number per (part, entry, component).  The table of the round before last is
deleted.  A lost executor's tasks read the round before again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.llm import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components at or beyond this magnitude have squared distances that no long holds.
LIMIT = 1 << 17


def _whole(scale: int):
    """Rows (vec_id, label, x) with x the floored scaled components, packed as int32."""
    def run(batches):
        for batch in batches:
            vectors = batch.column("v")
            flat, off = vectors.flatten(), vectors.offsets.to_numpy().astype(np.int64)
            off = off - off[0] if len(off) else off
            valid = vectors.is_valid().to_numpy(zero_copy_only=False)
            if vectors.null_count:  # flatten() leaves out what null rows point at
                off = np.concatenate([[0], np.cumsum(np.where(valid, np.diff(off), 0))])
            values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * scale
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            keep = valid & (bad[off[1:]] == bad[off[:-1]])
            with np.errstate(invalid="ignore"):
                whole = np.floor(np.where(np.isfinite(values), values, 0.0))
            far = np.concatenate([[0], np.cumsum(np.abs(whole) >= float(LIMIT) * scale)])
            if (keep & (far[off[1:]] > far[off[:-1]])).any():
                raise ValueError(f"a vector component is {LIMIT} or more in magnitude")
            whole = whole.astype(np.int32)
            packed = [whole[off[i]:off[i + 1]].tobytes() for i in np.flatnonzero(keep)]
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array(packed, pa.binary())],
                                             names=["vec_id", "label", "x"])

    return C.released(run)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows (n, w) to entries (k, w)."""
    gap = x[:, None, :] - entries[None, :, :]
    return np.einsum("nkw,nkw->nk", gap, gap)


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray | None, code: np.ndarray, dist: np.ndarray) -> None:
    """Updates (code, dist) of all parts in place; ``moved`` marks the entries that
    changed since they were last right, None asks for a full scan."""
    for p in range(book.shape[0]):
        active = np.arange(book.shape[1]) if moved is None else np.flatnonzero(moved[p])
        if not len(active):
            continue
        rescan = np.ones(len(x), bool) if moved is None else moved[p][code[:, p]]
        if rescan.any():
            d = distances(x[rescan, p], book[p])
            best = d.argmin(axis=1)
            code[rescan, p], dist[rescan, p] = best, d[np.arange(len(d)), best]
        held = np.flatnonzero(~rescan)
        if len(held):
            d = distances(x[held, p], book[p][active])
            j = d.argmin(axis=1)
            near, entry = d[np.arange(len(d)), j], active[j]
            better = (near < dist[held, p]) | ((near == dist[held, p]) & (entry < code[held, p]))
            code[held[better], p], dist[held[better], p] = entry[better], near[better]


def _pass(book: np.ndarray, moved: np.ndarray | None, last: bool):
    """One assignment of all rows; with ``last`` rows (vec_id, label, code, error),
    else rows (vec_id, label, x, code, dist) and a closing row of sums."""
    parts, k, width = book.shape

    def run(batches):
        sums = np.zeros((parts, k, width + 1), np.int64)
        label_type = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            label_type = batch.column("label").type
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i4").reshape(n, parts, width).astype(np.int64)
            if moved is None:
                code, dist = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)
            else:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts).copy()
                dist = np.frombuffer(b"".join(batch.column("dist").to_pylist()), "<i8").reshape(n, parts).copy()
            assign(x, book, moved, code, dist)
            codes = pa.array([row.tobytes() for row in code], pa.binary())
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(dist.sum(axis=1))],
                                                 names=["vec_id", "label", "code", "error"])
                continue
            for p in range(parts):
                chosen = (code[:, p, None] == np.arange(k)).astype(np.int64)
                sums[p, :, :width] += chosen.T @ x[:, p]
                sums[p, :, width] += chosen.sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("x"), codes,
                 pa.array([row.tobytes() for row in dist], pa.binary()), pa.nulls(n, pa.list_(pa.int64()))],
                names=["vec_id", "label", "x", "code", "dist", "sums"])
        if not last and label_type is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, label_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                 pa.nulls(1, pa.binary()), pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))],
                names=["vec_id", "label", "x", "code", "dist", "sums"])

    return C.released(run)


def _updated(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored means of their parts; unused ones stay."""
    parts, k, width = book.shape
    cells = state.select("sums").filter(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("cell", "s")).groupBy("cell").agg(F.sum("s").alias("s"))
    total = np.zeros(parts * k * (width + 1), np.int64)
    for r in cells.collect():  # one row per (part, entry, component)
        total[r.cell] = r.s
    total = total.reshape(parts, k, width + 1)
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), book)


def train_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code binary, error), codebooks of shape (parts, entries, width)).

    Rows whose vector is null or holds null, NaN or infinite components are
    dropped, and so are vectors of another length than that of the smallest kept
    id.  That length must divide into ``parts``.  A null id sorts last; rows that
    repeat an id each count and start entries in the order of their packed
    components.  With fewer kept rows than ``entries`` the codebooks are smaller;
    without kept rows the result is empty.  Other columns are left behind.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
                         F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    label = own.schema["label"].dataType.simpleString()
    state, path = C.written(own.mapInArrow(_whole(scale), f"vec_id long, label {label}, x binary"), "vectors")
    first = state.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    size = len(first[0].x) // 4 if first else 0
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    if size == 0:
        none = state.filter("false").select("vec_id", "label", F.col("x").alias("code"), F.lit(0).cast("long").alias("error"))
        return none, np.zeros((parts, 0, 0), np.int64)
    state = state.filter(F.octet_length("x") == 4 * size)
    if any(len(r.x) != 4 * size for r in first):
        first = state.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    book = np.stack([np.frombuffer(r.x, "<i4").astype(np.int64).reshape(parts, -1) for r in first], axis=1)
    moved, schema = None, f"vec_id long, label {label}, x binary, code binary, dist binary, sums array<long>"
    for _ in range(rounds):
        done, old = state.mapInArrow(_pass(book, moved, False), schema), path
        done, path = C.written(done, "codes")
        C.discard(spark, old)
        new = _updated(done, book)
        moved = (new != book).any(axis=2)
        book, state = new, done.filter(F.col("x").isNotNull())
        if not moved.any():  # no later round changes anything
            break
    out = state.mapInArrow(_pass(book, moved, True), f"vec_id long, label {label}, code binary, error long")
    out, _ = C.written(out, "coded")
    C.discard(spark, path)
    return out, book


def digest(book: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept row: vec_id, code (two hex digits a part), error, label_error (the
    errors of all rows of its label, null labels together), codebooks_sha256."""
    coded, book = train_codes(vectors, id_col, vec_col, label_col)
    totals = coded.groupBy(F.col("label").alias("__of")).agg(F.sum("error").alias("label_error"))
    return (coded.join(totals, F.col("label").eqNullSafe(F.col("__of")))
            .select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256")))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same codes by plain full scans."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT v.vec_id, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x)) AS dist
  FROM comp v JOIN c{r} c ON v.part = c.part AND v.pos = c.pos GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT vec_id, part, entry, dist FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN
  (SELECT a.part, a.entry, v.pos, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM a{r} a JOIN comp v ON a.vec_id = v.vec_id AND a.part = v.part
   GROUP BY ALL) m ON c.part = m.part AND c.entry = m.entry AND c.pos = m.pos)""")
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS MATERIALIZED (SELECT vec_id, n, (i - 1) // (size // {parts}) AS part, (i - 1) % (size // {parts}) AS pos, CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, n, len(embedding) AS size, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT part, n AS entry, pos, x FROM comp WHERE n < {entries}),
{", ".join(steps)},
coded AS (SELECT k.vec_id, any_value(k.label) AS label, string_agg(printf('%02x', CAST(a.entry AS INTEGER)), '' ORDER BY a.part) AS code, CAST(sum(a.dist) AS BIGINT) AS error
  FROM a{rounds} a JOIN kept k ON a.vec_id = k.vec_id GROUP BY k.vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256 FROM coded"""
