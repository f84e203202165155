"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked.  A group's label state is how many of its
documents each shard holds, and a group of any size is one row.  Linked documents
start in group order, in blocks that follow the shards' capacities, so most
groups start whole.  In each round a group that is split picks the shard that holds
most of it (a shard that it fills alone is done with), and its documents in shards
that hold fewer ask to move there.

Counts stay within the shards' quotas: a move is granted against the room that
unlinked documents leave, or in exchange along a cycle of requests between shards,
which changes no count.  What is granted between two shards goes to the groups in a
fixed random order.  Every move joins a smaller part with a larger one, so the sum
of the squared parts grows with each and the rounds end by themselves, when
``DRAWS`` draws of the ties in a row let nothing move.  Documents without links then fill the room that is left: counts are at
most one apart (the law ``rows``).

Running sums over groups and documents go by hash bucket: sums per bucket, then
within a bucket, so no group and no shard has to fit one task.  The driver sees
one number per pair of shards and round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.llm import common as C

SHARDS = 16
#: Rounds in a row, each with ties drawn anew, that must grant nothing before the end.
DRAWS = 4


def _offsets(rows: DataFrame, part: list[str], amounts: list[str], order: list[str]) -> DataFrame:
    """``rows`` with, for each amount, its running sum before the row, within
    ``part`` and over (bucket, order)."""
    total = rows.groupBy(*part, "bucket").agg(*[F.sum(a).alias(f"t_{a}") for a in amounts])
    before = Window.partitionBy(*part).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*part, "bucket", *[F.coalesce(F.sum(f"t_{a}").over(before), F.lit(0)).alias(f"b_{a}") for a in amounts])
    inside = Window.partitionBy(*part, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"i_{a}") for a in amounts])
    out = own.join(total, [*part, "bucket"])
    return out.select(*rows.columns, *[(F.col(f"b_{a}") + F.col(f"i_{a}")).cast("long").alias(f"before_{a}") for a in amounts])


def _longs(values) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _loads(groups: DataFrame, shards: int) -> list[int]:
    row = groups.agg(*[F.coalesce(F.sum(F.col("held")[s]), F.lit(0)).alias(f"s{s}") for s in range(shards)]).first()
    return [int(x) for x in row]


def exchange(asked: list[list[int]], room: list[int]) -> list[list[int]]:
    """Moves granted from shard to shard, of those asked for: along cycles of
    requests, which leave all counts as they are, then into the room there is."""
    left, granted, k = [row[:] for row in asked], [[0] * len(room) for _ in room], len(room)
    for size in range(2, k + 1):  # short cycles first
        while (cycle := _cycle(left, size)) is not None:
            steps = list(zip(cycle, cycle[1:] + cycle[:1]))
            n = min(left[s][t] for s, t in steps)
            for s, t in steps:
                left[s][t] -= n
                granted[s][t] += n
    for t in range(k):
        free = room[t]
        for s in sorted(range(k), key=lambda s: (room[s], s)):  # out of the fullest first
            n = max(0, min(free, left[s][t]))
            granted[s][t] += n
            free -= n
    return granted


def _cycle(left: list[list[int]], size: int) -> list[int] | None:
    """A cycle of at most ``size`` shards with requests all along, by breadth from each."""
    k = len(left)
    for start in range(k):
        before, row = {start: None}, [start]
        for _ in range(size):
            reached = []
            for s in row:
                for t in range(k):
                    if left[s][t] > 0:
                        if t == start:
                            path = [s]
                            while before[path[-1]] is not None:
                                path.append(before[path[-1]])
                            return path[::-1]
                        if t not in before:
                            before[t] = s
                            reached.append(t)
            row = reached
    return None


def propagate(groups: DataFrame, capacity: list[int]) -> DataFrame:
    """(k1, k2, m, bucket, held array<long>) once nothing can move any more."""
    shards, zero = len(capacity), F.lit(0).cast("long")
    groups = C.save(groups, "labels")
    draw = idle = 0
    while True:
        # The shard that holds most of the group; ties are drawn anew in each round, so
        # that requests do not all run one way and what was stuck may find a cycle.
        draw += 1
        best = groups.withColumn("best", F.array_max(F.transform("held", lambda n, s: F.struct(
            F.when(n < F.element_at(_longs(capacity), s + 1), n).otherwise(F.lit(-1)).alias("n"), F.xxhash64("k1", s, F.lit(draw)).alias("any"), s.alias("s")))))
        best = best.select("k1", "k2", "m", "bucket", "held", F.col("best")["s"].alias("to"))
        asks = best.select("*", F.posexplode("held").alias("from", "ask")).filter(
            (F.col("ask") > 0) & (F.col("from") != F.col("to")) & (F.col("ask") < F.element_at(_longs(capacity), F.col("from") + 1)))
        matrix = [[0] * shards for _ in capacity]
        for r in asks.groupBy("from", "to").agg(F.sum("ask").alias("n")).collect():
            matrix[r["from"]][r["to"]] = r["n"]
        room = [c - x for c, x in zip(capacity, _loads(groups, shards))]
        granted = exchange(matrix, room)
        idle = 0 if any(map(any, granted)) else idle + 1
        if idle == DRAWS or not any(map(any, matrix)):
            return groups
        if idle:
            continue
        asks = _offsets(asks.drop("held", "m"), ["from", "to"], ["ask"], ["k1", "k2"])
        quota = F.element_at(_longs(x for row in granted for x in row), F.col("from") * shards + F.col("to") + 1)
        asks = asks.withColumn("n", F.greatest(zero, F.least(F.col("ask"), quota - F.col("before_ask")))).filter("n > 0")
        out = asks.groupBy("k1", "k2").agg(F.array(*[F.sum(F.when(F.col("from") == s, F.col("n")).otherwise(zero)) for s in range(shards)]).alias("out"))
        out = out.withColumn("sum", F.aggregate("out", zero, lambda a, x: a + x))
        held = F.transform("held", lambda n, s: n - F.element_at("out", s + 1) + F.when(s == F.col("to"), F.col("sum")).otherwise(zero))
        groups = C.save(best.join(out, ["k1", "k2"], "left").select(
            "k1", "k2", "m", "bucket", F.when(F.col("out").isNull(), F.col("held")).otherwise(held).alias("held")), "labels")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null
    under the law ``rows``), group_size.  Null text counts as empty; repeated rows
    are rows of their own; an empty table gives an empty result."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    rows = C.save(rows, "shard-rows")
    n = rows.count()
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    buckets = max(256, n // 50_000)
    groups = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    groups = C.save(groups.withColumn("bucket", F.pmod("k1", F.lit(buckets))), "groups")
    dealt = _offsets(groups.withColumn("one", F.lit(0)), ["one"], ["m"], ["k1", "k2"])
    # Start labels: blocks in proportion to the capacities, so none holds more than its shard can.
    total = groups.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    bounds = [sum(capacity[:s]) * total // max(n, 1) for s in range(shards + 1)]
    held = F.array(*[F.greatest(F.lit(0), F.least(F.col("before_m") + F.col("m"), F.lit(hi)) - F.greatest(F.col("before_m"), F.lit(lo))).cast("long")
                     for lo, hi in zip(bounds, bounds[1:])])
    state = propagate(dealt.select("k1", "k2", "m", "bucket", held.alias("held")), capacity)

    # Where each group's part of a shard begins, and where the unlinked documents begin.
    loads = _loads(state, shards)
    parts = state.select("*", F.lit(0).alias("one"), *[F.col("held")[s].alias(f"h{s}") for s in range(shards)])
    parts = _offsets(parts, ["one"], [f"h{s}" for s in range(shards)], ["k1", "k2"])
    parts = C.save(parts.select("k1", "k2", "m", "held", F.array(*[F.col(f"before_h{s}") for s in range(shards)]).alias("base")), "parts")
    room = [c - x for c, x in zip(capacity, loads)]

    # Unlinked documents are one group of their own, numbered by bucket like the others.
    mark = F.col("m").isNotNull()
    grouped = rows.join(parts.select("k1", "k2", "m"), ["k1", "k2"], "left").select(
        "doc_id", "size", "text_crc32", mark.alias("linked"), F.when(mark, F.col("k1")).otherwise(0).alias("g1"),
        F.when(mark, F.col("k2")).otherwise(0).alias("g2"), F.coalesce("m", F.lit(1)).alias("group_size"),
        F.pmod(F.xxhash64("doc_id", "k1"), F.lit(buckets)).alias("bucket"), F.lit(1).alias("unit"))
    grouped = C.save(grouped, "grouped")
    numbered = _offsets(grouped, ["linked", "g1", "g2"], ["unit"], ["doc_id"]).withColumnRenamed("before_unit", "rank")
    # Only linked documents look up their group's parts; the others share one layout.
    inside = numbered.filter("linked").join(parts.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "held", "base"), ["g1", "g2"])
    outside = numbered.filter("not linked").withColumn("held", _longs(room)).withColumn("base", _longs(loads))
    numbered = inside.unionByName(outside)
    ends = F.transform("held", lambda x, s: F.aggregate(F.slice("held", F.lit(1), s + 1), F.lit(0).cast("long"), lambda a, y: a + y))
    placed = numbered.withColumn("ends", ends)
    placed = placed.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    slot = F.element_at("base", F.col("shard") + 1) + F.col("rank") - F.element_at("ends", F.col("shard") + 1) + F.element_at("held", F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                         slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("group_size").cast("long").alias("group_size"))
