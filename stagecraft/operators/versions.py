"""A1-A3, K1: stored tables whose columns change by version.

A stored table is a folder of Parquet parts and a small JSON file per version.
The file names the table's columns (declared type, NOT NULL, default, and the
name the column has inside the parts) and the parts that belong to the version.
A change writes what it needs first and then puts the next version's file in
place by one rename that fails if the file is there: readers see the old version
or the new one, a failed write leaves the old, and of two writers one is told.

Column changes copy nothing.  A column keeps its inner name for life, so RENAME
changes one name, DROP leaves the values unread (a later column of that name gets
another inner name), and ADD gives the parts written before it the default.  A
read unites at most one scan per ADD, whatever the number of parts.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.functions.types import IDENTIFIER
from stagecraft.operators.sinks import TIME, _cols, _declared_type, _to_type, enforce_not_null
from stagecraft.session import remove


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _file(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/_versions/v{version:08d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions of the stored table, oldest first."""
    fs, path = _fs(spark, root)
    folder = path(f"{root.rstrip('/')}/_versions")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[1:-5]) for n in names if re.fullmatch(r"v\d+\.json", n))


def describe(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The version's columns and parts (the newest by default)."""
    have = versions(spark, root)
    if not have:
        raise ValueError(f"no stored table at {root}")
    version = have[-1] if version is None else version
    if version not in have:
        raise ValueError(f"the stored table has no version {version}")
    return json.loads(spark.read.text(_file(root, version), wholetext=True).first()[0])


def _commit(spark: SparkSession, root: str, meta: dict) -> int:
    """Puts version ``meta["version"]`` in place, or fails if another writer did."""
    jvm, at = spark._jvm, _file(root, meta["version"])
    fs, path = _fs(spark, root)
    temporary = path(f"{root.rstrip('/')}/_versions/.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(fs.makeQualified(temporary), fs.makeQualified(path(at)), how)
    except Exception as e:
        fs.delete(temporary, False)
        raise RuntimeError(f"version {meta['version']} of {root} was written by another writer") from e
    return meta["version"]


def _column(c: dict, since: int, inner: int) -> dict:
    if not c["name"] or not re.fullmatch(IDENTIFIER, c["name"]):
        raise ValueError(f"column name not usable: {c['name']!r}")
    return {"name": c["name"], "type": c["type"], "spark": _declared_type(c["type"]), "nullable": c.get("nullable", True),
            "default": c.get("default"), "inner": f"c{inner}", "since": since}


def create_stored(spark: SparkSession, root: str, columns) -> int:
    """K1: version 1, without rows.  Names are checked and may not repeat in any case."""
    cols = _cols(columns)
    if not cols:
        raise ValueError("a table needs one or more columns")
    if len({(c["name"] or "").upper() for c in cols}) < len(cols):
        raise ValueError("a column name repeats")
    return _commit(spark, root, {"version": 1, "next": len(cols), "parts": [], "columns": [_column(c, 1, i) for i, c in enumerate(cols)]})


def write_stored(df: DataFrame, root: str, source_names: Sequence[str] | None = None, overwrite: bool = False, described=None) -> int:
    """Appends ``df`` (or puts it in place of all rows) as the next version: columns
    by name, or by position from ``source_names``, cast to their declared types.  A
    null in a NOT NULL column, or a value that does not fit, fails the write and
    leaves the version before.  Columns that ``df`` lacks take their default.
    ``described(part)`` may add facts about the written part to the version."""
    spark = df.sparkSession
    meta = describe(spark, root)
    names = list(source_names) if source_names else [c["name"] for c in meta["columns"]]
    have = {c.upper(): c for c in df.columns}
    out, needed = [], []
    for c, source in zip(meta["columns"], names):
        if source.upper() in have:
            value = _to_type(F.col(f"`{have[source.upper()]}`"), c["spark"])
        else:
            value = _to_type(F.lit(c["default"]).cast("string"), c["spark"])
        out.append(value.alias(c["inner"]))
        needed += [] if c["nullable"] else [c["inner"]]
    part = f"{root.rstrip('/')}/part-{uuid.uuid4().hex[:12]}"
    try:
        enforce_not_null(df.select(*out), needed).write.parquet(part)
        name = part.rsplit("/", 1)[1]
        own = {"path": name, "since": meta["version"] + 1} | (described(name) if described else {})
        return _commit(spark, root, meta | {"version": meta["version"] + 1, "parts": ([] if overwrite else meta["parts"]) + [own]})
    except Exception:
        remove(spark, part)
        remove(spark, f"{root.rstrip('/')}/_keys/{part.rsplit('/', 1)[1]}")
        raise


def read_stored(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default."""
    meta = describe(spark, root, version)
    groups: dict[tuple, list[str]] = {}
    for p in meta["parts"]:
        missing = tuple(c["inner"] for c in meta["columns"] if c["since"] > p["since"])
        groups.setdefault(missing, []).append(f"{root.rstrip('/')}/{p['path']}")
    out = None
    for missing, paths in groups.items():
        inside = [c for c in meta["columns"] if c["inner"] not in missing]
        schema = ", ".join(f"{c['inner']} {_plain(c['spark'])}" for c in inside)
        rows = spark.read.schema(schema).parquet(*paths) if inside else spark.read.parquet(*paths)
        rows = rows.select(*[(F.col(c["inner"]) if c in inside else _to_type(F.lit(c["default"]).cast("string"), c["spark"]))
                             .cast(_plain(c["spark"])).alias(c["name"]) for c in meta["columns"]])
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        out = spark.createDataFrame([], ", ".join(f"`{c['name']}` {_plain(c['spark'])}" for c in meta["columns"]))
    return out


def _plain(t: str) -> str:
    return "string" if t == TIME or t.startswith(("varchar", "char")) else t


def _changed(spark: SparkSession, root: str, change) -> int:
    meta = describe(spark, root)
    meta = meta | {"version": meta["version"] + 1}
    change(meta)
    return _commit(spark, root, meta)


def _place(meta: dict, name: str) -> int:
    for i, c in enumerate(meta["columns"]):
        if c["name"].upper() == name.upper():
            return i
    raise ValueError(f"no column {name}")


def add_stored_column(spark: SparkSession, root: str, name: str, type_: str, nullable: bool = True, default=None) -> int:
    """A1: a new version with one more column; rows so far have ``default``."""
    if not nullable and default is None:
        raise ValueError("a NOT NULL column needs a default")
    if default is not None:  # a default that does not fit fails here, not at the next read
        spark.range(1).select(_to_type(F.lit(default).cast("string"), _declared_type(type_))).collect()

    def change(meta):
        if any(c["name"].upper() == name.upper() for c in meta["columns"]):
            raise ValueError(f"the column {name} is there")
        meta["columns"].append(_column({"name": name, "type": type_, "nullable": nullable, "default": None if default is None else str(default)},
                                       meta["version"], meta["next"]))
        meta["next"] += 1

    return _changed(spark, root, change)


def drop_stored_column(spark: SparkSession, root: str, name: str) -> int:
    """A2: a new version without the column; older versions keep it."""
    def change(meta):
        at = _place(meta, name)
        if len(meta["columns"]) == 1:
            raise ValueError("a table keeps one column or more")
        del meta["columns"][at]

    return _changed(spark, root, change)


def rename_stored_column(spark: SparkSession, root: str, old: str, new: str) -> int:
    """A3: a new version in which the column has another name."""
    def change(meta):
        at = _place(meta, old)
        if not re.fullmatch(IDENTIFIER, new):
            raise ValueError(f"column name not usable: {new!r}")
        if any(c["name"].upper() == new.upper() for i, c in enumerate(meta["columns"]) if i != at):
            raise ValueError(f"the column {new} is there")
        meta["columns"][at]["name"] = new

    return _changed(spark, root, change)


# ---------------------------------------------------------------------------
# K4: append only what is new, by key filters of the parts
# ---------------------------------------------------------------------------
#: Bits of a filter block (128 BIGINT words), bits a key gets, and bits set per key.
BLOCK_BITS, BITS_A_KEY, BITS_SET = 8192, 12, 4


def _places(key, blocks: int) -> tuple:
    """(block, [(word, bit), ...]) of a key in a filter of ``blocks`` blocks."""
    text = key.cast("string")
    second = F.xxhash64(text, F.lit(1))
    at = [F.shiftright(second, 13 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(BITS_SET)]
    return F.pmod(F.xxhash64(text), F.lit(blocks)), [(F.shiftright(a, 6).cast("int"), a.bitwiseAND(F.lit(63)).cast("int")) for a in at]


def key_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, words ARRAY<BIGINT>): a blocked Bloom filter, built by combinable ORs."""
    block, places = _places(F.col(key), blocks)
    spots = F.array(*[F.struct(w.alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), b).alias("bit")) for w, b in places])
    words = (keys.filter(F.col(key).isNotNull()).select(block.alias("block"), F.inline(spots)).groupBy("block", "w").agg(F.bit_or("bit").alias("bit")))
    own = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("w", "bit"))).alias("m"))  # 128 words at most
    return own.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)),
                                           lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("words"))


def append_new_stored(df: DataFrame, root: str, key: str) -> dict:
    """K4 on a stored table: appends the rows of ``df`` whose key no row has yet.

    Every part written here keeps a Bloom filter of its keys.  The new keys are
    joined with the filters' blocks; a key that no filter may hold is new without a
    look at the table.  Only parts that may hold a key have their key column read,
    and only for those keys, so the result is exact.  Rows of one new key are all
    appended; a null key is always new.  Returns {"version" (null if nothing was
    new), "appended", "parts", "read"}.
    """
    from stagecraft.session import materialize
    spark = df.sparkSession
    meta = describe(spark, root)
    column = meta["columns"][_place(meta, key)]
    inner, plain = column["inner"], _plain(column["spark"])
    base = root.rstrip("/")
    cast = _to_type(F.col(f"`{next(c for c in df.columns if c.upper() == key.upper())}`"), column["spark"]).cast(plain)
    keys = materialize(df.select(cast.alias("k")).filter("k is not null").distinct(), "k4_keys")
    maybe, read = [], [p for p in meta["parts"] if p.get("keys") != inner and p["since"] >= column["since"]]
    sized: dict[int, list[dict]] = {}
    for p in meta["parts"]:
        if p.get("keys") == inner:
            sized.setdefault(p["blocks"], []).append(p)
    for blocks, parts in sized.items():  # sizes are powers of two: few
        filters = spark.read.schema("part string, block bigint, words array<bigint>").parquet(*[f"{base}/_keys/{p['path']}" for p in parts])
        block, places = _places(F.col("k"), blocks)
        hit = filters.join(keys.withColumn("b", block), F.col("b") == F.col("block"))
        for w, bit in places:
            hit = hit.filter(F.getbit(F.element_at("words", w + 1), bit) == 1)
        maybe.append(hit.select("part", "k"))
    known = keys.limit(0)
    if maybe:
        found = maybe[0]
        for m in maybe[1:]:
            found = found.unionAll(m)
        found = materialize(found, "k4_maybe")
        named = {r.part for r in found.select("part").distinct().collect()}  # names of parts only
        some = [p for p in meta["parts"] if p["path"] in named]
        if some:
            known = known.unionAll(_keys_of(spark, base, some, inner, plain).join(found.select("k").distinct(), "k", "left_semi"))
        read = read + some
    plain_parts = [p for p in read if p.get("keys") != inner]
    if plain_parts:
        known = known.unionAll(_keys_of(spark, base, plain_parts, inner, plain).join(keys, "k", "left_semi"))
    if any(p["since"] < column["since"] for p in meta["parts"]) and column["default"] is not None:
        known = known.unionAll(spark.range(1).select(_to_type(F.lit(column["default"]), column["spark"]).cast(plain).alias("k")))
    fresh = materialize(df.join(known.distinct().withColumnRenamed("k", "__k"), cast == F.col("__k"), "left_anti"), "k4_fresh")
    rows, out = fresh.count(), {"version": None, "parts": len(meta["parts"]), "read": len(read)}
    if rows:
        blocks = 1
        while blocks * BLOCK_BITS < BITS_A_KEY * rows:
            blocks *= 2

        def keep(part: str) -> dict:
            own = spark.read.schema(f"{inner} {plain}").parquet(f"{base}/{part}")
            key_filter(own, inner, blocks).select(F.lit(part).alias("part"), F.col("block").cast("bigint").alias("block"), "words") \
                .write.parquet(f"{base}/_keys/{part}")
            return {"keys": inner, "blocks": blocks}

        out["version"] = write_stored(fresh, root, described=keep)
    return out | {"appended": rows}


def _keys_of(spark: SparkSession, base: str, parts: list[dict], inner: str, plain: str) -> DataFrame:
    return spark.read.schema(f"{inner} {plain}").parquet(*[f"{base}/{p['path']}" for p in parts]).select(F.col(inner).alias("k"))
