"""Stages, i.e. directories of files.

A stage listing reads file metadata only: ``content`` is never selected, so
the ``binaryFile`` source does not open the files.  Opening them (S2) is a
separate projection, read per task in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.sources.parts import read_parts


def _base(spark: SparkSession, path: str) -> str:
    """The folder as the file sources report it: qualified by its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString().rstrip("/") + "/"


def relative(base: str):
    """A file's path below ``base``; its name when the stage is one file or a glob."""
    return F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 1 << 30)) \
            .otherwise(F.element_at(F.split("path", "/"), -1))


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def stage_directory(spark: SparkSession, path: str, glob: str | None = None,
                    enabled: bool = True) -> DataFrame:
    """(relative_path, size, last_modified) of every file under ``path``.
    With the directory disabled the listing is empty, as in the reference."""
    df = _files(spark, path, glob)
    rel = relative(_base(spark, path))
    out = df.select(rel.alias("relative_path"), F.col("length").alias("size"),
                    F.col("modificationTime").alias("last_modified"))
    return out if enabled else out.limit(0)


def stage_files(spark: SparkSession, path: str, glob: str | None = None, part_bytes: int | None = None) -> DataFrame:
    """The listing plus ``content`` (BINARY) -- ``TO_FILE`` per row.  A value ends at
    2 GB and its task holds it several times over; with ``part_bytes`` files of any size
    come as rows (listing, ``offset``, ``content``) of their parts in order (``sources.parts``)."""
    df = _files(spark, path, glob)
    rel = relative(_base(spark, path))
    out = df.select(rel.alias("relative_path"), F.col("length").alias("size"),
                    F.col("modificationTime").alias("last_modified"), "content" if part_bytes is None else "path")
    return out if part_bytes is None else read_parts(out, "path", "size", part_bytes).drop("path")


# Formats a stage may declare, and file extensions for "auto".
FILE_FORMATS = ("auto", "CSV", "JSON", "PARQUET")
EXTENSIONS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet"}


def stage_read(spark: SparkSession, path: str, file_format: str = "auto", schema=None,
               glob: str | None = None) -> DataFrame:
    """S3: read a stage's files as rows.  ``auto`` picks the format from the
    file extensions of the listing; files of several formats are read each by
    its own and united by column name.  A declared schema avoids inference (no
    extra pass over the data)."""
    fmt = (file_format or "auto").upper()
    if fmt not in {f.upper() for f in FILE_FORMATS}:
        raise ValueError(f"unknown file format {file_format!r}")
    if fmt == "AUTO":
        kinds = _kinds(spark, path, glob)
        if glob and len(kinds) > 1:
            raise ValueError("files of several formats: give one glob per format")
        parts = [_read(spark, path, EXTENSIONS[e], schema, glob or _any_case(e), recursive=True) for e in kinds]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
    return _read(spark, path, fmt.lower(), schema, glob)


def _kinds(spark: SparkSession, path: str, glob: str | None) -> list[str]:
    """Known extensions in the listing (one aggregate over file names); a
    compression suffix is left aside, any other extension is refused."""
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)(\.gz|\.bz2|\.zst)?$", 1))
    found = _files(spark, path, glob).agg(*[F.count_if(ext == e).alias(e[1:]) for e in EXTENSIONS],
                                          F.count_if(~ext.isin(*EXTENSIONS)).alias("other")).first()
    kinds = [e for e in EXTENSIONS if found[e[1:]]]
    if found["other"] or not kinds:
        raise ValueError("auto format needs files with a known extension")
    return kinds


def _any_case(ext: str) -> str:
    letters = "".join(f"[{c}{c.upper()}]" for c in ext[1:])
    return f"*.{letters}{{,.gz,.bz2,.zst}}"


def _read(spark: SparkSession, path: str, fmt: str, schema, glob: str | None, recursive: bool = False) -> DataFrame:
    r = spark.read
    if recursive:                          # as the listing, below every folder
        r = r.option("recursiveFileLookup", "true")
    if schema is not None:
        r = r.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.option("header", "true").csv(path) if fmt == "csv" else r.json(path) if fmt == "json" else r.parquet(path)
