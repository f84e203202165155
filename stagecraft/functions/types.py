"""P8 identifiers and P9 type names, and the map from declared types to Spark types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted identifier pattern and the 31 accepted type names.
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_$]*$"
TYPE_NAMES = [
    "VARCHAR", "STRING", "TEXT", "CHAR", "CHARACTER",
    "NUMBER", "NUMERIC", "DECIMAL", "INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT",
    "FLOAT", "DOUBLE", "REAL",
    "BOOLEAN",
    "DATE", "DATETIME", "TIME", "TIMESTAMP", "TIMESTAMP_LTZ", "TIMESTAMP_NTZ", "TIMESTAMP_TZ",
    "VARIANT", "OBJECT", "ARRAY",
    "BINARY", "VARBINARY",
    "GEOGRAPHY", "GEOMETRY",
]
# The node types a pipeline graph may hold.
NODE_TYPES = ["stage", "table", "task", "stream", "ai_extract", "ai_classify",
              "ai_parse_document", "ai_summarize", "ai_sentiment"]

# Our stricter shape: a name with at most one bracket of one or two integers
# (the greedy bracket removal of the original accepted ``VARCHAR(1) x (y)``).
TYPE_SHAPE = r"^[A-Z_]+(\([0-9]+(,[0-9]+)?\))?$"

# Declared type name -> Spark SQL type.  ``{p}``/``{s}`` take bracket values.
SPARK_TYPES = {
    "VARCHAR": "string", "STRING": "string", "TEXT": "string", "CHAR": "string", "CHARACTER": "string",
    "NUMBER": "decimal", "NUMERIC": "decimal", "DECIMAL": "decimal",
    "INT": "int", "INTEGER": "int", "BIGINT": "bigint", "SMALLINT": "smallint", "TINYINT": "tinyint",
    "FLOAT": "double", "DOUBLE": "double", "REAL": "double",
    "BOOLEAN": "boolean", "DATE": "date",
    "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP_NTZ": "timestamp_ntz",
    "TIMESTAMP_LTZ": "timestamp", "TIMESTAMP_TZ": "struct<ts: timestamp, tz: string>",
    "TIME": "string",
    "VARIANT": "variant", "OBJECT": "map<string, variant>", "ARRAY": "array<variant>",
    "BINARY": "binary", "VARBINARY": "binary",
    "GEOGRAPHY": "binary", "GEOMETRY": "binary",
}


def is_identifier(c: Column | str) -> Column:
    """True when the value is a valid unquoted identifier (null -> false)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.rlike(IDENTIFIER) & ~col.endswith("\n"), F.lit(False))  # $ also stands before a last newline


def type_name(c: Column | str) -> Column:
    """P9, first half: upper case, trimmed, bracket part removed."""
    col = F.col(c) if isinstance(c, str) else c
    up = F.upper(F.trim(col))
    return F.trim(F.regexp_replace(up, r"\(.*\)", ""))


def is_valid_type(c: Column | str) -> Column:
    """P9, second half: the shape is right and the name is one of the 31."""
    col = F.col(c) if isinstance(c, str) else c
    squeezed = F.regexp_replace(F.upper(F.trim(col)), r"[ \t]+", "")
    return F.coalesce(squeezed.rlike(TYPE_SHAPE) & type_name(col).isin(TYPE_NAMES), F.lit(False))


def normalize_type(c: Column | str) -> Column:
    """STRUCT<name STRING, valid BOOLEAN>."""
    return F.struct(type_name(c).alias("name"), is_valid_type(c).alias("valid"))


def type_base(declared: str) -> str:
    """The declared type's name without its brackets, in upper case."""
    return declared.strip().upper().split("(")[0].strip()


def spark_type(declared: str) -> str:
    """Spark SQL type for a declared type string (driver-side, for schemas)."""
    s = declared.strip().upper()
    if not re.fullmatch(TYPE_SHAPE, re.sub(r"[ \t]+", "", s)):
        raise ValueError(f"type not usable: {declared!r}")
    base = s.split("(")[0].strip()
    if base not in SPARK_TYPES:
        raise ValueError(f"unknown type {declared!r}")
    t = SPARK_TYPES[base]
    if t == "decimal":
        args = s[len(base):].strip().strip("()")
        if args:
            parts = [int(x) for x in args.split(",")]
            p, sc = (parts + [0])[:2]
            return f"decimal({p},{sc})"
        return "decimal(38,0)"
    if t == "string" and "(" in s and base in ("VARCHAR", "CHAR", "CHARACTER"):
        n = s[len(base):].strip().strip("()")
        return f"varchar({n})" if base == "VARCHAR" else f"char({n})"
    return t
