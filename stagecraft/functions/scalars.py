"""Projections and scalar column functions.

All are built-in Catalyst expressions (whole-stage code generation), so they
run per row inside the scan's task with no Python and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The default output table.
DEFAULT_COLUMNS = [("FILE_NAME", "VARCHAR"), ("PROCESSED_DATA", "VARIANT"), ("PROCESSED_AT", "TIMESTAMP_NTZ")]


def output_rows(df: DataFrame, name_col: Column | str, data_col: Column | str,
                as_of: str | None = None) -> DataFrame:
    """FILE_NAME, PROCESSED_DATA, PROCESSED_AT.  ``as_of`` pins the time
    (tests, replays); otherwise the query's local timestamp (NTZ)."""
    at = F.lit(as_of).cast("timestamp_ntz") if as_of else F.localtimestamp()
    return df.select(_c(name_col).alias("FILE_NAME"), _c(data_col).alias("PROCESSED_DATA"),
                     at.alias("PROCESSED_AT"))


def chain(df: DataFrame, input_col: Column | str, steps: Sequence[Callable[[Column], Column]],
          keep: Sequence[str] = ()) -> DataFrame:
    """Each step reads the previous output as text.  Intermediate results
    are ``STEP_1 .. STEP_n-1``; the last is ``PROCESSED_DATA``."""
    cur = as_text(input_col)
    out = df
    for i, step in enumerate(steps, start=1):
        name = "PROCESSED_DATA" if i == len(steps) else f"STEP_{i}"
        out = out.withColumn(name, step(cur))
        cur = as_text(F.col(name))
    return out


def as_text(c: Column | str) -> Column:
    """Value as text (``::VARCHAR``).  Bytes are decoded as UTF-8; VARIANT
    and structured values are rendered as JSON text by the cast."""
    return _c(c).cast("string")


def as_text_bytes(c: Column | str) -> Column:
    """P3 for BINARY file content."""
    return F.decode(_c(c), "UTF-8")


def json_get(c: Column | str, path: str, type_: str = "string") -> Column:
    """Parse JSON text to VARIANT and read one path (null when the text is
    not JSON or the path is missing)."""
    return F.try_variant_get(F.try_parse_json(_c(c)), path, type_)


def json_unwrap(c: Column | str) -> Column:
    """P5: decode JSON again for as long as the decoded value is a string
    (values encoded any number of times by a store).  Returns VARIANT.

    Every level puts a quote before the head of the text and escapes the quotes
    and backslashes in it, so the head (1, 3, 7, ... characters) at least doubles
    and the logarithm of its length bounds the number of levels."""
    col = _c(c)
    head = F.length(F.regexp_extract(col, r'^[ \t\r\n"\\u0-9a-fA-Fnrt]*', 0))

    def decode(v, _):
        inner = F.try_parse_json(F.try_variant_get(v, "$", "string"))
        return F.when(F.schema_of_variant(v) == F.lit("STRING"), inner).otherwise(v)
    levels = F.greatest(F.ceil(F.log2(head + 1)).cast("int"), F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), F.coalesce(levels, F.lit(1))), F.try_parse_json(col), decode)


def json_text(c: Column | str) -> Column:
    """JSON text of a struct, map, array or VARIANT."""
    return F.to_json(_c(c))


def object_name(name: Column | str, label: Column | str) -> Column:
    """The configured name, else the label with whitespace runs as ``_``,
    upper case."""
    return F.coalesce(F.nullif(_c(name), F.lit("")),
                      F.upper(F.regexp_replace(_c(label), r"\s+", "_")))


# Whitespace trimmed around a line (carriage returns of CRLF text included),
# written without \s or \v so Java regex and RE2 read it the same way.
LINE_TRIM = r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$"


def split_lines(c: Column | str) -> Column:
    """P10: ARRAY of non-blank lines, each trimmed of surrounding whitespace."""
    return F.filter(F.transform(F.split(_c(c), "\n"), lambda x: F.regexp_replace(x, LINE_TRIM, "")),
                    lambda x: x != F.lit(""))


def strip_fences(c: Column | str) -> Column:
    """Remove a leading ```json (or bare ```) fence and a trailing ``` fence,
    then trim."""
    lead = F.regexp_replace(_c(c), r"(?i)^```(json)?[ \t\r\n\f]*", "")
    return F.trim(F.regexp_replace(lead, r"\n?```[ \t\r\n\f]*$", ""))


def join_strings(c: Column | str, sep: str = ", ") -> Column:
    """Join an ARRAY<STRING> with a separator (nulls skipped)."""
    return F.array_join(_c(c), sep)


def label(c: Column | str, mapping: dict, default=None) -> Column:
    """Map values to labels, e.g. {"true": "Stale"} else "Fresh"."""
    col = _c(c)
    out = None
    for k, v in mapping.items():
        out = (F.when(col == F.lit(k), F.lit(v)) if out is None else out.when(col == F.lit(k), F.lit(v)))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


def first_filled(*cols: Column | str, default=None) -> Column:
    """First value that is neither null nor empty, else ``default``."""
    parts = [F.nullif(_c(c).cast("string"), F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)
