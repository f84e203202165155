"""SQL (DuckDB dialect) forms of the fixed text rules, for the oracle check.

These mirror ``stagecraft.functions.text`` rule by rule: the same patterns,
the same splitting, the same rounding.  They are used only to build the
independent oracle SQL in ``plans.catalog``.
"""

from __future__ import annotations

from stagecraft.functions import text as X


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), {lit(X.TOKEN_SPLIT)}), lambda x: x <> '')"


def strip_dropped(expr: str) -> str:
    out = f"regexp_replace({expr}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in X.DROPPED_ELEMENTS:
        out = f"regexp_replace({out}, {lit(f'(?is)<{tag}[ \\t\\r\\n\\f>].*?</{tag}[ \\t\\r\\n\\f]*>')}, ' ', 'g')"
    return out


def decode_entities(expr: str) -> str:
    out = expr
    for ent, ch in X.ENTITIES:
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"
    return out


def squash(expr: str) -> str:
    return f"trim(regexp_replace({expr}, {lit(X.WHITESPACE)}, ' ', 'g'))"


def parse_text(expr: str) -> str:
    return squash(decode_entities(f"regexp_replace({strip_dropped(expr)}, '<[^>]*>', ' ', 'g')"))


def block_pieces(expr: str) -> str:
    marked = f"regexp_replace({strip_dropped(expr)}, {lit(X.BLOCK_TAG)}, chr(1) || '\\1' || chr(2), 'g')"
    return f"string_split(regexp_replace({marked}, '<[^>]*>', ' ', 'g'), chr(1))"


def kind_of(expr: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in X.BLOCK_KINDS.items())
    return f"(CASE lower({expr}) {whens} END)"


def piece_text(p: str) -> str:
    return squash(decode_entities(f"(CASE WHEN strpos({p}, chr(2)) > 0 THEN split_part({p}, chr(2), 2) ELSE {p} END)"))


def layout_text(expr: str) -> str:
    return (f"array_to_string(list_filter(list_transform({block_pieces(expr)}, lambda p: {piece_text('p')}), "
            f"lambda t: t <> ''), chr(10))")


def blocks(source: str, id_col: str, html_col: str) -> str:
    return f"""
SELECT {id_col}, pos, kind, text FROM (
  SELECT {id_col}, pos,
         CASE WHEN strpos(piece, chr(2)) > 0 THEN {kind_of("split_part(piece, chr(2), 1)")} ELSE 'text' END AS kind,
         {piece_text('piece')} AS text
  FROM (SELECT {id_col}, unnest(arr) AS piece, (generate_subscripts(arr, 1) - 1)::INTEGER AS pos
        FROM (SELECT {id_col}, {block_pieces(html_col)} AS arr FROM {source}) a) b
) c WHERE text <> ''"""


def sentences(source: str, id_col: str, text_col: str) -> str:
    return f"""
SELECT {id_col}, pos, sentence FROM (
  SELECT {id_col}, generate_subscripts(arr, 1) - 1 AS pos, trim(unnest(arr)) AS sentence
  FROM (SELECT {id_col}, regexp_split_to_array({text_col}, {lit(X.SENTENCE_SPLIT)}) AS arr FROM {source}) a
) b WHERE sentence <> ''"""


def summarize(source: str, id_col: str, text_col: str, k: int = 3) -> str:
    return f"""
WITH s AS ({sentences(source, id_col, text_col)}),
t AS (SELECT {id_col}, pos, sentence, unnest({tokens('sentence')}) AS token FROM s),
f AS (SELECT {id_col}, pos, sentence,
             count(*) OVER (PARTITION BY {id_col}, token) AS tf,
             count(*) OVER (PARTITION BY {id_col}) AS n FROM t),
w AS (SELECT {id_col}, pos, any_value(sentence) AS sentence,
             sum(tf)::DOUBLE / (count(*) * any_value(n)) AS weight
      FROM f GROUP BY {id_col}, pos),
r AS (SELECT *, row_number() OVER (PARTITION BY {id_col} ORDER BY round(weight, {X.SCORE_DIGITS}) DESC, pos) AS rk FROM w)
SELECT {id_col}, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM r WHERE rk <= {k} GROUP BY {id_col}"""


def idf_table(source: str, id_col: str, text_col: str) -> str:
    return f"""
SELECT token, count(*) AS df,
       ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf
FROM (SELECT DISTINCT {id_col}, unnest({tokens(text_col)}) AS token FROM {source}) d
GROUP BY token"""
