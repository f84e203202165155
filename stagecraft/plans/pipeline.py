"""U6 stored pipelines and X10 text chains.

A pipeline spec is the reference's request shape::

    {"database": ..., "schema": ..., "nodes": [{id, type, label, config}],
     "edges": [{source, target}]}

``pipeline_outputs`` turns one spec into one DataFrame plan per target table:
stage rows (key, content) -> the text steps along the edges -> the output row.
Before the first step that groups or joins by key the rows are numbered and
written once to the shared folder; the rest runs when the caller writes the
result.  The spec itself is configuration, not data, and is read on the driver.
"""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Callable, Sequence
from collections import Counter
from graphlib import CycleError, TopologicalSorter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecraft.functions import text as X
from stagecraft.functions.scalars import output_rows
from stagecraft.functions.types import IDENTIFIER
from stagecraft.operators.sinks import apply_schema
from stagecraft.session import materialize

KEY = "__key"      # STRUCT<src, row, name>: one value per row, whatever its name
TEXT = "__text"

# A step is row-local, a column function of the text, or keyed: it maps (key,
# text) rows to (key, text) rows, one for every key (null when it found nothing).
LocalStep = Callable[[Column], Column]
KeyedStep = Callable[[DataFrame], DataFrame]


class Rows(NamedTuple):
    """(key, text) rows; ``fixed`` once their row numbers are written down."""
    df: DataFrame
    fixed: bool


def _source(df: DataFrame, name_col: str, text_col: str, src: str) -> Rows:
    key = F.struct(F.lit(src).alias("src"), F.lit(None).cast("bigint").alias("row"), F.col(name_col).alias("name"))
    return Rows(df.select(key.alias(KEY), F.col(text_col).cast("string").alias(TEXT)), False)


def _fix(rows: Rows) -> Rows:
    """Number the rows and write them once: keyed steps group and join by key, so
    two rows of one name, or of none, must stay two rows in every pass."""
    if rows.fixed:
        return rows
    key = F.col(KEY).withField("row", F.monotonically_increasing_id())
    return Rows(materialize(rows.df.select(key.alias(KEY), TEXT), "rows"), True)


def _union(parts: Sequence[tuple[str, Rows]]) -> Rows:
    """The rows of all inputs of a node.  With several, the input's id joins the
    key: the same row can arrive by two branches."""
    if len(parts) == 1:
        return parts[0][1]
    out = None
    for name, rows in parts:
        src = F.concat(F.col(KEY)["src"], F.lit(f">{name}"))
        df = rows.df.select(F.col(KEY).withField("src", src).alias(KEY), TEXT)
        out = df if out is None else out.unionByName(df)
    return Rows(out, all(rows.fixed for _, rows in parts))


def _keep_all(df: DataFrame, result: DataFrame, col: Column) -> DataFrame:
    """Left join a per-key result back so no key is lost.  Both sides derive
    from ``df``'s rows and join on the key only, which is never null."""
    return df.select(KEY).join(result.select(KEY, col.alias(TEXT)), KEY, "left")


def _table(spark, name, tables: dict, what: str) -> DataFrame:
    """A table that a step's config names (or, from code, the DataFrame itself)."""
    if isinstance(name, DataFrame):
        return name
    if name in tables:
        return tables[name]
    if re.fullmatch(IDENTIFIER, name) and spark.catalog.tableExists(name):
        return spark.table(name)
    raise ValueError(f"{what}: no table {name}")


def parse_step(config: dict, tables: dict) -> LocalStep:
    mode = (config.get("mode") or "LAYOUT").upper()
    if mode not in X.PARSE_MODES:
        raise ValueError(f"unknown parse mode {mode!r}")
    return X.layout_text if mode == "LAYOUT" else X.parse_text


def summarize_step(config: dict, tables: dict) -> KeyedStep:
    prompt = config.get("prompt") or None
    k = int(config.get("k", 3))

    def run(df: DataFrame) -> DataFrame:
        # a key is one row (``_fix``, ``_union``)
        s = X.summarize(df, KEY, TEXT, k=k, prompt=prompt, keep_all=True, unique=True)
        return s.select(KEY, F.col("summary").alias(TEXT))
    return run


def _free_questions(config: dict) -> list[str]:
    return [q for q in X.split_questions(config.get("prompts")) if q not in X.EXTRACT_RULES]


def extract_step(config: dict, tables: dict) -> KeyedStep | LocalStep:
    questions = X.split_questions(config.get("prompts"))
    free = _free_questions(config)
    if not free:
        # every question has a rule: one row-local projection
        return lambda text: X.extract_map(text, questions)

    def run(df: DataFrame) -> DataFrame:
        idf = config.get("idf")
        idf = _table(df.sparkSession, idf, tables, "idf") if idf is not None else None
        ruled = X.extract(df, KEY, TEXT, questions)
        parts = ruled.unionByName(X.answer_sentence(df, KEY, TEXT, free, idf=idf).drop("score"))
        answers = parts.groupBy(KEY).agg(
            F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("question", "answer"))))).alias("a"))
        return _keep_all(df, answers, F.col("a"))
    return run


def classify_step(config: dict, tables: dict) -> KeyedStep:
    cats = X.split_questions(config.get("categories"), default=X.DEFAULT_CATEGORIES)
    seeds = config.get("seeds") or None

    def run(df: DataFrame) -> DataFrame:
        idf = config.get("idf")
        idf = _table(df.sparkSession, idf, tables, "idf") if idf is not None else None
        c = X.classify(df, KEY, TEXT, cats, seeds, idf=idf)
        return _keep_all(df, c, F.col("category"))
    return run


# The lexicon table of a sentiment step whose config names none.
DEFAULT_LEXICON = "SENTIMENT_LEXICON"


def sentiment_step(config: dict, tables: dict) -> KeyedStep:
    lexicon = config.get("lexicon")

    def run(df: DataFrame) -> DataFrame:
        lex = _table(df.sparkSession, DEFAULT_LEXICON if lexicon is None else lexicon, tables, "lexicon")
        # sentiment() keeps every input row (explode_outer + left join), so
        # no join back to the keys is needed
        return X.sentiment(df, KEY, TEXT, lex).select(KEY, F.col("sentiment").alias(TEXT))
    return run


STEP_BUILDERS = {
    "ai_parse_document": parse_step,
    "ai_summarize": summarize_step,
    "ai_extract": extract_step,
    "ai_classify": classify_step,
    "ai_sentiment": sentiment_step,
}


def _row_local(kind: str, config: dict) -> bool:
    return kind == "ai_parse_document" or (kind == "ai_extract" and not _free_questions(config))


def _apply(rows: Rows, kind: str, config: dict, tables: dict) -> Rows:
    """One step; the caller has fixed the rows of a keyed one."""
    if kind not in STEP_BUILDERS:
        raise ValueError(f"unknown text step {kind!r}")
    step = STEP_BUILDERS[kind](config, tables)
    if _row_local(kind, config):
        return Rows(rows.df.select(KEY, step(F.col(TEXT)).alias(TEXT)), rows.fixed)
    return Rows(step(_fix(rows).df), True)


def text_chain(df: DataFrame, key_col: str, text_col: str,
               steps: Sequence[tuple[str, dict]], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Apply text steps in sequence; each reads the previous output as
    text.  Returns (key, PROCESSED_DATA), one row per row of ``df``: keys may
    repeat or be null."""
    cur = _source(df, key_col, text_col, "")
    for kind, cfg in steps:
        cur = _apply(cur, kind, cfg or {}, tables or {})
    return cur.df.select(F.col(KEY)["name"].alias(key_col), F.col(TEXT).alias("PROCESSED_DATA"))


# ---------------------------------------------------------------------------
# Spec handling (driver side, configuration only)
# ---------------------------------------------------------------------------
def node_name(node: dict) -> str:
    cfg = node.get("config") or {}
    name = cfg.get("name") or ""
    if name:
        return name
    return re.sub(r"\s+", "_", node.get("label") or "").upper()


def _order(nodes: list[dict], edges: list[dict]) -> list[dict]:
    """Topological order of one small spec, level by level in the spec's order.
    Nodes in or behind a cycle, or behind an unknown node, are left out (T3
    reports them on tables of specs)."""
    known = {n["id"]: n for n in nodes}
    place = {i: k for k, i in enumerate(known)}
    sorter = TopologicalSorter({i: () for i in known})
    for e in edges:
        sorter.add(e["target"], e["source"])
    with contextlib.suppress(CycleError):  # what stands before a cycle can still be taken
        sorter.prepare()
    out: list[dict] = []
    while level := sorted((i for i in sorter.get_ready() if i in known), key=place.get):
        out += [known[i] for i in level]
        sorter.done(*level)
    return out


def _checked(spec: dict) -> list[dict]:
    """The spec's nodes in topological order, once its names and edges hold."""
    for part in ("database", "schema"):
        if not re.fullmatch(IDENTIFIER, spec.get(part) or ""):
            raise ValueError(f"{part} name not usable: {spec.get(part)!r}")
    nodes = spec.get("nodes") or []
    if not nodes:
        raise ValueError("the pipeline has no nodes")
    for n in nodes:
        if not re.fullmatch(IDENTIFIER, node_name(n)):
            raise ValueError(f"name of a {n['type']} not usable: {node_name(n)!r}")
    tables = Counter(node_name(n) for n in nodes if n["type"] == "table")
    for what, seen in (("id", Counter(n["id"] for n in nodes)), ("name of a table", tables)):
        again = sorted(k for k, count in seen.items() if count > 1)
        if again:
            raise ValueError(f"{what} used more than once: {', '.join(again)}")
    ids = {n["id"] for n in nodes}
    for e in spec.get("edges") or []:
        for end in ("source", "target"):
            if e.get(end) not in ids:
                raise ValueError(f"edge {end} is no node of the pipeline: {e.get(end)!r}")
    ordered = _order(nodes, spec.get("edges") or [])
    if len(ordered) != len(nodes):
        raise ValueError("pipeline graph has a cycle")
    if not any(n["type"] == "stage" for n in nodes):
        raise ValueError("pipeline has no stage")
    return ordered


def _declared(rows: DataFrame, table: dict) -> DataFrame:
    """Output rows in the columns that the table node declares, if it does:
    the three default ones cast, any other null."""
    columns = [c for c in (table.get("config") or {}).get("columns") or []
               if c.get("name") and re.fullmatch(IDENTIFIER, c["name"])]
    if not columns:
        return rows
    names = [c["name"] for c in columns]
    missing = [c for c in rows.columns if c not in names]
    if missing:
        raise ValueError(f"table {node_name(table)} declares no column {', '.join(missing)}")
    for n in names:
        if n not in rows.columns:
            rows = rows.withColumn(n, F.lit(None).cast("string"))
    return apply_schema(rows, columns)


def pipeline_outputs(spec: dict, stages: dict[str, DataFrame], as_of: str | None = None, only: str | None = None,
                     tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The output rows of every table of the spec, by table name.

    Rows follow the edges: a text node reads the outputs of all its inputs, a
    table takes those of all branches and stages that reach it.  Tasks and
    streams pass rows on.  Only nodes that lead to a table are run.  A spec
    without tables gives the rows of its last text nodes under the name "".
    ``tables`` holds tables that configs name (``lexicon``, ``idf``).
    """
    ordered = _checked(spec)
    place = {n["id"]: k for k, n in enumerate(ordered)}
    inputs: dict[str, set[str]] = {n["id"]: set() for n in ordered}
    for e in spec.get("edges") or []:
        inputs[e["target"]].add(e["source"])
    targets = [n for n in ordered if n["type"] == "table" and only in (None, node_name(n))]
    if only is not None and not targets:
        raise ValueError(f"no table {only}")
    ends = [n["id"] for n in targets]
    if not targets:
        texts = {n["id"] for n in ordered if n["type"].startswith("ai_")}
        ends = [i for i in texts if not any(i in inputs[t] for t in texts)]
    needed: set[str] = set()
    todo = list(ends)
    while todo:
        i = todo.pop()
        if i not in needed:
            needed.add(i)
            todo += inputs[i]

    out: dict[str, Rows] = {}
    for n in ordered:
        i, config = n["id"], n.get("config") or {}
        if i not in needed:
            continue
        if n["type"] == "stage":
            out[i] = _source(stages[node_name(n)], "FILE_NAME", "content", i)
            continue
        ready = [p for p in sorted(inputs[i], key=place.get) if p in out]
        if not ready:
            continue                       # no stage reaches this node
        if n["type"].startswith("ai_"):
            if not _row_local(n["type"], config) and len(ready) == 1:
                out[ready[0]] = _fix(out[ready[0]])     # written once for all branches from here
            out[i] = _apply(_union([(p, out[p]) for p in ready]), n["type"], config, tables or {})
        else:
            out[i] = _union([(p, out[p]) for p in ready])

    def final(ids: list[str]) -> DataFrame:
        rows = _union([(i, out[i]) for i in ids]).df
        return output_rows(rows, F.col(KEY)["name"], TEXT, as_of=as_of)
    if targets:
        return {node_name(n): _declared(final([n["id"]]), n) for n in targets if n["id"] in out}
    ends = [i for i in sorted(ends, key=place.get) if i in out]
    return {"": final(ends)} if ends else {}


def run_pipeline(spec: dict, stages: dict[str, DataFrame], as_of: str | None = None, target: str | None = None,
                 tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The output rows (FILE_NAME, PROCESSED_DATA, PROCESSED_AT, or the
    table's declared columns) that the pipeline's procedure would insert into
    ``target``, which may be left out when the spec has one table.

    ``stages`` maps a stage name to its rows ``(FILE_NAME, content)``, e.g. the
    result of ``stage_files`` or a table treated as a stage.  Unlike the
    reference, rows follow the edges (SURVEY 2.13), see ``pipeline_outputs``.
    """
    outputs = pipeline_outputs(spec, stages, as_of, target, tables)
    if len(outputs) != 1:
        raise ValueError("no stage reaches a table" if not outputs else
                         f"the pipeline fills {', '.join(sorted(outputs))}: name a target, or use pipeline_outputs")
    return next(iter(outputs.values()))


def spec_from_json(text: str) -> dict:
    """Saved configs may be encoded more than once (P5 on one value)."""
    v = text
    while isinstance(v, str):
        v = json.loads(v)
    return v


def schedule_minutes(schedule: str | None) -> int:
    """Task schedule text (``N MINUTE``; empty -> 60) to minutes.  ``USING CRON``
    has no Structured Streaming trigger and is refused."""
    s = (schedule or "").strip()
    if not s:
        return 60
    m = re.match(r"(?i)^([0-9]+)[ \t]*MINUTES?$", s)
    if not m:
        raise ValueError(f"unsupported schedule {schedule!r}: use 'N MINUTE'")
    return int(m.group(1))


def start_pipeline_task(spec: dict, stage_path: str, target_path: str, checkpoint: str,
                        schedule: str | None = None, available_now: bool = False,
                        as_of: str | None = None, target: str | None = None,
                        tables: dict[str, DataFrame] | None = None):
    """U6 + ST4 + ST5 + ST7: the pipeline's task.  New files of the stage
    (a file stream, INSERT_ONLY) are processed each ``schedule`` interval:
    every micro-batch runs the pipeline's text chain as a batch plan (its
    windows and aggregates are not streaming operators) and is appended
    exactly once.  ``available_now`` processes what is there and stops.  Steps
    that weigh tokens by idf need a stored table of them (config ``idf``): a
    batch's own would make the answers depend on the batch."""
    from pyspark.sql import SparkSession
    from stagecraft.streaming.live import consume, stage_stream
    spark = SparkSession.active()
    stage, *more = [n for n in spec["nodes"] if n["type"] == "stage"]
    if more:
        raise ValueError("a task reads one stage: start one per stage")
    for n in spec["nodes"]:
        c = n.get("config") or {}
        if c.get("idf") is None and (n["type"] == "ai_classify" or (n["type"] == "ai_extract" and _free_questions(c))):
            raise ValueError(f"{node_name(n)} needs an idf table in a task")
    files = stage_stream(spark, stage_path).select("FILE_NAME", F.decode("content", "UTF-8").alias("content"))

    def run_batch(batch: DataFrame) -> DataFrame:
        return run_pipeline(spec, {node_name(stage): batch}, as_of=as_of, target=target, tables=tables)

    every = None if available_now else f"{schedule_minutes(schedule)} minutes"
    return consume(files, target_path, checkpoint, transform=run_batch,
                   available_now=available_now, processing_time=every)
