"""Registered queries: one per operator of SURVEY section 2.

Each entry is ``name -> (fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``.
Every query reads whole driver tables (or tables Spark derives from them);
the SQL is an independent DuckDB statement over the same parquet files that
must give the same rows.  Output columns are scalars (strings, integers,
rounded doubles, booleans) so the two engines compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.functions import text as X
from stagecraft.plans import oracle as Q
from stagecraft.plans.pipeline import run_pipeline
from stagecraft.sources.tables import load

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

AS_OF = "2024-02-01 00:00:00"


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql.strip() if sql else None)
        return fn
    return deco


# ---------------------------------------------------------------------------
# Flagship: a stored pipeline over pages treated as a stage
# ---------------------------------------------------------------------------
FLAGSHIP_SPEC = {
    "database": "MY_DB", "schema": "PUBLIC",
    "nodes": [
        {"id": "n1", "type": "stage", "label": "Web pages", "config": {"name": "PAGES"}},
        {"id": "n2", "type": "ai_parse_document", "label": "Parse", "config": {"mode": "LAYOUT"}},
        {"id": "n3", "type": "ai_summarize", "label": "Summarize", "config": {}},
        {"id": "n4", "type": "table", "label": "Page summaries", "config": {}},
    ],
    "edges": [{"source": "n1", "target": "n2"}, {"source": "n2", "target": "n3"},
              {"source": "n3", "target": "n4"}],
}


def pages_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(F.col("url").alias("FILE_NAME"), F.col("html").alias("content"))


@query("stored_pipeline", f"""
WITH src AS (SELECT url AS FILE_NAME, {Q.layout_text('html')} AS content FROM pages),
summ AS ({Q.summarize('src', 'FILE_NAME', 'content')})
SELECT src.FILE_NAME, summ.summary AS PROCESSED_DATA, TIMESTAMP '{AS_OF}' AS PROCESSED_AT
FROM src LEFT JOIN summ ON src.FILE_NAME = summ.FILE_NAME
""")
def q_stored_pipeline(spark, sf_dir):
    return run_pipeline(FLAGSHIP_SPEC, {"PAGES": pages_stage(spark, sf_dir)}, as_of=AS_OF)


# ---------------------------------------------------------------------------
# Parse and summarize
# ---------------------------------------------------------------------------
BRANCH_SPEC = {
    "database": "MY_DB", "schema": "PUBLIC",
    "nodes": [{"id": "s", "type": "stage", "label": "Pages", "config": {}},
              {"id": "p", "type": "ai_parse_document", "label": "Parse", "config": {}},
              {"id": "m", "type": "ai_summarize", "label": "Short", "config": {}},
              {"id": "t", "type": "table", "label": "Out", "config": {}}],
    "edges": [{"source": "s", "target": "p"}, {"source": "p", "target": "m"},
              {"source": "p", "target": "t"}, {"source": "m", "target": "t"}],
}
STAGES_SPEC = {
    "database": "MY_DB", "schema": "PUBLIC",
    "nodes": [{"id": "a", "type": "stage", "label": "Pages", "config": {}},
              {"id": "b", "type": "stage", "label": "Docs", "config": {}},
              {"id": "p", "type": "ai_parse_document", "label": "Parse", "config": {}},
              {"id": "m", "type": "ai_summarize", "label": "Short", "config": {}},
              {"id": "t", "type": "table", "label": "Out", "config": {}}],
    "edges": [{"source": "a", "target": "p"}, {"source": "p", "target": "m"},
              {"source": "b", "target": "m"}, {"source": "m", "target": "t"}],
}


@query("pipeline_branches", f"""
WITH src AS (SELECT url AS FILE_NAME, {Q.layout_text('html')} AS content FROM pages),
summ AS ({Q.summarize('src', 'FILE_NAME', 'content')})
SELECT FILE_NAME, content AS PROCESSED_DATA, TIMESTAMP '{AS_OF}' AS PROCESSED_AT FROM src
UNION ALL
SELECT src.FILE_NAME, summ.summary, TIMESTAMP '{AS_OF}' FROM src LEFT JOIN summ ON src.FILE_NAME = summ.FILE_NAME
""")
def q_pipeline_branches(spark, sf_dir):
    return run_pipeline(BRANCH_SPEC, {"PAGES": pages_stage(spark, sf_dir)}, as_of=AS_OF)


@query("pipeline_two_stages", f"""
WITH src AS (SELECT url AS FILE_NAME, {Q.layout_text('html')} AS content FROM pages
             UNION ALL SELECT 'doc-' || doc_id, text FROM documents),
summ AS ({Q.summarize('src', 'FILE_NAME', 'content')})
SELECT src.FILE_NAME, summ.summary AS PROCESSED_DATA, TIMESTAMP '{AS_OF}' AS PROCESSED_AT
FROM src LEFT JOIN summ ON src.FILE_NAME = summ.FILE_NAME
""")
def q_pipeline_two_stages(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("FILE_NAME"), F.col("text").alias("content"))
    return run_pipeline(STAGES_SPEC, {"PAGES": pages_stage(spark, sf_dir), "DOCS": docs}, as_of=AS_OF)


@query("parse_layout", Q.blocks("pages", "page_id", "html"))
def q_parse_layout(spark, sf_dir):
    return X.parse_document(load(spark, sf_dir, "pages"), "page_id", "html", "LAYOUT")


@query("parse_text", f"SELECT page_id, {Q.parse_text('html')} AS text FROM pages")
def q_parse_text(spark, sf_dir):
    return X.parse_document(load(spark, sf_dir, "pages"), "page_id", "html", "TEXT")


@query("summarize", Q.summarize("documents", "doc_id", "text"))
def q_summarize(spark, sf_dir):
    return X.summarize(load(spark, sf_dir, "documents"), "doc_id", "text", k=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}


# ---------------------------------------------------------------------------
# X3-X6, X8-X11
# ---------------------------------------------------------------------------
def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(Q.lit(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_RULE_QUESTIONS = list(X.EXTRACT_RULES)


@query("extract_fields", " UNION ALL ".join(
    f"SELECT doc_id, {Q.lit(q)} AS question, ans AS answer FROM "
    f"(SELECT doc_id, nullif(regexp_extract(text, {Q.lit(p)}, {g}), '') AS ans FROM documents) t "
    f"WHERE ans IS NOT NULL"
    for q, (p, g) in X.EXTRACT_RULES.items()))
def q_extract_fields(spark, sf_dir):
    return X.extract(load(spark, sf_dir, "documents"), "doc_id", "text", _RULE_QUESTIONS)


FREE_QUESTIONS = ["Under which license is the work released?", "What is the token value?"]


@query("extract_sentence", f"""
WITH q AS (SELECT * FROM (VALUES {_values(list(enumerate(FREE_QUESTIONS)))}) q(q_ord, question)),
qt AS (SELECT DISTINCT question, token FROM (SELECT question, unnest({Q.tokens('question')}) AS token FROM q) a),
idf AS (SELECT * FROM ({Q.idf_table('documents', 'doc_id', 'text')}) i WHERE token IN (SELECT token FROM qt)),
s AS ({Q.sentences('documents', 'doc_id', 'text')}),
st AS (SELECT DISTINCT doc_id, pos, sentence, token FROM (SELECT doc_id, pos, sentence, unnest({Q.tokens('sentence')}) AS token FROM s) a),
sc AS (SELECT doc_id, pos, question, any_value(sentence) AS sentence, sum(idf) AS score
       FROM st JOIN qt USING (token) JOIN idf USING (token) GROUP BY doc_id, pos, question),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, question ORDER BY round(score, 9) DESC, pos) AS rk FROM sc)
SELECT doc_id, question, sentence AS answer, round(score, 6) AS score FROM r WHERE rk = 1
""")
def q_extract_sentence(spark, sf_dir):
    return X.answer_sentence(load(spark, sf_dir, "documents"), "doc_id", "text", FREE_QUESTIONS)


# Fixed configuration of the registered classify query: categories and seeds.
CLASSIFY_CATEGORIES = ["english", "french", "german", "spanish", "legal"]
CLASSIFY_SEEDS = {
    "english": ["the", "and", "of"],
    "french": ["le", "la", "les", "des"],
    "german": ["der", "die", "und"],
    "spanish": ["el", "los", "las", "del"],
    "legal": [],
}
_CFG_ROWS = [(i, c, w) for i, c in enumerate(CLASSIFY_CATEGORIES) for w in (CLASSIFY_SEEDS[c] or [c])]


@query("classify_seeded", f"""
WITH cfg AS (SELECT * FROM (VALUES {_values(_CFG_ROWS)}) c(c_ord, category, seed)),
st AS (SELECT DISTINCT c_ord, category, token FROM (SELECT c_ord, category, unnest({Q.tokens('seed')}) AS token FROM cfg) a),
idf AS (SELECT * FROM ({Q.idf_table('documents', 'doc_id', 'text')}) i WHERE token IN (SELECT token FROM st)),
tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({Q.tokens('text')}) AS token FROM documents) a
       WHERE token IN (SELECT token FROM st) GROUP BY doc_id, token),
pc AS (SELECT doc_id, c_ord, category, sum(tf * idf) AS score FROM tf JOIN st USING (token) JOIN idf USING (token)
       GROUP BY doc_id, c_ord, category),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, c_ord) AS rk FROM pc)
SELECT doc_id, category, round(score, 6) AS score FROM r WHERE rk = 1
""")
def q_classify_seeded(spark, sf_dir):
    return X.classify(load(spark, sf_dir, "documents"), "doc_id", "text", CLASSIFY_CATEGORIES, CLASSIFY_SEEDS)


@query("classify_trained", f"""
WITH lab AS (SELECT doc_id, toxic::INT AS y FROM labels),
occ AS (SELECT a.doc_id, a.token, lab.y FROM
        (SELECT doc_id, unnest({Q.tokens('text')}) AS token FROM documents WHERE doc_id IN (SELECT doc_id FROM lab)) a
        JOIN lab USING (doc_id)),
counts AS (SELECT token, count(*) FILTER (WHERE y = 0) AS c0, count(*) FILTER (WHERE y = 1) AS c1 FROM occ GROUP BY token),
tot AS (SELECT count(*) AS v, sum(c0) AS t0, sum(c1) AS t1 FROM counts),
pri AS (SELECT count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM lab),
model AS (SELECT token, ln((c0 + 1) / (t0 + v)) AS lp0, ln((c1 + 1) / (t1 + v)) AS lp1 FROM counts, tot),
dt AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({Q.tokens('text')}) AS token FROM documents) a
       GROUP BY doc_id, token),
sums AS (SELECT doc_id, sum(n * lp0) AS s0, sum(n * lp1) AS s1 FROM dt JOIN model USING (token) GROUP BY doc_id),
m AS (SELECT d.doc_id, (coalesce(s1, 0) + ln(n1 / (n0 + n1))) - (coalesce(s0, 0) + ln(n0 / (n0 + n1))) AS margin
      FROM documents d LEFT JOIN sums USING (doc_id), pri)
SELECT doc_id, CASE WHEN margin > 0 THEN 1 ELSE 0 END AS label, round(margin, 6) AS margin FROM m
""")
def q_classify_trained(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    index, _ = X.token_index(docs, "doc_id", "text")
    model = X.fit_nb(docs, load(spark, sf_dir, "labels"), "doc_id", "text", "toxic", index)
    return X.predict_nb(docs, model, "doc_id", "text", index)


LEXICON_SQL = f"""
SELECT token, round(w, 6) AS weight, round(w * 1000000)::BIGINT AS weight_micro FROM (
  SELECT token, a, b, ln((b + 0.5) / (nb - b + 0.5)) - ln((a + 0.5) / (na - a + 0.5)) AS w FROM (
    SELECT token, count(*) FILTER (WHERE bad = 1) AS a, count(*) FILTER (WHERE bad = 0) AS b
    FROM (SELECT DISTINCT p.doc_id, p.token, lab.bad FROM
          (SELECT doc_id, unnest({Q.tokens('text')}) AS token FROM documents
           WHERE doc_id IN (SELECT doc_id FROM labels)) p
          JOIN (SELECT doc_id, toxic::INT AS bad FROM labels) lab USING (doc_id)) x
    GROUP BY token) c,
  (SELECT count(*) FILTER (WHERE toxic = 1) AS na, count(*) FILTER (WHERE toxic = 0) AS nb FROM labels) n
  WHERE a + b >= 5) t
WHERE abs(w) >= 2.0"""


def _lexicon(spark, sf_dir):
    return X.learn_lexicon(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id", "text")


@query("learn_lexicon", LEXICON_SQL)
def q_learn_lexicon(spark, sf_dir):
    return _lexicon(spark, sf_dir)


def _sentiment_sql(source: str, id_col: str, text_col: str) -> str:
    return f"""
SELECT s.{id_col}, coalesce(sum(lex.weight_micro), 0)::BIGINT AS score_micro,
       CASE WHEN coalesce(sum(lex.weight_micro), 0) > 0 THEN 'positive'
            WHEN coalesce(sum(lex.weight_micro), 0) < 0 THEN 'negative' ELSE 'neutral' END AS sentiment
FROM {source} s
LEFT JOIN (SELECT DISTINCT {id_col}, token FROM (SELECT {id_col}, unnest({Q.tokens(text_col)}) AS token FROM {source}) a) t
  ON s.{id_col} = t.{id_col}
LEFT JOIN lex ON t.token = lex.token
GROUP BY s.{id_col}"""


@query("sentiment", f"WITH lex AS ({LEXICON_SQL}) {_sentiment_sql('documents', 'doc_id', 'text')}")
def q_sentiment(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    index, _ = X.token_index(docs, "doc_id", "text")
    lexicon = X.learn_lexicon(docs, load(spark, sf_dir, "labels"), "doc_id", "text", "toxic", index=index)
    return X.sentiment(docs, "doc_id", "text", lexicon, index)


@query("text_chain", f"""
WITH lex AS ({LEXICON_SQL}),
summ AS ({Q.summarize('documents', 'doc_id', 'text')}),
src AS (SELECT d.doc_id, summ.summary AS text FROM documents d LEFT JOIN summ USING (doc_id)),
sent AS ({_sentiment_sql('src', 'doc_id', 'text')})
SELECT doc_id, sentiment AS PROCESSED_DATA FROM sent
""")
def q_text_chain(spark, sf_dir):
    from stagecraft.plans.pipeline import text_chain
    docs = load(spark, sf_dir, "documents")
    return text_chain(docs, "doc_id", "text",
                      [("ai_summarize", {}), ("ai_sentiment", {"lexicon": _lexicon(spark, sf_dir)})])


@query("model_apply", """
SELECT conv_id, turn, 'Database: MY_DB, Schema: PUBLIC. Request: ' || text AS prompt,
       'Database: MY_DB, Schema: PUBLIC. Request: ' || text AS response
FROM conversations WHERE role = 'user'
""")
def q_model_apply(spark, sf_dir):
    from stagecraft.functions.model import echo_model, model_apply, prompt_column
    conv = load(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    prompts = conv.select("conv_id", "turn", prompt_column("text").alias("prompt"))
    return model_apply(prompts, "prompt", echo_model)


# ---------------------------------------------------------------------------
# Graph tables
# ---------------------------------------------------------------------------
from stagecraft.operators import graph as GR  # noqa: E402
from stagecraft.plans import fixtures as FX  # noqa: E402

LEVELS_SQL = """
lv AS (
  WITH RECURSIVE walk(graph_id, id, level) AS (
    SELECT n.graph_id, n.id, 0 FROM graph_nodes n
    WHERE NOT EXISTS (SELECT 1 FROM graph_edges e WHERE e.graph_id = n.graph_id AND e.target = n.id)
    UNION ALL
    SELECT e.graph_id, e.target, w.level + 1 FROM walk w
    JOIN graph_edges e ON e.graph_id = w.graph_id AND e.source = w.id)
  SELECT graph_id, id, max(level) AS level FROM walk GROUP BY graph_id, id),
ordr AS (
  SELECT lv.graph_id, lv.id, lv.level,
         row_number() OVER (PARTITION BY lv.graph_id ORDER BY lv.level, n.pos, lv.id) AS ord
  FROM lv JOIN graph_nodes n ON n.graph_id = lv.graph_id AND n.id = lv.id)"""


def _graph(spark, sf_dir):
    nodes = FX.graph_nodes(spark, sf_dir)
    return nodes, FX.graph_edges(spark, sf_dir, nodes)


@query("topological_levels", f"WITH {FX.GRAPH_SQL}, {LEVELS_SQL} SELECT graph_id, id, level FROM lv")
def q_topological_levels(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return GR.topological_levels(nodes, edges)


@query("topological_order", f"WITH {FX.GRAPH_SQL}, {LEVELS_SQL} SELECT graph_id, id, level, ord FROM ordr")
def q_topological_order(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return GR.topological_order(nodes, edges)


@query("cyclic_nodes", f"""
WITH RECURSIVE {FX.GRAPH_SQL},
reach(graph_id, src, id) AS (
  SELECT graph_id, source, target FROM cyclic_edges
  UNION
  SELECT r.graph_id, r.src, e.target FROM reach r JOIN cyclic_edges e ON e.graph_id = r.graph_id AND e.source = r.id),
seeds AS (
  SELECT graph_id, id FROM reach WHERE src = id
  UNION
  SELECT e.graph_id, e.target FROM cyclic_edges e
  WHERE NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.graph_id = e.graph_id AND n.id = e.source)),
bad AS (
  SELECT graph_id, id FROM seeds
  UNION
  SELECT r.graph_id, r.id FROM seeds s JOIN reach r ON r.graph_id = s.graph_id AND r.src = s.id)
SELECT DISTINCT n.graph_id, n.id FROM graph_nodes n JOIN bad b ON b.graph_id = n.graph_id AND b.id = n.id
""")
def q_cyclic_nodes(spark, sf_dir):
    nodes = FX.graph_nodes(spark, sf_dir)
    return GR.cyclic_nodes(nodes, FX.cyclic_edges(spark, sf_dir, nodes))


@query("in_degree", f"""
WITH {FX.GRAPH_SQL}
SELECT n.graph_id, n.id, count(e.target)::BIGINT AS in_degree
FROM graph_nodes n LEFT JOIN graph_edges e ON e.graph_id = n.graph_id AND e.target = n.id
GROUP BY n.graph_id, n.id
""")
def q_in_degree(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return GR.in_degree(nodes, edges, FX.graph_size(spark, sf_dir))


_KIND_SQL = ("CASE WHEN type IN ('stage', 'table', 'task', 'stream') THEN type "
             "WHEN starts_with(type, 'ai_') THEN 'ai' END")


@query("nodes_by_kind", f"""
WITH {FX.GRAPH_SQL}, {LEVELS_SQL}
SELECT graph_id, kind, row_number() OVER (PARTITION BY graph_id, kind ORDER BY ord) AS rank, id, name FROM (
  SELECT n.graph_id, n.id, {_KIND_SQL} AS kind, upper(regexp_replace(n.label, '\\s+', '_', 'g')) AS name, o.ord
  FROM graph_nodes n JOIN ordr o ON o.graph_id = n.graph_id AND o.id = n.id) x
WHERE kind IS NOT NULL
""")
def q_nodes_by_kind(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return GR.nodes_by_kind(nodes, GR.topological_levels(nodes, edges, carry=["pos", "type", "label"]))


@query("first_of_kind", f"""
WITH {FX.GRAPH_SQL}, {LEVELS_SQL}
SELECT graph_id, kind, arg_min(id, ord) AS id FROM (
  SELECT n.graph_id, n.id, {_KIND_SQL} AS kind, o.ord
  FROM graph_nodes n JOIN ordr o ON o.graph_id = n.graph_id AND o.id = n.id) x
WHERE kind IN ('stage', 'table') GROUP BY graph_id, kind
""")
def q_first_of_kind(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return GR.first_of_kind(nodes, GR.topological_levels(nodes, edges, carry=["pos", "type"]))


@query("upstream_nodes", f"""
WITH {FX.GRAPH_SQL}
SELECT e.graph_id, e.target AS id, arg_min(e.source, e.epos) AS upstream_id
FROM graph_edges e JOIN graph_nodes n ON n.graph_id = e.graph_id AND n.id = e.source AND n.type = 'table'
GROUP BY e.graph_id, e.target
""")
def q_upstream_nodes(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return GR.first_upstream(nodes, edges, "table")


@query("downstream_nodes", f"""
WITH {FX.GRAPH_SQL}
SELECT e.graph_id, e.source AS id, e.target AS downstream_id
FROM graph_edges e JOIN graph_nodes n ON n.graph_id = e.graph_id AND n.id = e.target
""")
def q_downstream_nodes(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return GR.downstream(nodes, edges)


# ---------------------------------------------------------------------------
# Prompt and reply tables
# ---------------------------------------------------------------------------
from stagecraft.operators import replies as RP  # noqa: E402

_STRIP_SQL = ("trim(regexp_replace(regexp_replace(content, '(?i)^```(json)?[ \\t\\r\\n\\f]*', ''), "
              "'\\n?```[ \\t\\r\\n\\f]*$', ''))")
DECODE_SQL = f"""
{FX.REPLIES_SQL},
dec AS (SELECT reply_id, json_valid(raw) AS outer_json,
               CASE WHEN NOT json_valid(raw) THEN raw
                    ELSE coalesce(json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.choices[0].messages'), '')
               END AS content
        FROM replies),
st AS (SELECT *, {_STRIP_SQL} AS stripped FROM dec),
parsed0 AS (SELECT *, outer_json AND json_valid(stripped) AS valid FROM st),
parsed1 AS (SELECT *, CASE WHEN valid THEN stripped END AS sj FROM parsed0),
parsed AS (SELECT *, coalesce(valid AND json_type(sj) = 'OBJECT', false) AS is_pipeline,
                  CASE WHEN valid AND json_type(sj) = 'OBJECT' THEN sj END AS pj FROM parsed1),
rnodes AS (SELECT reply_id, (generate_subscripts(arr, 1) - 1)::INTEGER AS pos, unnest(arr) AS node
           FROM (SELECT reply_id, CAST(json_extract(pj, '$.nodes') AS JSON[]) AS arr FROM parsed
                 WHERE is_pipeline AND json_type(pj, '$.nodes') = 'ARRAY') a),
redges AS (SELECT reply_id, n_nodes, json_extract(e, '$.source_index')::INT AS source_index,
                  json_extract(e, '$.target_index')::INT AS target_index
           FROM (SELECT reply_id, coalesce(json_array_length(pj, '$.nodes'), 0)::INTEGER AS n_nodes,
                        unnest(CAST(json_extract(pj, '$.edges') AS JSON[])) AS e FROM parsed
                 WHERE is_pipeline AND json_type(pj, '$.edges') = 'ARRAY') a)"""


def _parsed(spark, sf_dir):
    return RP.reply_to_pipeline(RP.decode_replies(FX.replies(spark, sf_dir)))


@query("render_prompts", f"""
SELECT conv_id, turn, to_json([struct_pack(role := 'system', content := {Q.lit(RP.SYSTEM_PROMPT)}),
                               struct_pack(role := 'user', content := 'Database: MY_DB, Schema: PUBLIC. Request: ' || text)])::VARCHAR
       AS messages
FROM conversations WHERE role = 'user'
""")
def q_render_prompts(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return conv.select("conv_id", "turn", F.to_json(RP.render_prompts(conv, "text")).alias("messages"))


@query("chat_transcripts", """
SELECT conv_id, turn, row_number() OVER w AS ord, role, text, lag(role) OVER w AS prev_role
FROM conversations WHERE role IN ('user', 'assistant')
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def q_chat_transcripts(spark, sf_dir):
    return RP.transcripts(load(spark, sf_dir, "conversations"))


@query("decode_replies", f"WITH {DECODE_SQL} SELECT reply_id, outer_json, content FROM dec")
def q_decode_replies(spark, sf_dir):
    return RP.decode_replies(FX.replies(spark, sf_dir)).select("reply_id", "outer_json", "content")


@query("strip_fences", f"WITH {DECODE_SQL} SELECT reply_id, stripped FROM st")
def q_strip_fences(spark, sf_dir):
    from stagecraft.functions.scalars import strip_fences
    d = RP.decode_replies(FX.replies(spark, sf_dir))
    return d.select("reply_id", strip_fences("content").alias("stripped"))


@query("reply_to_pipeline", f"""
WITH {DECODE_SQL}
SELECT reply_id, is_pipeline,
       CASE WHEN is_pipeline THEN json_extract_string(pj, '$.message') ELSE content END AS message,
       coalesce(CASE WHEN json_type(pj, '$.nodes') = 'ARRAY' THEN json_array_length(pj, '$.nodes') END, 0)::INT AS n_nodes,
       coalesce(CASE WHEN json_type(pj, '$.edges') = 'ARRAY' THEN json_array_length(pj, '$.edges') END, 0)::INT AS n_edges
FROM parsed
""")
def q_reply_to_pipeline(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return p.select("reply_id", "is_pipeline", "message", F.size("nodes").alias("n_nodes"),
                    F.size("edges").alias("n_edges"))


@query("replies_to_graph", f"""
WITH {DECODE_SQL}
SELECT reply_id, pos, 'chat_' || reply_id || '_' || pos AS node_id,
       json_extract_string(node, '$.type') AS type, json_extract_string(node, '$.label') AS label,
       json_extract(node, '$.config')::VARCHAR AS config
FROM rnodes
""")
def q_replies_to_graph(spark, sf_dir):
    return RP.reply_nodes(_parsed(spark, sf_dir))


@query("edge_range_filter", f"""
WITH {DECODE_SQL}
SELECT reply_id, n_nodes, source_index, target_index FROM redges
WHERE source_index >= 0 AND source_index < n_nodes AND target_index >= 0 AND target_index < n_nodes
""")
def q_edge_range_filter(spark, sf_dir):
    return RP.edges_in_range(RP.index_edges(_parsed(spark, sf_dir)))


@query("index_to_id_join", f"""
WITH {DECODE_SQL}
SELECT e.reply_id, s.node_id AS source, t.node_id AS target
FROM redges e
JOIN (SELECT reply_id, pos, 'chat_' || reply_id || '_' || pos AS node_id FROM rnodes) s
  ON s.reply_id = e.reply_id AND s.pos = e.source_index
JOIN (SELECT reply_id, pos, 'chat_' || reply_id || '_' || pos AS node_id FROM rnodes) t
  ON t.reply_id = e.reply_id AND t.pos = e.target_index
""")
def q_index_to_id_join(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return RP.resolve_edges(RP.reply_nodes(parsed), RP.edges_in_range(RP.index_edges(parsed)))


@query("replies_to_edges", f"""
WITH {DECODE_SQL}
SELECT reply_id, 'chat_' || reply_id || '_' || source_index AS source, 'chat_' || reply_id || '_' || target_index AS target
FROM redges WHERE source_index >= 0 AND source_index < n_nodes AND target_index >= 0 AND target_index < n_nodes
""")
def q_replies_to_edges(spark, sf_dir):
    return RP.replies_to_graph(FX.replies(spark, sf_dir))[1]


# ---------------------------------------------------------------------------
# Projections and scalar functions
# ---------------------------------------------------------------------------
from stagecraft.functions import scalars as S  # noqa: E402
from stagecraft.functions import types as TY  # noqa: E402


@query("derived_projection", f"""
SELECT source || '/' || doc_id AS FILE_NAME, lang AS PROCESSED_DATA, TIMESTAMP '{AS_OF}' AS PROCESSED_AT FROM documents
""")
def q_derived_projection(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return S.output_rows(d, F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), "lang", as_of=AS_OF)


@query("chained_projection", f"""
SELECT page_id, s1 AS STEP_1, s2 AS STEP_2, regexp_replace(s2, '#+', '#', 'g') AS PROCESSED_DATA FROM (
  SELECT page_id, s1, regexp_replace(s1, '[0-9]', '#', 'g') AS s2 FROM (
    SELECT page_id, {Q.parse_text('html')} AS s1 FROM pages) a) b
""")
def q_chained_projection(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    out = S.chain(p, "html", [X.parse_text, lambda c: F.regexp_replace(c, "[0-9]", "#"),
                              lambda c: F.regexp_replace(c, "#+", "#")])
    return out.select("page_id", "STEP_1", "STEP_2", "PROCESSED_DATA")


@query("cast_to_string", """
SELECT event_id::VARCHAR AS event_id_text, value::VARCHAR AS value_text, user_id::VARCHAR AS user_text,
       json(props)::VARCHAR AS props_text FROM events
""")
def q_cast_to_string(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(S.as_text("event_id").alias("event_id_text"), S.as_text("value").alias("value_text"),
                    S.as_text("user_id").alias("user_text"),
                    S.as_text(F.parse_json("props")).alias("props_text"))


@query("json_parse_get", "SELECT event_id, (CAST(props AS JSON)->>'k')::INT AS k FROM events")
def q_json_parse_get(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", S.json_get("props", "$.k", "int").alias("k"))


def _json_string(c):
    """Encode text as a JSON string literal (what a store does to a value it
    saves as text)."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


@query("json_unwrap", """
SELECT event_id, (CAST(props AS JSON)->>'k')::INT AS k, (CAST(props AS JSON)->>'k')::INT AS k_plain FROM events
""")
def q_json_unwrap(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    twice = _json_string(F.col("props"))
    thrice = _json_string(twice)
    enc = F.when(F.col("event_type") == "error", thrice).when(F.col("event_type") == "view", twice).otherwise(F.col("props"))
    return e.select("event_id", F.try_variant_get(S.json_unwrap(enc), "$.k", "int").alias("k"),
                    S.json_get("props", "$.k", "int").alias("k_plain"))


@query("json_render", """
SELECT event_id, to_json(struct_pack(event_id := event_id, event_type := event_type, user_id := user_id))::VARCHAR AS config_text
FROM events
""")
def q_json_render(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", S.json_text(F.struct("event_id", "event_type", "user_id")).alias("config_text"))


@query("object_name", """
SELECT p_partkey, coalesce(nullif(CASE WHEN p_type = 'SMALL' THEN 'S_' || p_partkey ELSE '' END, ''),
                           upper(regexp_replace(p_name, '\\s+', '_', 'g'))) AS object_name FROM part
""")
def q_object_name(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    name = F.when(F.col("p_type") == "SMALL", F.concat(F.lit("S_"), F.col("p_partkey").cast("string"))).otherwise(F.lit(""))
    return p.select("p_partkey", S.object_name(name, "p_name").alias("object_name"))


@query("valid_identifier", f"""
WITH {FX.COLUMN_DEFS_SQL.strip()}
SELECT ord, name, coalesce(regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_$]*$'), false) AS valid FROM column_defs
""")
def q_valid_identifier(spark, sf_dir):
    c = FX.column_defs(spark, sf_dir)
    return c.select("ord", "name", TY.is_identifier("name").alias("valid"))


_TYPE_LIST = ", ".join(Q.lit(t) for t in TY.TYPE_NAMES)


@query("normalize_type", f"""
WITH {FX.COLUMN_DEFS_SQL.strip()}
SELECT ord, type, trim(regexp_replace(upper(trim(type)), '\\(.*\\)', '')) AS type_name,
       coalesce(regexp_matches(regexp_replace(upper(trim(type)), '[ \\t]+', '', 'g'), {Q.lit(TY.TYPE_SHAPE)})
                AND trim(regexp_replace(upper(trim(type)), '\\(.*\\)', '')) IN ({_TYPE_LIST}), false) AS valid
FROM column_defs
""")
def q_normalize_type(spark, sf_dir):
    c = FX.column_defs(spark, sf_dir)
    t = TY.normalize_type("type")
    return c.select("ord", "type", t["name"].alias("type_name"), t["valid"].alias("valid"))


_LINES_SQL = (f"list_filter(list_transform(string_split(text, chr(10)), "
              f"lambda x: regexp_replace(x, {Q.lit(S.LINE_TRIM)}, '', 'g')), lambda x: x <> '')")


@query("split_lines", f"""
SELECT doc_id, pos, line FROM (
  SELECT doc_id, (generate_subscripts(arr, 1) - 1)::INTEGER AS pos, unnest(arr) AS line
  FROM (SELECT doc_id, {_LINES_SQL} AS arr FROM documents) a) b
""")
def q_split_lines(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return (d.select("doc_id", F.posexplode_outer(S.split_lines("text")).alias("pos", "line"))
             .filter(F.col("line").isNotNull()))


@query("join_strings", f"SELECT doc_id, array_to_string({_LINES_SQL}, ' / ') AS joined FROM documents")
def q_join_strings(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", S.join_strings(S.split_lines("text"), " / ").alias("joined"))


@query("state_label", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Open' ELSE 'Other' END AS state FROM orders
""")
def q_state_label(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.label("o_orderstatus", {"F": "Final", "O": "Open"}, "Other").alias("state"))


@query("default_fill", """
SELECT c_custkey, coalesce(nullif(nullif(c_mktsegment, 'AUTOMOBILE'), ''), nullif(c_name, ''), 'Y') AS filled FROM customer
""")
def q_default_fill(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", S.first_filled(F.nullif("c_mktsegment", F.lit("AUTOMOBILE")), "c_name",
                                                default="Y").alias("filled"))


# ---------------------------------------------------------------------------
# F1, F2, F4, J4, U1, U2, O1
# ---------------------------------------------------------------------------
from stagecraft.operators import filters as FI  # noqa: E402
from stagecraft.operators import setops as SO  # noqa: E402


@query("name_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def q_name_search(spark, sf_dir):
    return FI.name_search(load(spark, sf_dir, "part"), "p_name", "RinG").select("p_partkey", "p_name")


@query("filter_valid_columns", f"""
WITH {FX.COLUMN_DEFS_SQL.strip()}
SELECT table_name, ord, name, type FROM column_defs
WHERE coalesce(name, '') <> '' AND regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_$]*$')
""")
def q_filter_valid_columns(spark, sf_dir):
    return FI.valid_columns(FX.column_defs(spark, sf_dir)).select("table_name", "ord", "name", "type")


USER_PREDICATE = "o_totalprice > 100000 AND o_orderstatus = 'F'"


@query("user_predicate", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {USER_PREDICATE}")
def q_user_predicate(spark, sf_dir):
    return FI.where(load(spark, sf_dir, "orders"), USER_PREDICATE).select("o_orderkey", "o_totalprice")


@query("prefer_draft_merge", f"""
WITH {FX.COLUMN_DEFS_SQL.strip()},
draft AS (SELECT name, 'VARIANT' AS type FROM column_defs WHERE nullable),
existing AS (SELECT name, type FROM column_defs)
SELECT * FROM draft UNION ALL
SELECT * FROM existing e WHERE NOT EXISTS (SELECT 1 FROM draft d WHERE d.name = e.name)
""")
def q_prefer_draft_merge(spark, sf_dir):
    c = FX.column_defs(spark, sf_dir)
    draft = c.filter("nullable").select("name", F.lit("VARIANT").alias("type"))
    return SO.prefer(draft, c.select("name", "type"), "name")


@query("append_sets", f"""
WITH {FX.GRAPH_SQL}, {DECODE_SQL}
SELECT graph_id, id, type, label FROM graph_nodes
UNION ALL
SELECT reply_id, 'chat_' || reply_id || '_' || pos, json_extract_string(node, '$.type'), json_extract_string(node, '$.label')
FROM rnodes
""")
def q_append_sets(spark, sf_dir):
    a = FX.graph_nodes(spark, sf_dir).select("graph_id", "id", "type", "label")
    b = RP.reply_nodes(_parsed(spark, sf_dir)).select(F.col("reply_id").alias("graph_id"), F.col("node_id").alias("id"),
                                                      "type", "label")
    return SO.append_sets(a, b)


@query("distinct_names", f"""
WITH {FX.GRAPH_SQL}
SELECT DISTINCT upper(regexp_replace(label, '\\s+', '_', 'g')) AS name FROM graph_nodes
""")
def q_distinct_names(spark, sf_dir):
    n = FX.graph_nodes(spark, sf_dir).select(S.object_name(F.lit(""), "label").alias("name"))
    return SO.distinct_names(n, "name")


@query("recent_configs", """
SELECT o_orderkey AS ID, o_orderpriority AS NAME, o_orderdate AS CREATED_AT FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50
""")
def q_recent_configs(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_orderpriority").alias("NAME"),
                                             F.col("o_orderdate").alias("CREATED_AT"))
    return SO.recent(o, "CREATED_AT", 50, tie="ID")


# ---------------------------------------------------------------------------
# Inventory, profiles, validation
# ---------------------------------------------------------------------------
from stagecraft.operators import inventory as INV  # noqa: E402
from stagecraft.operators import validate as VA  # noqa: E402
from stagecraft.sources.tables import TABLES  # noqa: E402

# The oracle runs at sf0.01 only; file listings there need the folder's path.
ORACLE_DIR = "/root/testdata/sf0.01"


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES))
def q_table_counts(spark, sf_dir):
    return INV.table_counts(spark, sf_dir, TABLES)


@query("table_inventory", f"""
WITH c AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES)}),
f AS (SELECT regexp_extract(replace(filename, '{ORACLE_DIR}/', ''), '^([^/]+)\\.parquet', 1) AS table_name,
             count(*) AS files, sum(size)::BIGINT AS bytes, max(epoch(last_modified))::BIGINT AS newest_epoch
      FROM read_blob('{ORACLE_DIR}/*.parquet') GROUP BY 1)
SELECT c.table_name, c.rows, f.files, f.bytes, f.newest_epoch FROM c LEFT JOIN f USING (table_name)
""")
def q_table_inventory(spark, sf_dir):
    return INV.table_inventory(spark, sf_dir, TABLES)


_PROFILE_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")]


@query("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS type, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
    f"count(DISTINCT {c}) AS distinct_count, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value FROM customer"
    for c, t in _PROFILE_COLS))
def q_column_profile(spark, sf_dir):
    return INV.column_profile(load(spark, sf_dir, "customer"), exact=True)


# Columns of the given tables and their types (bigint where none is given).
GIVEN_COLUMNS = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey, o_custkey, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id, ts timestamp_ntz, user_id, event_type string, value double, props string",
    "documents": "doc_id, text string, lang string, source string, n_chars", "embeddings": "vec_id, embedding array<float>, label int",
    "pages": "page_id, url string, html string", "benchmark": "item_id, text string", "labels": "doc_id, quality int, toxic int",
    "conversations": "conv_id, turn, role string, text string",
}


def _profile_sql() -> str:
    parts = []
    for t, cols in GIVEN_COLUMNS.items():
        for name, kind in ((c.split() + ["bigint"])[:2] for c in cols.split(", ")):
            edge = {"double": "{}({})::DECIMAL(38,6)::VARCHAR", "array<float>": "NULL::VARCHAR"}.get(kind, "{}({})::VARCHAR")
            parts.append(f"SELECT '{t}' AS table_name, '{name}' AS column_name, '{kind}' AS type, count(*) AS rows, count(*) - count({name}) AS nulls, "
                         f"{edge.format('min', name)} AS min_value, {edge.format('max', name)} AS max_value FROM {t}")
    return " UNION ALL ".join(parts)


@query("column_profiles", _profile_sql())
def q_column_profiles(spark, sf_dir):
    """All given tables, each in two loads whose sketches are stored and merged."""
    from functools import reduce
    _, loc = _scratch(spark, "g3")
    for odd in (0, 1):
        parts = [INV.profile_sketches(load(spark, sf_dir, t).filter(F.pmod(F.hash(cols.split(",")[0].split()[0]), F.lit(2)) == odd), t)
                 for t, cols in GIVEN_COLUMNS.items()]
        reduce(DataFrame.unionByName, parts).write.mode("append").parquet(loc)
    return INV.merged_profile(spark.read.parquet(loc)).drop("distinct_count")


VALIDATE_COLUMNS_SQL = f"""
WITH {FX.COLUMN_DEFS_SQL.strip()},
r AS (SELECT table_name, name,
             coalesce(name, '') = '' AS empty_name,
             coalesce(name, '') <> '' AND NOT coalesce(regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_$]*$'), false) AS invalid_name,
             NOT coalesce(regexp_matches(regexp_replace(upper(trim(type)), '[ \\t]+', '', 'g'), {Q.lit(TY.TYPE_SHAPE)})
                 AND trim(regexp_replace(upper(trim(type)), '\\(.*\\)', '')) IN ({_TYPE_LIST}), false) AS invalid_type
      FROM column_defs)
SELECT table_name, name, 'empty_name' AS violation FROM r WHERE empty_name
UNION ALL SELECT table_name, name, 'invalid_name' FROM r WHERE invalid_name
UNION ALL SELECT table_name, name, 'invalid_type' FROM r WHERE invalid_type
"""


@query("validate_columns", VALIDATE_COLUMNS_SQL)
def q_validate_columns(spark, sf_dir):
    return VA.validate_columns(FX.column_defs(spark, sf_dir))


@query("validate_tables", f"{VALIDATE_COLUMNS_SQL.strip()} UNION ALL SELECT n_name, NULL, 'no_columns' FROM nation")
def q_validate_tables(spark, sf_dir):
    """Definitions of the tables named by brands, which have columns, and nations, which have none."""
    tables = FX.column_defs(spark, sf_dir).select("table_name").unionByName(
        load(spark, sf_dir, "nation").select(F.col("n_name").alias("table_name")))
    return VA.validate_columns(FX.column_defs(spark, sf_dir), tables=tables)


def _specs(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("graph_id"),
                    F.when(F.col("o_orderstatus") == "P", F.lit("MY DB")).otherwise(F.lit("MY_DB")).alias("database"),
                    F.lit("PUBLIC").alias("schema"))


@query("validate_pipelines", f"""
WITH {FX.GRAPH_SQL},
specs AS (SELECT o_orderkey AS graph_id, CASE WHEN o_orderstatus = 'P' THEN 'MY DB' ELSE 'MY_DB' END AS database,
                 'PUBLIC' AS schema FROM orders),
cnt AS (SELECT graph_id, count(*) AS n FROM graph_nodes GROUP BY graph_id),
named AS (SELECT graph_id, id, type, upper(regexp_replace(label, '\\s+', '_', 'g')) AS obj_name FROM graph_nodes),
dup AS (SELECT *, count(*) OVER (PARTITION BY graph_id, obj_name) > 1 AS dup FROM named)
SELECT graph_id, NULL::VARCHAR AS id, 'invalid_database' AS violation FROM specs
  WHERE NOT coalesce(regexp_matches(database, '^[A-Za-z_][A-Za-z0-9_$]*$'), false)
UNION ALL SELECT graph_id, NULL, 'invalid_schema' FROM specs
  WHERE NOT coalesce(regexp_matches(schema, '^[A-Za-z_][A-Za-z0-9_$]*$'), false)
UNION ALL SELECT s.graph_id, NULL, 'empty_pipeline' FROM specs s LEFT JOIN cnt USING (graph_id) WHERE coalesce(n, 0) = 0
UNION ALL SELECT graph_id, id, 'invalid_name' FROM dup WHERE NOT coalesce(regexp_matches(obj_name, '^[A-Za-z_][A-Za-z0-9_$]*$'), false)
UNION ALL SELECT graph_id, id, 'duplicate_name' FROM dup WHERE dup
UNION ALL SELECT graph_id, id, 'unknown_type' FROM dup WHERE type NOT IN ({", ".join(Q.lit(t) for t in TY.NODE_TYPES)})
""")
def q_validate_pipelines(spark, sf_dir):
    nodes = FX.graph_nodes(spark, sf_dir).withColumn("name", F.lit(""))
    return VA.validate_pipelines(_specs(spark, sf_dir), nodes)


# ---------------------------------------------------------------------------
# Stages, scans, views, previews
# ---------------------------------------------------------------------------
from stagecraft.sources import parts as PT  # noqa: E402
from stagecraft.sources import stage as SG  # noqa: E402
from stagecraft.sources import tables as TB  # noqa: E402


@query("stage_directory", f"""
SELECT replace(filename, '{ORACLE_DIR}/', '') AS relative_path, size::BIGINT AS size,
       epoch(last_modified)::BIGINT AS modified_epoch FROM read_blob('{ORACLE_DIR}/*.parquet')
""")
def q_stage_directory(spark, sf_dir):
    d = SG.stage_directory(spark, sf_dir, glob="*.parquet")
    return d.select("relative_path", "size", F.unix_timestamp("last_modified").alias("modified_epoch"))


@query("stage_files", f"""
SELECT replace(filename, '{ORACLE_DIR}/', '') AS relative_path, size::BIGINT AS size, md5(content) AS md5
FROM read_blob('{ORACLE_DIR}/*.parquet')
""")
def q_stage_files(spark, sf_dir):
    d = SG.stage_files(spark, sf_dir, glob="*.parquet", part_bytes=PT.PART_BYTES)
    return PT.md5_of_parts(d, "relative_path")


@query("stage_read", "SELECT * FROM orders")
def q_stage_read(spark, sf_dir):
    import os
    return SG.stage_read(spark, os.path.join(sf_dir, "orders.parquet"), "auto")


@query("table_scan", "SELECT * FROM lineitem")
def q_table_scan(spark, sf_dir):
    return TB.table_scan(spark, "lineitem", sf_dir)


@query("sql_view", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000
""")
def q_sql_view(spark, sf_dir):
    TB.register_views(spark, sf_dir, ["orders"])
    return TB.create_view(spark, "open_orders",
                          "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
                          "WHERE o_orderstatus = 'O' AND o_totalprice > 50000", replace=True)


@query("table_preview", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def q_table_preview(spark, sf_dir):
    return TB.preview(load(spark, sf_dir, "orders"), 100, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


# ---------------------------------------------------------------------------
# Tables and writes
# ---------------------------------------------------------------------------
from stagecraft.operators import sinks as SK  # noqa: E402


def _scratch(spark, tag: str) -> tuple[str, str]:
    """A fresh table name and folder under the shared checkpoint folder."""
    import uuid
    from stagecraft.session import checkpoint_dir
    u = uuid.uuid4().hex[:12]
    base = checkpoint_dir(spark).rstrip("/")
    return f"stagecraft_{tag}_{u}", f"{base}/stagecraft-tables/{tag}_{u}"


DECLARED = [("CUSTOMER_NAME", "VARCHAR(25)"), ("BALANCE", "NUMBER(12,2)"), ("NATION", "INT"), ("SEGMENT", "TEXT")]


@query("declared_table", """
SELECT c_name::VARCHAR AS CUSTOMER_NAME, c_acctbal::DECIMAL(12,2) AS BALANCE, c_nationkey::INT AS NATION,
       c_mktsegment AS SEGMENT FROM customer
""")
def q_declared_table(spark, sf_dir):
    return SK.apply_schema(load(spark, sf_dir, "customer"), DECLARED,
                           ["c_name", "c_acctbal", "c_nationkey", "c_mktsegment"])


def _doc_rows(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return S.output_rows(d, F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), "lang", as_of=AS_OF)


_DOC_ROWS_SQL = f"SELECT source || '/' || doc_id AS FILE_NAME, lang AS PROCESSED_DATA, TIMESTAMP '{AS_OF}' AS PROCESSED_AT FROM documents"


def _read_output(spark, table):
    return spark.table(table).select("FILE_NAME", F.col("PROCESSED_DATA").cast("string").alias("PROCESSED_DATA"),
                                     "PROCESSED_AT")


@query("default_output_table", _DOC_ROWS_SQL)
def q_default_output_table(spark, sf_dir):
    name, loc = _scratch(spark, "k2")
    SK.ensure_table(spark, name, None, location=loc)
    SK.ensure_table(spark, name, None, location=loc)          # idempotent
    SK.append_into(_doc_rows(spark, sf_dir), name)
    return _read_output(spark, name)


@query("append_select", f"{_DOC_ROWS_SQL} UNION ALL {_DOC_ROWS_SQL}")
def q_append_select(spark, sf_dir):
    name, loc = _scratch(spark, "k3")
    SK.ensure_table(spark, name, None, location=loc)
    rows = _doc_rows(spark, sf_dir)
    SK.append_into(rows, name, ["FILE_NAME", "PROCESSED_DATA", "PROCESSED_AT"])
    SK.append_into(rows, name, ["FILE_NAME", "PROCESSED_DATA", "PROCESSED_AT"])   # every run re-reads the stage
    return _read_output(spark, name)


@query("append_new_files", _DOC_ROWS_SQL)
def q_append_new_files(spark, sf_dir):
    name, loc = _scratch(spark, "k4")
    SK.ensure_table(spark, name, None, location=loc)
    rows = _doc_rows(spark, sf_dir)
    SK.append_into(rows.filter(F.col("PROCESSED_DATA") == "en"), name)
    SK.append_new(rows, name)
    SK.append_new(rows, name)                                  # twice equals once
    return _read_output(spark, name)


def _config_rows(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    cfg = F.concat(F.lit('{"edges": [], "nodes": [{"id": "n1", "label": "'), F.col("o_orderpriority"),
                   F.lit('", "type": "stage"}]}'))
    return o.select(F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" pipeline "), F.col("o_orderkey").cast("string"),
                             F.lit(" ")).alias("NAME"), cfg.alias("CONFIG"), "o_orderkey")


@query("config_insert", f"""
SELECT row_number() OVER (ORDER BY o_orderkey) AS ID,
       trim(o_orderstatus || ' pipeline ' || o_orderkey) AS NAME,
       json('{{"edges": [], "nodes": [{{"id": "n1", "label": "' || o_orderpriority || '", "type": "stage"}}]}}')::VARCHAR AS CONFIG,
       TIMESTAMP '{AS_OF}' AS CREATED_AT
FROM orders
""")
def q_config_insert(spark, sf_dir):
    out = SK.save_configs(_config_rows(spark, sf_dir), None, order="o_orderkey", created_at=AS_OF)
    return out.select("ID", "NAME", F.to_json("CONFIG").alias("CONFIG"), "CREATED_AT")


@query("config_nodes", """
SELECT o_orderkey AS graph_id, 0 AS pos, 'n1' AS id, 'stage' AS type, o_orderpriority AS label, '' AS name FROM orders
""")
def q_config_nodes(spark, sf_dir):
    from stagecraft.plans.specs import spec_tables
    saved = _config_rows(spark, sf_dir)
    return spec_tables(_encoded(saved, 5), "o_orderkey", "CONFIG")[0]


def _encoded(saved, times: int):
    """CONFIG as a store keeps it that encodes what it is given again."""
    for _ in range(times):
        saved = saved.withColumn("CONFIG", F.to_json(F.array("CONFIG"))).withColumn(
            "CONFIG", F.expr("substring(CONFIG, 2, length(CONFIG) - 2)"))
    return saved


# A label that makes the config of the dearest orders longer than 1 MiB.
_LONG_LABEL = 1_200_000


def _graph_configs(spark, sf_dir):
    """Configs of two nodes and one edge or two, encoded three times."""
    o = load(spark, sf_dir, "orders")
    top = o.agg(F.max("o_totalprice").alias("m"))
    o = o.join(top, o.o_totalprice == top.m, "left")
    label = F.when(F.col("m").isNotNull(), F.repeat(F.lit("long "), _LONG_LABEL // 5)).otherwise(F.col("o_orderpriority"))
    more = F.when(F.col("o_orderstatus") == "F", ', {"source": "n2", "target": "n3"}').otherwise("")
    cfg = F.concat(F.lit('{"nodes": [{"id": "n1", "type": "stage", "label": "'), label,
                   F.lit('"}, {"id": "n2", "type": "table", "label": "Out", "config": {"name": "T \\"1\\""}}], "edges": [{"source": "n1", "target": "n2"}'),
                   more, F.lit("]}"))
    return _encoded(o.select("o_orderkey", cfg.alias("CONFIG")), 3)


@query("config_graph_nodes", f"""
SELECT o_orderkey AS graph_id, 0 AS pos, 'n1' AS id, 'stage' AS type, '' AS name,
       CASE WHEN o_totalprice = (SELECT max(o_totalprice) FROM orders) THEN {_LONG_LABEL} ELSE length(o_orderpriority) END::INT AS label_length FROM orders
UNION ALL SELECT o_orderkey, 1, 'n2', 'table', 'T "1"', 3 FROM orders
""")
def q_config_graph_nodes(spark, sf_dir):
    from stagecraft.plans.specs import spec_tables
    nodes = spec_tables(_graph_configs(spark, sf_dir), "o_orderkey", "CONFIG")[0]
    return nodes.select("graph_id", "pos", "id", "type", "name", F.length("label").alias("label_length"))


@query("config_edges", """
SELECT o_orderkey AS graph_id, 'n1' AS source, 'n2' AS target, 0 AS epos FROM orders
UNION ALL SELECT o_orderkey, 'n2', 'n3', 1 FROM orders WHERE o_orderstatus = 'F'
""")
def q_config_edges(spark, sf_dir):
    from stagecraft.plans.specs import spec_tables
    return spec_tables(_graph_configs(spark, sf_dir), "o_orderkey", "CONFIG")[1]


@query("not_null_check", """
SELECT 'segment' AS column_name, count(*) FILTER (WHERE nullif(c_mktsegment, 'AUTOMOBILE') IS NULL) AS failing_rows FROM customer
UNION ALL
SELECT 'nation', count(*) FILTER (WHERE nullif(c_nationkey, 0) IS NULL) FROM customer
UNION ALL
SELECT 'name', count(*) FILTER (WHERE c_name IS NULL) FROM customer
""")
def q_not_null_check(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.nullif("c_mktsegment", F.lit("AUTOMOBILE")).alias("segment"),
                                              F.nullif("c_nationkey", F.lit(0)).alias("nation"),
                                              F.col("c_name").alias("name"))
    return SK.violations(c, ["segment", "nation", "name"])


@query("add_column", "SELECT *, 0::INT AS c_rating FROM customer")
def q_add_column(spark, sf_dir):
    return SK.add_column(load(spark, sf_dir, "customer"), "c_rating", "INT", nullable=False, default=0)


@query("drop_column", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def q_drop_column(spark, sf_dir):
    return SK.drop_column(load(spark, sf_dir, "customer"), "c_acctbal")


@query("rename_column", "SELECT c_custkey, c_name AS customer_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_rename_column(spark, sf_dir):
    return SK.rename_column(load(spark, sf_dir, "customer"), "c_name", "customer_name")


from stagecraft.operators import versions as VS  # noqa: E402

CUSTOMER_COLUMNS = [("c_custkey", "BIGINT", False), ("c_name", "VARCHAR(40)"), ("c_nationkey", "INT"), ("c_acctbal", "DOUBLE"),
                    ("c_mktsegment", "TEXT", False)]


def _stored_customer(spark, sf_dir, tag: str) -> tuple[DataFrame, str]:
    """customer as a stored table: version 1 is empty, version 2 has its rows."""
    _, root = _scratch(spark, tag)
    VS.create_stored(spark, root, CUSTOMER_COLUMNS)
    c = load(spark, sf_dir, "customer")
    VS.write_stored(c, root)
    return c, root


@query("stored_add_column", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 7::INT AS c_rating, NULL::VARCHAR AS c_note FROM customer
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, c_nationkey::INT, 'again' FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def q_stored_add_column(spark, sf_dir):
    c, root = _stored_customer(spark, sf_dir, "a1")
    VS.add_stored_column(spark, root, "c_rating", "INT", nullable=False, default=7)
    VS.add_stored_column(spark, root, "c_note", "TEXT")
    VS.write_stored(c.filter("c_mktsegment = 'BUILDING'").withColumns({"c_rating": F.col("c_nationkey"), "C_NOTE": F.lit("again")}), root)
    return VS.read_stored(spark, root)


@query("stored_drop_column", """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment, NULL::VARCHAR AS c_acctbal FROM customer
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_mktsegment, 'new' FROM customer WHERE c_acctbal < 0
""")
def q_stored_drop_column(spark, sf_dir):
    c, root = _stored_customer(spark, sf_dir, "a2")
    VS.drop_stored_column(spark, root, "c_acctbal")
    VS.add_stored_column(spark, root, "c_acctbal", "TEXT")     # the dropped values do not come back
    VS.write_stored(c.filter("c_acctbal < 0").withColumn("c_acctbal", F.lit("new")), root)
    return VS.read_stored(spark, root)


@query("stored_rename_column", """
SELECT c_custkey, c_name AS customer_name, c_nationkey, c_acctbal, c_mktsegment, 'now' AS version FROM customer
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 'before' FROM customer
""")
def q_stored_rename_column(spark, sf_dir):
    _, root = _stored_customer(spark, sf_dir, "a3")
    VS.rename_stored_column(spark, root, "c_name", "customer_name")
    now, before = VS.read_stored(spark, root), VS.read_stored(spark, root, version=2)
    return now.withColumn("version", F.lit("now")).unionAll(before.withColumn("version", F.lit("before")))


@query("stored_not_null", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, true AS refused FROM customer
""")
def q_stored_not_null(spark, sf_dir):
    """A write with nulls in a NOT NULL column fails as a whole; the version before stays."""
    c, root = _stored_customer(spark, sf_dir, "k1")
    bad = c.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("AUTOMOBILE")))
    refused = False
    try:
        VS.write_stored(bad, root)
    except Exception as e:  # noqa: BLE001 - what the write's job raises
        refused = "NOT NULL" in str(e)
    return VS.read_stored(spark, root).withColumn("refused", F.lit(refused))


@query("append_new_stored", f"{_DOC_ROWS_SQL}")
def q_append_new_stored(spark, sf_dir):
    """English documents, then all, then all again: a key is appended once."""
    _, root = _scratch(spark, "k4s")
    VS.create_stored(spark, root, [("FILE_NAME", "TEXT", False), ("PROCESSED_DATA", "TEXT"), ("PROCESSED_AT", "TIMESTAMP")])
    rows = _doc_rows(spark, sf_dir).withColumn("PROCESSED_DATA", F.col("PROCESSED_DATA").cast("string"))
    for part in (rows.filter(F.col("PROCESSED_DATA") == "en"), rows, rows):
        VS.append_new_stored(part, root, "FILE_NAME")
    return VS.read_stored(spark, root)


# Text columns derived from events, and the type each is declared with.
TYPED = [("id", "NUMBER(12,0)", False), ("amount", "DECIMAL(10,2)"), ("big", "BIGINT"), ("small", "SMALLINT"), ("tiny", "TINYINT"),
         ("whole", "INTEGER"), ("ratio", "FLOAT"), ("flag", "BOOLEAN"), ("day", "DATE"), ("clock", "TIME"), ("at", "TIMESTAMP"),
         ("at_tz", "TIMESTAMP_TZ"), ("doc", "VARIANT"), ("obj", "OBJECT"), ("list", "ARRAY"), ("name", "VARCHAR(20)"), ("code", "CHARACTER"),
         ("raw", "VARBINARY")]


@query("declared_types", """
SELECT event_id::DECIMAL(12,0) AS id, value::DECIMAL(10,2) AS amount, event_id::BIGINT AS big, (user_id % 1000)::SMALLINT AS small,
       (user_id % 100)::TINYINT AS tiny, user_id::INTEGER AS whole, value::DOUBLE AS ratio, event_type = 'click' AS flag, ts::DATE AS day,
       strftime(ts, '%H:%M:%S') AS clock, date_trunc('second', ts) AS at, date_trunc('second', ts) - INTERVAL 2 HOUR AS at_utc, '+02:00' AS at_zone,
       '{"k":' || (user_id % 7)::VARCHAR || '}' AS doc, '{"a":1,"u":' || user_id::VARCHAR || '}' AS obj, '[' || user_id::VARCHAR || ',"x"]' AS list,
       event_type AS name, event_type AS code, hex(event_type) AS raw
FROM events
""")
def q_declared_types(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    second = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    user = F.col("user_id").cast("string")
    text = e.select(F.col("event_id").cast("string").alias("id"), F.col("value").cast("string").alias("amount"),
                    F.concat(F.lit(" "), F.col("event_id").cast("string")).alias("big"), (F.col("user_id") % 1000).cast("string").alias("small"),
                    (F.col("user_id") % 100).cast("string").alias("tiny"), user.alias("whole"), F.col("value").cast("string").alias("ratio"),
                    F.when(F.col("event_type") == "click", "true").otherwise("false").alias("flag"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
                    F.date_format("ts", "HH:mm:ss").alias("clock"), second.alias("at"), F.concat(second, F.lit("+02:00")).alias("at_tz"),
                    F.concat(F.lit('{"k": '), (F.col("user_id") % 7).cast("string"), F.lit("}")).alias("doc"),
                    F.concat(F.lit('{"u": '), user, F.lit(', "a": 1}')).alias("obj"), F.concat(F.lit("["), user, F.lit(', "x"]')).alias("list"),
                    F.col("event_type").alias("name"), F.col("event_type").alias("code"), F.col("event_type").alias("raw"))
    _, root = _scratch(spark, "types")
    VS.create_stored(spark, root, TYPED)
    VS.write_stored(text, root)
    out = VS.read_stored(spark, root)
    return out.select("id", "amount", "big", "small", "tiny", "whole", "ratio", "flag", "day", "clock", "at",
                      (F.expr("TIMESTAMP_NTZ'1970-01-01'") + F.make_dt_interval(secs=F.unix_seconds("at_tz.ts").cast("decimal(18,6)"))).alias("at_utc"), F.col("at_tz.tz").alias("at_zone"), F.to_json("doc").alias("doc"),
                      F.to_json(F.map_from_entries(F.array_sort(F.map_entries("obj"), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))).alias("obj"),
                      F.to_json("list").alias("list"), "name", "code", F.hex("raw").alias("raw"))


# ---------------------------------------------------------------------------
# ST1-ST8: change tracking, stage streams, schedules
# ---------------------------------------------------------------------------
from stagecraft.streaming import changes as CH  # noqa: E402
from stagecraft.streaming import live as LV  # noqa: E402

_DIFF = " OR ".join(f"b.{c} IS DISTINCT FROM a.{c}" for c in FX.SNAP_COLS[1:])


@query("changes_standard", f"""
WITH {FX.SNAPSHOT_SQL.strip()}
SELECT b.*, 'DELETE' AS action, a.o_orderkey IS NOT NULL AS is_update
FROM before b LEFT JOIN after a ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR {_DIFF}
UNION ALL
SELECT a.*, 'INSERT' AS action, b.o_orderkey IS NOT NULL AS is_update
FROM after a LEFT JOIN before b ON a.o_orderkey = b.o_orderkey
WHERE b.o_orderkey IS NULL OR {_DIFF}
""")
def q_changes_standard(spark, sf_dir):
    before, after = FX.snapshots(spark, sf_dir)
    return CH.changes(before, after, "o_orderkey")


COMPACT_SQL = f"""
WITH {FX.CHANGE_LOG_SQL.strip()},
g AS (SELECT user_id, arg_min(op, seq) AS first_op, arg_max(op, seq) AS last_op, count(*) AS n_ops,
             arg_max(value, seq) AS value, arg_max(props, seq) AS props FROM change_log GROUP BY user_id),
a AS (SELECT *, CASE WHEN first_op = 'INSERT' AND last_op = 'DELETE' THEN NULL WHEN first_op = 'INSERT' THEN 'INSERT'
                     WHEN last_op = 'DELETE' THEN 'DELETE' ELSE 'UPDATE' END AS action FROM g)
SELECT user_id, action, n_ops, value, props FROM a WHERE action IS NOT NULL
"""


@query("changes_compact", COMPACT_SQL)
def q_changes_compact(spark, sf_dir):
    return CH.compact_log(FX.change_log(spark, sf_dir), "user_id", "seq")


@query("changes_append_only", f"""
WITH {FX.SNAPSHOT_SQL.strip()}
SELECT a.*, 'INSERT' AS action FROM after a WHERE a.o_orderkey NOT IN (SELECT o_orderkey FROM before)
""")
def q_changes_append_only(spark, sf_dir):
    before, after = FX.snapshots(spark, sf_dir)
    return CH.append_only(before, after, "o_orderkey")


def _file_digest(batch):
    return PT.md5_of_parts(batch, "FILE_NAME")


_LISTING_SQL = f"""
SELECT replace(filename, '{ORACLE_DIR}/', '') AS FILE_NAME, size::BIGINT AS size, md5(content) AS md5
FROM read_blob('{ORACLE_DIR}/*.parquet')"""


@query("stage_stream", _LISTING_SQL)
def q_stage_stream(spark, sf_dir):
    name, loc = _scratch(spark, "st4")
    q = LV.consume(LV.stage_stream(spark, sf_dir, glob="*.parquet", part_bytes=PT.PART_BYTES), loc + "/out", loc + "/ckpt", _file_digest)
    q.awaitTermination()
    return spark.read.parquet(loc + "/out").select("FILE_NAME", "size", "md5")


@query("consume_once", _LISTING_SQL)
def q_consume_once(spark, sf_dir):
    name, loc = _scratch(spark, "st5")
    for _ in range(2):   # a second run of the task finds nothing new: no repeats
        q = LV.consume(LV.stage_stream(spark, sf_dir, glob="*.parquet", part_bytes=PT.PART_BYTES), loc + "/out", loc + "/ckpt", _file_digest)
        q.awaitTermination()
    return spark.read.parquet(loc + "/out").select("FILE_NAME", "size", "md5")


@query("scheduled_runs", """
SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS run_start, time_bucket(INTERVAL 60 MINUTE, ts) + INTERVAL 60 MINUTE AS run_end,
       count(*) AS rows FROM events GROUP BY 1, 2
""")
def q_scheduled_runs(spark, sf_dir):
    return LV.scheduled_runs(load(spark, sf_dir, "events"), "ts", "60 minutes")




# Three deliveries of events, by their time.
DELIVERIES = ("ts < TIMESTAMP '2024-01-11'", "ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21'", "ts >= TIMESTAMP '2024-01-21'")


def _deliver(spark, tag: str, deliveries: list[DataFrame], stream, output_mode: str = "append") -> str:
    """Puts each delivery into a stage folder and runs the task over what is new;
    returns the task's output folder."""
    _, loc = _scratch(spark, tag)
    for rows in deliveries:
        rows.write.mode("append").parquet(loc + "/in")
        LV.consume(stream(LV.table_stream(spark, loc + "/in", rows.schema)), loc + "/out", loc + "/ckpt", output_mode=output_mode).awaitTermination()
    return loc + "/out"


@query("live_changes", COMPACT_SQL)
def q_live_changes(spark, sf_dir):
    """Three deliveries of the log; the second and third bring all earlier rows again."""
    log = FX.change_log(spark, sf_dir, "ts").filter(F.col("seq").isNotNull())
    first, second, third = (log.filter(d) for d in DELIVERIES)
    out = _deliver(spark, "st2", [first, second.unionByName(first), third.unionByName(second).unionByName(first)],
                   lambda s: LV.net_changes(s, "user_id", "seq", "ts", "40 days"), "update")
    return LV.current(spark, out, "user_id")


@query("live_inserts", "SELECT event_id, ts, user_id, event_type, 'INSERT' AS action FROM events")
def q_live_inserts(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    first, second, third = (e.filter(d) for d in DELIVERIES)
    out = _deliver(spark, "st3", [first, second.unionByName(first), third.unionByName(second)],
                   lambda s: LV.inserted_rows(s, "event_id", "ts", "40 days"))
    return spark.read.parquet(out).select("event_id", "ts", "user_id", "event_type", "action")


@query("scheduled_runs_live", """
SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS run_start, time_bucket(INTERVAL 60 MINUTE, ts) + INTERVAL 60 MINUTE AS run_end,
       count(*) AS rows FROM events GROUP BY 1, 2
""")
def q_scheduled_runs_live(spark, sf_dir):
    """Hourly runs in append mode, each once its hour is behind the watermark.  The
    second delivery brings the first's clicks of the days before its last again:
    they are behind the watermark by then, so late, and are dropped.  A closing row
    ends the last hours."""
    e = load(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    first, second, third = (e.filter(d) for d in DELIVERIES)
    late = first.filter("event_type = 'click' AND ts < TIMESTAMP '2024-01-10'")
    out = _deliver(spark, "st6", [first, second.unionByName(late), third, LV.closing_row(e, "ts", "1 DAY")],
                   lambda s: LV.scheduled_runs(s, "ts", "60 minutes", watermark="1 hour"))
    return spark.read.parquet(out).select(F.col("run_start").cast("timestamp_ntz").alias("run_start"),
                                          F.col("run_end").cast("timestamp_ntz").alias("run_end"), "rows")


def _mixed_stage(spark, sf_dir, tag: str, statuses=("F", "O", "P"), loc: str | None = None) -> tuple[str, DataFrame]:
    """orders as a stage of Parquet (F), CSV (O) and JSON (P) files in nested folders."""
    loc = loc or _scratch(spark, tag)[1]
    o = load(spark, sf_dir, "orders")
    for status in statuses:
        rows = o.filter(F.col("o_orderstatus") == status)
        w = rows.write.mode("append")
        if status == "F":
            w.parquet(f"{loc}/in/a")
        elif status == "O":
            w.option("header", "true").csv(f"{loc}/in/b/c")
        else:
            w.json(f"{loc}/in/b")
    return loc, o


@query("stage_read_mixed", "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def q_stage_read_mixed(spark, sf_dir):
    loc, o = _mixed_stage(spark, sf_dir, "s3")
    return SG.stage_read(spark, loc + "/in", "auto", schema=o.schema)


@query("stage_rows", "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def q_stage_rows(spark, sf_dir):
    loc, o = _mixed_stage(spark, sf_dir, "st4r")
    LV.consume(LV.stage_rows(spark, loc + "/in", o.schema, 2), loc + "/out", loc + "/ckpt").awaitTermination()
    return spark.read.parquet(loc + "/out").select(*o.columns)


@query("consume_rows_once", "SELECT o_orderstatus, count(*) AS orders, sum(o_totalprice)::DECIMAL(20,2)::DOUBLE AS price FROM orders "
                            "WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY o_orderstatus")
def q_consume_rows_once(spark, sf_dir):
    """New files of each format between runs of the task, and runs without any."""
    _, loc = _scratch(spark, "st5r")
    o = load(spark, sf_dir, "orders")
    for status in ("F", "O", "P", None):
        if status:
            _mixed_stage(spark, sf_dir, "st5r", (status,), loc)
        LV.consume(LV.stage_rows(spark, loc + "/in", o.schema), loc + "/out", loc + "/ckpt").awaitTermination()
    out = spark.read.parquet(loc + "/out")
    return out.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("price"))


def _schedule_text():
    et = F.col("event_type")
    return (F.when(et == "view", F.concat(F.floor("value").cast("bigint").cast("string"), F.lit(" MINUTE")))
             .when(et == "click", F.lit("60 minutes"))
             .when(et == "purchase", F.lit("USING CRON 0 9 * * * UTC"))
             .when(et == "signup", F.lit(""))
             .otherwise(F.lit("x MINUTE")))


@query("schedule_parse", """
SELECT event_id, schedule,
       CASE WHEN s = '' THEN 60 WHEN regexp_matches(s, '(?i)^([0-9]+)[ \\t]*MINUTES?$')
            THEN regexp_extract(s, '(?i)^([0-9]+)[ \\t]*MINUTES?$', 1)::INT END AS minutes,
       nullif(regexp_extract(s, '(?i)^USING[ \\t]+CRON[ \\t]+(.+)$', 1), '') AS cron
FROM (SELECT event_id, schedule, trim(coalesce(schedule, '')) AS s FROM (
  SELECT event_id, CASE event_type WHEN 'view' THEN floor(value)::BIGINT || ' MINUTE' WHEN 'click' THEN '60 minutes'
                   WHEN 'purchase' THEN 'USING CRON 0 9 * * * UTC' WHEN 'signup' THEN '' ELSE 'x MINUTE' END AS schedule
  FROM events) a) b
""")
def q_schedule_parse(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", _schedule_text().alias("schedule"))
    p = LV.parse_schedule("schedule")
    return e.select("event_id", "schedule", p["minutes"].alias("minutes"), p["cron"].alias("cron"))


@query("stale_streams", f"""
SELECT user_id, max(ts) AS last_ts, max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY AS stale,
       CASE WHEN max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY THEN 'Stale' ELSE 'Fresh' END AS state
FROM events GROUP BY user_id
""")
def q_stale_streams(spark, sf_dir):
    return CH.stale(load(spark, sf_dir, "events"), "user_id", "ts", AS_OF, "3 days")


# ---------------------------------------------------------------------------
# User functions
# ---------------------------------------------------------------------------
from stagecraft.functions import procedures as PR  # noqa: E402


@query("sql_function", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net_price FROM lineitem
""")
def q_sql_function(spark, sf_dir):
    PR.define_sql_function(spark, "net_price", [("price", "DOUBLE"), ("discount", "DOUBLE")], "DOUBLE",
                           "price * (1 - discount)")
    return load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber",
                                                      "net_price(l_extendedprice, l_discount) AS net_price")


@query("sql_table_function", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def q_sql_table_function(spark, sf_dir):
    TB.register_views(spark, sf_dir, ["orders"])
    PR.define_table_function(spark, "orders_of", [("status", "VARCHAR")],
                             [("o_orderkey", "BIGINT"), ("o_totalprice", "DOUBLE")],
                             "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = status")
    return spark.sql("SELECT * FROM orders_of('F')")


def _name_length(s):
    return s.str.len()


@query("python_udf", "SELECT p_partkey, length(p_name)::INT AS name_length FROM part")
def q_python_udf(spark, sf_dir):
    f = PR.define_python_udf(_name_length, "INT")
    return load(spark, sf_dir, "part").select("p_partkey", f("p_name").alias("name_length"))


class PackedRuns:
    """Table function: a user's events, in time order, packed into runs of at most
    ``BUDGET`` value; where the budget breaks depends on all events before."""

    BUDGET = 500.0

    def __init__(self):
        self.run, self.total = 1, 0.0

    def eval(self, rows):
        import pyarrow as pa
        runs, totals = [], []
        for value in rows.column("value").to_pylist():
            if self.total > 0 and self.total + value > self.BUDGET:
                self.run, self.total = self.run + 1, 0.0
            self.total += value
            runs.append(self.run)
            totals.append(self.total)
        yield pa.table({"user_id": rows.column("user_id"), "event_id": rows.column("event_id"),
                        "run": pa.array(runs, pa.int32()), "total": pa.array(totals, pa.float64())})


@query("python_table_function", """
WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(user_id, event_id, n, run, total) AS (
  SELECT user_id, event_id, n, 1, value FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.n, CASE WHEN r.total > 0 AND r.total + e.value > 500 THEN r.run + 1 ELSE r.run END,
         CASE WHEN r.total > 0 AND r.total + e.value > 500 THEN e.value ELSE r.total + e.value END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, run::INT AS run, round(total, 6) AS total FROM r
""")
def q_python_table_function(spark, sf_dir):
    PR.define_python_table_function(spark, "packed_runs", PackedRuns, [("user_id", "BIGINT"), ("event_id", "BIGINT"), ("run", "INT"), ("total", "DOUBLE")])
    TB.register_views(spark, sf_dir, ["events"])
    return spark.sql("SELECT user_id, event_id, run, round(total, 6) AS total FROM packed_runs(TABLE(events) PARTITION BY user_id ORDER BY (ts, event_id))")
