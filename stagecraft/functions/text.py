"""Text functions X1-X10 as DataFrame plans.

The reference hands its five text functions to a remote service; their meaning
here is fixed (SURVEY 2.14) and deterministic, so every result can be checked
in SQL.  Shared building blocks:

* ``tokens``: lower case, split on runs of characters that are neither letters
  nor digits, blanks removed.
* ``sentences``: split on runs of ``.``, ``!``, ``?`` or newline, trimmed,
  blanks removed, position kept from the split (0-based).
* ``idf(t) = ln((1 + N) / (1 + df(t))) + 1``.

Plan shape at scale: documents are rows, so tokenising is a per-row
``explode`` with no shuffle.  The ``_outer`` generators are used on purpose:
for a plain ``explode`` the optimizer infers a ``size(array) > 0`` filter and
evaluates the whole split/regex expression twice per row.  Corpus statistics (document frequency, N) are
combinable aggregates: Spark pre-aggregates them per partition before the
shuffle, so a token found in every document costs one row per partition, not
one per document.  Totals such as N are scalar subqueries (computed once,
inlined as a literal) rather than cross joins.  Small configuration tables
(questions, seeds) are built from the call's arguments, so their size is known
when the plan is built and they are broadcast.  Tables derived from data
(lexicons, models) are joined without hints: AQE turns the join into a
broadcast only when the runtime size is under the threshold, and splits skewed
partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagecraft.session import materialize

# ---------------------------------------------------------------------------
# Fixed values (must match the SQL oracle exactly)
# ---------------------------------------------------------------------------
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
SENTENCE_SPLIT = r"[.!?\n]+"
WHITESPACE = r"[ \t\r\n\f]+"
# Elements removed with their content before parsing a page.
DROPPED_ELEMENTS = ("script", "style", "nav", "title")
# Opening tags that start a block, and the kind each block gets.
BLOCK_KINDS = {
    "h1": "heading", "h2": "heading", "h3": "heading",
    "h4": "heading", "h5": "heading", "h6": "heading",
    "p": "paragraph", "li": "item", "pre": "code",
    "blockquote": "quote", "tr": "row",
}
BLOCK_TAG = r"(?i)<(h[1-6]|p|li|pre|blockquote|tr)([ \t\r\n\f][^>]*)?>"
# HTML entities decoded after tags are removed; &amp; goes last.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"),
    ("&amp;", "&"),
]
MARK_START = "\u0001"
MARK_END = "\u0002"
SCORE_DIGITS = 9      # rounding of scores before ranking
OUT_DIGITS = 6        # rounding of scores on output


# ---------------------------------------------------------------------------
# Shared column functions
# ---------------------------------------------------------------------------
def tokens(text: Column | str) -> Column:
    """ARRAY<STRING> of lower-case word tokens."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda x: x != F.lit(""))


def sentence_array(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.split(c, SENTENCE_SPLIT)


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, sentence): one row per non-blank sentence, no shuffle."""
    return (df.select(F.col(id_col), F.posexplode_outer(sentence_array(text_col)).alias("pos", "raw"))
              .select(id_col, "pos", F.trim("raw").alias("sentence"))
              .filter(F.col("sentence") != ""))


def token_rows(df: DataFrame, id_col: str, text_col: str, distinct: bool = False) -> DataFrame:
    """(id, token): one row per token occurrence (or per distinct token of a row)."""
    arr = tokens(text_col)
    if distinct:
        arr = F.array_distinct(arr)
    return df.select(F.col(id_col), F.explode_outer(arr).alias("token")).filter(F.col("token").isNotNull())


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def token_counts(arr: Column) -> Column:
    """ARRAY<STRUCT<token, tf>> of a row's tokens: sorted, then counted by the
    starts of their runs.  Row-local: no shuffle brings a row's tokens together."""
    def runs(s):
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return _once(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(s, i - 1).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).alias("tf"))))

    return F.when(F.size(arr) > 0, _once(F.sort_array(arr), runs)).otherwise(F.array().cast("array<struct<token:string,tf:int>>"))


def token_index(df: DataFrame, id_col: str, text_col: str, vocabulary: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """((id, token, tf), rows of ``df``): the inverted index of a corpus, written once.

    One scan tokenises; all who need counts, document frequencies or a document's
    tokens read the index.  Each token of a row is one index row; a row without
    tokens has one with a null token.  ``vocabulary`` (from a call's configuration)
    keeps only its tokens, before they become rows."""
    from pyspark.sql import Observation
    obs = Observation()
    arr = tokens(text_col)
    if vocabulary is not None:
        words = F.array(*[F.lit(t) for t in vocabulary]) if vocabulary else F.array().cast("array<string>")
        arr = F.filter(arr, lambda t: F.array_contains(words, t))
    seen = df.observe(obs, F.count(F.lit(1)).alias("n"))
    rows = materialize(seen.select(F.col(id_col), F.inline_outer(token_counts(arr))), "index")
    return rows, int(obs.get["n"])


def index_frequency(index: DataFrame, n_docs: int) -> DataFrame:
    """(token, df, idf) from ``token_index``."""
    return (index.filter(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
                 .withColumn("idf", F.log((F.lit(1) + F.lit(n_docs)) / (F.lit(1) + F.col("df"))) + F.lit(1.0)))


def document_frequency(df: DataFrame, id_col: str, text_col: str,
                       vocabulary: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """(token, df, idf) over the corpus ``df``.

    ``vocabulary`` restricts the work to the tokens that matter.  A Python
    list (built from a call's configuration, so its size is known) is
    intersected with each document's tokens BEFORE the explode, so only the
    matching tokens become rows; a DataFrame is applied as a broadcast semi
    join after the explode.
    """
    if isinstance(vocabulary, (list, tuple)):
        lit_vocab = F.array(*[F.lit(t) for t in vocabulary]) if vocabulary else F.array().cast("array<string>")
        rows = (df.select(F.col(id_col), F.explode_outer(F.array_intersect(tokens(text_col), lit_vocab)).alias("token"))
                  .filter(F.col("token").isNotNull()))
    else:
        rows = token_rows(df, id_col, text_col, distinct=True)
        if vocabulary is not None:
            rows = rows.join(vocabulary.select("token").distinct(), "token", "left_semi")
    n_docs = df.select(F.count(F.lit(1))).scalar()
    return (rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
                .withColumn("idf", F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + F.lit(1.0)))


def config_tokens(df: DataFrame, col: str) -> list[str]:
    """Distinct tokens of a small configuration table (questions, seeds),
    tokenised by the same Spark expression as the data.  The table is built
    from a call's arguments, so bringing its tokens to the driver is bounded
    by the configuration, not by the data."""
    return sorted({r[0] for r in df.select(F.explode(tokens(col))).distinct().collect()})


# ---------------------------------------------------------------------------
# Parse marked-up documents
# ---------------------------------------------------------------------------
def _strip_dropped(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in DROPPED_ELEMENTS:
        out = F.regexp_replace(out, rf"(?is)<{tag}[ \t\r\n\f>].*?</{tag}[ \t\r\n\f]*>", " ")
    return out


def _decode_entities(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def _squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITESPACE, " "))


def parse_text(html: Column | str) -> Column:
    """Plain text of a page: dropped elements removed, tags -> space,
    entities decoded, whitespace runs -> one space."""
    c = F.col(html) if isinstance(html, str) else html
    return _squash(_decode_entities(F.regexp_replace(_strip_dropped(c), r"<[^>]*>", " ")))


def _block_pieces(html: Column) -> Column:
    marked = F.regexp_replace(_strip_dropped(html), BLOCK_TAG, MARK_START + "$1" + MARK_END)
    return F.split(F.regexp_replace(marked, r"<[^>]*>", " "), MARK_START)


def _kind_of(tag: Column) -> Column:
    kinds = F.create_map(*[x for k, v in BLOCK_KINDS.items() for x in (F.lit(k), F.lit(v))])
    return kinds[F.lower(tag)]


def parse_blocks(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """X1 (LAYOUT): (id, pos, kind, text) blocks, one per opening block tag.

    Tags are not paired (pages carry unclosed ``<p><b>``): a block runs to the
    next block tag.  Text before the first block has kind ``text``.  Row-local:
    no shuffle.
    """
    pieces = df.select(F.col(id_col), F.posexplode_outer(_block_pieces(F.col(html_col))).alias("pos", "piece"))
    has_tag = F.instr("piece", MARK_END) > 0
    return (pieces.select(
                id_col, "pos",
                F.when(has_tag, _kind_of(F.substring_index("piece", MARK_END, 1))).otherwise(F.lit("text")).alias("kind"),
                _squash(_decode_entities(F.when(has_tag, F.substring_index("piece", MARK_END, -1))
                                         .otherwise(F.col("piece")))).alias("text"))
            .filter(F.col("text") != ""))


def layout_text(html: Column | str) -> Column:
    """X1 as one text value (the form a chained step reads): block texts in
    page order, one per line.  Row-local, no explode."""
    c = F.col(html) if isinstance(html, str) else html
    texts = F.transform(_block_pieces(c),
                        lambda p: _squash(_decode_entities(F.substring_index(p, MARK_END, -1))))
    return F.array_join(F.filter(texts, lambda t: t != F.lit("")), "\n")


PARSE_MODES = ("LAYOUT", "TEXT", "OCR")


def parse_document(df: DataFrame, id_col: str, html_col: str, mode: str = "LAYOUT") -> DataFrame:
    """X1/X2 entry point.  LAYOUT gives blocks; TEXT (and OCR, which has no
    images to read here) gives one plain-text row per document."""
    m = (mode or "LAYOUT").upper()
    if m not in PARSE_MODES:
        raise ValueError(f"unknown parse mode {mode!r}; expected one of {PARSE_MODES}")
    if m == "LAYOUT":
        return parse_blocks(df, id_col, html_col)
    return df.select(F.col(id_col), parse_text(html_col).alias("text"))


# ---------------------------------------------------------------------------
# extraction
# ---------------------------------------------------------------------------
# Question -> (pattern, group).  Patterns avoid look-around and
# \b so Java regex and RE2 (the oracle) agree.
EXTRACT_RULES = {
    "What is the e-mail address?": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0),
    "What is the IP address?": (r"(?:^|[^0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?:[^0-9]|$)", 1),
    "What is the card number?": (r"(?:^|[^0-9])([0-9]{13,16})(?:[^0-9]|$)", 1),
    "What is the token?": (r"\"([^\"\s]+)\"", 1),
    "Which licence applies?": (r"((?:MIT|Apache|GNU General Public|BSD|Mozilla Public) License(?:, [Vv]ersion [0-9.]*[0-9])?)", 1),
    "What is the title?": (r"^[ \t]*([^\n]*[^ \t\n])", 1),
    "What is the document ID?": (r"(?i)(?:document|doc)[ _-]?(?:id|no|number)[ \t]*[:#=][ \t]*([A-Za-z0-9_-]+)", 1),
}
# A rule can only match when the text holds this literal; the cheap substring
# test skips the regex scan on the other documents (same result).
EXTRACT_GUARDS = {
    "What is the e-mail address?": "@",
    "What is the token?": '"',
    "Which licence applies?": " License",
}
# The default question of an extract step.
DEFAULT_QUESTIONS = ["What is the document ID?"]


def split_questions(text: str | None, default: Sequence[str] = DEFAULT_QUESTIONS) -> list[str]:
    """Config form: one question per line, blanks dropped, trimmed, each once."""
    if not text:
        return list(default)
    out = list(dict.fromkeys(q.strip() for q in text.split("\n") if q.strip()))
    return out or list(default)


def extract(df: DataFrame, id_col: str, text_col: str, questions: Sequence[str],
            rules: dict | None = None) -> DataFrame:
    """(id, question, answer) for every question that has a rule and a match.

    One projection with one ``regexp_extract`` per rule, then a stack to rows:
    row-local, no shuffle.  Questions without a rule are answered by X4.
    """
    rules = EXTRACT_RULES if rules is None else rules
    known = [q for q in dict.fromkeys(questions) if q in rules]
    if not known:
        none = F.lit(None).cast("string")
        return df.select(F.col(id_col), none.alias("question"), none.alias("answer")).filter(F.lit(False))

    def answer(q):
        got = F.nullif(F.regexp_extract(F.col(text_col), rules[q][0], rules[q][1]), F.lit(""))
        guard = EXTRACT_GUARDS.get(q) if rules is EXTRACT_RULES else None
        return F.when(F.instr(F.col(text_col), guard) > 0, got) if guard else got

    pairs = F.array(*[F.struct(F.lit(q).alias("question"), answer(q).alias("answer")) for q in known])
    return (df.select(F.col(id_col), F.inline_outer(pairs))
              .filter(F.col("answer").isNotNull()))


def extract_map(text: Column | str, questions: Sequence[str], rules: dict | None = None) -> Column:
    """X3 as one value per row: JSON text of {question: answer} for the
    questions with a rule and a match (keys sorted), null when none matched.
    Row-local: no aggregation and no join."""
    rules = EXTRACT_RULES if rules is None else rules
    col = F.col(text) if isinstance(text, str) else text
    known = [q for q in dict.fromkeys(questions) if q in rules]
    if not known:
        return F.lit(None).cast("string")

    def answer(q):
        got = F.nullif(F.regexp_extract(col, rules[q][0], rules[q][1]), F.lit(""))
        guard = EXTRACT_GUARDS.get(q) if rules is EXTRACT_RULES else None
        return F.when(F.instr(col, guard) > 0, got) if guard else got

    entries = F.filter(F.array(*[F.struct(F.lit(q).alias("question"), answer(q).alias("answer")) for q in known]),
                       lambda e: e["answer"].isNotNull())
    return F.when(F.size(entries) > 0, F.to_json(F.map_from_entries(F.array_sort(entries))))


def answer_sentence(df: DataFrame, id_col: str, text_col: str, questions: Sequence[str],
                    idf: DataFrame | None = None) -> DataFrame:
    """(id, question, answer, score) -- the sentence with the largest sum of
    idf over the distinct question tokens it holds; ties -> earlier sentence;
    score 0 -> no row.

    Each sentence's tokens are intersected with the (config-sized) question
    vocabulary before the explode, so only matching tokens become rows.
    ``idf`` (token, idf) replaces the weights of ``df`` itself, e.g. for a batch
    of a stream, whose answers must not depend on the batch."""
    from pyspark.sql import Observation
    spark = df.sparkSession
    questions = list(dict.fromkeys(questions))
    q = spark.createDataFrame([(i, s) for i, s in enumerate(questions)], "q_ord int, question string")
    q_tokens = q.select("question", F.explode(F.array_distinct(tokens("question"))).alias("token"))
    vocab = config_tokens(q, "question")
    lit_vocab = F.array(*[F.lit(t) for t in vocab]) if vocab else F.array().cast("array<string>")
    # One scan: sentences that hold a question token, written with the row they are
    # of, give both the document frequencies and the scores.
    obs = Observation()
    seen = df.observe(obs, F.count(F.lit(1)).alias("n")).withColumn("__row", F.monotonically_increasing_id())
    sent = (seen.select("__row", F.col(id_col), F.posexplode_outer(sentence_array(text_col)).alias("pos", "raw"))
                .select("__row", id_col, "pos", F.trim("raw").alias("sentence")).filter(F.col("sentence") != ""))
    st = materialize(sent.select("__row", id_col, "pos", "sentence",
                                 F.explode_outer(F.array_intersect(tokens("sentence"), lit_vocab)).alias("token"))
                         .filter(F.col("token").isNotNull()), "x4_tokens")
    if idf is None:
        idf = index_frequency(st.select("__row", "token").distinct(), int(obs.get["n"]))
    # At most one row per question and token.  Written first, so the planner knows
    # its size and joins by its own threshold.
    weights = materialize(q_tokens.join(idf.select("token", "idf"), "token"), "x4")
    scored = (st.join(weights, "token")
                .groupBy(id_col, "pos", "question")
                .agg(F.sum("idf").alias("score"), F.any_value("sentence").alias("sentence")))
    best = (scored.groupBy(id_col, "question")
                  .agg(F.max_by(F.struct("sentence", "score"),
                                 F.struct(F.round("score", SCORE_DIGITS), -F.col("pos"))).alias("b")))
    return best.select(id_col, "question", F.col("b.sentence").alias("answer"),
                       F.round("b.score", OUT_DIGITS).alias("score"))


# ---------------------------------------------------------------------------
# Seeded classification
# ---------------------------------------------------------------------------
# The default categories of a classify step.
DEFAULT_CATEGORIES = ["invoice", "contract", "receipt"]


def classify(df: DataFrame, id_col: str, text_col: str, categories: Sequence[str],
             seeds: dict[str, Sequence[str]] | None = None, idf: DataFrame | None = None) -> DataFrame:
    """(id, category, score).  Score of a category = sum over its seed
    tokens of tf * idf; a category without seeds uses its own name's tokens;
    best category wins (ties -> earlier category); no evidence -> no row.
    ``idf`` as in ``answer_sentence``."""
    spark = df.sparkSession
    seeds = seeds or {}
    rows = []
    for i, c in enumerate(categories):
        words = seeds.get(c) or [c]
        for w in words:
            rows.append((i, c, w))
    cfg = spark.createDataFrame(rows, "c_ord int, category string, seed string")
    seed_tokens = cfg.select("c_ord", "category", F.explode(tokens("seed")).alias("token")).distinct()
    vocab = config_tokens(cfg, "seed")
    # One scan: only seed tokens become rows; they give both counts.
    tf, n_docs = token_index(df, id_col, text_col, vocab)
    tf = tf.filter(F.col("token").isNotNull())
    if idf is None:
        idf = index_frequency(tf, n_docs)
    # At most one row per category and seed token, written first as in X4.
    weights = materialize(seed_tokens.join(idf.select("token", "idf"), "token"), "x5")
    per_cat = (tf.join(weights, "token")
                 .groupBy(id_col, "c_ord", "category")
                 .agg(F.sum(F.col("tf") * F.col("idf")).alias("score")))
    best = (per_cat.groupBy(id_col)
                   .agg(F.max_by(F.struct("category", "score"),
                                 F.struct(F.round("score", SCORE_DIGITS), -F.col("c_ord"))).alias("b")))
    return best.select(id_col, F.col("b.category").alias("category"),
                       F.round("b.score", OUT_DIGITS).alias("score"))


# ---------------------------------------------------------------------------
# Trained classification (multinomial naive Bayes)
# ---------------------------------------------------------------------------
def fit_nb(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, index: DataFrame | None = None) -> DataFrame:
    """Multinomial naive Bayes with Laplace smoothing (McCallum & Nigam 1998).

    Returns the model as a table ``(token, lp0, lp1)`` of log P(token | class),
    plus the class priors in columns ``prior0, prior1`` (same on every row).
    Counting is a grouped aggregate on (token): pre-aggregated per partition,
    so frequent tokens do not skew the shuffle.  The counts are written, since
    the totals and the model's rows both read them.  ``index`` is the table of
    ``token_index`` over ``docs``; without it the labelled documents get their own.
    """
    lab = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y"))
    if index is None:
        index = token_index(docs.select(id_col, text_col).join(lab.select(id_col).distinct(), id_col, "left_semi"), id_col, text_col)[0]
    occ = index.filter(F.col("token").isNotNull()).join(lab, id_col)
    counts = materialize(occ.groupBy("token").agg(
        F.sum(F.when(F.col("y") == 0, F.col("tf")).otherwise(0)).alias("c0"),
        F.sum(F.when(F.col("y") == 1, F.col("tf")).otherwise(0)).alias("c1")), "x6_counts")
    # One scalar subquery for the three totals, one for the two class sizes.
    tot = counts.select(F.struct(F.count(F.lit(1)).alias("v"), F.sum("c0").alias("t0"),
                                 F.sum("c1").alias("t1"))).scalar()
    vocab, total0, total1 = tot.getField("v"), tot.getField("t0"), tot.getField("t1")
    cls = lab.select(F.struct(F.count_if(F.col("y") == 0).alias("n0"),
                              F.count_if(F.col("y") == 1).alias("n1"))).scalar()
    n0, n1 = cls.getField("n0"), cls.getField("n1")
    return counts.select(
        "token",
        F.log((F.col("c0") + 1) / (total0 + vocab)).alias("lp0"),
        F.log((F.col("c1") + 1) / (total1 + vocab)).alias("lp1"),
        F.log(n0 / (n0 + n1)).alias("prior0"),
        F.log(n1 / (n0 + n1)).alias("prior1"))


def predict_nb(docs: DataFrame, model: DataFrame, id_col: str, text_col: str, index: DataFrame | None = None) -> DataFrame:
    """(id, label, margin): margin = log P(1|d) - log P(0|d) up to a constant.

    The model is written first, so it is built once and the planner knows its
    size before the join: token rows stay in place when Spark's threshold lets
    it broadcast the model, else they are shuffled (AQE splits hot tokens).  Tokens
    outside the model are ignored; a document with no known token takes the
    larger prior (its index row without a token and the left join keep it).
    ``index`` as in ``fit_nb``, over all of ``docs``.
    """
    model = materialize(model, "x6")
    pri = model.select(F.struct(F.first("prior0").alias("p0"), F.first("prior1").alias("p1"))).scalar()
    p0, p1 = pri.getField("p0"), pri.getField("p1")
    if index is None:
        index = token_index(docs, id_col, text_col)[0]
    joined = index.join(model.select("token", "lp0", "lp1"), "token", "left")
    sums = joined.groupBy(id_col).agg(
        F.sum(F.coalesce(F.col("tf") * F.col("lp0"), F.lit(0.0))).alias("s0"),
        F.sum(F.coalesce(F.col("tf") * F.col("lp1"), F.lit(0.0))).alias("s1"))
    margin = (F.col("s1") + p1) - (F.col("s0") + p0)
    return sums.select(id_col, F.when(margin > 0, 1).otherwise(0).alias("label"),
                       F.round(margin, OUT_DIGITS).alias("margin"))


# ---------------------------------------------------------------------------
# summarize
# ---------------------------------------------------------------------------
def summarize(df: DataFrame, id_col: str, text_col: str, k: int = 3,
              prompt: str | None = None, keep_all: bool = False, unique: bool = False) -> DataFrame:
    """(id, summary).  SumBasic weights (Nenkova & Vanderwende 2005)
    without the update step: a sentence's weight is the mean, over its tokens,
    of the token's relative frequency in the document.  The ``k`` best
    sentences (ties -> earlier) are joined in document order.  With a prompt a
    sentence holding one of its tokens has its weight doubled.

    Plan: the raw documents are hash-partitioned by id ONCE (one exchange of
    the input size; none at all when the table is stored bucketed by id), texts
    of one id are brought together there, and the rest is row-local: words and
    sentences never become rows, so nothing but the texts is shuffled or sorted.
    Rows that share an id are one document: sentences at the same place share
    their words, and one of them stands for the place.
    ``keep_all`` keeps documents without any token (summary null) so a
    pipeline step needs no join back.  ``unique`` says that no two rows share an id:
    rows are spread by the same exchange, but no texts are sorted to be grouped.
    """
    hits = None
    if prompt:
        spark = df.sparkSession
        hits = config_tokens(spark.createDataFrame([(prompt,)], "p string"), "p")
    docs = df.select(F.col(id_col), F.col(text_col)).repartition(id_col)
    if unique:
        texts = F.array_compact(F.array(text_col))
    else:
        docs = docs.groupBy(id_col).agg(F.sort_array(F.collect_list(text_col)).alias("__texts"))
        texts = F.col("__texts")
    # explode_outer of one value: a filter on the summary must not compute it twice.
    out = docs.select(id_col, F.explode_outer(F.array(_summary(texts, k, hits))).alias("summary"))
    return out if keep_all else out.filter(F.col("summary").isNotNull())


def _runs(arr: Column, key) -> Column:
    """ARRAY<STRUCT<at, n>> of the runs of equal ``key`` in a sorted array; ``at`` from 1."""
    starts = F.filter(F.sequence(F.lit(1), F.size(arr)), lambda i: (i == 1) | (key(F.get(arr, i - 1)) != key(F.get(arr, i - 2))))
    runs = _once(starts, lambda at: F.transform(at, lambda i, j: F.struct(
        i.alias("at"), (F.coalesce(F.get(at, j + 1), F.size(arr) + 1) - i).alias("n"))))
    return F.when(F.size(arr) > 0, runs).otherwise(F.array().cast("array<struct<at:int,n:int>>"))


def _summary(texts: Column, k: int, hits: Sequence[str] | None) -> Column:
    """The summary of one document's texts, null without a token: its words are
    sorted to count them, and sorted back to their sentences with their counts."""
    def parts(text):
        split = F.transform(sentence_array(text), lambda s, i: F.struct(
            i.alias("pos"), F.trim(s).alias("sentence"), tokens(s).alias("words")))
        return F.filter(split, lambda s: F.size(s["words"]) > 0)

    def counted(words):      # (pos, tf, hit) of every word, by place
        def of(r):
            hit = F.get(words, r["at"] - 1)["word"].isin(list(hits)) if hits else F.lit(False)
            return F.transform(F.slice(words, r["at"], r["n"]), lambda w: F.struct(
                w["pos"].alias("pos"), r["n"].cast("bigint").alias("tf"), hit.cast("int").alias("hit")))
        return F.sort_array(F.flatten(F.transform(_runs(words, lambda w: w["word"]), of)))

    def ranked(words):
        def weigh(r):
            def of(own):
                tf = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, w: a + w["tf"])
                weight = tf / (r["n"].cast("bigint") * F.size(words).cast("bigint"))
                if hits is not None:
                    weight = weight * (F.lit(1) + F.exists(own, lambda w: w["hit"] == 1).cast("int"))
                return F.struct((-F.round(weight, SCORE_DIGITS)).alias("w"), F.get(own, F.lit(0))["pos"].alias("pos"))
            return _once(F.slice(words, r["at"], r["n"]), of)
        return F.slice(F.sort_array(F.transform(_runs(words, lambda w: w["pos"]), weigh)), 1, max(k, 0))

    def chosen(sents):
        words = F.flatten(F.transform(sents, lambda s: F.transform(
            s["words"], lambda w: F.struct(w.alias("word"), s["pos"].alias("pos")))))
        best = _once(_once(F.sort_array(words), counted), ranked)
        return F.transform(F.sort_array(F.transform(best, lambda b: b["pos"])), lambda p: F.get(
            F.filter(sents, lambda s: s["pos"] == p), F.lit(0))["sentence"])

    picked = _once(F.flatten(F.transform(texts, parts)), chosen)
    return _once(picked, lambda c: F.when(F.size(c) > 0, F.array_join(c, " ")))


# ---------------------------------------------------------------------------
# Sentiment with a lexicon
# ---------------------------------------------------------------------------
def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                  bad_col: str = "toxic", min_count: int = 5, min_weight: float = 2.0,
                  index: DataFrame | None = None) -> DataFrame:
    """(token, weight, weight_micro).  Document-presence log-odds of good
    against bad: ln((b+.5)/(nb-b+.5)) - ln((a+.5)/(na-a+.5)), where a of na bad
    and b of nb good documents hold the token.  Tokens in fewer than
    ``min_count`` labelled documents or with |weight| < ``min_weight`` are
    dropped.  ``weight_micro`` is the weight in BIGINT millionths, so document
    sums are exact.  ``index`` is the table of ``token_index`` over ``docs``."""
    lab = labels.select(F.col(id_col), F.col(bad_col).cast("int").alias("bad"))
    if index is None:
        pres = (docs.select(id_col, text_col).join(lab, id_col)
                    .select("bad", F.explode_outer(F.array_distinct(tokens(text_col))).alias("token"))
                    .filter(F.col("token").isNotNull()))
    else:
        pres = index.filter(F.col("token").isNotNull()).select(id_col, "token").join(lab, id_col)
    counts = pres.groupBy("token").agg(F.count_if(F.col("bad") == 1).alias("a"),
                                       F.count_if(F.col("bad") == 0).alias("b"))
    cls = lab.select(F.struct(F.count_if(F.col("bad") == 1).alias("na"),
                              F.count_if(F.col("bad") == 0).alias("nb"))).scalar()
    na, nb = cls.getField("na"), cls.getField("nb")
    w = (F.log((F.col("b") + 0.5) / (nb - F.col("b") + 0.5))
         - F.log((F.col("a") + 0.5) / (na - F.col("a") + 0.5)))
    out = (counts.filter(F.col("a") + F.col("b") >= min_count)
                 .withColumn("w", w)
                 .filter(F.abs("w") >= min_weight))
    return out.select("token", F.round("w", OUT_DIGITS).alias("weight"),
                      F.round(F.col("w") * 1_000_000).cast("bigint").alias("weight_micro"))


def sentiment(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(id, score_micro, sentiment).  Sum of lexicon weights (BIGINT
    micro-units) over the document's distinct tokens; > 0 positive, < 0
    negative, else neutral.  Every input row gets a result.  The lexicon is
    written first, so the planner knows its size before the join.  ``index`` as in
    ``learn_lexicon``."""
    occ = index.select(id_col, "token") if index is not None else \
        df.select(F.col(id_col), F.explode_outer(F.array_distinct(tokens(text_col))).alias("token"))
    joined = occ.join(materialize(lexicon.select("token", "weight_micro"), "x8"), "token", "left")
    sums = joined.groupBy(id_col).agg(F.sum(F.coalesce("weight_micro", F.lit(0))).cast("bigint").alias("score_micro"))
    return sums.select(id_col, "score_micro",
                       F.when(F.col("score_micro") > 0, "positive")
                        .when(F.col("score_micro") < 0, "negative")
                        .otherwise("neutral").alias("sentiment"))


def lexicon_from_pairs(spark: SparkSession, pairs: Sequence[tuple[str, float]]) -> DataFrame:
    """A user-supplied lexicon (word, weight) in the same form as X9's output."""
    return (spark.createDataFrame(list(pairs), "token string, weight double")
                 .select(F.lower("token").alias("token"), "weight",
                         F.round(F.col("weight") * 1_000_000).cast("bigint").alias("weight_micro")))
