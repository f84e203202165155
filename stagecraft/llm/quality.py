"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, runs of white space to one space) and hashed.
Per host, the distinct documents that hold a line are counted (first by text, so
that a copied text or a common line is no hot key).  Lines in more than
``MIN_DOCS`` documents and more than ``SHARE`` of the host's documents are removed;
a document that loses more than ``MAX_LOST`` percent of its words is depleted and
rejected, next to the rules on one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecraft.llm import common as C

MIN_DOCS, SHARE, MAX_LOST = 20, 0.01, 70
MIN_WORDS, MAX_REPEATED = 50, 50
GAP = r"[ \x09-\x0D]+"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the text."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = _once(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3),
                                                lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))

    def starts(g):
        """Sorted starts of repeated windows."""
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return _once(placed, lambda s: F.sort_array(F.transform(F.filter(
            F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]), x["i"])),
            lambda i: i.isNotNull()), lambda i: F.coalesce(i, F.lit(0)))))

    def covered(g):
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(
            F.aggregate(starts(g), start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"]))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_once(grams, covered))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), GAP, " ")))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_common_words (words on removed lines), base_failed, kept.

    Null and empty texts have no words and fail; a null host is a host of its
    own; rows that repeat an id and its text are one document and get the same
    result; each row without id is a document."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), text.alias("text"))
    rows = (rows.withColumn("words", F.filter(F.split("text", GAP), lambda w: w != ""))
            .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))))
    measured = rows.select(
        "doc_id", "host", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(_line_hash(x).alias("h"),
                                                F.size(F.filter(F.split(x, GAP), lambda w: w != "")).alias("w"))).alias("lines"))
    measured = C.save(measured, "quality")

    own = measured.select("doc_id", "host", "t1", "t2", "n_words", F.explode("lines").alias("x"))
    # Rows that repeat an id and its text are one document.
    same = ["doc_id", "host", "t1", "t2"]
    many = C.save(measured.groupBy(*same).agg(F.count(F.lit(1)).alias("same")).filter("same > 1"), "repeated")
    again = (many.filter(F.col("doc_id").isNotNull()).groupBy("host", "t1", "t2").agg(F.sum(F.col("same") - 1).alias("again"))
             .select(F.col("host").alias("host_"), F.col("t1").alias("t1_"), F.col("t2").alias("t2_"), "again"))

    def documents(rows: DataFrame) -> DataFrame:
        """``n`` of (host, t1, t2) without what repeats."""
        one = F.col("host").eqNullSafe(F.col("host_")) & (F.col("t1") == F.col("t1_")) & (F.col("t2") == F.col("t2_"))
        return rows.join(again, one, "left").withColumn("n", F.col("n") - F.coalesce("again", F.lit(0))).drop("host_", "t1_", "t2_", "again")

    # Copies are added up by (host, text) first, so neither a host nor a line is a hot key.
    held = documents(measured.select("host", "t1", "t2", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
                     .groupBy("host", "t1", "t2", "h").agg(F.count(F.lit(1)).alias("n")))
    hosts = documents(measured.groupBy("host", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))).groupBy("host").agg(F.sum("n").alias("docs"))
    often = held.groupBy("host", "h").agg(F.sum("n").alias("n")).filter(F.col("n") > MIN_DOCS)
    often = (often.withColumnRenamed("host", "host_").join(hosts, F.col("host_").eqNullSafe(F.col("host")))
             .filter(F.col("n") > SHARE * F.col("docs")).select("host_", F.col("h").alias("h_")))
    lost = (own.join(often, F.col("host").eqNullSafe(F.col("host_")) & (F.col("x.h") == F.col("h_")))
            .select("host", "t1", "t2", "doc_id", "x.w")
            .groupBy("doc_id", "host", "t1", "t2").agg(F.sum("w").alias("sum"), F.count(F.lit(1)).alias("k")))
    # Rows that repeat are summed together above: take each row's share.
    lost = lost.alias("l").join(many.alias("m"), F.expr("l.doc_id <=> m.doc_id and l.host <=> m.host and l.t1 = m.t1 and l.t2 = m.t2"), "left") \
        .select("l.doc_id", "l.host", "l.t1", "l.t2", F.floor(F.col("l.sum") / F.coalesce("m.same", F.lit(1))).cast("long").alias("common"))
    out = measured.drop("lines").alias("a").join(lost.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.host <=> b.host and a.t1 = b.t1 and a.t2 = b.t2"), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return (out.select("a.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       F.coalesce("b.common", F.lit(0).cast("long")).alias("n_common_words"), failed.alias("base_failed"))
            .withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_common_words") <= MAX_LOST * F.col("n_words"))))


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
ln AS (SELECT doc_id, source, text, x, regexp_replace(lower(x), '[ \\x09-\\x0D]+', ' ', 'g') AS norm,
              len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS k
       FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x FROM d) u),
li AS (SELECT doc_id, source, text, x, trim(norm, ' ') AS norm, k FROM ln WHERE k > 0),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
often AS (SELECT li.source, norm FROM li JOIN hosts ON li.source IS NOT DISTINCT FROM hosts.source
          GROUP BY li.source, norm, docs HAVING count(DISTINCT doc_id) > {MIN_DOCS} AND count(DISTINCT doc_id) > {SHARE} * docs),
lost AS (SELECT doc_id, sum(k) AS common FROM li JOIN often ON li.source IS NOT DISTINCT FROM often.source AND li.norm = often.norm GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM li GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
gr AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM g),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM gr),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) t(k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.common, 0)::BIGINT AS n_common_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * n_common_words <= {MAX_LOST} * n_words AS kept
FROM m
"""
