"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Text is folded first: lower case, homoglyphs and digit substitutions to plain
letters, everything between words to one space.  A lexicon term is a word start
(or a whole short word) with a weight, the log odds of toxic against clean
training documents; at a word the longest term counts.  A match inside an
exception phrase does not count.  The sum of the weights, plain and per hundred
words, goes through a logistic curve to a score from 0 to 1.

Terms, weights and curve are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.llm import common as C

#: Labelled rows to learn from, at most about this many (chosen by a hash of the id).
SAMPLE = 20_000
#: Toxic documents that a term must stand in, and its least weight.
MIN_DOCS, MIN_WEIGHT = 5, 1.0
PREFIXES = range(4, 9)
#: Folded phrases in which a match does not count.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown fish", "clown fish", "idiot proof")

# Look-alike characters and digit substitutions, and what they fold to.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
}
FOLD = str.maketrans(LOOKALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | dict.fromkeys("​‌‍­", ""))
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower().translate(FOLD)) if text else []


def terms_of(word: str):
    """Lexicon terms that match the word: word starts, and the word itself if short."""
    for k in PREFIXES:
        if k > len(word):
            break
        yield " " + word[:k]
    if len(word) < PREFIXES[0]:
        yield f" {word} "


def _doc_terms(text) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(words_of(text)).items():
        for t in terms_of(w):
            out[t] += n
    return out


def automaton(lexicon: dict[str, float], exceptions=EXCEPTIONS):
    a = ahocorasick.Automaton()
    for term, weight in lexicon.items():
        a.add_word(term, (len(term), weight))
    for phrase in exceptions:
        a.add_word(f" {phrase} ", (len(phrase) + 2, None))
    a.make_automaton()
    return a


def raw_score(a, text) -> tuple[float, int]:
    """(sum of weights, words)."""
    words = words_of(text)
    if not words:
        return 0.0, 0
    hit: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, weight) in a.iter(f" {' '.join(words)} "):
        if weight is None:
            spared.append((end + 1 - n, end))
        else:
            hit[end + 1 - n] = weight  # later ends are longer terms
    if spared:
        hit = {s: w for s, w in hit.items() if not any(x <= s < y for x, y in spared)}
    return sum(hit.values()), len(words)


def features(raw, n) -> np.ndarray:
    raw, n = np.asarray(raw, float), np.asarray(n, float)
    return np.stack([np.ones_like(raw), np.log1p(raw), np.log1p(100 * raw / (n + 20))], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    penalty = ridge * len(y) / 100 * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) + 1e-6 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> dict:
    """{"lexicon": {term: weight}, "curve": coefficients} from the labelled rows
    for which the column ``train(id)`` holds.  The sample is bounded by ``sample``;
    without toxic and clean rows the lexicon is empty and every score 0."""
    spark = docs.sparkSession
    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{label_col}`").cast("int").alias("y"))
    own = own.filter(F.col("doc").isNotNull() & F.col("y").isNotNull() & train(F.col("doc"))).groupBy("doc").agg(F.max("y").alias("y"))
    total = own.count()
    bits = 1 << 30
    chosen = own.filter(F.pmod(F.xxhash64("doc"), F.lit(bits)) < int(bits * min(1.0, 0.95 * sample / max(total, 1))))
    rows = C.save(C.keyed(docs, id_col, text_col).join(F.broadcast(chosen), "doc")
                  .select("doc", "y", "text", (F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(4)) > 0).alias("first")), "toxic-sample")
    first = rows.filter("first")
    size = {r.y: r.n for r in first.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = {"lexicon": {}, "curve": [-30.0, 0.0, 0.0]}
    if not size.get(1) or not size.get(0):
        return empty

    def present(batches):
        """(term, toxic documents, clean documents) that have it, added up per batch."""
        for batch in batches:
            n: dict[str, list[int]] = {}
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                for t in _doc_terms(text):
                    n.setdefault(t, [0, 0])[y == 1] += 1
            counts = np.array(list(n.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(counts[:, 1]), pa.array(counts[:, 0])],
                                             names=["term", "toxic", "clean"])

    # The sample bounds the terms: those of MIN_DOCS toxic documents of it.
    terms = (first.select("y", "text").mapInArrow(C.released(present), "term string, toxic long, clean long")
             .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= MIN_DOCS))
    weight = {r.term: math.log((r.toxic + 0.5) / (size[1] + 1)) - math.log((r.clean + 0.5) / (size[0] + 1)) for r in terms.collect()}
    lexicon = {t: w for t, w in sorted(weight.items()) if w >= MIN_WEIGHT}
    raw = rows.filter(~F.col("first")).select("y", _raw(spark, lexicon)("text").alias("r")).select("y", "r.*").toPandas()
    if raw["y"].nunique() < 2:
        raw = rows.select("y", _raw(spark, lexicon)("text").alias("r")).select("y", "r.*").toPandas()
    curve = _fit(features(raw["raw"], raw["n"]), raw["y"].to_numpy(float))
    return {"lexicon": lexicon, "curve": [float(x) for x in curve]}


def _raw(spark, lexicon: dict[str, float]):
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("raw double, n long")
    def raw(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = automaton(shared.value)
        for text in parts:
            yield pd.DataFrame([raw_score(terms, t) for t in text], columns=["raw", "n"])
        C.forget()

    return raw


def score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "toxic_score") -> DataFrame:
    """``docs`` and a column ``name`` (0 to 1), which must not be there yet.  Null and
    empty texts have no match and get the curve's value there."""
    b = model["curve"]
    r, = C.fresh(docs, "raw")
    raw, n = F.col(f"{r}.raw"), F.col(f"{r}.n")
    z = F.lit(b[0]) + b[1] * F.log1p(raw) + b[2] * F.log1p(100 * raw / (n + 20))
    found = docs.withColumn(r, _raw(docs.sparkSession, model["lexicon"])(F.col(text_col)))
    return found.withColumn(name, 1 / (1 + F.exp(-z))).drop(r)


def crc_fold(column, folds: int):
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id mod 5 is 0), score, predicted.
    Learns from the other rows of ``labels`` only."""
    model = learn(docs, labels, lambda c: crc_fold(c, 5) != 0, id_col, text_col)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = score(base, model)
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"),
                      F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score at or above ``threshold``."""
    model = learn(docs, labels, lambda c: crc_fold(c, 5) != 0)
    name, = C.fresh(docs, "toxic_score")
    return score(docs, model, name=name).filter(F.col(name) < threshold).select(*docs.columns)
