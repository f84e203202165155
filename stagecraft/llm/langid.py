"""Language ID by rank-order profiles.

A document's n-grams (one to three letters, words padded by one space) are ranked
by frequency; its ``PROFILE`` most frequent ones are compared with each language's
profile.  The out-of-place distance adds up how far each n-gram's rank is from its
rank in the profile; a missing one counts ``PROFILE``.  The nearest language wins.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.llm import common as C
from stagecraft.llm.toxicity import crc_fold

PROFILE = 400
#: Training documents per language, at most about this many (chosen by a hash of the id).
SAMPLE = 4_000
_PIECE = 1 << 20
_SPACE = 32
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)]))
    return _letters[0]


def _grams(text: str) -> np.ndarray:
    """Sorted keys of all n-grams: three 21-bit code points, the last lowest."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.concatenate([[_SPACE], np.where(letters()[a], a, _SPACE), [_SPACE]]).astype(np.int64)
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != _SPACE) | (a[:-1] != _SPACE)
    a = a[keep]
    if len(a) < 3:
        return np.zeros(0, np.int64)
    two = a[:-1] << 21 | a[1:]
    three = (two[:-1] << 21 | a[2:])[a[1:-1] != _SPACE]
    return np.sort(np.concatenate([a[a != _SPACE], two, three]))


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys, counts) of a whole text, a piece at a time."""
    total: tuple | None = None
    at = 0
    while text and at < len(text):
        end = len(text) if at + _PIECE >= len(text) else max(text.rfind(" ", at + 1, at + _PIECE), 0) or at + _PIECE
        g = _grams(text[at:end])
        at = end
        if not len(g):
            continue
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        keys, n = g[first], np.diff(np.append(first, len(g)))
        if total is None:
            total = keys, n
        else:
            u, back = np.unique(np.concatenate([total[0], keys]), return_inverse=True)
            total = u, np.bincount(back, np.concatenate([total[1], n])).astype(np.int64)
    return total or (np.zeros(0, np.int64), np.zeros(0, np.int64))


def ranked(keys: np.ndarray, n: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent keys, best first; ties by key."""
    if len(n) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        keep = n >= least
        keys, n = keys[keep], n[keep]
    return keys[np.lexsort((keys, -n))][:size]


def learn(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profile of each language: its n-grams, most frequent first, from the rows
    for which the column ``train(id)`` holds, about ``sample`` for a language."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc").isNotNull() & train(F.col("doc")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    bits = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(bits * min(1.0, sample / n)))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc"), F.lit(bits)) < share[F.col("lang")]).filter("text is not null")

    def count(batches):
        for b in batches:
            n: dict[str, Counter] = {}
            for lang, text in zip(b["lang"], b["text"]):
                keys, c = counts(text)
                own = n.setdefault(lang, Counter())
                for k, v in zip(keys.tolist(), c.tolist()):
                    own[k] += v
            out = [(lang, k, v) for lang, own in n.items() for k, v in own.items()]
            yield pd.DataFrame(out, columns=["lang", "gram", "n"])

    grams = chosen.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in grams.withColumn("rank", best).filter(F.col("rank") <= PROFILE).orderBy("lang", "rank").select("lang", "gram").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.keys, self.ranks = [], []
        for name in self.names:
            k = np.array(profiles[name], np.int64)
            order = np.argsort(k)
            self.keys.append(k[order])
            self.ranks.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the lead over the second language,
        from 0 to 1.  ``und`` and 0 without a letter or without profiles."""
        own = ranked(*counts(text))
        if not len(own) or not self.names:
            return "und", 0.0
        place = np.arange(len(own))
        far = []
        for keys, ranks in zip(self.keys, self.ranks):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            far.append(int(np.where(keys[at] == own, np.minimum(np.abs(ranks[at] - place), PROFILE), PROFILE).sum()))
        order = sorted(range(len(far)), key=lambda i: (far[i], i))
        second = far[order[1]] if len(order) > 1 else PROFILE * len(own)
        return self.names[order[0]], (second - far[order[0]]) / second if second else 0.0


def language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id mod 4 is 2), lang_pred, score.
    Learns from text and language of the other rows only; ties go to the first
    name in alphabetical order; null texts and texts without a letter are ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, lambda c: crc_fold(c, 4) != 2, id_col, text_col, lang_col))
    made: list[Profiles] = []

    @F.pandas_udf("lang string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Profiles(shared.value))
        return pd.DataFrame([made[0].predict(t) for t in text], columns=["lang", "score"])

    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return base.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), predict("text").alias("p")) \
        .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
