"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one automaton (its size is bounded:
items are dealt into blocks of about ``BLOCK_BYTES``, each with an automaton of
its own that every task streams its documents through).  Streaming a document
keeps the state of the longest suffix that is a substring of an item, and its
length.  Words outside the items' vocabulary, and word pairs that no item has,
set the state back without a step, so only stretches that could hold a window
are walked.  A state with a window of ``WINDOW`` words, or a whole shorter item,
names the items and marks the words of the window as hit.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.llm import common as C

WINDOW = 10
#: Text bytes of test items per automaton (and so per broadcast).
BLOCK_BYTES = 1 << 20


class SuffixAutomaton:
    """Generalised suffix automaton over word hashes."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int = WINDOW):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.window = window
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.found: dict[tuple[int, int], set[str]] = defaultdict(set)
        self.shortest = window
        for name, words in items:
            if not words:
                continue
            size = min(window, len(words))
            self.shortest = min(self.shortest, size)
            state, n = 0, 0
            for w in words:
                state, n = self.step(state, n, w)
                if n >= size:
                    at = state
                    while self.len[self.link[at]] >= size:
                        at = self.link[at]
                    names = self.found[at, size]
                    if name is not None:  # an item without id marks words but names nothing
                        names.add(name)
        self.sizes = sorted({s for _, s in self.found}, reverse=True)
        words = sorted({w for _, x in items for w in x})
        self.vocabulary = np.array(words, np.uint64)
        pairs = {_pair(a, b) for _, x in items for a, b in zip(x, x[1:])}
        self.pairs = np.array(sorted(pairs), np.uint64)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        cur = self._state(self.len[last] + 1, {}, 0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """State and matching length after one more word; the length stays at
        ``window`` or less."""
        while state and w not in self.next[state]:
            state = self.link[state]
            n = self.len[state]
        if w not in self.next[state]:
            return 0, 0
        state, n = self.next[state][w], n + 1
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state, min(n, self.window)

    def matches(self, words: list[int]):
        """(first word, number of words, item names) of every window met."""
        state = n = 0
        for i, w in enumerate(words):
            state, n = self.step(state, n, w)
            if n < self.shortest:
                continue
            for size in self.sizes:
                if size > n:
                    continue
                at = state
                while self.len[self.link[at]] >= size:
                    at = self.link[at]
                names = self.found.get((at, size))
                if names is not None:
                    yield i + 1 - size, size, names


def _pair(a: int, b: int) -> int:
    return (a * 0x9E3779B97F4A7C15 ^ b) & 0xFFFFFFFFFFFFFFFF


def _stretches(h: np.ndarray, woff: np.ndarray, auto: SuffixAutomaton):
    """(text, first word, next word) of runs that may hold a window."""
    none = np.zeros(0, np.int64)
    if not len(h):
        return none, none, none
    known = np.zeros(len(h), bool)
    if len(auto.vocabulary):
        k = np.searchsorted(auto.vocabulary, h)
        known = auto.vocabulary[np.minimum(k, len(auto.vocabulary) - 1)] == h
    cut = np.ones(len(h), bool)  # a run starts here
    if len(h) > 1 and len(auto.pairs):
        both = np.flatnonzero(known[1:] & known[:-1])
        key = h[both] * np.uint64(0x9E3779B97F4A7C15) ^ h[both + 1]
        k = np.searchsorted(auto.pairs, key)
        cut[both[auto.pairs[np.minimum(k, len(auto.pairs) - 1)] == key] + 1] = False
    cut[woff[:-1][woff[:-1] < len(h)]] = True
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(h))
    ok = known[first] & (last - first >= auto.shortest)
    first, last = first[ok], last[ok]
    return np.searchsorted(woff, first, "right") - 1, first, last


def _stream(shared):
    """Per row: number of words, hit spans (in words), items."""
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()),
                        ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def run(batches):
        auto = shared.value
        for batch in batches:
            for lo, hi, data, off in C.chunks(batch.column("text")):
                h, woff, _, _ = C.word_hashes(data, off, C.ALNUM_WORD, lower=True)
                spans: list[list] = [[] for _ in range(hi - lo)]
                items: list[set] = [set() for _ in range(hi - lo)]
                for t, a, b in zip(*(x.tolist() for x in _stretches(h, woff, auto))):
                    at = a - int(woff[t])
                    for s, size, names in auto.matches(h[a:b].tolist()):
                        s += at
                        items[t] |= names
                        if spans[t] and s <= spans[t][-1]["e"] and s >= spans[t][-1]["s"]:
                            spans[t][-1]["e"] = max(spans[t][-1]["e"], s + size)
                        else:
                            spans[t].append({"s": s, "e": s + size})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(lo, hi - lo), batch.column("row").slice(lo, hi - lo), pa.array(np.diff(woff), pa.int64()),
                     pa.array(spans, schema.field("spans").type), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], schema=schema)

    return run


def automata(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> list:
    """One broadcast automaton per block of items; blocks hold about
    ``BLOCK_BYTES``, so each is bounded however large the benchmark is."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = items.filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    out = []
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = []
        for r in own.toLocalIterator():
            data = np.frombuffer(r.text.encode(), np.uint8)
            h = C.word_hashes(data, np.array([0, len(data)]), C.ALNUM_WORD, lower=True)[0]
            rows.append((r.item, h.tolist()))
        out.append(spark.sparkContext.broadcast(SuffixAutomaton(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])), window)))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc, row (0 unless several blocks are merged), n_words,
    spans of hit words (may overlap), items.  Null text has no words; items
    without text or words are left out; items without id mark words but are not
    named; an empty benchmark hits nothing."""
    base = C.keyed(docs, id_col, text_col)
    schema = "doc long, row long, n_words long, spans array<struct<s: long, e: long>>, items array<string>"
    autos = automata(benchmark, item_id, item_text)
    if len(autos) == 1:
        return base.withColumn("row", F.lit(0).cast("long")).mapInArrow(_stream(autos[0]), schema)
    # Numbered and written once: every block sees the same numbers, and no rows merge.
    base = C.save(base.withColumn("row", F.monotonically_increasing_id()), "numbered")
    all_ = None
    for a in autos:
        one = base.mapInArrow(_stream(a), schema)
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy("row").agg(F.first("doc").alias("doc"), F.first("n_words").alias("n_words"),
                                   F.flatten(F.collect_list("spans")).alias("spans"),
                                   F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    @F.pandas_udf("long")
    def n_hit(spans, n):
        from stagecraft.llm.repeats import covered
        return spans.combine(n, lambda x, k: sum(b - a for a, b in covered(x, k)) if len(x) else 0)

    found = hits(docs, benchmark, id_col, text_col)
    items = F.array_sort(F.col("items"))
    return found.select(C.original_id(), "n_words", n_hit("spans", "n_words").alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256")) \
        .withColumn("contaminated", F.col("n_hit") > 0)


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     length_col: str | None = "n_chars", coverage: float = 0.5) -> DataFrame:
    """``docs`` without what the benchmark has: hit spans are cut from the text;
    a document with more than ``coverage`` of its words hit goes altogether.
    Clean documents stay as they are."""
    autos = automata(benchmark, "item_id", "text")

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from stagecraft.llm.repeats import covered
        from stagecraft.llm.substring import cut_words

        def one(t):
            if t is None:
                return None
            raw = t.encode()
            data = np.frombuffer(raw, np.uint8)
            off = np.array([0, len(data)])
            h, woff, starts, ends = C.word_hashes(data, off, C.ALNUM_WORD, lower=True)
            spans = []
            for a in autos:
                for _, lo, hi in zip(*_stretches(h, woff, a.value)):
                    spans += [{"s": int(lo) + s, "e": int(lo) + s + n} for s, n, _ in a.value.matches(h[lo:hi].tolist())]
            cut = covered(spans, len(h))
            if not cut:
                return t
            if sum(e - s for s, e in cut) > coverage * len(h):
                return None
            return cut_words(raw, starts, ends, cut).decode()
        for text in parts:
            yield text.map(one)
        C.forget()

    left, = C.fresh(docs, "left")
    out = docs.withColumn(left, clean(F.col(text_col))).filter(F.col(left).isNotNull() | F.col(text_col).isNull())
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(left) == F.col(text_col), F.col(length_col))
                             .otherwise(F.length(left)).cast(docs.schema[length_col].dataType))
    return out.withColumn(text_col, F.col(left)).select(*docs.columns)
