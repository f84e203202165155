"""One row per input row and the same result for any number of blocks; items
without id mark words but are not named."""

import random
from collections import Counter

import pytest

from stagecraft.llm import decontam


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_rows_and_items_without_id(spark, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n))
    named, unnamed, clean = words(12), words(12), words(20)
    bench = spark.createDataFrame([(1, named), (2, words(12)), (None, unnamed), (None, words(12)), (5, None)], "item_id long, text string")
    rows = [(1, clean), (1, clean), (2, f"x {named} y"), (2, f"x {named} y"), (None, clean), (None, clean), (None, None), (None, None),
            (None, f"{unnamed} z"), (3, f"{named} {unnamed}"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.decontamination(docs, bench).collect())
    assert got == Counter([(1, 20, 0, 0, False)] * 2 + [(2, 14, 12, 1, True)] * 2 + [(None, 20, 0, 0, False)] * 2 + [(None, 0, 0, 0, False)] * 2
                          + [(None, 13, 12, 0, True), (3, 24, 24, 1, True), (4, 0, 0, 0, False)])
