"""Rows without id, and rows that repeat an id with other texts, are documents of
their own: found as repeats of each other, and never cut at each other's places."""

import random

import numpy as np
import pytest

from stagecraft.llm import repeats, substring, suffix

SCHEMA = "doc_id long, text string, n_chars long"


def rows():
    rng = random.Random(11)
    words = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n)]
    shared, passage, pair = words(60), words(60), words(60)
    texts = [(1, shared + words(40)), (2, words(100)), (2, shared + words(40)),  # id 2: only its second text repeats
             (None, shared + words(40)), (None, words(100)), (None, words(100)),
             (None, words(30) + passage), (None, words(10) + passage),  # repeat between two rows without id
             (4, pair + words(5)), (4, words(5) + pair)]  # repeat between two texts of one id
    whole = " ".join(words(80))
    return [(i, " ".join(w)) for i, w in texts] + [(None, whole), (None, whole), (7, whole), (7, whole)], shared, passage, pair, whole


@pytest.fixture(scope="module")
def odd_ids(spark):
    return spark.createDataFrame([(i, t, len(t)) for i, t in rows()[0]], SCHEMA).repartition(4)


@pytest.mark.parametrize("hot, split", [(2048, 64), (0, 0)])
def test_substring_rows_keep_their_own_spans(odd_ids, hot, split, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SPLIT", split)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring.substring_dedup(odd_ids).collect())
    low, none = got[:7], got[7:]
    assert [x[1:] for x in low] == [(1, 100, 0), (2, 100, 0), (2, 100, 60), (4, 65, 0), (4, 65, 60), (7, 80, 0), (7, 80, 0)]
    assert sorted(x[3] for x in none if x[2] == 100) == [0, 0, 60] and sorted(x[3] for x in none if x[2] in (70, 90)) == [0, 60]
    assert [x[3] for x in none if x[2] == 80] == [80, 80]


@pytest.mark.parametrize("hot, split", [(2048, 64), (0, 0)])
def test_suffix_rows_keep_their_own_spans(odd_ids, hot, split, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SPLIT", split)
    given, shared, passage, pair, whole = rows()
    size = {k: len(" ".join(v)) for k, v in (("shared", shared), ("passage", passage), ("pair", pair))} | {"whole": len(whole)}
    near = lambda n, k: k is None and n == 0 or k and size[k] <= n <= size[k] + 4  # noqa: E731  (a space or letter beside it may agree)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffix.suffix_dedup(odd_ids).collect()))
    want = [None, None, "shared", None, "pair", None, None]
    assert [x[1] for x in got[:7]] == [1, 2, 2, 4, 4, 7, 7] and all(near(x[2], k) for x, k in zip(got, want))
    none = [x[2] for x in got[7:]]
    assert len(none) == 7 and none.count(0) == 3 and none.count(size["whole"]) == 2
    assert sum(near(n, "shared") or near(n, "passage") for n in none if n not in (0, size["whole"])) == 2


def test_pipeline_stage_cuts_only_the_rows_that_repeat(odd_ids):
    given, shared, passage, pair, whole = rows()
    out = substring.remove_duplicates(odd_ids)
    assert out.dtypes == odd_ids.dtypes
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sum(" ".join(shared) in t for _, t in got) == sum(" ".join(passage) in t for _, t in got) == 1
    assert sum(" ".join(pair) in t for _, t in got) == 1
    assert sorted(i for i, t in got if t == whole) == [7, 7]
    clean = [x for k, x in enumerate(given) if k in (0, 1, 4, 5)]
    assert all(x in got for x in clean) and len(got) == 12


@pytest.mark.parametrize("query", [substring.substring_dedup, suffix.suffix_dedup])
def test_texts_are_shuffled_once(spark, query):
    """Blocks and removed spans are joined with the texts in two joins on one shuffle."""
    # (the digits differ, so buckets hold several kinds of blocks)
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(1, text + " a"), (2, "b " + text + " c"), (2, text), (None, text), (3, None)], "doc_id long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = query(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("xxhash64(text") == 1 and "ReusedExchange" in plan
        removed = [(r.doc_id, r.n_removed > 0) for r in out.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(removed, key=str) == sorted([(1, False), (2, True), (2, True), (3, False), (None, True)], key=str)


def test_packed_block_columns(spark):
    p = np.array([0, 5, 1 << 40], np.int64)
    n = np.array([0, 69, 17], np.int64)
    full, wide = np.array([True, False, False]), np.array([False, True, False])
    bits = repeats._count_bits(100, 32)
    packed = repeats._run(p, n, full, wide, bits)
    rows = spark.createDataFrame([(int(x),) for x in packed], "run long").select(*[c.alias(k) for k, c in repeats._of_run(bits).items()])
    assert [tuple(r) for r in rows.collect()] == list(zip(p.tolist(), n.tolist(), full.tolist(), wide.tolist()))
