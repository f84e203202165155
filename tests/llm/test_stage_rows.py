"""Pipeline stages on rows without id, repeated ids, clashing columns and small batches."""

import random

import pytest

from stagecraft.llm import decontam, neardup, substring, toxicity

CLASH = {c: "x" for c in ("doc", "sub", "spans", "row", "first", "left", "raw", "toxic_score", "__doc", "component_id", "place", "best", "n")}


def frame(spark, rows):
    """(doc_id, text) with columns named like the stages' own."""
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i, t, None if t is None else len(t), *CLASH.values()) for i, t in rows], schema).repartition(3)


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n))


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(1)
    a, b, c, d, top = (words(rng, 30) for _ in range(5))
    near = c.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (7, near), (4, d), (4, d), (None, None), (None, ""), (9, None), (30, top), (3, top)]
    got = neardup.drop_near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(
        [(1, a), (2, b), (7, near), (4, d), (None, None), (None, ""), (9, None), (3, top)], key=str)
    assert got[0].asDict().keys() == {"doc_id", "text", "n_chars", *CLASH}
    assert all(r[k] == v for r in got for k, v in CLASH.items())
    assert neardup.drop_near_duplicates(frame(spark, rows).limit(0)).collect() == []
    got = neardup.drop_near_duplicates(frame(spark, [((1 << 63) - 1, a), (-5, a), (1, b), (1, b), (None, c), (-(1 << 63), d)])).collect()
    assert sorted(r.text for r in got) == sorted([a, b, c, d])


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(2)
    passage, item = words(rng, 60), words(rng, 12)
    rows = [(1, passage + " " + words(rng, 20)), (2, words(rng, 20) + " " + passage), (3, words(rng, 40)), (4, None)]
    out = substring.remove_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: len((r.text or "").split()) for r in out} == {1: 80, 2: 20, 3: 40, 4: 0} and all(r["spans"] == "x" for r in out)
    marks = spark.createDataFrame([("i", item)], "item_id string, text string")
    rows = [(1, words(rng, 30) + " " + item), (2, words(rng, 9)), (3, None), (4, item)]
    out = decontam.remove_benchmark(frame(spark, rows), marks).collect()
    assert {r.doc_id: len((r.text or "").split()) for r in out} == {1: 30, 2: 9, 3: 0} and all(r["left"] == "x" for r in out)


@pytest.mark.parametrize("batch", [10_000, 1])
def test_toxicity_of_batches_without_terms(spark, batch):
    """No clean document, or no toxic one, of a batch has a lexicon term."""
    rng = random.Random(3)
    rows = [(i, words(rng, 15) + (" insult insulted insulting you" if i % 2 else " fine")) for i in range(80)] + [(900, None), (901, ""), (None, "fine")]
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(40)] + [(900, None, "t"), (None, 1, "t")], "doc_id long, toxic int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), labels).collect()}
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
        assert all(got[i].predicted == i % 2 for i in range(80))
        left = toxicity.drop_toxic(frame(spark, rows), labels).collect()
        assert {r.doc_id for r in left} == {i for i in range(0, 80, 2)} | {900, 901, None} and all(r["toxic_score"] == "x" for r in left)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_toxicity_against_brute_force(spark):
    """Scores from term counts and sums that plain loops make."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    frame_ = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lexicon = {" " + w[:4]: 0.5 + i / 10 for i, w in enumerate(sorted({w for _, t in docs[:20] for w in toxicity.words_of(t) if len(w) >= 4})[:50])}
    lexicon |= {k + "a": v + 1 for k, v in list(lexicon.items())[:20]}
    curve = [-2.0, 0.7, 0.3]
    got = {r.doc_id: r.s for r in toxicity.score(frame_, {"lexicon": lexicon, "curve": curve}, name="s").collect()}
    for i, t in docs:
        total = 0.0
        for w in toxicity.words_of(t):
            hits = [k for k in lexicon if f" {w} ".startswith(k)]
            total += lexicon[max(hits, key=len)] if hits else 0.0
        n = len(toxicity.words_of(t))
        z = curve[0] + curve[1] * toxicity.math.log1p(total) + curve[2] * toxicity.math.log1p(100 * total / (n + 20))
        assert abs(got[i] - 1 / (1 + toxicity.math.exp(-z))) < 1e-9
