"""The pipeline's stages against brute force on their own input, and its columns."""

import hashlib

import corpus_pipeline as P
from test_operators import ALNUM, LOW, PLAIN, brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [ALNUM.findall((r.text or "").translate(LOW)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[p:p + 10]) for w in items for p in range(len(w) - 9)}
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = P.save(stage(spark, docs, SF), "test")
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and after
        if name != "tokens":
            assert out.dtypes == docs.dtypes
            assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)
        if name == "toxicity":
            assert all(after[i] == before[i] for i in after)
        if name == "near duplicates":
            assert set(after) == {i for i, x in brute_components([(i, r.text) for i, r in before.items()]).items() if x[2]}
        if name == "duplicate substrings":
            seen = {}
            for i in sorted(before):
                w = PLAIN.findall(before[i].text)
                mask = [0] * len(w)
                for p in range(len(w) - 49):
                    if seen.setdefault(tuple(w[p:p + 50]), i) != i:
                        mask[p:p + 50] = [1] * 50
                left = [x for x, m in zip(w, mask) if not m]
                assert PLAIN.findall(after[i].text) == left if left else i not in after or not w
        if name == "benchmark passages":
            for i, r in after.items():
                w = ALNUM.findall(before[i].text.translate(LOW))
                if not any(tuple(w[p:p + 10]) in windows for p in range(len(w) - 9)):
                    assert r == before[i]
                else:
                    assert r.n_chars < before[i].n_chars
            for i in set(before) - set(after):
                w = ALNUM.findall(before[i].text.translate(LOW))
                assert any(tuple(w[p:p + 10]) in windows for p in range(len(w) - 9))
        if name == "tokens":
            assert all(after[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for i, r in before.items())
        docs = out


def test_run_gives_the_last_stage(spark):
    assert P.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
