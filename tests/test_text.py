"""Text functions on literal edge cases, and SumBasic against a brute-force
Python implementation on a small fixture."""

import regex

from stagecraft.functions import text as X


def test_tokens_edge_cases(spark):
    texts = ["", "one", "no end", "...!!?", "Élan vital, café NOËL 42", "w " * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.tokens("t")).collect()]
    assert got[:5] == [[], ["one"], ["no", "end"], [], ["élan", "vital", "café", "noël", "42"]]
    assert len(got[5]) == 5000


def _py_summary(text, k=3):
    sents = [(i, s.strip()) for i, s in enumerate(regex.split(r"[.!?\n]+", text)) if s.strip()]
    toks = {i: [t for t in regex.split(r"[^\p{L}\p{N}]+", s.lower()) if t] for i, s in sents}
    alltoks = [t for ts in toks.values() for t in ts]
    if not alltoks:
        return None
    freq = {t: alltoks.count(t) / len(alltoks) for t in set(alltoks)}
    scored = [(round(sum(freq[t] for t in toks[i]) / len(toks[i]), 9), i, s) for i, s in sents if toks[i]]
    best = sorted(scored, key=lambda x: (-x[0], x[1]))[:k]
    return " ".join(s for _, _, s in sorted(best, key=lambda x: x[1]))


def test_summarize_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.summary for r in X.summarize(docs, "doc_id", "text").collect()}
    for r in docs.limit(60).collect():
        assert got.get(r.doc_id) == _py_summary(r.text)


def test_parse_blocks_unclosed_tags(spark):
    html = ("<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><li>menu</li></nav>"
            "<!-- c --><h2>Head &amp; more</h2><p><b>one<p>two<br>three<li>item</body></html>")
    df = spark.createDataFrame([(1, html)], "id int, html string")
    blocks = [(r.kind, r.text) for r in X.parse_blocks(df, "id", "html").orderBy("pos").collect()]
    assert blocks == [("heading", "Head & more"), ("paragraph", "one"), ("paragraph", "two three"), ("item", "item")]
    plain = df.select(X.parse_text("html")).first()[0]
    assert plain == "Head & more one two three item"


def test_sentiment_and_nb_keep_every_document(spark):
    docs = spark.createDataFrame([(1, "good good day"), (2, "bad day"), (3, ""), (4, "unknown words")],
                                 "doc_id long, text string")
    lex = X.lexicon_from_pairs(spark, [("good", 1.5), ("bad", -2.0)])
    s = {r.doc_id: (r.score_micro, r.sentiment) for r in X.sentiment(docs, "doc_id", "text", lex).collect()}
    assert s == {1: (1500000, "positive"), 2: (-2000000, "negative"), 3: (0, "neutral"), 4: (0, "neutral")}
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 0)], "doc_id long, toxic int")
    model = X.fit_nb(docs, labels, "doc_id", "text", "toxic")
    pred = {r.doc_id: r.label for r in X.predict_nb(docs, model, "doc_id", "text").collect()}
    assert set(pred) == {1, 2, 3, 4} and pred[2] == 1 and pred[3] == 0   # empty doc takes the larger prior


def test_extract_and_answer(spark):
    docs = spark.createDataFrame([(1, 'Mail me at a.b@example.com. Licensed under the Apache License, Version 2.0.\n'
                                      'token = "abc123" here'), (2, "nothing here")], "doc_id long, text string")
    ex = {(r.doc_id, r.question): r.answer for r in X.extract(docs, "doc_id", "text", list(X.EXTRACT_RULES)).collect()}
    assert ex[(1, "What is the e-mail address?")] == "a.b@example.com"
    assert ex[(1, "Which licence applies?")] == "Apache License, Version 2.0"
    assert ex[(1, "What is the token?")] == "abc123"
    ans = X.answer_sentence(docs, "doc_id", "text", ["Which license is used?"]).collect()
    assert [r.answer for r in ans] == ["Licensed under the Apache License, Version 2"]


def test_summarize_with_prompt_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    prompt = "The licence and the token"
    ptoks = {"the", "licence", "and", "token"}
    got = {r.doc_id: r.summary for r in X.summarize(docs, "doc_id", "text", prompt=prompt).collect()}

    def brute(text, k=3):
        sents = [(i, s.strip()) for i, s in enumerate(regex.split(r"[.!?\n]+", text)) if s.strip()]
        toks = {i: [t for t in regex.split(r"[^\p{L}\p{N}]+", s.lower()) if t] for i, s in sents}
        alltoks = [t for ts in toks.values() for t in ts]
        if not alltoks:
            return None
        cnt = {}
        for t in alltoks:
            cnt[t] = cnt.get(t, 0) + 1
        scored = []
        for i, s in sents:
            if toks[i]:
                w = sum(cnt[t] for t in toks[i]) / (len(toks[i]) * len(alltoks))
                w *= 2 if ptoks & set(toks[i]) else 1
                scored.append((round(w, 9), i, s))
        best = sorted(scored, key=lambda x: (-x[0], x[1]))[:k]
        return " ".join(s for _, _, s in sorted(best, key=lambda x: x[1]))

    for r in docs.collect():
        assert got.get(r.doc_id) == brute(r.text)


def test_extract_step_row_local_equals_grouped(spark):
    from pyspark.sql import functions as F
    from stagecraft.plans.pipeline import text_chain
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    qs = ["What is the e-mail address?", "What is the token?", "Which licence applies?"]
    got = {r.doc_id: r.PROCESSED_DATA for r in
           text_chain(docs, "doc_id", "text", [("ai_extract", {"prompts": "\n".join(qs)})]).collect()}
    grouped = (X.extract(docs, "doc_id", "text", qs).groupBy("doc_id")
               .agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("question", "answer"))))).alias("a")))
    want = {r.doc_id: r.a for r in grouped.collect()}
    assert len(got) == docs.count()
    assert {k: v for k, v in got.items() if v is not None} == want


def test_extract_step_free_and_repeated_questions(spark):
    """Questions without a rule on text keys, and a question given twice."""
    from stagecraft.plans.pipeline import text_chain
    df = spark.createDataFrame([("a.txt", "Anna Berg signed the contract. It rained."), ("b.txt", "")], "f string, t string")
    assert X.extract(df, "f", "t", ["Who signed the contract?"]).collect() == []
    got = dict(text_chain(df, "f", "t", [("ai_extract", {"prompts": "Who signed the contract?\n Who signed the contract?"})]).collect())
    assert got == {"a.txt": '{"Who signed the contract?":"Anna Berg signed the contract"}', "b.txt": None}
    mixed = dict(text_chain(df, "f", "t", [("ai_extract", {"prompts": "What is the title?\nWhat is the title?"})]).collect())
    assert mixed == {"a.txt": '{"What is the title?":"Anna Berg signed the contract. It rained."}', "b.txt": None}


def test_summarize_long_sentence(spark):
    """One sentence of 20,000 words next to a short one; the rows of a sentence
    do not repeat its text."""
    long = " ".join(f"w{i % 700}" for i in range(20_000))
    df = spark.createDataFrame([(1, f"{long}. w1 w1 w1.")], "id long, t string")
    assert X.summarize(df, "id", "t", k=1).collect()[0]["summary"] == _py_summary(f"{long}. w1 w1 w1.", 1)
    assert X.summarize(df, "id", "t", k=2).collect()[0]["summary"] == f"{long} w1 w1 w1"


def test_token_index_counts(spark):
    from collections import Counter
    texts = [(1, "a b a. B c"), (2, None), (3, ""), (4, "..."), (5, "x" ), (1, "a"), (None, "z z z")]
    df = spark.createDataFrame(texts, "id long, text string")
    rows, n = X.token_index(df, "id", "text")
    assert n == len(texts)
    assert Counter(map(tuple, rows.collect())) == Counter([(1, "a", 2), (1, "b", 2), (1, "c", 1), (2, None, None), (3, None, None), (4, None, None),
                                                           (5, "x", 1), (1, "a", 1), (None, "z", 3)])
    some, _ = X.token_index(df, "id", "text", ["b", "z"])
    assert {tuple(r) for r in some.collect() if r.token} == {(1, "b", 2), (None, "z", 3)}
    freq = {r.token: r.df for r in X.index_frequency(rows, n).collect()}
    assert freq == {"a": 2, "b": 1, "c": 1, "x": 1, "z": 1}


def test_summarize_rows_stay_documents(spark):
    """Words never become rows: no window, one exchange, of the texts; rows of one id are one document."""
    df = spark.createDataFrame([(1, "A b. C d d! e"), (1, "A b. C d d! e"), (2, None), (3, " ... "), (None, "x y\nx"), (4, "É é. É\t z?? z")], "id long, t string")
    out = X.summarize(df, "id", "t", k=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {r.id: r.summary for r in out.collect()}
    assert got == {1: _py_summary("A b. C d d! e", 2), None: "x y x", 4: _py_summary("É é. É\t z?? z", 2)}
    kept = {r.id: r.summary for r in X.summarize(df, "id", "t", k=2, keep_all=True).collect()}
    assert kept == got | {2: None, 3: None}


def test_text_chain_summary_rows_stay_documents(spark):
    from stagecraft.plans.pipeline import text_chain
    df = spark.createDataFrame([("a", "good day. bad"), ("a", "bad bad. good"), (None, None)], "k string, t string")
    lex = X.lexicon_from_pairs(spark, [("good", 1.0), ("bad", -2.0)])
    out = text_chain(df, "k", "t", [("ai_summarize", {"k": 1}), ("ai_sentiment", {"lexicon": lex})])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [("a", "positive"), ("a", "negative"), (None, "neutral")]))


def test_summarize_unique_ids_sorts_no_texts(spark):
    """Ids that are said to be unique: the same summaries without an aggregate."""
    df = spark.createDataFrame([(1, "A b. C d d! e"), (2, None), (3, " ... "), (None, "x y\nx"), (4, "É é. É\t z?? z"), (5, "")], "id long, t string")
    for more in ({}, {"prompt": "z d"}, {"keep_all": True}, {"k": 1}):
        out = X.summarize(df, "id", "t", unique=True, **more)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "Sort" not in plan and plan.count("Exchange hashpartitioning") == 1
        assert sorted(map(str, out.collect())) == sorted(map(str, X.summarize(df, "id", "t", **more).collect()))


def test_text_chain_summaries_sort_no_texts(spark):
    from stagecraft.plans.pipeline import text_chain
    df = spark.createDataFrame([("a", "one. two two"), ("a", "one. two two"), (None, "x"), (None, "x"), ("b", None)], "k string, t string")
    out = text_chain(df, "k", "t", [("ai_summarize", {"k": 1})])
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [("a", "two two")] * 2 + [(None, "x")] * 2 + [("b", None)]))
