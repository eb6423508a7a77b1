import re

import corpus_pipeline
from lectern.llm import exact_dedup, packing, pii, quality
from lectern.llm.shared import stored
from tests.llm.test_dedup import brute
from tests.llm.test_models import brute_report

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.keep for r in quality.scores(docs).collect()}
    docs = stored(corpus_pipeline.good(spark, docs, DATA))
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {i for i, k in scores.items() if k}
    kept = {i: texts[i] for i, k in scores.items() if k}
    docs = stored(corpus_pipeline.exact_copies(spark, docs, DATA))
    groups = {}
    for i, t in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    kept = {min(g)[1]: texts[min(g)[1]] for g in groups.values()}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == set(kept)
    docs = stored(corpus_pipeline.near_copies(spark, docs, DATA))
    kept = {i: texts[i] for i in {c for _, c in brute(list(kept.items()), 5, 80, 100).values()}}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == set(kept)
    docs = stored(corpus_pipeline.private(spark, docs, DATA))
    told = {i: x for i, _, x in brute_report([(i, t or "") for i, t in kept.items()])[0]}
    for r in docs.collect():
        want, low = "", 0
        for s, k, e in told[r.doc_id]:
            if s >= low:
                want += kept[r.doc_id][low:s] + f"[{pii.KINDS[k].upper()}]"
            low = max(low, e)
        assert r.text == (want + kept[r.doc_id][low:] if kept[r.doc_id] else kept[r.doc_id])
        assert r.n_chars == len(r.text or "")
    rows = corpus_pipeline.packed(spark, docs, DATA)
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == set(kept) and rows.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, DATA)
    n = got.count()
    assert n > 0 and got.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`").count() == 0


def test_awkward(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "some words of a text here. More of them.", "en", "s", 40), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA))
        docs.count()
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, DATA))
        assert empty.count() == 0


def test_registered():
    import __spark_entry__ as e

    names = [q for q in e.queries() if re.match(r"op\d+_|pipeline", q)]
    assert len(names) == 11 and exact_dedup is not None
