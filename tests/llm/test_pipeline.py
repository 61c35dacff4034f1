import corpus_pipeline
from lakeatlas.llm import ngram_join, quality, secret_scan
from lakeatlas.llm._common import table

from .test_ngram_join import brute

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
        out = stage(spark, out, SF).cache()
        if i == 4:
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
        if i == 0:
            rated = quality.rate_documents(docs, table(spark, SF, "labels")).where("keep").select("doc_id").collect()
            assert after.keys() == {r.doc_id for r in rated} and 0.5 < len(after) / len(rows) < 1
        if i == 1:
            groups = brute(list(before.items()), 5, 80)
            assert after.keys() == {c for _, n, c in groups if n} | {d for d, n, _ in groups if not n}
        if i == 3:
            assert after.keys() == before.keys()
            assert all(not s.spans for s in secret_scan.scan_secrets(out).collect())
            assert sum(after[d] != before[d] for d in after) < len(after) / 5
    mixed = out.collect()
    assert {r.doc_id for r in mixed} <= after.keys() and abs(sum(r.tokens for r in mixed) / sum(len((t or "").split()) for t in after.values()) - 1) < 0.15


def test_keep_one_with_clashing_ids_and_nulls(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (1, a), (1, b), (2, b), (3, a.upper()), (None, a), (None, None), (4, None), (4, ""), (5, None), (6, "x y")]
    df = spark.createDataFrame([(*r, "n", 7) for r in rows], "doc_id long, text string, node string, component_id int")
    got = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()), key=str)
    assert [(d, t or "") for d, t in got] == sorted([(None, ""), (1, a), (1, b), (4, ""), (5, ""), (6, "x y")], key=str)
    assert ngram_join.keep_one(df).columns == df.columns


def test_two_results_at_once(spark):
    first = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    second = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 50 < first.count() == second.count()


def test_edges_end_to_end(spark, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    plain = "these plain words say something about the weather of last week and of this"
    rows = [(None, plain, "en", None, 5), (2**53 + 1, plain + " and more", None, "a", None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, "token=abcdef1234 stands in the middle of other words here", "en", "b", 55), (5, "token=abcdef1234 stands in the middle of other words here", "en", "b", 55), (6, "long " * 200_000 + "text", "en", "a", 1_000_004)]
    more = [(*r, 1, "x", None) for r in rows]
    df = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, node int, spans string, component long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {None, 2**53 + 1, 5, 6} and len(got) > 0
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
