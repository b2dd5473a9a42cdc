import corpus_pipeline
from papertide.llm import order_minhash, quality

D = "/root/testdata/sf0.001"


def test_stages_agree_with_their_operators(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    good = corpus_pipeline.keep_good(spark, docs, D)
    want = {r.doc_id for r in quality.judged(docs, labels).where("predicted = 1").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == want
    one = corpus_pipeline.keep_one_of_each(spark, good, D)
    kept = {r.doc_id for r in order_minhash.classes(good).where("kept").collect()}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(kept)
    mixed = corpus_pipeline.mix_sources(spark, one, D)
    ids = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == docs.columns and set(ids) <= kept and max(map(ids.count, ids)) <= 2
    out = corpus_pipeline.to_token_ids(spark, mixed, D).collect()
    assert sorted(r.doc_id for r in out) == sorted(ids) and all(r.n_tokens == len(r.ids) for r in out)


def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and out.count() > 100


def test_empty(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
    assert docs.count() == 0
