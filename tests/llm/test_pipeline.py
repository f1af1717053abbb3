"""Each stage of the pipeline on its own input, against brute force."""

import re
from collections import Counter

import corpus_pipeline
from tessera.llm import mixing, toxicity
from tests.llm.test_operators import brute_near


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text").collect() if name != "bpe" else None
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        done = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert done.columns == columns
        if name == "toxicity":
            rejected = {r.doc_id for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
            assert {r.doc_id for r in done.collect()} == {r.doc_id for r in before} - rejected
        if name == "exact_dedup":
            best = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]+", "", r.text or "")
                best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
            assert {r.doc_id for r in done.collect()} == {i for _, i in best.values()}
        if name == "near_dedup":
            want = {i for i, _, _, k in brute_near([(r.doc_id, r.text) for r in before]) if k}
            assert {str(r.doc_id) for r in done.collect()} == want
        if name == "mixing":
            copies = {r.doc_id: sum(2 * c.words >= r["size"] for c in r.copies) for r in mixing.plan_mix(docs).collect()}
            assert Counter(r.doc_id for r in done.collect()) == Counter({i: n for i, n in copies.items() if n})
        if name == "bpe":
            assert Counter(r.doc_id for r in done.collect()) == Counter(r.doc_id for r in docs.collect())
            assert all(len(r.ids) == r.n_tokens for r in done.collect())
        kept[name], docs = done.count(), done
    assert corpus_pipeline.run(spark, sf_dir).count() == kept["bpe"]


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0


def test_odd_documents(spark, sf_dir, odd_docs, tmp_path):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert out.columns == odd_docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0
