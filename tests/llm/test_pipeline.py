"""The pipeline against the decisions its operators make alone."""

from collections import Counter

import corpus_pipeline
from factorwise.llm import decontam, langid, mixing, simhash

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id: r for r in docs.collect()}
    rejected = {r.doc_id for r in langid.identify(docs, train=~langid.held_out()).collect() if r.rejected}
    left = docs.filter(~docs.doc_id.isin(list(rejected) or [-1]))
    first = {r.doc_id for r in simhash.keep_first(left).collect()}
    left = left.filter(left.doc_id.isin(list(first)))
    leaked = {r.doc_id for r in decontam.leaks(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    left = left.filter(~left.doc_id.isin(list(leaked) or [-1]))
    rows = left.select("doc_id", "source", mixing.word_count(left.text).alias("size"))
    copies = {r.doc_id: r.copies for r in mixing.mix_to_weights(rows).collect() if r.copies}

    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == copies and leaked
    assert all(r.text == whole[r.doc_id].text and r.source == whole[r.doc_id].source for r in got)
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
