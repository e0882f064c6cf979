"""The stages of the corpus pipeline, each on what the stage before kept."""

from __future__ import annotations

import corpus_pipeline
from proofmill.llm import decontaminate, jaccard, mixing, toxicity
from proofmill.llm.common import table


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "token_ids"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, sf_dir)
        if k < len(names) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = before
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    scores = toxicity.score_toxicity(kept["toxicity"], table(spark, sf_dir, "labels"))
    assert ids(read("toxicity")) == ids(scores.where("predicted = 0"))
    classes = jaccard.jaccard_classes(kept["ngram_jaccard"]).where("doc_id = component_id")
    assert ids(read("ngram_jaccard")) == ids(classes)
    bad = {r.doc_id for r in decontaminate.contaminated_documents(kept["decontamination"], table(spark, sf_dir, "benchmark")).collect()}
    assert ids(read("decontamination")) == [d for d in ids(kept["decontamination"]) if d not in bad]
    mix = {r.doc_id: r.copies for r in mixing.mix_sources(kept["mixing"]).collect()}
    assert ids(read("mixing")) == sorted(d for d, n in mix.items() for _ in range(n))
    last = read("token_ids")
    assert ids(last) == ids(kept["token_ids"])
    total, at = 0, sorted((r.start, r.n_tokens) for r in last.collect())
    for start, n in at:
        assert start == total
        total += n


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
