"""The pipeline's stages on their own and together."""

import corpus_pipeline
from tests.llm.test_corpus_operators import awkward, brute_classes
from tidemark.llm import common, decontaminate

DATA = "/root/testdata/sf0.001"


def test_run_covers_what_the_stages_keep(spark):
    docs = common.table(spark, DATA, "documents")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = common.materialize(stage(spark, kept, DATA))
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert kept.columns == columns and after.items() <= before.items() and 0 < len(after)
        assert name == "mixing" or kept.count() == len(after)
        if name == "near_duplicates":
            assert set(after) == set(brute_classes(before).values())
        if name == "decontamination":
            items = [decontaminate.normalise(r["text"]) for r in common.table(spark, DATA, "benchmark").collect()]
            clean = {k for k, t in before.items() if not any(i in decontaminate.normalise(t) for i in items)}
            assert set(after) == clean
    final = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in final) == sorted(r["doc_id"] for r in kept.collect())


def test_stages_take_awkward_tables(spark):
    for docs in (awkward(spark), awkward(spark, [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, DATA).columns == docs.columns
        assert corpus_pipeline.sharded(spark, docs, DATA).count() == docs.count()
