"""The stages on the awkward rows: each works on all its predecessor kept."""

from collections import Counter

import corpus_pipeline
from lagledger.llm.common import staged


def test_stages(docs, none, tmp_path, spark):
    now, kept = docs, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = staged(stage(spark, now, str(tmp_path)), "test")
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            kept.append(Counter(r["doc_id"] for r in out.collect()))
        now = out
    language, exact, near, mixed = kept
    assert set(language) == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert max(exact.values()) == 1 and set(near) <= set(exact) <= set(language) and set(mixed) == set(near)
    assert {r["doc_id"] for r in now.collect()} == set(mixed)


def test_run_equals_the_stages_one_by_one(docs, tmp_path, spark):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_an_empty_table_passes_through(none, tmp_path, spark):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
