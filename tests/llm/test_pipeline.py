"""The pipeline's stages against what each may drop."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_stages_chain(spark):
    import corpus_pipeline
    from ciphersift.llm import decontam, simhash
    from ciphersift.llm.common import written
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF), f"test-{name}"))
    rows = [df.select("doc_id").distinct().count() for df in kept]
    assert rows[0] >= rows[1] >= rows[2] >= rows[3] >= rows[4] == rows[5] > 0.6 * rows[0]
    assert all(df.columns == columns for df in kept[:-1])
    # no near pair and no leak is left, and nothing else went
    before, after = kept[2], kept[3]
    groups = {r.doc_id: r.component_id for r in simhash.simhash_components(before).collect()}
    assert {r.doc_id for r in after.collect()} == set(groups.values())
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r.doc_id for r in decontam.find_leaks(after, bench).collect()}
    assert {r.doc_id for r in kept[4].collect()} == {r.doc_id for r in after.collect()} - leaks
    both = {r.doc_id: r.text for r in kept[4].collect()}
    assert all(r.round_trip for r in kept[5].filter("sample = 1").collect()) and both
