import brute

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.select("doc_id", "text", "source").collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    now = stages["quality"](spark, docs, SF)
    kept = {r.doc_id: r.text for r in seen if not brute.quality(r.text)[5]}
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == kept.keys()

    now = stages["exact_dedup"](spark, now, SF)
    kept = {i: kept[i] for i, c in brute.copies(list(kept.items())).items() if c[2]}
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == kept.keys()

    now = stages["near_dedup"](spark, now, SF)
    kept = {i: kept[i] for i, (_, c) in brute.near(list(kept.items())).items() if c == i}
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == kept.keys()

    now = stages["pii"](spark, now, SF)
    assert now.columns == docs.columns
    for r in now.collect():
        assert not [x for x in brute.pii(r.text) if not x.startswith(("card", "phone"))]
        if not brute.pii(kept[r.doc_id]):
            assert r.text == kept[r.doc_id]
        assert r.n_chars == len(r.text)

    out = stages["packing"](spark, now, SF).collect()
    assert {r.doc_id for r in out} == kept.keys()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
