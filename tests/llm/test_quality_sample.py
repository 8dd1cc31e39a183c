import pytest

from quillstream.llm import quality_model


def test_the_sample_fills_up_to_its_bound(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "BUCKETS", 3)  # every bucket is larger than the bound at first
    rows = [(i, f"text {i} " * (1 + i % 5)) for i in range(600)] + [(1000, "long " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = docs.select("doc_id")
    got = quality_model.sample(docs, trusted, 2000).collect()
    for fold in (0, 1):
        size = sum(len(r["text"]) for r in got if r["fold"] == fold)
        assert 0.9 * 2000 - 60 <= size <= 2000
    assert len({r["text"] for r in got}) == len(got)
    whole = quality_model.sample(docs, trusted, 10**7).collect()
    assert {r["text"] for r in whole} == {t for _, t in rows}
    with pytest.raises(ValueError):
        quality_model.sample(docs.filter("doc_id = 1000"), trusted, 100)
    assert quality_model.sample(docs, trusted.limit(0), 100).count() == 0
