import corpus_pipeline
from quillstream.llm import queries


def test_stages_on_awkward_rows(spark, docs, empty, tmp_path):
    items = spark.createDataFrame([(0, "no such item here. at all")], "item_id bigint, text string")
    items.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for table in (docs, empty):
        rows = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, f"file://{tmp_path}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
                path = f"file://{tmp_path}/{name}-{table is docs}"
                out.write.parquet(path)
                rows = spark.read.parquet(path)
                assert rows.count() <= table.count()
        assert (out.count() > 0) == (table is docs)


def test_every_operator_is_registered():
    names = {q.split("_")[0] for q in queries.queries()}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(queries.oracle_sql()) <= set(queries.queries())
