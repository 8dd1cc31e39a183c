import pytest
from pyspark.sql import Observation

from quillstream.functions.tables import register
from quillstream.operators.chunking import chunk_pages
from quillstream.sources.documents import attempts, read_attempts

PAGES = [
    (0, 2, "# A\nshort\n\n## B\n" + "word " * 300 + "\n\n| a | b |\n| - | - |\n| 1 | 2 |\n\ntail\n\n" + "x" * 1500),
    (0, 1, "| lone\ntext after\n##### five\n\n\n"),
    (1, None, " \n\t\n# only\n"),
    (2, 1, None),
    (3, 1, "p\n\n" * 900),
]


def test_the_table_function_equals_the_plan(spark):
    pages = spark.createDataFrame(PAGES, "file_ord int, page_number int, text string")
    pages.createOrReplaceTempView("some_pages")
    register(spark)
    names = ["file_ord", "page_number", "section_ord", "piece_ord", "chunk_ord", "chunk_type", "text"]
    for cap in (1200, 2):
        got = spark.sql(f"SELECT * FROM chunk(max_chunks => {cap}, pages => TABLE(some_pages) PARTITION BY file_ord ORDER BY page_number)")
        rows = lambda df: sorted(map(tuple, df.select(names).collect()))
        assert rows(got) == rows(chunk_pages(pages, max_chunks=cap))
    with pytest.raises(Exception):
        spark.sql("SELECT * FROM chunk(TABLE(SELECT 1 AS page_number))").collect()


def test_no_file_vanishes(spark):
    files = spark.createDataFrame([("a", b"good"), ("b", b"bad"), ("c", b"late"), ("d", b"blank"), ("e", b"")], "path string, content binary")

    def first(content):
        if content == b"bad" or content == b"late":
            raise ValueError(f"cannot read {content.decode()}")
        return [(1, content.decode()), (2, " ")] if content == b"good" else []

    def second(content):
        if content == b"bad":
            raise KeyError("page")
        return [(3, "found")] if content == b"late" else []

    got = sorted((r["path"], r["page_number"] or 0, r["text"], r["stage"], r["reason"]) for r in attempts(files, ("one", first), ("two", second)).collect())
    assert got == [
        ("a", 1, "good", None, None),
        ("b", 0, None, "one", "ValueError: cannot read bad"),
        ("b", 0, None, "two", "KeyError: 'page'"),
        ("c", 0, None, "one", "ValueError: cannot read late"),
        ("c", 3, "found", None, None),
        ("d", 0, None, "two", "no text"),
        ("e", 0, None, "two", "no text"),
    ]
    counts = Observation()
    rows = read_attempts(files.withColumn("path", files["path"]), pdf=first, pdf_fallback=second, counts=counts)
    assert rows.count() == 7 and counts.get == {"n_pages": 2, "n_failures": 5}
    assert {r["reason"] for r in read_attempts(files).collect()} == {"no parser"}
