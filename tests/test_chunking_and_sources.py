import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstream.operators import chunking as c
from quillstream.sources import documents as d
from quillstream.streaming import history, ingest


def A(n):
    return "a" * n


TABLE = "| k | v |\n| 1 | 2 |"


def chunk(spark, text):
    rows = spark.createDataFrame([(0, 1, text)], "file_ord int, page_number int, text string")
    return [(r["chunk_type"], len(r["text"])) for r in c.chunk_pages(rows).orderBy("chunk_ord").collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        (A(600) + "\n" + TABLE + "\n" + A(1200 - 602 - len(TABLE)), [("section", 1200)]),
        ("## H\n\n" + "\n\n".join([A(700), A(600), TABLE, A(100)]), [("text", 706), ("text", 600), ("table", len(TABLE)), ("text", 100)]),
        ("\n\n".join([A(596), A(600), A(1000)]), [("text", 1198), ("text", 1000)]),
        ("\n\n".join([A(597), A(600), A(1000)]), [("text", 597), ("text", 600), ("text", 1000)]),
        ("\n\n".join([A(1000), A(598), A(600)]), [("text", 1000), ("text", 1200)]),
        (A(1500), [("text", 1500)]),
        ("\n\n".join(["| alone", A(1300)]), [("text", 7), ("text", 1300)]),
        ("x\n##### five\n# one\ny", [("section", 12), ("section", 7)]),
        ("x\r# no heading", [("section", 14)]),
    ],
)
def test_chunks(spark, text, want):
    assert chunk(spark, text) == want


def test_blocks_of_very_many_lines(spark):
    import time

    lines = ["text", "| a | b |", "| 1 | 2 |", "", "more", " ", "| c |"] * 6000
    df = spark.createDataFrame([("\n".join(lines),), ("",), ("x",), ("| a |\n| b |",), ("\n\n",)], "s string").coalesce(1)
    start = time.time()
    got = [r[0] for r in df.select(c.blocks(F.col("s"))).collect()]
    one = ["text", "| a | b |\n| 1 | 2 |", "more", "| c |"]
    assert got[0] == one * 6000 and got[1:] == [[], ["x"], ["| a |\n| b |"], []] and time.time() - start < 20


def test_caps(spark):
    rows = spark.createDataFrame([(f, 1, "# a\n# b\n# c") for f in range(3)], "file_ord int, page_number int, text string")
    chunks = c.chunk_pages(rows, max_chunks=2).withColumn("session_id", F.lit("s"))
    got = c.cap_files(chunks, "session_id", 5).orderBy("chunk_ord").collect()
    assert [(r["file_ord"], r["text"]) for r in got] == [(0, "# a"), (0, "# b"), (1, "# a"), (1, "# b"), (2, "# a")]


def test_pages(spark):
    col = lambda t, f: [tuple(p) for p in spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("p")).first()["p"]]
    assert [(n, len(t)) for n, t in col("\n\n".join([A(1500), A(1500), A(1)]), c.virtual_pages)] == [(1, 3002), (2, 1)]
    assert col("a\f \fb\n---\nc", c.marked_pages) == [(1, "a"), (3, "b\n---\nc")]
    assert col("a<!-- PAGE-break -->b", c.marked_pages) == [(1, "a"), (2, "b")]
    assert col(" plain ", c.marked_pages) == [(1, "plain")]


def docx(paragraphs, table=None) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for t, s in paragraphs)
    t = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>" for x in r) + "</w:tr>" for r in table) + "</w:tbl>" if table else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{t}{p}</w:body></w:document>")
    return out.getvalue()


def test_docx_pages_and_dispatch(spark, tmp_path):
    body = docx([(f"p{i}", "Heading1" if i == 0 else "") for i in range(61)] + [(" ", "")], [["k", "v"], ["1", "2"]])
    (tmp_path / "A.DOCX").write_bytes(body)
    (tmp_path / "b.pdf").write_bytes(b"first;jailbreak now")
    (tmp_path / "c.bin").write_bytes(b"broken")
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    files = d.read_files(spark, f"file://{tmp_path}")
    pdf = lambda x: [(i + 1, t) for i, t in enumerate(x.decode().split(";"))] if b";" in x else 1 / 0
    got = {(r["path"].rpartition("/")[2], r["page_number"]): (r["text"], r["n_redactions"]) for r in d.read_documents(files, pdf, lambda x: [(1, "fallback")]).collect()}
    assert got["b.pdf", 2] == ("[REDACTED] now", 1) and got["c.bin", 1] == ("fallback", 0)
    assert [k for k in got if k[0] == "A.DOCX"] and {k[1] for k in got if k[0] == "A.DOCX"} == {1, 2, 3}
    assert got["A.DOCX", 1][0].startswith("## p0\np1") and got["A.DOCX", 3][0] == "p60\n\n| k | v |\n| --- | --- |\n| 1 | 2 |"
    spark.dataSource.register(d.DocxSource)
    assert spark.read.format("docx").load(str(tmp_path / "A.DOCX")).count() == 3
    (tmp_path / "folder" / "below").mkdir(parents=True)
    (tmp_path / "folder" / "below" / "B.docx").write_bytes(body)
    (tmp_path / "folder" / "c.txt").write_bytes(b"passed over")
    for path in (f"{tmp_path}/folder", f"file://{tmp_path}/folder"):
        assert spark.read.format("docx").load(path).count() == 3


def test_item_pages(spark):
    rows = [("f", 0, 1, "a"), ("f", 1, 2, "b"), ("f", 2, 1, "c"), ("g", 0, 1, "only")]
    got = sorted(map(tuple, d.item_pages(spark.createDataFrame(rows, "path string, item_ord int, page_number int, text string")).collect()))
    assert got == [("f", 1, "a\n\nc"), ("f", 2, "b")]


def test_page_of_an_item(spark):
    schema = "item struct<prov:array<struct<page_no:int,page:int,page_number:int>>,origin:struct<page_no:int,page:int,page_number:int>>"
    none = (None, None, None)
    rows = [([(None, 3, 4), (9, 9, 9)], (5, 5, 5)), ([none], (None, None, 6)), ([], (7, None, None)), (None, None), ([none], none)]
    got = [r["p"] for r in spark.createDataFrame([(r,) for r in rows], schema).select(d.item_page().alias("p")).collect()]
    assert got == [3, 6, 7, 1, 1]


def test_the_next_parser_reads_what_one_cannot(spark):
    calls = []
    first = lambda x: calls.append(x) or ([(1, "one")] if x == b"a" else [(1, "  ")] if x == b"b" else 1 / 0)
    p = d.first_that_reads(None, first, lambda x: [(2, "two")])
    assert [p(x) for x in (b"a", b"b", b"c")] == [[(1, "one")], [(2, "two")], [(2, "two")]] and calls == [b"a", b"b", b"c"]
    assert d.first_that_reads(first)(b"c") == []


def test_indexing_files_by_session(spark):
    rows = [("s1", 0, "x.docx", docx([("para", "")], None)), ("s1", 1, "y.pdf", b"p1;p2"), ("s2", 0, "z.pdf", b"q")]
    files = spark.createDataFrame(rows, "session_id string, file_ord int, path string, content binary")
    pages, chunks = d.index_files(files, pdf=lambda x: [(i + 1, t) for i, t in enumerate(x.decode().split(";"))])
    assert pages.count() == 4
    got = sorted((r["session_id"], r["chunk_ord"], r["page_number"], r["text"]) for r in chunks.collect())
    assert got == [("s1", 0, 1, "para"), ("s1", 1, 1, "p1"), ("s1", 2, 2, "p2"), ("s2", 0, 1, "q")]
    assert d.index_files(files, max_chunks=2, pdf=lambda x: [(1, x.decode())])[1].count() == 3
    assert d.index_pdf(files.filter("path = 'z.pdf'").select("path", "content"), pdf=lambda x: [(1, x.decode())])[1].count() == 1


def test_streams(spark, tmp_path):
    pages = [("s1", 0, 1, "# a jailbreak\n# b"), ("s2", 0, 1, "plain")]
    spark.createDataFrame(pages, ingest.PAGES).write.parquet(f"file://{tmp_path}/in")
    ingest.ingest(ingest.pages_stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    got = sorted((r["session_id"], r["text"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [("s1", "# a [REDACTED]"), ("s1", "# b"), ("s2", "plain")]
    schema = "session_id string, turn_no long, question string, answer string"
    spark.createDataFrame([("s", i, f"q{i}", f"a{i}") for i in range(7)], schema).coalesce(1).write.parquet(f"file://{tmp_path}/turns")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/turns")
    q = history.with_history(stream).writeStream.format("memory").queryName("turn_history").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp2").start()
    q.awaitTermination()
    got = sorted((r["turn_no"], r["n_history"], r["last_question"]) for r in spark.sql("select * from turn_history").collect())
    assert got[0] == (0, 0, None) and got[6] == (6, 5, "q5")


def test_strip_is_linear(spark):
    import time

    from quillstream.functions.text import strip

    texts = ["a" + " " * 1_000_000 + "b", " " * 1_000_000, " x\n", " \x1c y  ", "", "z"]
    start = time.time()
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t"))).collect()]
    assert got == [t.strip() for t in texts] and time.time() - start < 20
