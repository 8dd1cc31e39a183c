"""Files to pages: binary files, DOCX (standard library), pluggable PDF parsers.

Files are read by Spark's ``binaryFile`` source, so any store that the session
can read will do.  Parsing runs on executors, one file at a time; a file that
cannot be parsed gives no page.  All pages are sanitised before they go on.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import strip
from ..operators.chunking import MAX_CHUNKS, cap_files, chunk_pages, marked_pages, virtual_pages
from ..operators.guard import sanitize

PAGES = "path string, page_number int, text string"
ITEMS_ON_PAGE = 30
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)\z", 1))


def accepted_upload(name: Column) -> Column:
    """Whether the service takes a file: extension .pdf or .docx in any case."""
    return extension(name).isin(".pdf", ".docx")


def client_accepted(name: Column) -> Column:
    """Whether the client offers a file: the same extensions, in lower case only."""
    return name.endswith(".pdf") | name.endswith(".docx")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _text(node) -> str:
    return "".join((x.text or "") if x.tag == _W + "t" else "\n" if x.tag in (_W + "br", _W + "cr") else "\t" if x.tag == _W + "tab" else "" for x in node.iter())


def docx_items(content: bytes) -> list[str]:
    """Items of a DOCX body: non-blank paragraphs (headings marked), then all tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(_W + "style"):
                name = style.find(_W + "name")
                names[style.get(_W + "styleId")] = name.get(_W + "val") if name is not None else ""
    items = []
    for p in body.findall(_W + "p"):
        text = _text(p).strip()
        if text:
            style = p.find(f"{_W}pPr/{_W}pStyle")
            name = names.get(style.get(_W + "val"), style.get(_W + "val")) if style is not None else ""
            items.append(f"\n## {text}" if (name or "").lower().startswith("heading") else text)
    for t in body.findall(_W + "tbl"):
        rows = [[_text(c).strip().replace("\n", " ") for c in r.findall(_W + "tc")] for r in t.findall(_W + "tr")]
        if rows:
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            lines.insert(1, "| " + " | ".join(["---"] * len(rows[0])) + " |")
            items.append("\n" + "\n".join(lines) + "\n")
    return items


def docx_pages(content: bytes) -> list[tuple[int, str]]:
    """Pages of 30 items: item i stands on page i // 30 + 1."""
    items = docx_items(content)
    pages = [(k // ITEMS_ON_PAGE + 1, "\n".join(items[k : k + ITEMS_ON_PAGE]).strip()) for k in range(0, len(items), ITEMS_ON_PAGE)]
    return [p for p in pages if p[1]]


#: Files that a task holds as Python objects, with their pages.
FILES_AT_ONCE = 64


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, FILES_AT_ONCE):
            yield batch.slice(at, FILES_AT_ONCE)


Parser = Callable[[bytes], list[tuple[int, str]]]


def parse(files: DataFrame, parser: Parser) -> DataFrame:
    """PAGES of ``files`` (path, content); files that the parser rejects give none."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in _slices(batches):
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    pages = parser(content)
                except Exception:  # noqa: BLE001  a broken file is not an error of the job
                    pages = []
                rows += [(path, n, text) for n, text in pages if text.strip()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["path", "page_number", "text"])

    return files.select("path", "content").mapInArrow(run, PAGES)


ATTEMPTS = f"{PAGES}, stage string, reason string"


def attempts(files: DataFrame, *stages: tuple[str, Parser | None]) -> DataFrame:
    """ATTEMPTS of ``files`` (path, content): the pages of the first of the named ``stages``
    that makes one, and a row without page for every stage that failed, with the reason.

    A file that no stage found any text in has a row of the last one: no file vanishes."""
    real = [(name, parser) for name, parser in stages if parser is not None]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in _slices(batches):
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pages, failed, stage = [], False, None
                for stage, parser in real:
                    try:
                        pages = [p for p in parser(content) if p[1].strip()]
                    except Exception as e:  # noqa: BLE001  told in a row
                        rows.append((path, None, None, stage, f"{type(e).__name__}: {e}"[:500]))
                        failed = True
                    if pages:
                        break
                    failed = failed and stage == real[-1][0]
                rows += [(path, n, text, None, None) for n, text in pages]
                if not pages and not failed:
                    rows.append((path, None, None, stage, "no text" if real else "no parser"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], [c.split()[0] for c in ATTEMPTS.split(", ")])

    return files.select("path", "content").mapInArrow(run, ATTEMPTS)


def read_attempts(files: DataFrame, pdf: Parser | None = None, pdf_fallback: Parser | None = None, counts: Observation | None = None) -> DataFrame:
    """Like ``read_documents``, with failures: ATTEMPTS and n_redactions of every file.
    ``counts`` is told n_pages and n_failures by whatever job reads the result."""
    is_docx = extension(F.col("path")) == ".docx"
    rows = attempts(files.filter(is_docx), ("docx", docx_pages)).unionByName(attempts(files.filter(~is_docx | is_docx.isNull()), ("pdf", pdf), ("pdf_fallback", pdf_fallback)))
    rows = rows.withColumn("z", F.when(F.col("text").isNotNull(), sanitize(F.col("text")))).select("path", "page_number", F.col("z.text").alias("text"), "stage", "reason", F.col("z.n").alias("n_redactions"))
    if counts is not None:
        rows = rows.observe(counts, F.count_if(F.col("stage").isNull()).alias("n_pages"), F.count_if(F.col("stage").isNotNull()).alias("n_failures"))
    return rows


def first_that_reads(*parsers: Parser | None) -> Parser:
    """A parser that tries others in turn, in one task, until one makes a page; one
    that fails made none."""

    def run(content: bytes) -> list[tuple[int, str]]:
        for parser in parsers:
            try:
                pages = [p for p in parser(content) if p[1].strip()] if parser else []
            except Exception:  # noqa: BLE001  the next one may read it
                pages = []
            if pages:
                return pages
        return []

    return run


def read_documents(files: DataFrame, pdf: Parser | None = None, pdf_fallback: Parser | None = None) -> DataFrame:
    """PAGES and n_redactions of ``files``: .docx by name, anything else as PDF.

    ``pdf`` and ``pdf_fallback``: parsers of bytes to (page number, text); the
    second sees only files of which the first made no page.  A parser of layouts
    makes its pages with ``layout_pages``."""
    is_docx = extension(F.col("path")) == ".docx"
    pages = parse(files.filter(is_docx), docx_pages)
    if pdf is not None or pdf_fallback is not None:
        pages = pages.unionByName(parse(files.filter(~is_docx), first_that_reads(pdf, pdf_fallback)))
    return pages.withColumn("z", sanitize(F.col("text"))).select("path", "page_number", F.col("z.text").alias("text"), F.col("z.n").alias("n_redactions"))


def item_page(item: str = "item") -> Column:
    """Page of a layout item: the first of its provenance's or origin's page numbers, 1 by default."""
    places = F.get(F.col(item)["prov"], F.lit(0)), F.col(item)["origin"]
    return F.coalesce(*[p[n] for p in places for n in ("page_no", "page", "page_number")], F.lit(1)).cast("int")


_PAGE = "array<struct<page_number:int,text:string>>"


def pages_of_items(items: Column) -> Column:
    """array<struct<page_number, text>> of layout items, array<struct<page_number, text>>
    in reading order: the items of a page with blank lines between, blank items dropped."""
    stripped = F.transform(items, lambda i: F.struct(i["page_number"].cast("int").alias("page_number"), strip(i["text"]).alias("text")))
    some = F.filter(stripped, lambda i: i["text"] != "")
    numbers = F.array_sort(F.array_distinct(F.transform(some, lambda i: i["page_number"])))
    return F.transform(numbers, lambda n: F.struct(n.alias("page_number"), F.array_join(F.transform(F.filter(some, lambda i: i["page_number"] == n), lambda i: i["text"]), "\n\n").alias("text"))).cast(_PAGE)


def item_pages(items: DataFrame) -> DataFrame:
    """path, page_number, text from layout items (path, item_ord, page_number, text),
    for files whose items lie on more than one page."""
    listed = items.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("item_ord", "page_number", "text"))).alias("x"))
    pages = listed.select("path", pages_of_items(F.col("x")).alias("pages"))
    return pages.filter(F.size("pages") > 1).select("path", F.inline("pages"))


def layout_pages(items: Column, markdown: Column, pages: Column) -> Column:
    """array<struct<page_number, text>> of a layout parser's document: the first rung
    that holds of

    1. its items, if they lie on more than one page;
    2. its text cut by page marks, if that makes more than one page;
    3. its own pages' texts, those that aren't blank;
    4. virtual pages of its text; nothing if there is no text.
    """
    by_item, marked = pages_of_items(F.coalesce(items, F.array().cast(_PAGE))), marked_pages(markdown)
    own = F.filter(F.transform(F.coalesce(pages, F.array().cast("array<string>")), lambda t, i: F.struct((i + 1).alias("page_number"), strip(t).alias("text"))), lambda p: p["text"] != "")
    some = F.coalesce(markdown, F.lit("")) != ""
    return (
        F.when(F.size(by_item) > 1, by_item)
        .when(some & (F.size(marked) > 1), marked.cast(_PAGE))
        .when(F.size(own) > 0, own.cast(_PAGE))
        .when(some, virtual_pages(markdown).cast(_PAGE))
        .otherwise(F.array().cast(_PAGE))
    )


def text_pages(texts: DataFrame) -> DataFrame:
    """path, page_number, text of plain texts (path, text) by virtual pages."""
    return texts.select("path", F.inline(virtual_pages(F.col("text"))))


def index_files(files: DataFrame, session: str = "session_id", max_chunks: int = MAX_CHUNKS, **parsers) -> tuple[DataFrame, DataFrame]:
    """Pages and chunks of ``files`` (session, file_ord, path, content), chunks capped
    by file and by session; ``parsers`` as of ``read_documents``."""
    names = files.select("path", session, "file_ord").distinct()
    pages = read_documents(files, **parsers).join(names, "path")
    chunks = chunk_pages(pages, max_chunks=max_chunks, file=(session, "file_ord"))
    return pages, cap_files(chunks, session, max_chunks)


def index_pdf(content: DataFrame, **parsers) -> tuple[DataFrame, DataFrame]:
    """``index_files`` of a single file (path, content), a session of its own."""
    return index_files(content.withColumns({"session_id": F.lit("doc"), "file_ord": F.lit(0)}), **parsers)


class DocxSource(DataSource):
    """``spark.read.format("docx").load(path)``: PAGES of a DOCX file or of those in a folder and
    below it, an absolute path that every executor has or an address of a store that Arrow
    can read (``file:``, ``hdfs:``, ``s3:``, ``gs:``).  Other stores are read by ``read_files``
    and ``read_documents``."""

    @classmethod
    def name(cls):
        return "docx"

    def schema(self):
        return PAGES

    def reader(self, schema):
        return _DocxReader(self.options["path"])


class _DocxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def partitions(self):
        from pyarrow import fs

        store, path = self._store()
        found = store.get_file_info(path)
        infos = store.get_file_info(fs.FileSelector(path, recursive=True)) if found.type == fs.FileType.Directory else [found]
        return [InputPartition(i.path) for i in sorted(infos, key=lambda i: i.path) if i.type == fs.FileType.File and i.path.lower().endswith(".docx")]

    def read(self, partition):
        with self._store()[0].open_input_stream(partition.value) as f:
            for n, text in docx_pages(f.read()):
                yield partition.value, n, text
