"""Pages and structure-aware chunks, as native column expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, strip

CHUNK_SIZE, MAX_CHUNKS, PAGE_SIZE = 1200, 1200, 3000
#: Page markers in order; the first that cuts a text decides.
PAGE_MARKERS = [r"\f", r"(?i)<!-- pagebreak -->", r"(?i)<!-- page-break -->", r"\n---\n"]
_LIST = "array<string>"
_CHUNKS = "array<struct<kind:string,text:string>>"


def _pages(parts: Column) -> Column:
    numbered = F.transform(parts, lambda t, i: F.struct((i + 1).alias("page_number"), strip(t).alias("text")))
    return F.filter(numbered, lambda p: p["text"] != "")


def marked_pages(text: Column) -> Column:
    """array<struct<page_number, text>> by the first page marker that cuts the
    text; blank pages go, numbers stay; without a marker one page."""
    choice = F.array(F.struct(F.lit(1).alias("page_number"), strip(text).alias("text")))
    for marker in reversed(PAGE_MARKERS):
        parts = F.split(text, marker)
        choice = F.when(F.size(parts) > 1, _pages(parts)).otherwise(choice)
    return choice


def virtual_pages(text: Column, limit: int = PAGE_SIZE) -> Column:
    """array<struct<page_number, text>>: paragraphs gathered until the next would
    exceed ``limit`` characters, separators not counted."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    empty = F.array().cast(_LIST)
    start = F.struct(empty.alias("page"), F.lit(0).alias("size"), empty.alias("pages"))

    def step(a, p):
        n = F.length(p)
        full = (a["size"] + n > limit) & (F.size(a["page"]) > 0)
        done = F.concat(a["pages"], F.array(F.array_join(a["page"], "\n\n")))
        return F.when(full, F.struct(F.array(p).alias("page"), n.alias("size"), done.alias("pages"))).otherwise(
            F.struct(F.concat(a["page"], F.array(p)).alias("page"), (a["size"] + n).alias("size"), a["pages"].alias("pages"))
        )

    pages = F.aggregate(paragraphs, start, step, lambda a: F.when(F.size(a["page"]) > 0, F.concat(a["pages"], F.array(F.array_join(a["page"], "\n\n")))).otherwise(a["pages"]))
    pages = F.when(F.size(pages) > 0, pages).otherwise(F.array(strip(text)))
    return F.transform(pages, lambda t, i: F.struct((i + 1).alias("page_number"), t.alias("text")))


def sections(text: Column) -> Column:
    """Sections of a page: cut before lines that begin with one to four hashes and
    white space; stripped, blank ones dropped."""
    cut = F.split(text, r"(?mdU)(?=^#{1,4}[\s\x1c-\x1f])")
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def is_table_line(line: Column) -> Column:
    return strip(line).startswith("|")


def blocks(section: Column) -> Column:
    """Blocks of a section: maximal runs of table lines, or of other non-blank
    lines; array<string>, stripped.

    Runs are cut where the kind of line changes, so that the work grows with the
    lines, however many blocks they make."""

    def kind(line: Column) -> Column:
        return bind(strip(line), lambda x: F.when(x.startswith("|"), 1).when(x == "", 0).otherwise(2))

    def cut(lines: Column, kinds: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        changes = lambda step: F.filter(places, lambda i: (F.get(kinds, i) != 0) & ~F.get(kinds, i).eqNullSafe(F.get(kinds, i + step)))
        return F.zip_with(changes(-1), changes(1), lambda first, last: strip(F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")))

    return bind(F.split(section, "\n"), lambda lines: bind(F.transform(lines, kind), lambda kinds: cut(lines, kinds)))


def is_table(block: Column) -> Column:
    return F.size(F.filter(F.split(strip(block), "\n"), is_table_line)) >= 2


def packed(block_list: Column, limit: int = CHUNK_SIZE) -> Column:
    """Chunks of a long section from its blocks: tables whole, text gathered up to
    ``limit`` with blank lines between.  The first block of a chunk that begins
    empty counts two characters more than it has; one that follows an overflow
    does not."""
    none = F.array().cast(_CHUNKS)
    start = F.struct(F.lit("").alias("cur"), none.alias("out"))
    chunk = lambda kind, t: F.array(F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    flushed = lambda a: F.when(a["cur"] != "", F.concat(a["out"], chunk("text", strip(a["cur"])))).otherwise(a["out"])

    def step(a, b):
        fits = F.length(a["cur"]) + F.length(b) + 2 <= limit
        return (
            F.when(is_table(b), F.struct(F.lit("").alias("cur"), F.concat(flushed(a), chunk("table", b)).alias("out")))
            .when(fits, F.struct(F.concat(a["cur"], F.lit("\n\n"), b).alias("cur"), a["out"].alias("out")))
            .otherwise(F.struct(b.alias("cur"), flushed(a).alias("out")))
        )

    return F.aggregate(block_list, start, step, flushed)


def section_chunks(section: Column, limit: int = CHUNK_SIZE) -> Column:
    """array<struct<kind, text>> of one section."""
    short = F.array(F.struct(F.lit("section").alias("kind"), section.alias("text")))
    return F.when(F.length(section) <= limit, short).otherwise(packed(blocks(section), limit))


def chunk_pages(pages: DataFrame, limit: int = CHUNK_SIZE, max_chunks: int | None = MAX_CHUNKS, file: tuple[str, ...] = ("file_ord",)) -> DataFrame:
    """Chunks of ``pages`` (*file, page_number, text): *file, page_number,
    section_ord, piece_ord, chunk_ord (0-based within the file), chunk_type, text.

    ``max_chunks`` cuts each file; the window is by file, so files stay apart.
    """
    rows = pages.select(*file, F.coalesce("page_number", F.lit(1)).alias("page_number"), F.posexplode(sections(F.col("text"))).alias("section_ord", "section"))
    rows = rows.select(*file, "page_number", "section_ord", F.posexplode(section_chunks(F.col("section"), limit)).alias("piece_ord", "chunk"))
    order = Window.partitionBy(*file).orderBy("page_number", "section_ord", "piece_ord")
    rows = rows.withColumn("chunk_ord", F.row_number().over(order) - 1)
    if max_chunks is not None:
        rows = rows.filter(F.col("chunk_ord") + 1 <= max_chunks)
    return rows.select(*file, "page_number", "section_ord", "piece_ord", "chunk_ord", F.col("chunk.kind").alias("chunk_type"), F.col("chunk.text").alias("text"))


def cap_files(chunks: DataFrame, session: str, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """At most ``max_chunks`` chunks of each session, files in order; chunk_ord
    becomes the order within the session."""
    order = Window.partitionBy(session).orderBy("file_ord", "chunk_ord")
    return chunks.withColumn("chunk_ord", F.row_number().over(order) - 1).filter(F.col("chunk_ord") < max_chunks)
