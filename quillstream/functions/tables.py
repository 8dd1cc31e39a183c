"""Table functions for SQL.

    register(spark)
    SELECT * FROM chunk(TABLE(pages) PARTITION BY file_ord ORDER BY page_number)

gives what ``operators.chunking.chunk_pages`` gives for the same pages.  The plan of
column expressions is the faster form; this one is for SQL and for pages that come
in an order of one's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.chunking import CHUNK_SIZE, MAX_CHUNKS

_HEADING = re.compile(r"(?m)(?=^#{1,4}\s)")
_MADE = [StructField("section_ord", IntegerType()), StructField("piece_ord", IntegerType()), StructField("chunk_ord", IntegerType()), StructField("chunk_type", StringType()), StructField("text", StringType())]


def _table_line(line: str) -> bool:
    return line.strip().startswith("|")


def chunks_of_page(text: str, limit: int = CHUNK_SIZE) -> Iterator[tuple[int, int, str, str]]:
    """(section, piece, kind, text) of a page."""
    sections = [s for s in map(str.strip, _HEADING.split(text)) if s]
    for n, section in enumerate(sections):
        if len(section) <= limit:
            yield n, 0, "section", section
            continue
        made, held = [], ""
        lines = section.split("\n")
        for blank_or_table, run in groupby(lines, lambda x: (not x.strip(), _table_line(x))):
            block = "\n".join(run).strip()
            if blank_or_table[0]:
                continue
            table = sum(map(_table_line, block.split("\n"))) > 1
            if not table and len(held) + 2 + len(block) <= limit:
                held = f"{held}\n\n{block}"
                continue
            made += [("text", held.strip())] if held else []
            made += [("table", block)] if table else []
            held = "" if table else block
        made += [("text", held.strip())] if held else []
        yield from ((n, k, kind, t) for k, (kind, t) in enumerate(made))


@udtf
class Chunk:
    """chunk(max_chunks => n, limit => n, pages => TABLE(pages) PARTITION BY file ORDER BY page): the columns of
    the pages but for their text, and section_ord, piece_ord, chunk_ord, chunk_type, text.
    A partition is a file; ``max_chunks`` (null: none) ends it; a null page is page 1."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, limit: AnalyzeArgument | None = None, max_chunks: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pages.isTable or "text" not in pages.dataType.names:
            raise ValueError("chunk needs a table of pages with a column text")
        made = {f.name for f in _MADE}
        return AnalyzeResult(StructType([f for f in pages.dataType.fields if f.name not in made] + _MADE))

    def __init__(self):
        self.n = 0

    def eval(self, pages, limit: int = CHUNK_SIZE, max_chunks: int | None = MAX_CHUNKS):
        row = pages.asDict()
        text = row.pop("text")
        kept = [(1 if k == "page_number" and v is None else v) for k, v in row.items() if k not in ("section_ord", "piece_ord", "chunk_ord", "chunk_type")]
        for section, piece, kind, chunk in chunks_of_page(text or "", limit):
            if max_chunks is not None and self.n >= max_chunks:
                return
            yield (*kept, section, piece, self.n, kind, chunk)
            self.n += 1


def register(spark: SparkSession) -> None:
    """Make ``chunk`` known to the session's SQL."""
    spark.udtf.register("chunk", Chunk)
