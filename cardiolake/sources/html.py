"""Tables and lists of HTML pages as rows of cells, by their tags: spans, nesting, end tags that are left out."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Tags of a table, its rows and its cells; a list is one row of a table.
TABLES, LISTS = (("table",), ("tr",), ("td", "th")), (("ul", "ol"), (), ("li",))
# Fixed value: the most columns and rows that a span may cover.
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534


class _Open:
    """A table that is being read: its number, finished rows, the row and cell that are open, and cells that reach into later rows."""

    def __init__(self, number: int):
        self.number, self.rows = number, 0
        self.row: list[str | None] | None = None
        self.cell: list[str] | None = None
        self.spans = (1, 1)
        self.below: dict[int, tuple[int, str]] = {}
        self.next: dict[int, tuple[int, str]] = {}


class RowParser(HTMLParser):
    """Feeds on a page; `found` gets (table, row, cells) as rows end. Text of an inner table isn't text of the outer cell."""

    def __init__(self, tags: tuple[tuple[str, ...], ...] = TABLES):
        super().__init__(convert_charrefs=True)
        self.table_tags, self.row_tags, self.cell_tags = tags
        self.open: list[_Open] = []
        self.count, self.silent = 0, 0
        self.found: list[tuple[int, int, list[str | None]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        elif tag in self.table_tags:
            self.open.append(_Open(self.count))
            self.count += 1
        elif self.open and tag in self.row_tags:
            self._end_row()
            self._begin_row()
        elif self.open and tag in self.cell_tags:
            self._end_cell()
            top = self.open[-1]
            if top.row is None:
                self._begin_row()
            known = dict(attrs)
            size = lambda name, most: min(max(int(v), 1), most) if (v := (known.get(name) or "").strip()).isdecimal() else 1
            top.cell, top.spans = [], (size("rowspan", MOST_ROWS), size("colspan", MOST_COLUMNS))
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(self.silent - 1, 0)
        elif self.open and tag in self.cell_tags:
            self._end_cell()
        elif self.open and tag in self.row_tags:
            self._end_row()
        elif self.open and tag in self.table_tags:
            self._end_table()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].cell is not None and not self.silent:
            self.open[-1].cell.append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self._end_table()

    def _begin_row(self) -> None:
        self.open[-1].row = []
        self._reach()

    def _reach(self) -> None:
        """Cells of earlier rows that cover the next columns."""
        top = self.open[-1]
        while (place := len(top.row)) in top.below:
            rest, text = top.below.pop(place)
            if rest > 1:
                top.next[place] = (rest - 1, text)
            top.row.append(text)

    def _end_cell(self) -> None:
        top = self.open[-1]
        if top.cell is None:
            return
        text = " ".join("".join(top.cell).split())
        down, across = top.spans
        for _ in range(across):
            if down > 1:
                top.next[len(top.row)] = (down - 1, text)
            top.row.append(text)
        top.cell = None
        self._reach()

    def _end_row(self) -> None:
        self._end_cell()
        top = self.open[-1]
        if top.row is not None:
            self.found.append((top.number, top.rows, top.row))
            top.rows += 1
            # columns behind a short row's end are covered, too
            top.next |= {place: (rest - 1, text) for place, (rest, text) in top.below.items() if rest > 1}
            top.below, top.next = top.next, {}
        top.row = None

    def _end_table(self) -> None:
        self._end_row()
        self.open.pop()


def html_rows(pages: DataFrame, html: str = "html", tags: tuple[tuple[str, ...], ...] = TABLES) -> DataFrame:
    """pages without html, with table, row (both from 0, tables in the order of their start tags) and cells of each row.

    A cell over several rows or columns is repeated in each; a page that is null or has no table gives no rows.
    """
    kept = [c for c in pages.columns if c not in (html, "table", "row", "cells")]
    fields = [f for f in pages.schema if f.name in kept]
    schema = StructType(fields + [StructField("table", IntegerType()), StructField("row", IntegerType()), StructField("cells", ArrayType(StringType()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, tables, rows, cells = [], [], [], []
            for i, page in enumerate(batch.column(len(kept)).to_pylist()):
                parser = RowParser(tags)
                parser.feed(page or "")
                parser.close()
                for table, row, texts in parser.found:
                    owner.append(i)
                    tables.append(table)
                    rows.append(row)
                    cells.append(texts)
            own = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(tables, pa.int32()), pa.array(rows, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=[*kept, "table", "row", "cells"])

    return pages.select(*kept, html).mapInArrow(parse, schema)


def read_summary_rows(spark: SparkSession, glob: str) -> DataFrame:
    """file, table, row and cells of the tables in HTML files: published tables as data."""
    text = spark.read.text(glob, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value")
    return html_rows(text, "value")
