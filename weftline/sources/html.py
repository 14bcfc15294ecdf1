"""Tables and list items out of HTML text, as long rows of cells."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import strip

# Parts of a table, and the limits that HTML sets to spans.
SECTIONS = ("thead", "tbody", "tfoot")
MOST_ROWS, MOST_COLUMNS = 65_534, 1_000

CELLS = "table_no int, row_no int, col_no int, text string, is_header boolean"
ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
ROWS_A_BATCH = 20_000
SPACES = " \t\n\x0b\f\r"  # what ``strip`` takes off


class _Cells(HTMLParser):
    """Collects (block, row, column, text, header) of table cells or list items."""

    def __init__(self, kind: str):
        super().__init__(convert_charrefs=True)
        self.block_tags = {"table"} if kind == "table" else {"ul", "ol"}
        self.items = kind != "table"
        self.found: list[list] = []
        self.open: list[dict] = []
        self.blocks = 0
        self.spans: list[tuple[int, int, int, bool]] = []  # of each cell: rows, columns, section, in a head

    def handle_starttag(self, tag, attrs):
        if tag in self.block_tags:
            self.open.append({"no": self.blocks, "row": -1, "col": -1, "cell": None, "section": 0, "head": False})
            self.blocks += 1
            return
        if not self.open:
            return
        at = self.open[-1]
        if tag in SECTIONS:
            at["section"] += 1
            at["head"] = tag == "thead"
        if (tag == "li") if self.items else (tag == "tr"):
            at["row"] += 1
            at["col"] = -1
            at["cell"] = None
        if tag in (("li",) if self.items else ("td", "th")):
            at["col"] += 1
            at["cell"] = [at["no"], max(at["row"], 0), at["col"], "", tag == "th"]
            self.found.append(at["cell"])
            told = dict(attrs)
            # a row span of 0 reaches to the end of its section; a column span of 0 is 1
            rows = min(_whole(told.get("rowspan"), 1), MOST_ROWS)
            self.spans.append((rows, min(max(_whole(told.get("colspan"), 1), 1), MOST_COLUMNS), at["section"], at["head"]))

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag in self.block_tags:
            self.open.pop()
        elif tag in SECTIONS:
            self.open[-1]["section"] += 1
            self.open[-1]["head"] = False
        elif tag in ("td", "th", "li"):
            self.open[-1]["cell"] = None

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"][3] += data


def _whole(text: str | None, otherwise: int) -> int:
    """The number an attribute begins with."""
    digits = re.match(r"\s*\+?(\d+)", text or "")
    return int(digits[1]) if digits else otherwise


def _tables(page: str) -> Iterator[tuple[int, dict[int, list]]]:
    """Each table's number and, by row, its cells with their spans."""
    walker = _Cells("table")
    walker.feed(page or "")
    walker.close()
    tables: dict[int, dict[int, list]] = {}
    for cell, span in zip(walker.found, walker.spans, strict=True):
        tables.setdefault(cell[0], {}).setdefault(cell[1], []).append((cell, span))
    yield from sorted(tables.items())


def _grid(page: str) -> Iterator[tuple]:
    """(table, row, column, text, header, in a head row) of every place of every table, spans filled with their cell's text."""
    for no, rows in _tables(page):
        for place in _places(rows):
            yield no, *place


def _places(rows: dict[int, list]) -> Iterator[tuple]:
    """(row, column, text, header, in a head row) of every place of a table.

    A cell takes the first place of its row that no cell of an earlier row reaches into.  Rows of a head are those of
    ``thead``, or else the leading rows that hold header cells only.
    """
    carried: dict[int, list] = {}  # column: [rows left (None: to the end of the section), cell, section, head]
    heads = any(span[3] for cells in rows.values() for _, span in cells)
    leading = True
    for r in sorted(rows):
        section = rows[r][0][1][2]
        carried = {c: x for c, x in carried.items() if x[0] is not None or x[2] == section}
        placed = {c: x[1] for c, x in carried.items()}
        carried = {c: [x[0] if x[0] is None else x[0] - 1, *x[1:]] for c, x in carried.items() if x[0] is None or x[0] > 1}
        c = 0
        for cell, (down, across, _, _) in rows[r]:
            while c in placed:
                c += 1
            for k in range(c, c + across):
                if k in placed:  # overlapping spans: the earlier cell stays
                    continue
                placed[k] = cell
                if down != 1:
                    carried[k] = [None if down == 0 else down - 1, cell, section]
            c += across
        leading = leading and all(cell[4] for cell in placed.values())
        in_head = rows[r][0][1][3] if heads else leading
        for c, cell in sorted(placed.items()):
            yield r, c, cell[3], cell[4], in_head


def _records(page: str, sep: str) -> Iterator[tuple]:
    """(table, row, column, name, text) of the body places of every table; places are gone through twice, not kept."""
    for no, rows in _tables(page):
        told: dict[int, dict[str, None]] = {}
        for _, c, text, _, in_head in _places(rows):
            if in_head and (known := text.strip(SPACES)):
                told.setdefault(c, {})[known] = None
        names = {c: sep.join(texts) for c, texts in told.items()}
        for r, c, text, _, in_head in _places(rows):
            if not in_head:
                yield no, r, c, names.get(c, ""), text


def html_grid(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """One row per place of each table, with ``rowspan`` and ``colspan`` filled in, so that columns line up.

    ``is_head`` says whether the row belongs to the table's head.
    """
    return _per_page(pages, page_id, html, _grid, f"{CELLS}, is_head boolean")


def grid_records(grid: DataFrame, page_id: str, sep: str = " / ") -> DataFrame:
    """Body cells with the name of their column: the different texts of its head rows from top to bottom, joined by ``sep``.

    A table without a head has empty names; a long table of (page, table_no, row_no, col_no, name, text).
    For a grid that is stored: it is read twice.  ``html_records`` gives the same from pages in one pass.
    """
    at = [page_id, "table_no", "col_no"]
    told = F.transform(F.sort_array(F.collect_list(F.struct("row_no", "text"))), lambda r: r["text"])
    different = F.filter(F.array_distinct(told), lambda t: t != "")
    names = grid.filter("is_head").groupBy(*at).agg(F.array_join(different, sep).alias("name"))
    body = grid.filter(~F.col("is_head")).join(names, at, "left")
    return body.select(*at[:2], "row_no", "col_no", F.coalesce("name", F.lit("")).alias("name"), "text")


def html_records(pages: DataFrame, page_id: str, html: str, sep: str = " / ") -> DataFrame:
    """``grid_records`` of the pages' grids, named while a page is parsed, so that no page is parsed twice or joined."""
    columns = "table_no int, row_no int, col_no int, name string, text string"
    return _per_page(pages, page_id, html, lambda page: _records(page, sep), columns)


def _walk(page: str, kind: str) -> list[list]:
    walker = _Cells(kind)
    walker.feed(page or "")
    walker.close()
    return walker.found


def _matching(cells: list[list], text: str) -> list[list]:
    """Cells of those tables in which some cell holds ``text``."""
    hits = {cell[0] for cell in cells if text in cell[3].strip(SPACES)}
    return [cell for cell in cells if cell[0] in hits]


def _per_page(pages: DataFrame, page_id: str, html: str, found: Callable[[str], Iterable[tuple]], columns: str) -> DataFrame:
    """Each page's id beside the rows that ``found`` gives for its text.

    Parsing costs far more than reading, and one file of pages is often one partition: so pages are dealt evenly over
    as many tasks as a shuffle has (every core at least), whatever files they come from.  Rows leave a task in batches
    of bounded length; ids stay in Arrow.
    """
    spark = pages.sparkSession
    id_type = pages.schema[page_id].dataType.simpleString()
    names = [page_id, *[c.split()[0] for c in columns.split(", ")]]
    kinds = [ARROW[c.split()[1]] for c in columns.split(", ")]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((at, *row) for at, page in enumerate(batch.column(1)) for row in found(page.as_py()))
            for some in batched(rows, ROWS_A_BATCH):
                at, *values = zip(*some, strict=True)
                made = [pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *made], names)

    rows = pages.select(page_id, html).repartition(tasks).mapInArrow(run, f"`{page_id}` {id_type}, {columns}")
    return rows.withColumn("text", strip(F.col("text")))


def html_cells(pages: DataFrame, page_id: str, html: str, kind: str = "table", match: str | None = None) -> DataFrame:
    """One row per cell: (page id, table_no, row_no, col_no, text, is_header).

    ``kind='list'`` gives list items instead, one row each.  ``match`` keeps only the tables in which some cell holds
    that text; it is looked for while a page is parsed, page by page, so that no page is parsed twice or joined.
    """

    def found(page: str) -> list[list]:
        cells = _walk(page, kind)
        return cells if match is None else _matching(cells, match)

    return _per_page(pages, page_id, html, found, CELLS)


def tables_matching(cells: DataFrame, page_id: str, text: str) -> DataFrame:
    """Only the tables in which some cell holds ``text``.

    For cells that are stored: they are read twice.  ``html_cells(match=…)`` gives the same from pages in one pass.
    """
    hits = cells.filter(F.contains("text", F.lit(text))).select(page_id, "table_no").distinct()
    return cells.join(hits, [page_id, "table_no"], "left_semi")


def table_wide(cells: DataFrame, page_id: str, header_row: int, names: list[str]) -> DataFrame:
    """Cells under a header row as a frame: one row per (page, table, row), one column per name.

    The names are given, so the pivot needs no job of its own, and a column finds its name in a window, so that cells
    are read once.
    """
    at = [page_id, "table_no"]
    named = (F.col("row_no") == header_row) & F.col("is_header") & F.col("text").isin(names)
    name = F.max(F.when(named, F.col("text"))).over(Window.partitionBy(*at, "col_no"))
    return (
        cells.filter(F.col(page_id).isNotNull())
        .withColumn("__name", name)
        .filter((F.col("row_no") > header_row) & F.col("__name").isNotNull())
        .groupBy(*at, "row_no")
        .pivot("__name", names)
        .agg(F.first("text", ignorenulls=True))
    )
