"""Office documents: Python table functions over file contents, one file at a time.

The functions take an archive apart, member by member and element by element, with the standard library; what
the names of members and the references of cells mean is told by built-in functions afterwards.  The size of
members is capped by ``MAX_MEMBER`` so that a crafted archive can't fill a worker, and documents with a DOCTYPE
are refused, wherever before the root it is and in any encoding, which rules out entity expansion.

A file that can't be read gives one row with ``error`` alone.  By default that fails the query;
with ``permissive`` such files have no rows, and ``unreadable`` lists them.
"""

from __future__ import annotations

import contextlib
import functools
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import cell_column, cell_row, slide_number

MAX_MEMBER = 256 << 20
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, NotImplementedError, EOFError)


class _Prolog:
    """Reads a member up to its root, the only place for a DOCTYPE, and refuses that."""

    def __init__(self, member: str):
        self.member, self.open, self.parser = member, True, expat.ParserCreate()
        self.parser.StartDoctypeDeclHandler, self.parser.StartElementHandler = self._refuse, self._root

    def _refuse(self, *declared) -> None:
        raise ValueError(f"{self.member} declares a document type")

    def _root(self, *started) -> None:
        self.open = False

    def feed(self, data: bytes) -> None:
        if self.open:
            with contextlib.suppress(expat.ExpatError):  # the parser of the elements says it
                self.parser.Parse(data, not data)


def _elements(z: zipfile.ZipFile, member: str, *wanted: str) -> Iterator[tuple[str, ElementTree.Element]]:
    """(local name, element) of a member's wanted elements as each ends.  Parsers may hold back what a long token
    is part of until the end, so events are read once more after it."""
    if z.getinfo(member).file_size > MAX_MEMBER:
        raise ValueError(f"{member} is larger than {MAX_MEMBER} bytes")
    with z.open(member) as f:
        parser, prolog = ElementTree.XMLPullParser(["end"]), _Prolog(member)
        data = b" "
        while data:
            data = f.read(1 << 16)
            prolog.feed(data)
            parser.feed(data) if data else parser.close()
            for _, e in parser.read_events():
                local = e.tag.rpartition("}")[2]
                if local in wanted:
                    yield local, e


def _child(e: ElementTree.Element, local: str) -> str | None:
    """Text of the first child of that name; None without one."""
    return next((x.text or "" for x in e if x.tag.rpartition("}")[2] == local), None)


def _guarded(width: int):
    """Makes a function of an archive into a table function's ``eval``; failures become a last column of one row."""

    def wrap(rows):
        @functools.wraps(rows)
        def eval_(self, content: bytes):
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                    yield from ((*r, None) for r in list(rows(self, z)))
            except BROKEN as e:
                yield (*[None] * width, f"{type(e).__name__}: {e}")

        return eval_

    return wrap


@udtf(returnType="member string, size long, error string")
class ZipMembers:
    """Names and sizes of an archive's members."""

    @_guarded(2)
    def eval(self, z):
        return ((i.filename, i.file_size) for i in z.infolist())


@udtf(returnType="member string, nth int, ref string, value string, error string")
class XlsxCells:
    """All cells with a value: the sheet's member, the row's place among rows with values, the cell's reference.  A
    shared string is its own direct text, without that of rich runs; an index beyond the strings keeps the number."""

    @_guarded(4)
    def eval(self, z):
        names = z.namelist()
        strings = [_child(si, "t") or "" for _, si in _elements(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        for member in names:
            if member.startswith("xl/worksheets/sheet") and member.endswith(".xml"):
                nth = 0
                for _, row in _elements(z, member, "row"):
                    own = [(c.get("r", ""), _child(c, "v"), c.get("t")) for c in row if c.tag.rpartition("}")[2] == "c"]
                    own = [(ref, v, kind) for ref, v, kind in own if v]
                    for ref, v, kind in own:
                        shared = kind == "s" and v.isdecimal() and int(v) < len(strings)
                        yield member, nth, ref, strings[int(v)] if shared else v
                    nth += bool(own)
                    row.clear()


@udtf(returnType="ord int, text string, error string")
class DocxTexts:
    """Text runs of the main part, in order."""

    @_guarded(2)
    def eval(self, z):
        return enumerate(t.text for _, t in _elements(z, "word/document.xml", "t") if t.text)


@udtf(returnType="member string, text string, error string")
class PptxTexts:
    """Text of each slide that has any."""

    @_guarded(2)
    def eval(self, z):
        for member in z.namelist():
            if member.startswith("ppt/slides/slide") and member.endswith(".xml"):
                runs = [t.text for _, t in _elements(z, member, "t") if t.text]
                if runs:
                    yield member, " ".join(runs)


@udtf(returnType="page int, text string, error string")
class PdfPages:
    """Text of each page; needs the optional package pymupdf."""

    def eval(self, content: bytes):
        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("reading PDF needs the package pymupdf, which isn't installed") from e
        try:
            with pymupdf.open(stream=content or b"", filetype="pdf") as doc:
                pages = [(i + 1, page.get_text(), None) for i, page in enumerate(doc)]
        except (RuntimeError, ValueError) as e:  # what the package raises for broken files
            pages = [(None, None, f"{type(e).__name__}: {e}")]
        yield from pages


FUNCTIONS = {"zip_members": ZipMembers, "xlsx_cells": XlsxCells, "docx_texts": DocxTexts, "pptx_texts": PptxTexts, "pdf_pages": PdfPages}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL, for use with LATERAL."""
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)


def _lateral(files: DataFrame, function: str) -> DataFrame:
    register(files.sparkSession)
    return files.sparkSession.sql(f"SELECT f.path, t.* FROM {{files}} f, LATERAL {function}(f.content) t", files=files)


def _rows(files: DataFrame, function: str, permissive: bool) -> DataFrame:
    found = _lateral(files, function)
    if permissive:
        return found.where("error is null").drop("error")
    stop: Column = F.raise_error(F.concat("path", F.lit(": "), "error")).cast("boolean")
    return found.where(F.when(F.col("error").isNull(), True).otherwise(stop)).drop("error")


def unreadable(files: DataFrame, function: str) -> DataFrame:
    """path and error of the files that a table function can't read."""
    return _lateral(files, function).where("error is not null").select("path", "error")


def members(files: DataFrame, prefix: str = "", suffix: str = "", permissive: bool = False) -> DataFrame:
    """path, member and size of archives (path, content) whose members begin and end so."""
    return _rows(files, "zip_members", permissive).where(F.col("member").startswith(prefix) & F.col("member").endswith(suffix))


def cells(files: DataFrame, permissive: bool = False) -> DataFrame:
    """path, sheet, row_num, col and value of all cells with a value.  Sheets are numbered by the digits in their
    names; a cell without a row in its reference is in the row's place."""
    sheet = F.coalesce(F.regexp_extract("member", r"sheet(\d*)\.xml$", 1).try_cast("int"), F.lit(0))
    found = _rows(files, "xlsx_cells", permissive).where(F.col("member").rlike(r"^xl/worksheets/sheet\d*\.xml$"))
    return found.select("path", sheet.alias("sheet"), F.coalesce(cell_row(F.col("ref")), "nth").alias("row_num"), cell_column(F.col("ref")).alias("col"), "value")


def first_sheet(files: DataFrame, header: str = "letters") -> DataFrame:
    """The first sheet of one workbook as a table of strings.

    ``letters``: columns are the letters of the first row's cells, which is dropped; ``first_row``: they
    are its values.  Cells of other columns are dropped, gaps are empty.  The column letters, which the
    format bounds at 16,384, come to the driver as the names of the result."""
    grid = cells(files)
    grid = grid.join(grid.agg(F.min("sheet").alias("sheet")), "sheet")
    top = grid.join(grid.agg(F.min("row_num").alias("row_num")), "row_num").select("col", "value").distinct().collect()
    names = {r.col: r.value if header == "first_row" else r.col for r in sorted(top, key=lambda r: (len(r.col), r.col))}
    if not names:
        return grid.select("row_num").limit(0)
    first = grid.agg(F.min("row_num")).first()[0]
    wide = grid.where(F.col("row_num") > first).groupBy("row_num").pivot("col", list(names)).agg(F.first("value"))
    return wide.orderBy("row_num").select("row_num", *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in names.items()])


def joined(texts: DataFrame, separator: str, value: str = "text") -> DataFrame:
    """path and text: the pieces of each file in order, with a separator."""
    pieces = F.array_sort(F.collect_list(F.struct("ord", value)))
    return texts.groupBy("path").agg(F.array_join(F.transform(pieces, lambda x: x[value]), separator).alias("text"))


def docx_text(files: DataFrame, permissive: bool = False) -> DataFrame:
    return joined(_rows(files, "docx_texts", permissive), " ")


def pptx_text(files: DataFrame, numeric: bool = False, permissive: bool = False) -> DataFrame:
    """``Slide N: ...`` lines by member name, or by slide number."""
    number = slide_number(F.col("member"))
    place = F.struct(F.coalesce(number.try_cast("int"), F.lit(2147483647)).alias("n"), "member") if numeric else F.struct("member")
    slides = _rows(files, "pptx_texts", permissive)
    return joined(slides.select("path", place.alias("ord"), F.concat(F.lit("Slide "), number, F.lit(": "), "text").alias("line")), "\n", "line")


def pdf_text(files: DataFrame, permissive: bool = False) -> DataFrame:
    """path, text and page_count."""
    pages = _rows(files, "pdf_pages", permissive).withColumnRenamed("page", "ord")
    return joined(pages, "\n").join(pages.groupBy("path").agg(F.count("*").alias("page_count")), "path")
