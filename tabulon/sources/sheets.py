"""Spreadsheet and CSV files as one table of cells; a workbook is read by one task, a delimited file by many, none by the driver.

A cell row is (file, sheet, row, col, text, number): blanks aren't rows, merged cells repeat their first cell's
value, text is trimmed, number is null for cells that aren't numbers (truth values and dates among them). What
can't be read becomes a row with a warning, so one bad file doesn't stop the others. A workbook has to fit a task.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.tables import ship

GRID = "file string, sheet string, row int, col int, text string, number double, warning string"
# Suffixes and encodings in the order in which they are tried.
WORKBOOKS, DELIMITED = ("xlsx", "xlsm"), ("csv", "txt")
UNREADABLE = ("xls", "ods", "xlsb", "numbers")
ENCODINGS = ("utf-8-sig", "cp950", "utf-8", "big5")

_PLAIN = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")
_DATES = {*range(14, 23), *range(45, 48)}


def coerce(text: str | None) -> tuple[str, float | None] | None:
    """Trimmed text and number of a cell: thousands commas go, (1,234) is negative; None for a blank."""
    text = (text or "").strip()
    if not text:
        return None
    bare = text.replace(",", "")
    inside = bare[1:-1] if bare.startswith("(") and bare.endswith(")") else None
    if inside is not None and _PLAIN.fullmatch(inside):
        return text, -float(inside)
    return text, float(bare) if _PLAIN.fullmatch(bare) else None


def decode(content: bytes) -> str:
    """The text by the first encoding that fits all of it."""
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"none of {', '.join(ENCODINGS)} fits")


def csv_cells(content: bytes) -> Iterator[tuple[int, int, str, float | None]]:
    csv.field_size_limit(1 << 30)
    for r, line in enumerate(csv.reader(io.StringIO(decode(content), newline="")), 1):
        for c, value in enumerate(line, 1):
            if (found := coerce(value)) is not None:
                yield r, c, *found


def place(ref: str) -> tuple[int, int]:
    """Row and column of an A1 address."""
    letters = ref.rstrip("0123456789")
    col = 0
    for x in letters.replace("$", ""):
        col = col * 26 + ord(x.upper()) - 64
    return int(ref[len(letters) :]), col


class Workbook:
    """The sheets of an XLSX archive, by its XML parts."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        self.shared = [self._text(x) for x in self._parts("xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()
        targets = {x.get("Id"): x.get("Target") for x in self._parts("xl/_rels/workbook.xml.rels", "Relationship")}
        self.sheets: list[tuple[str, str]] = []
        for x in self._parts("xl/workbook.xml", "sheet"):
            target = targets[next(v for k, v in x.attrib.items() if k.endswith("}id"))]
            self.sheets.append((x.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))

    def _parts(self, name: str, tag: str) -> list[ElementTree.Element]:
        return [x for x in ElementTree.fromstring(self.zip.read(name)).iter() if x.tag.rpartition("}")[2] == tag]

    @staticmethod
    def _text(x: ElementTree.Element) -> str:
        """The runs of a string without its reading aids."""
        aid = {id(t) for p in x.iter() if p.tag.endswith("}rPh") for t in p.iter()}
        return "".join(t.text or "" for t in x.iter() if t.tag.rpartition("}")[2] == "t" and id(t) not in aid)

    def _date_styles(self) -> set[int]:
        own = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode", "")) for x in self._parts("xl/styles.xml", "numFmt")}
        dates = _DATES | {k for k, v in own.items() if re.search("[ymdhs]", v, re.I)}
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        formats = next((x for x in root.iter() if x.tag.endswith("}cellXfs")), ())
        return {i for i, x in enumerate(formats) if int(x.get("numFmtId", 0)) in dates}

    def _value(self, x: ElementTree.Element) -> tuple[str, float | None] | None:
        kind, style = x.get("t", "n"), int(x.get("s", 0))
        if kind == "inlineStr":
            return coerce_text(self._text(x))
        v = next((y.text for y in x if y.tag.rpartition("}")[2] == "v"), None)
        if v is None:
            return None
        if kind == "s":
            return coerce_text(self.shared[int(v)])
        if kind == "b":
            return ("TRUE" if v == "1" else "FALSE"), None
        if kind in ("str", "e", "d"):
            return coerce_text(v)
        number = float(v)
        if style in self.dates:
            return (dt.datetime(1899, 12, 30) + dt.timedelta(days=number)).isoformat(" "), None
        return (str(int(number)) if number.is_integer() else repr(number)), number

    def cells(self, part: str) -> Iterator[tuple[int, int, str, float | None]]:
        root = ElementTree.fromstring(self.zip.read(part))
        grid: dict[tuple[int, int], tuple[str, float | None]] = {}
        row = 0
        for line in (x for x in root.iter() if x.tag.rpartition("}")[2] == "row"):
            row, col = int(line.get("r", row + 1)), 0
            for x in line:
                row, col = place(x.get("r")) if x.get("r") else (row, col + 1)
                if (found := self._value(x)) is not None:
                    grid[row, col] = found
        for x in (x for x in root.iter() if x.tag.rpartition("}")[2] == "mergeCell"):
            (top, left), (bottom, right) = (place(p) for p in (x.get("ref").split(":") * 2)[:2])
            if (first := grid.get((top, left))) is not None:
                grid.update({(r, c): first for r in range(top, bottom + 1) for c in range(left, right + 1)})
        yield from ((r, c, *v) for (r, c), v in sorted(grid.items()))


def coerce_text(text: str) -> tuple[str, None] | None:
    """A cell that is text, whatever it looks like."""
    return (text.strip(), None) if text.strip() else None


def file_rows(name: str, content: bytes, only: set[str] | None = None) -> Iterator[tuple]:
    """Rows of GRID for one file, of the sheets in ``only`` if given; whatever is wrong with it becomes a warning."""
    stem, _, suffix = name.rpartition(".")
    if suffix.lower() in UNREADABLE:
        yield name, None, None, None, None, None, f"{suffix} files can't be read here; save as xlsx or csv"
        return
    rows: list[tuple] = []
    try:
        if suffix.lower() in DELIMITED:
            rows = [(name, stem, *x, None) for x in (csv_cells(content) if only is None or stem in only else ())]
        else:
            book = Workbook(content)
            rows = [(name, sheet, *x, None) for sheet, part in book.sheets if only is None or sheet in only for x in book.cells(part)]
    except Exception as e:  # the others are read
        rows = [(name, None, None, None, None, None, f"can't be opened: {type(e).__name__}: {e}")]
    yield from rows


def _read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in GRID.split(", ")]
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            rows = list(file_rows(path.rpartition("/")[2], bytes(content)))
            yield pd.DataFrame(rows, columns=names).astype({"row": "Int32", "col": "Int32", "number": "Float64"})


def read_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of GRID for the files in a folder; other suffixes and lock files (``~$``) are passed over.

    ``warning`` is null in cells; other rows say which file couldn't be read and why. Raises if no file is readable by
    its suffix.
    """
    from tabulon.sources.delimited import read_delimited

    ship(spark)
    known = "|".join((*WORKBOOKS, *DELIMITED, *UNREADABLE))
    files = spark.read.format("binaryFile").load(folder).where(F.col("path").rlike(rf"(?i)/(?!~\$|%7E\$)[^/]*\.({known})$"))
    kinds = {r.kind for r in files.select(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("kind")).distinct().collect()}
    if kinds <= {*UNREADABLE}:
        raise FileNotFoundError(f"no file of {', '.join((*WORKBOOKS, *DELIMITED))} in {folder}")
    whole = files.where(~F.col("path").rlike(rf"(?i)\.({'|'.join(DELIMITED)})$")).select("path", "content").repartition("path").mapInPandas(_read, GRID)
    return whole.unionByName(read_delimited(spark, folder)) if kinds & {*DELIMITED} else whole


def cells_of(grid: DataFrame) -> DataFrame:
    """The cells of ``read_grid``'s rows."""
    return grid.where("warning IS NULL").drop("warning")


def warnings_of(grid: DataFrame) -> DataFrame:
    """(file, warning) of what couldn't be read."""
    return grid.where("warning IS NOT NULL").select("file", "warning")
