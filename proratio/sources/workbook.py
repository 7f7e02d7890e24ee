"""Spreadsheet files to cell, sheet and workbook rows.

One file is one row of ``binaryFile`` and the only piece of work that cannot be
divided (the format limits its size). Sheets are read as streams and rows leave
in batches, so a task holds the file and one batch, not its cells.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 5_000

# Number formats that mean a date, and the parts that show a feature.
DATE_FORMATS = set(range(14, 23)) | {45, 46, 47}
FEATURES = {
    "has_pivot_tables": r"xl/pivotTables/", "has_pivot_caches": r"xl/pivotCache/", "has_external_links": r"xl/externalLinks/",
    "has_vba_macros": r"xl/vbaProject\.bin$", "has_charts": r"xl/charts/", "has_drawings": r"xl/drawings/",
    "has_images": r"xl/media/", "has_threaded_comments": r"xl/threadedComments/", "has_legacy_comments": r"xl/comments\d*\.xml$",
}

CELL = pa.struct([
    ("cell_ref", pa.string()), ("row_number", pa.int32()), ("column_index", pa.int32()), ("column_letters", pa.string()),
    ("cell_type", pa.string()), ("raw_value", pa.string()), ("cached_value", pa.string()), ("formula_expression", pa.string()),
    ("is_shared_formula", pa.bool_()), ("style_index", pa.int32()),
])
SHEET = pa.struct([
    ("sheet_index", pa.int32()), ("visibility", pa.string()), ("dimension_ref", pa.string()), ("n_rows", pa.int32()),
    ("n_cols", pa.int32()), ("merged_cells_count", pa.int32()), ("has_autofilter", pa.bool_()), ("table_count", pa.int32()),
    ("freeze_panes", pa.string()), ("hyperlinks_count", pa.int32()), ("comments_present", pa.bool_()),
    ("data_validations_count", pa.int32()), ("conditional_formatting_count", pa.int32()), ("has_chart_or_image", pa.bool_()),
    ("sheet_protected", pa.bool_()), ("hidden_rows", pa.list_(pa.int32())), ("hidden_cols", pa.list_(pa.int32())),
])
WORKBOOK = pa.struct(
    [("source_filename", pa.string()), ("source_size_bytes", pa.int64()), ("sheet_count", pa.int32()), ("creator", pa.string()),
     ("last_modified_by", pa.string()), ("created", pa.string()), ("modified", pa.string()), ("application", pa.string()),
     ("defined_names_count", pa.int32()), ("workbook_protected", pa.bool_()), ("table_definitions_count", pa.int32()),
     ("hidden_names", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))]
    + [(f, pa.bool_()) for f in FEATURES]
)
RECORD = pa.schema([("workbook_id", pa.string()), ("sheet_name", pa.string()), ("cell", CELL), ("sheet", SHEET), ("workbook", WORKBOOK)])


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(element, name: str) -> str | None:
    """An attribute whatever its namespace."""
    return next((v for k, v in element.attrib.items() if _name(k) == name), None)


class _Package:
    """The parts of one file."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.parts = set(self.zip.namelist())

    def tree(self, part: str):
        """A part's root, or an empty element if it is missing or broken."""
        if part in self.parts:
            try:
                return ElementTree.fromstring(self.zip.read(part))
            except ElementTree.ParseError:
                pass
        return ElementTree.Element("none")

    def all(self, root, name: str):
        return [e for e in root.iter() if _name(e.tag) == name]

    def texts(self, part: str) -> dict[str, str]:
        return {_name(e.tag): (e.text or "").strip() for e in self.tree(part)}

    def targets(self, folder: str, part: str) -> dict[str, str]:
        """Relationship id to part name."""
        found = {}
        for e in self.tree(part):
            target = e.get("Target", "")
            path = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
            while "/../" in path:
                path = re.sub(r"[^/]+/\.\./", "", path, count=1)
            found[e.get("Id")] = path.replace("/./", "/")
        return found

    def strings(self) -> list[str]:
        """Shared texts; phonetic hints are not part of the text."""
        items = []
        for item in self.tree("xl/sharedStrings.xml"):
            pieces = [c for c in item if _name(c.tag) == "t"] + [t for r in item if _name(r.tag) == "r" for t in r if _name(t.tag) == "t"]
            items.append("".join(p.text or "" for p in pieces))
        return items

    def date_styles(self) -> set[int]:
        """Style numbers whose number format shows a date."""
        root = self.tree("xl/styles.xml")
        custom = {e.get("numFmtId"): e.get("formatCode", "").lower() for e in self.all(root, "numFmt")}
        found = set()
        for group in self.all(root, "cellXfs"):
            for i, style in enumerate(group):
                number = style.get("numFmtId", "0")
                code = custom.get(number, "")
                dated = bool(re.search("[ymdh]", code)) and "general" not in code
                if dated or (number.isdigit() and int(number) in DATE_FORMATS):
                    found.add(i)
        return found


def _index(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _value(kind: str, text: str | None, inline: str, style: int, strings: list[str], dates: set[int]) -> tuple[str, str | None]:
    """Type and text of a cell's value."""
    if kind == "s":
        known = text is not None and text.isdigit() and int(text) < len(strings)
        return "string", strings[int(text)] if known else ""
    if kind == "str":
        return "string", text or ""
    if kind == "inlineStr":
        return "string", inline
    if kind == "b":
        return "boolean", str(text == "1")
    if kind == "e":
        return "error", text
    if text is None:
        return "empty", None
    try:
        number = float(text)
    except ValueError:
        return "number", None
    if style in dates:
        try:
            return "date", (datetime.date(1899, 12, 30) + datetime.timedelta(days=number)).isoformat()
        except (OverflowError, ValueError):
            return "date", None
    return "number", str(number)


def _cell(element, row: int, strings, dates, shared: dict[str, str]) -> dict:
    ref = element.get("r", "")
    letters = re.match("[A-Z]*", ref).group()
    style = int(element.get("s", "0"))
    text, inline, formula, is_shared = None, "", None, False
    for child in element:
        part = _name(child.tag)
        if part == "v":
            text = child.text
        elif part == "is":
            inline = "".join(t.text or "" for t in child if _name(t.tag) == "t")
        elif part == "f":
            formula = child.text or None
            if child.get("t") == "shared":
                is_shared = True
                if formula:
                    shared[child.get("si")] = formula
                formula = formula or shared.get(child.get("si"))
    kind, value = _value(element.get("t", "n"), text, inline, style, strings, dates)
    return {
        "cell_ref": ref, "row_number": row, "column_index": _index(letters), "column_letters": letters, "cell_type": kind,
        "raw_value": None if formula else value, "cached_value": value if formula else None, "formula_expression": formula,
        "is_shared_formula": is_shared, "style_index": style,
    }


def _sheet(package: _Package, part: str, strings, dates, facts: dict) -> Iterator[dict]:
    """Cells of a sheet as they are read; ``facts`` is filled on the way."""
    shared: dict[str, str] = {}
    facts.update(n_rows=0, n_cols=0, merged_cells_count=0, has_autofilter=False, table_count=0, freeze_panes="", hyperlinks_count=0,
                 data_validations_count=0, conditional_formatting_count=0, sheet_protected=False, hidden_rows=[], hidden_cols=[],
                 dimension_ref=None)
    links = package.targets(part.rpartition("/")[0], "{0}/_rels/{2}.rels".format(*part.rpartition("/")))
    facts["comments_present"] = any("comment" in t.lower() for t in links.values())
    facts["has_chart_or_image"] = any("drawing" in t.lower() for t in links.values())
    counted = {"mergeCell": "merged_cells_count", "hyperlink": "hyperlinks_count", "dataValidation": "data_validations_count",
               "conditionalFormatting": "conditional_formatting_count"}
    with package.zip.open(part) as stream:
        for _, e in ElementTree.iterparse(stream):
            name = _name(e.tag)
            if name == "row":
                row = int(e.get("r", facts["n_rows"] + 1))
                facts["n_rows"] = max(facts["n_rows"], row)
                if e.get("hidden") == "1":
                    facts["hidden_rows"].append(row)
                for child in e:
                    if _name(child.tag) == "c":
                        cell = _cell(child, row, strings, dates, shared)
                        facts["n_cols"] = max(facts["n_cols"], cell["column_index"])
                        yield cell
                e.clear()
            elif name == "dimension":
                facts["dimension_ref"] = e.get("ref")
            elif name == "col" and e.get("hidden") == "1":
                facts["hidden_cols"] += range(int(e.get("min", 1)), int(e.get("max", 0)) + 1)
            elif name in counted:
                facts[counted[name]] += 1
            elif name == "autoFilter":
                facts["has_autofilter"] = bool(e.get("ref"))
            elif name == "sheetProtection":
                facts["sheet_protected"] = True
            elif name == "tablePart":
                facts["table_count"] += (_attribute(e, "id") in links)
            elif name == "pane":
                facts["freeze_panes"] = e.get("topLeftCell") or f"{e.get('xSplit', '0')}x{e.get('ySplit', '0')}"


def parse(name: str, content: bytes) -> Iterator[dict]:
    """All records of one file."""
    key = hashlib.sha256(content).hexdigest()
    package = _Package(content)
    strings, dates = package.strings(), package.date_styles()
    book = package.tree("xl/workbook.xml")
    parts = package.targets("xl", "xl/_rels/workbook.xml.rels")
    sheets = package.all(book, "sheet")
    for i, sheet in enumerate(sheets):
        part = parts.get(_attribute(sheet, "id"))
        if part not in package.parts:
            continue
        facts = {"sheet_index": i, "visibility": sheet.get("state", "visible")}
        title = sheet.get("name")
        try:
            for cell in _sheet(package, part, strings, dates, facts):
                yield {"workbook_id": key, "sheet_name": title, "cell": cell}
        except ElementTree.ParseError:
            continue
        yield {"workbook_id": key, "sheet_name": title, "sheet": facts}
    core, app = package.texts("docProps/core.xml"), package.texts("docProps/app.xml")
    names = package.all(book, "definedName")
    yield {
        "workbook_id": key,
        "workbook": {
            "source_filename": name, "source_size_bytes": len(content), "sheet_count": len(sheets),
            "creator": core.get("creator", ""), "last_modified_by": core.get("lastModifiedBy", ""),
            "created": core.get("created", ""), "modified": core.get("modified", ""), "application": app.get("Application", ""),
            "defined_names_count": len(names), "workbook_protected": bool(package.all(book, "workbookProtection")),
            "table_definitions_count": sum(p.startswith("xl/tables/table") for p in package.parts),
            "hidden_names": [{"name": n.get("name"), "value": (n.text or "").strip()} for n in names if n.get("hidden") == "1"],
            **{f: any(re.match(p, part) for part in package.parts) for f, p in FEATURES.items()},
        },
    }


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            for record in parse(path.rpartition("/")[2], content):
                rows.append(record)
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=RECORD)


def read_records(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """Records of every workbook of a folder, each file in its own task where there are cores for it.

    Stage the result before filtering it by kind, or every kind parses the files again.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    found = workbook_files(spark, folder) if files is None else files
    return found.select("path", "content").mapInArrow(_batches, from_arrow_schema(RECORD))


def workbook_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(folder)


def new_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose content is not stored yet (``stored`` carries ``workbook_id``, their digest)."""
    return files.withColumn("workbook_id", F.sha2("content", 256)).join(stored.select("workbook_id"), "workbook_id", "left_anti")


def all_cells(records: DataFrame) -> DataFrame:
    """Every cell, empty ones too, as the profiles need them."""
    return records.where("cell is not null").select("workbook_id", "sheet_name", "cell.*")


def raw_cells(records: DataFrame) -> DataFrame:
    """Cells to store: those with a value or a formula."""
    return all_cells(records).where("cell_type <> 'empty' or formula_expression is not null")


def sheets(records: DataFrame) -> DataFrame:
    return records.where("sheet is not null").select("workbook_id", "sheet_name", "sheet.*")


def workbooks(records: DataFrame) -> DataFrame:
    return records.where("workbook is not null").select("workbook_id", "workbook.*")


def intake_counts(records: DataFrame) -> DataFrame:
    """Sheets, filled cells and formulas per workbook: what an ingest would store."""
    return records.groupBy("workbook_id").agg(
        F.count("sheet").alias("sheets"),
        F.count_if(F.col("cell.cell_type") != "empty").alias("cells"),
        F.count("cell.formula_expression").alias("formulas"),
    )
