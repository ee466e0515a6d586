"""First sheet of .xlsx workbooks as text columns: binary files in, one workbook per task, standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DATE_FORMATS = {*range(14, 23), 45, 46, 47}       # built-in number formats that are dates or times
BATCH = 20_000


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(NS + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(NS + "si")]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")) for f in root.iter(NS + "numFmt")
              if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    cells = root.find(NS + "cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | custom}


def sheet_rows(content: bytes):
    """Rows of the first sheet as {column index: text}; dates come out as ISO text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings, dates = _shared(z), _date_styles(z)
        sheet = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)),
                       key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1]).group()))[0]
        with z.open(sheet) as stream:
            for _, row in ET.iterparse(stream):
                if row.tag != NS + "row":
                    continue
                out = {}
                for i, c in enumerate(row):
                    letters = re.match(r"[A-Z]*", c.get("r", "")).group()
                    at = sum((ord(ch) - 64) * 26 ** k for k, ch in enumerate(reversed(letters))) - 1 if letters else i
                    kind, v = c.get("t"), c.find(NS + "v")
                    text = "".join(t.text or "" for t in c.iter(NS + "t")) if kind == "inlineStr" else (v.text if v is not None else None)
                    if text is not None and kind == "s":
                        text = strings[int(text)]
                    elif text is not None and kind in (None, "n") and int(c.get("s", -1)) in dates:
                        text = (datetime(1899, 12, 30) + timedelta(microseconds=round(float(text) * 86_400_000_000))).isoformat(sep=" ")
                    out[at] = text
                row.clear()
                yield out


def workbooks(spark: SparkSession, paths) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def workbook_headers(spark: SparkSession, paths) -> list[tuple]:
    """(path, header names or None, problem) per workbook; one row per file comes back."""
    def read(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    first = next(sheet_rows(content))
                    names, problem = [first.get(i) or f"_c{i}" for i in range(max(first) + 1)], None
                except Exception as error:
                    names, problem = None, f"{type(error).__name__}: {error}"
                yield pd.DataFrame({"path": [path], "names": [names], "problem": [problem]})

    rows = workbooks(spark, paths).mapInPandas(read, "path string, names array<string>, problem string").collect()
    return [(r["path"], tuple(r["names"]) if r["names"] else None, r["problem"]) for r in rows]


def scan_excel(spark: SparkSession, paths, header) -> DataFrame:
    return parse_workbooks(workbooks(spark, paths), header)


def parse_workbooks(books: DataFrame, header) -> DataFrame:
    """Workbooks (path, content) sharing one header as text columns plus source_file, `_path` and `_row`."""
    header = list(header)

    def read(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows, start = [], 0
                for n, cells in enumerate(sheet_rows(content)):
                    if n == 0:
                        continue
                    rows.append([cells.get(i) for i in range(len(header))])
                    if len(rows) == BATCH:
                        yield _frame(rows, start, path)
                        start, rows = start + len(rows), []
                if rows:
                    yield _frame(rows, start, path)

    def _frame(rows, start, path):
        out = pd.DataFrame(rows, columns=header, dtype=object)
        out["_row"], out["_path"], out["source_file"] = range(start, start + len(rows)), path, path.rsplit("/", 1)[-1]
        return out

    ddl = ", ".join(f"`{c}` string" for c in header) + ", _row bigint, _path string, source_file string"
    return books.mapInPandas(read, ddl)
