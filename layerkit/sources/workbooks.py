"""Folders of spreadsheet workbooks, one task per file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_CHUNK = 10_000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(element) -> str:
    return "".join(part.text or "" for part in element.iter() if _local(part.tag) == "t")


def _column_no(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _sheet_part(book: zipfile.ZipFile, sheet: str | int) -> str:
    """Path of a sheet inside the workbook, by name or position."""
    sheets = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
    wanted = [s for i, s in enumerate(sheets) if sheet in (i, s.get("name"))]
    if not wanted:
        raise ValueError(f"no sheet {sheet!r}; the workbook has {[s.get('name') for s in sheets]}")
    link = next(v for k, v in wanted[0].attrib.items() if _local(k) == "id")
    for relation in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if relation.get("Id") == link:
            target = relation.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"sheet {sheet!r} has no part")


def sheet_rows(content: bytes, sheet: str | int) -> Iterator[list[str | None]]:
    """Rows of a sheet as lists of texts; rows and cells left out in the file are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = [_text(e) for e in root if _local(e.tag) == "si"]
        with book.open(_sheet_part(book, sheet)) as part:
            at = 0
            for _, element in ElementTree.iterparse(part):
                if _local(element.tag) != "row":
                    continue
                number = int(element.get("r", at + 1))
                for _ in range(number - at - 1):
                    yield []
                at = number
                cells: list[str | None] = []
                for cell in element:
                    place = _column_no(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (place - len(cells))
                    kind = cell.get("t")
                    value = next((c.text for c in cell if _local(c.tag) == "v"), None)
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = _text(cell)
                    elif kind == "b" and value is not None:
                        value = "true" if value == "1" else "false"
                    cells.append(value)
                yield cells
                element.clear()


def read_workbooks(
    spark: SparkSession,
    folder: str,
    sheet: str | int = 0,
    skip: int = 0,
    columns: list[str] | None = None,
    glob: str = "*.xlsx",
) -> DataFrame:
    """One sheet of every workbook in a folder; all columns are text.

    ``skip`` lines come before the header. Columns are found by header, so their
    order may differ between files. Without ``columns`` the header of the first
    file names them. The result ends with ``_source_file``.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    ).select("path", "content")
    if columns is None:
        first = files.select("path").orderBy("path").limit(1)

        def header(batches):
            for batch in batches:
                for content in batch["content"]:
                    rows = sheet_rows(content, sheet)
                    names = next((r for i, r in enumerate(rows) if i == skip), [])
                    yield pd.DataFrame({"names": [[n for n in names if n]]})

        one = files.filter(F.col("path") == F.lit(first.collect()[0]["path"]))
        columns = list(one.mapInPandas(header, "names array<string>").collect()[0]["names"])
    names = list(columns)

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                places, chunk = None, []
                for i, row in enumerate(sheet_rows(content, sheet)):
                    if i < skip:
                        continue
                    if places is None:
                        found = {name: p for p, name in enumerate(row)}
                        places = [found.get(n) for n in names]
                        continue
                    values = [row[p] if p is not None and p < len(row) else None for p in places]
                    if any(v is not None for v in values):
                        chunk.append([*values, path])
                    if len(chunk) == _CHUNK:
                        yield pd.DataFrame(chunk, columns=[*names, "_source_file"])
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=[*names, "_source_file"])

    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_source_file"]])
    return files.mapInPandas(parse, schema)
