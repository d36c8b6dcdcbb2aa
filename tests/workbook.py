"""Write a small workbook, as spreadsheet programs do, for tests."""

import zipfile
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(ord("A") + rest) + out
    return out


def write_workbook(path, sheets: dict[str, list[list]]) -> None:
    shared: list[str] = []

    def cell(row: int, column: int, value) -> str:
        place = f"{letters(column)}{row}"
        if isinstance(value, bool):
            return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{place}"><v>{value}</v></c>'
        if value.startswith("inline:"):
            return f'<c r="{place}" t="inlineStr"><is><t>{escape(value[7:])}</t></is></c>'
        shared.append(value)
        return f'<c r="{place}" t="s"><v>{len(shared) - 1}</v></c>'

    with zipfile.ZipFile(path, "w") as book:
        names = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets)
        )
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(
            f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))
        )
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(
                f'<row r="{r + 1}">' + "".join(cell(r + 1, c, v) for c, v in enumerate(row) if v is not None) + "</row>"
                for r, row in enumerate(rows)
                if row
            )
            book.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
        items = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{items}</sst>')
