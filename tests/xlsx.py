"""Small spreadsheet files for tests."""

import zipfile

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def cell(ref, value=None, formula=None, kind=None, style=None, shared=None):
    f = ""
    if shared is not None:
        f = f'<f t="shared" si="{shared}">{formula or ""}</f>'
    elif formula:
        f = f"<f>{formula}</f>"
    t = f' t="{kind}"' if kind else ""
    s = f' s="{style}"' if style is not None else ""
    v = f"<v>{value}</v>" if value is not None else ""
    return f'<c r="{ref}"{t}{s}>{f}{v}</c>'


def sheet(rows: dict[int, list[str]], hidden_rows=(), extra_before="", extra_after=""):
    body = "".join(
        f'<row r="{r}"{" hidden=\"1\"" if r in hidden_rows else ""}>{"".join(cells)}</row>' for r, cells in rows.items()
    )
    return f'<worksheet {MAIN}><dimension ref="A1:C5"/>{extra_before}<sheetData>{body}</sheetData>{extra_after}</worksheet>'


def write(path, sheets: list[tuple[str, str, str]], strings=(), styles=None, names="", parts=None):
    """``sheets``: name, state, xml."""
    listed = "".join(f'<sheet name="{n}" sheetId="{i}" state="{s}" r:id="rId{i}"/>' for i, (n, s, _) in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets>{listed}</sheets>{names}</workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PKG}">{links}</Relationships>')
        items = "".join(f"<si><t>{s}</t></si>" for s in strings)
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{items}</sst>")
        if styles:
            z.writestr("xl/styles.xml", styles)
        for i, (_, _, xml) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", xml)
        for name, text in (parts or {}).items():
            z.writestr(name, text)


def audited(path, second_state="visible"):
    """Header codigo, quantidade, total; a shared formula down C2:C4; errors in row 5."""
    rows = {
        1: [cell("A1", 0, kind="s"), cell("B1", 1, kind="s"), cell("C1", 2, kind="s")],
        2: [cell("A2", 1), cell("B2", 10), cell("C2", 10, "A2*B2", shared=0)],
        3: [cell("A3", 2), cell("B3", 20), cell("C3", 40, shared=0)],
        4: [cell("A4", 3), cell("B4", 30), cell("C4", 90, shared=0)],
        5: [cell("A5", 4), cell("B5", "#DIV/0!", kind="e"), cell("C5", "#DIV/0!", "A5*B5", kind="e")],
    }
    other = {1: [cell("A1", 3, kind="s")], 2: [cell("A2", 5)]}
    write(path, [("Dados", "visible", sheet(rows)), ("Auxiliar", second_state, sheet(other))], ["codigo", "quantidade", "total", "nota"])


def ingested(path, extra=""):
    """Nineteen filled cells, two formulas."""
    words = ["TIPO1", "TIPO2", "TERREO", "PRIMEIRO", "SEGUNDO"]
    rows = {1: [cell("H1", 0.75)]}
    data = [(1, 50.5, 0, 500000, 2, 0.95), (2, 60.25, 0, 600000, 3, 1.0), (3, 70.0, 1, 700000, 4, 1.05)]
    for i, (a, b, c, d, e, f) in enumerate(data):
        r = i + 2
        first = cell(f"A{r}", a, f"A{r - 1}+1" if i else None)
        rows[r] = [first, cell(f"B{r}", b), cell(f"C{r}", c, kind="s"), cell(f"D{r}", d), cell(f"E{r}", e, kind="s"), cell(f"F{r}", f), cell(f"G{r}")]
    write(path, [("Plan1", "visible", sheet(rows, extra_after=extra))], words)
