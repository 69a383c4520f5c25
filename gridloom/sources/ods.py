"""OpenDocument spreadsheets (.ods): reading."""

from __future__ import annotations

import re

from gridloom.plans.formula import column_letters
from gridloom.plans.grid import number_text
from gridloom.sources import numfmt
from gridloom.sources.model import MAX_TEXT, ReadError, Workbook, open_zip, part
from gridloom.sources.xlsx import box, every, get, local, tree

#: What a copy of a repeated cell counts besides its text, against the budget of MAX_TEXT; and the grid.
COPY_COST, ROWS, COLUMNS = 2048, 1 << 20, 16_384


def is_ods(data: bytes) -> bool:
    return data[:2] == b"PK" and b"opendocument.spreadsheet" in data[:400]


def _paragraphs(e) -> str:
    def inner(x) -> str:
        out = x.text or ""
        for c in x:
            name = local(c.tag)
            out += {"s": " " * int(get(c, "c") or 1), "tab": "\t", "line-break": "\n"}.get(name) or ("" if name == "annotation" else inner(c))
            out += c.tail or ""
        return out

    return "\n".join(inner(p) for p in e if local(p.tag) == "p")


def duration(text: str) -> float | None:
    """PTnHnMnS in days."""
    m = re.fullmatch(r"(-?)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not m:
        return None
    days = int(m[2] or 0) + (int(m[3] or 0) * 3600 + int(m[4] or 0) * 60 + float(m[5] or 0)) / 86400
    return -days if m[1] else days


def read(data: bytes) -> Workbook:
    archive = open_zip(data)
    manifest = part(archive, "META-INF/manifest.xml")
    if manifest and b"encryption-data" in manifest:
        raise ReadError("encrypted_open_document")
    root = tree(part(archive, "content.xml"))
    if root is None:
        raise ReadError("missing_workbook" if part(archive, "content.xml") is None else "xml")
    book = Workbook(parts=[(i.filename, i.file_size, i.compress_size) for i in archive.infolist()])
    hidden = {get(s, "name") for s in every(root, "style") if any(get(p, "display") == "false" for p in every(s, "table-properties"))}
    tables = every(root, "table")
    rules = {get(e, "name"): get(e, "condition") or "" for e in every(root, "content-validation")}
    for index, table in enumerate(tables):
        _table(book, index, table, get(table, "style-name") in hidden, rules)
    titles = [get(t, "name", "") for t in tables]
    for e in every(root, "database-range"):
        title, area = _area(get(e, "target-range-address") or "")
        if title not in titles or area is None:
            continue
        at = titles.index(title)
        book.add_range(at, "table", area, name=get(e, "name"))
        if get(e, "display-filter-buttons") == "true":
            book.sheets[at] = (*book.sheets[at][:-1], f"{_label(*area[:2])}:{_label(*area[2:])}")
    for e in every(root, "named-range"):
        book.names.append((None, get(e, "name", ""), get(e, "cell-range-address", "").replace("$", "")))
    return book


class _Copies:
    """The budget for copies of repeated cells; cells that are written out themselves cost nothing here."""

    def __init__(self, book: Workbook):
        self.book, self.left = book, MAX_TEXT

    def take(self, text: str) -> bool:
        cost = len(text.encode()) + COPY_COST
        if cost > self.left:
            self.left, self.book.truncated = 0, True
            return False
        self.left -= cost
        return True


def _label(row: int, col: int) -> str:
    return f"{column_letters(col)}{row + 1}"


def _area(address: str) -> tuple[str, tuple[int, int, int, int] | None]:
    """The sheet and the rectangle of an address such as 'My Sheet'.A1:'My Sheet'.B9."""
    ends = [re.fullmatch(r"\$?(?:'((?:[^']|'')*)'|([^.']*))?\.(\$?[A-Za-z]+\$?[0-9]+)", x) for x in re.findall(r"(?:'(?:[^']|'')*'|[^':])+", address)]
    if not 1 <= len(ends) <= 2 or not all(ends):
        return "", None
    title = ends[0][1].replace("''", "'") if ends[0][1] is not None else ends[0][2] or ""
    return title, box(f"{ends[0][3]}:{ends[-1][3]}")


def _table(book: Workbook, index: int, table, hidden: bool, rules: dict[str, str]) -> None:
    title, row, copies = get(table, "name", ""), 0, _Copies(book)
    book.sheets.append((index, title, "WorkSheet", "hidden" if hidden else "visible", None, None, None, False, True, None, get(table, "protected") == "true", None))
    for r in every(table, "table-row"):
        times, col, found, notes = int(get(r, "number-rows-repeated") or 1), 0, [], []
        for c in r:
            if local(c.tag) not in ("table-cell", "covered-table-cell"):
                continue
            across = int(get(c, "number-columns-repeated") or 1)
            made = _value(c)
            if made and local(c.tag) == "table-cell":
                for k in range(min(across, COLUMNS - col)):
                    if k and not copies.take(made[1]):
                        break
                    found.append((col + k, *made))
            rule = get(c, "content-validation-name")
            if rule in rules:
                book.add_range(index, "validation", (row, col, min(row + times, ROWS) - 1, min(col + across, COLUMNS) - 1), text=rules[rule])
            notes += [("comment", col, _paragraphs(a)) for a in c if local(a.tag) == "annotation"] + [("hyperlink", col, get(a, "href")) for a in every(c, "a")]
            down, wide = int(get(c, "number-rows-spanned") or 1), int(get(c, "number-columns-spanned") or 1)
            if down > 1 or wide > 1:
                book.add_range(index, "merge", (row, col, row + down - 1, col + wide - 1))
            col += across
        for k in range(min(times, ROWS - row) if found or notes else 0):
            if k and not all(copies.take(x) for x in (*(f[2] for f in found), *(n[2] or "" for n in notes))):
                break
            for at, value, shown, kind, source in found:
                book.add_cell(index, title, row + k, at, value, shown, kind, source)
            for kind, at, text in notes:
                book.add_range(index, kind, (row + k, at, row + k, at), text=text)
        row += times


def _value(c):
    """(value, display, kind, formula) of a cell, None if it holds nothing."""
    kind, shown = get(c, "value-type"), _paragraphs(c)
    source = get(c, "formula")
    source = re.sub(r"^(?:[a-z]+:)?=", "", source) if source else None
    value, own = shown, None
    if kind in ("float", "percentage", "currency"):
        value = float(get(c, "value") or 0)
        shown = shown or number_text(value)
    elif kind == "date":
        found = numfmt.serial_of(get(c, "date-value") or "")
        value, own = (found, "date") if found is not None else (shown, None)
        shown = shown or get(c, "date-value") or ""
    elif kind == "time":
        found = duration(get(c, "time-value") or "")
        value = found if found is not None else shown
        shown = shown or (number_text(value) if isinstance(value, float) else "")
    elif kind == "boolean":
        value = get(c, "boolean-value") == "true"
        shown = shown or ("TRUE" if value else "FALSE")
    elif kind == "string" and not shown:
        value = shown = get(c, "string-value") or ""
    return (value, shown, own, source) if shown or source else None
