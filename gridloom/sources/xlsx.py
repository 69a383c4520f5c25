"""Office Open XML workbooks (.xlsx, .xlsm): reading and writing."""

from __future__ import annotations

import io
import math
import posixpath
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from itertools import groupby
from typing import IO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from gridloom.plans import formula as A
from gridloom.plans.formula import Error, cell_place, column_letters
from gridloom.plans.grid import number_text
from gridloom.sources import numfmt
from gridloom.sources.model import Packed, ReadError, Workbook, open_zip, part

_REF = re.compile(r"(?<![A-Za-z0-9_.$!'\]])(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)(?![A-Za-z0-9_(.!])|(?<=!)(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)(?![A-Za-z0-9_(.])")
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def tree(data: bytes | None) -> ET.Element | None:
    """The root of a part, None if it is missing or not well formed. Document types are refused."""
    if data is None or b"<!DOCTYPE" in data[:4096]:
        return None
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        return None


def events(data: bytes) -> Iterator[tuple[str, ET.Element]]:
    """Start and end events; what is not well formed ends them, so that rows before it stay."""
    if b"<!DOCTYPE" in data[:4096]:
        return
    try:
        yield from ET.iterparse(io.BytesIO(data), ("start", "end"))
    except ET.ParseError:
        return


def find(e: ET.Element, name: str) -> ET.Element | None:
    return next((x for x in e if local(x.tag) == name), None)


def every(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if e is None else [x for x in e.iter() if local(x.tag) == name]


def get(e: ET.Element, name: str, default: str | None = None) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), default)


def true(value: str | None) -> bool:
    return value in ("1", "true")


def relations(archive: zipfile.ZipFile, of: str) -> dict[str, tuple[str, str]]:
    """id -> (kind, target part or URL) of a part."""
    folder, name = posixpath.split(of)
    root = tree(part(archive, f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"))
    out = {}
    for e in every(root, "Relationship"):
        target = e.get("Target", "")
        if e.get("TargetMode") != "External":
            target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[e.get("Id", "")] = (e.get("Type", "").rpartition("/")[2], target)
    return out


def text_of(e: ET.Element) -> str:
    """The text of a string item, runs joined, phonetic runs left out."""
    out = []
    for x in e:
        if local(x.tag) == "t":
            out.append(x.text or "")
        elif local(x.tag) == "r":
            out += [t.text or "" for t in x if local(t.tag) == "t"]
    return "".join(out)


def shifted(source: str, rows: int, cols: int) -> str:
    """A formula moved: relative references go along, strings and quoted names stay."""

    def move(m: re.Match) -> str:
        d1, letters, d2, digits = m.groups()[:4] if m[2] else m.groups()[4:]
        if not cell_place(letters + digits):
            return m[0]
        col = A.column_number(letters) + (0 if d1 else cols)
        row = int(digits) - 1 + (0 if d2 else rows)
        if not (0 <= row < A.MAX_ROWS and 0 <= col < A.MAX_COLS):
            return "#REF!"
        return f"{d1}{column_letters(col)}{d2}{row + 1}"

    pieces = re.split(r"""("(?:[^"]|"")*"|'(?:[^']|'')*')""", source)
    return "".join(p if i % 2 else _REF.sub(move, p) for i, p in enumerate(pieces))


def box(ref: str) -> tuple[int, int, int, int] | None:
    a, _, b = ref.replace("$", "").partition(":")
    p, q = cell_place(a), cell_place(b or a)
    return (min(p[0], q[0]), min(p[1], q[1]), max(p[0], q[0]), max(p[1], q[1])) if p and q else None


#: Elements of the property parts and what they are called in schema.WORKBOOKS.
PROPERTY_PARTS = {
    "core-properties": {"title": "title", "subject": "subject", "creator": "creator", "keywords": "keywords", "description": "description", "lastModifiedBy": "last_modified_by", "created": "created"},
    "extended-properties": {"Company": "company"},
}


def properties(archive) -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for kind, target in relations(archive, "").values():
        root = tree(part(archive, target)) if kind in PROPERTY_PARTS else None
        for e in root if root is not None else ():
            name = PROPERTY_PARTS[kind].get(local(e.tag))
            if name and e.text:
                out[name] = e.text
    return out


def read(data: bytes) -> Workbook:
    archive = open_zip(data)
    start = next((t for kind, t in relations(archive, "").values() if kind == "officeDocument"), "xl/workbook.xml")
    root = tree(part(archive, start))
    if root is None:
        raise ReadError("missing_workbook" if part(archive, start) is None else "xml")
    rels = relations(archive, start)
    by_kind = {kind: target for kind, target in rels.values()}
    book = Workbook(cells=Packed(), date1904=any(true(get(e, "date1904")) for e in every(root, "workbookPr")))
    book.parts = [(i.filename, i.file_size, i.compress_size) for i in archive.infolist()]
    book.properties = properties(archive)
    active = next((get(e, "activeTab") for e in every(root, "workbookView")), None)
    book.active_sheet = int(active) if active and active.isdigit() else None
    book.structure_protected = any(true(get(e, "lockStructure")) for e in every(root, "workbookProtection"))
    strings = [text_of(e) for e in every(tree(part(archive, by_kind.get("sharedStrings", ""))), "si")]
    kinds = _formats(tree(part(archive, by_kind.get("styles", ""))))
    listed = every(root, "sheet")
    titles = [get(e, "name", "") for e in listed]
    for e in every(root, "definedName"):
        at = get(e, "localSheetId")
        scope = titles[int(at)] if at and at.isdigit() and int(at) < len(titles) else None
        book.names.append((scope, get(e, "name", ""), e.text or ""))
    for index, e in enumerate(listed):
        kind, target = rels.get(get(e, "id", ""), ("", ""))
        _sheet(book, archive, index, titles[index], get(e, "state") or "visible", kind, target, strings, kinds)
    return book


def _formats(root: ET.Element | None) -> list[str]:
    """The class of number format of each cell style."""
    codes = {int(get(e, "numFmtId", "0")): get(e, "formatCode", "") for e in every(root, "numFmt")}
    styles = next(iter(every(root, "cellXfs")), None)
    ids = [int(get(e, "numFmtId", "0")) for e in (styles if styles is not None else []) if local(e.tag) == "xf"]
    return [numfmt.class_of(i, codes.get(i)) for i in ids]


def _sheet(book: Workbook, archive, index: int, title: str, state: str, kind: str, target: str, strings: list[str], kinds: list[str]) -> None:
    types = {"worksheet": "WorkSheet", "chartsheet": "ChartSheet", "dialogsheet": "DialogSheet", "xlMacrosheet": "MacroSheet"}
    data = part(archive, target)
    seen = {"freeze": (None, None), "zoom": None, "rtl": False, "grid": True, "tab": None, "protected": False, "filter": None}
    rels = relations(archive, target) if data else {}
    masters: dict[str, tuple[str, int, int]] = {}
    row, col, within = -1, -1, None
    for event, e in events(data or b""):
        name = local(e.tag)
        if event == "start":
            if name == "sheetData":
                within = e
            elif name == "row":
                row, col = int(get(e, "r")) - 1 if (get(e, "r") or "").isdigit() else row + 1, -1
            continue
        if name == "c":
            place = cell_place(get(e, "r") or "")
            row, col = place if place else (max(row, 0), col + 1)
            _cell(book, e, index, title, row, col, strings, kinds, masters)
            e.clear()
        elif name == "row":
            (e if within is None else within).clear()
        elif name == "mergeCell" and (b := box(get(e, "ref", ""))):
            book.add_range(index, "merge", b)
        elif name == "hyperlink" and (b := box(get(e, "ref", ""))):
            book.add_range(index, "hyperlink", b, text=rels.get(get(e, "id", ""), ("", get(e, "location")))[1])
        elif name == "dataValidation":
            rule = " ".join(filter(None, (get(e, "type") or "any", get(e, "operator"), *[x.text for x in e if local(x.tag).startswith("formula")])))
            for ref in (get(e, "sqref") or "").split():
                if b := box(ref):
                    book.add_range(index, "validation", b, text=rule)
        elif name == "conditionalFormatting":
            for ref in (get(e, "sqref") or "").split():
                if b := box(ref):
                    book.add_range(index, "conditional", b, text=",".join(get(x, "type") or "" for x in e if local(x.tag) == "cfRule"))
        elif name == "pane" and get(e, "state") in ("frozen", "frozenSplit"):
            seen["freeze"] = int(float(get(e, "ySplit") or 0)), int(float(get(e, "xSplit") or 0))
        elif name == "sheetView":
            seen |= {"zoom": int(get(e, "zoomScale") or 100), "rtl": true(get(e, "rightToLeft")), "grid": get(e, "showGridLines") not in ("0", "false")}
        elif name == "tabColor":
            seen["tab"] = get(e, "rgb")
        elif name == "sheetProtection":
            seen["protected"] = true(get(e, "sheet"))
        elif name == "autoFilter":
            seen["filter"] = get(e, "ref")
    visible = {"hidden": "hidden", "veryHidden": "veryHidden"}.get(state, "visible")
    book.sheets.append((index, title, types.get(kind, "WorkSheet"), visible, *seen["freeze"], seen["zoom"], seen["rtl"], seen["grid"], seen["tab"], seen["protected"], seen["filter"]))
    for rel, to in rels.values():
        if rel == "comments":
            _comments(book, tree(part(archive, to)), index)
        elif rel == "table" and (root := tree(part(archive, to))) is not None and (b := box(get(root, "ref", ""))):
            columns = "\t".join(get(c, "name", "") for c in every(root, "tableColumn"))
            book.add_range(index, "table", b, get(root, "displayName") or get(root, "name"), columns)
        elif rel == "drawing":
            for inner, image in relations(archive, to).values():
                if inner in ("image", "chart"):
                    book.add_range(index, inner, (0, 0, 0, 0), text=image)


def _comments(book: Workbook, root: ET.Element | None, index: int) -> None:
    authors = [e.text or "" for e in every(root, "author")]
    for e in every(root, "comment"):
        who, b = get(e, "authorId") or "", box(get(e, "ref", ""))
        said = find(e, "text")
        if b:
            book.add_range(index, "comment", b, text="" if said is None else text_of(said), author=authors[int(who)] if who.isdigit() and int(who) < len(authors) else None)


def _cell(book: Workbook, e, index: int, title: str, row: int, col: int, strings, kinds, masters) -> None:
    f, v, inline = find(e, "f"), find(e, "v"), find(e, "is")
    style = int(get(e, "s") or 0)
    fmt = kinds[style] if style < len(kinds) else "Plain"
    raw, kind, date = (v.text or "") if v is not None else "", get(e, "t") or "n", None
    value: object = ""
    if kind == "s":
        value = strings[int(raw)] if raw.strip().isdigit() and int(raw) < len(strings) else ""
    elif kind == "inlineStr":
        value = text_of(inline) if inline is not None else ""
    elif kind == "str":
        value = raw
    elif kind == "b":
        value = raw.strip() in ("1", "true")
    elif kind == "e":
        value = Error(raw)
    elif kind == "d":
        found = numfmt.serial_of(raw)
        value, date, fmt = (found, "date", "DateTime" if "T" in raw else "Date") if found is not None else (raw, None, fmt)
    elif raw.strip():
        try:
            value = float(raw)
        except ValueError:
            value = raw
        date = "date" if numfmt.is_date(fmt) else None
    shown = numfmt.render(value, fmt, book.date1904 and kind != "d") if isinstance(value, float) else ("TRUE" if value else "FALSE") if isinstance(value, bool) else str(value)
    source = None
    if f is not None:
        source, si = f.text or "", get(f, "si")
        if get(f, "t") == "shared" and si is not None:
            if source:
                masters[si] = source, row, col
            elif si in masters:
                text, r, c = masters[si]
                source = shifted(text, row - r, col - c)
    if source:
        book.add_cell(index, title, row, col, value, shown, date, source, style)
    elif shown:
        book.add_cell(index, title, row, col, value, shown, date, None, style)


# Writing


def xml_text(text: str) -> str:
    """Without what XML 1.0 cannot hold."""
    return escape(re.sub("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", text))


def safe_titles(titles: Iterable[str]) -> list[str]:
    """Valid sheet names: 31 characters, none of :\\/?*[], and no two alike."""
    out: list[str] = []
    for title in titles:
        base = re.sub(r"[:\\/?*\[\]]", "_", title).strip("'").strip()[:31] or "Sheet"
        name, n = base, 1
        while name.lower() in {t.lower() for t in out}:
            n += 1
            name = f"{base[: 31 - len(str(n)) - 1]}_{n}"
        out.append(name)
    return out


class WriteError(ValueError):
    """A cell that no sheet can hold: CellOutOfGrid, CellTextTooLong or NonFiniteNumber."""

    def __init__(self, rule: str, title: str, row: int, col: int):
        super().__init__(f"{rule}: {title}!{column_letters(max(0, col))}{row + 1}")
        self.rule = rule


#: Fixed value: the longest cell text, in UTF-16 units.
MAX_CELL_TEXT = 32_767


#: Bytes of a sheet's XML that are held in memory while it is made, a temporary file beyond.
HELD_XML = 4 << 20


def write(sheets: Iterable[dict], names: list[tuple[str | None, str, str]] = (), date1904: bool = False) -> bytes:
    """The bytes of a workbook, the same for the same input.

    sheets: dicts of title, cells {(row, col): (kind, value, formula)}, and optionally merges,
    state and freeze. Kinds are as in schema.CELLS; dates get a date format. Nothing is cut or
    left out: what cannot be held raises a WriteError. Sheets may come one after the other, and
    cells as pairs of place and cell, in order of row and column; each is then let go once written.
    """
    strings: dict[str, int] = {}
    parts: dict[str, IO[bytes]] = {}
    with ExitStack() as files:
        heads = []
        for i, sheet in enumerate(sheets, 1):
            parts[f"xl/worksheets/sheet{i}.xml"] = out = files.enter_context(tempfile.SpooledTemporaryFile(HELD_XML))
            for piece in _sheet_xml(sheet, strings):
                out.write(piece.encode())
            heads.append({k: v for k, v in sheet.items() if k != "cells"})
        return _package(heads, parts, strings, names, date1904)


def _package(sheets: list[dict], parts: dict[str, IO[bytes]], strings: dict[str, int], names: list[tuple[str | None, str, str]], date1904: bool) -> bytes:
    titles = safe_titles(s["title"] for s in sheets)
    overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    state = lambda s: f' state="{s["state"]}"' if s.get("state", "visible") != "visible" else ""
    listed = "".join(f'<sheet name={quoteattr(t)} sheetId="{i}"{state(s)} r:id="rId{i}"/>' for i, (t, s) in enumerate(zip(titles, sheets), 1))
    defined = "".join(f'<definedName name={quoteattr(n)}{f" localSheetId={chr(34)}{titles.index(s)}{chr(34)}" if s in titles else ""}>{xml_text(r)}</definedName>' for s, n, r in names)
    n = len(sheets)
    links = "".join(f'<Relationship Id="rId{i}" Type="{RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
    links += f'<Relationship Id="rId{n + 1}" Type="{RELS}/styles" Target="styles.xml"/><Relationship Id="rId{n + 2}" Type="{RELS}/sharedStrings" Target="sharedStrings.xml"/>'
    items = "".join(f'<si><t xml:space="preserve">{xml_text(t)}</t></si>' for t in strings)
    files = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/>{overrides}<Override PartName="/xl/styles.xml" ContentType="{main}.styles+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{main}.sharedStrings+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><workbookPr{" date1904=" + chr(34) + "1" + chr(34) if date1904 else ""}/><sheets>{listed}</sheets>{f"<definedNames>{defined}</definedNames>" if defined else ""}</workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd\\ hh:mm:ss"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
        '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>',
        **parts,
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}" uniqueCount="{len(strings)}">{items}</sst>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            with z.open(info, "w") as to:
                to.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n')
                if isinstance(content, str):
                    to.write(content.encode())
                else:
                    content.seek(0)
                    shutil.copyfileobj(content, to, 1 << 20)
    return out.getvalue()


def _sheet_xml(sheet: dict, strings: dict[str, int]) -> Iterator[str]:
    """The sheet's XML in pieces, a row or more each."""
    down, across = sheet.get("freeze") or (0, 0)
    pane = f'<sheetViews><sheetView workbookViewId="0"><pane{f" xSplit={chr(34)}{across}{chr(34)}" if across else ""}{f" ySplit={chr(34)}{down}{chr(34)}" if down else ""} topLeftCell="{column_letters(across)}{down + 1}" state="frozen"/></sheetView></sheetViews>' if down or across else ""
    yield f'<worksheet xmlns="{MAIN}">{pane}<sheetData>'
    cells = sheet["cells"]
    for row, found in groupby(sorted(cells.items()) if isinstance(cells, dict) else cells, key=lambda c: c[0][0]):
        yield f'<row r="{row + 1}">{"".join(_cell_xml(sheet["title"], *c, strings) for c in found)}</row>'
    label = lambda b: f"{column_letters(b[1])}{b[0] + 1}:{column_letters(b[3])}{b[2] + 1}"
    merges = "".join(f'<mergeCell ref="{label(b)}"/>' for b in sheet.get("merges", ()))
    yield f'</sheetData>{f"<mergeCells>{merges}</mergeCells>" if merges else ""}</worksheet>'


def _cell_xml(title: str, place: tuple[int, int], cell: tuple, strings: dict[str, int]) -> str:
    (row, col), (kind, value, source) = place, cell
    if not (0 <= row < A.MAX_ROWS and 0 <= col < A.MAX_COLS):
        raise WriteError("CellOutOfGrid", title, row, col)
    if kind == "text" and value is not None and len(value.encode("utf-16-le", "surrogatepass")) > 2 * MAX_CELL_TEXT:
        raise WriteError("CellTextTooLong", title, row, col)
    if kind in ("number", "date") and value is not None and not math.isfinite(value) and not source:
        raise WriteError("NonFiniteNumber", title, row, col)
    f = f"<f>{xml_text(source.removeprefix('='))}</f>" if source else ""
    t, v = "", ""
    if kind in ("number", "date") and value is not None and math.isfinite(value):
        t, v = ' s="1"' if kind == "date" else "", number_text(float(value))
    elif kind == "bool":
        t, v = ' t="b"', str(int(value))
    elif kind == "error":
        t, v = ' t="e"', xml_text(value)
    elif kind == "text" and value is not None:
        t, v = (' t="str"', xml_text(value)) if source else (' t="s"', str(strings.setdefault(value, len(strings))))
    return f'<c r="{column_letters(col)}{row + 1}"{t}>{f}{f"<v>{v}</v>" if v else ""}</c>'
