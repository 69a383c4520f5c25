"""Edits of .xlsx/.xlsm packages that leave every untouched part as it was.

Only parts that an edit changes are parsed and written again; all other entries
keep their bytes. A failed edit changes nothing (each works on a copy), and the
calculation chain goes when cells change. edit_workbooks() does this for a
DataFrame of files.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from xml.dom import minidom
from xml.parsers.expat import ExpatError

from pyspark.sql import DataFrame

from gridloom.operators.edit import rewritten
from gridloom.plans.formula import MAX_COLS, MAX_ROWS, cell_place, column_letters
from gridloom.plans.grid import number_text
from gridloom.sources.model import ReadError, open_zip
from gridloom.sources.xlsx import MAIN, PACKAGE, RELS, box

#: The most cells that one edit clears, and values that one appends.
MAX_CLEAR, MAX_APPEND = 10_000, 16_384
#: The order of a worksheet's children.
ORDER = (
    "sheetPr dimension sheetViews sheetFormatPr cols sheetData sheetCalcPr sheetProtection protectedRanges scenarios autoFilter sortState dataConsolidate "
    "customSheetViews mergeCells phoneticPr conditionalFormatting dataValidations hyperlinks printOptions pageMargins pageSetup headerFooter rowBreaks colBreaks "
    "customProperties cellWatches ignoredErrors smartTags drawing legacyDrawing legacyDrawingHF picture oleObjects controls webPublishItems tableParts extLst"
).split()
#: Parts that a sheet may depend on in ways that a deletion would break.
UNSAFE = ("pivotTable", "queryTable", "oleObject", "control", "threadedComment", "slicer", "timeline", "connections", "externalLink")
#: Fixed value: the start of the namespaces of legacy drawings.
VML = "urn:schemas-microsoft-com"


class EditError(ValueError):
    pass


def _label(row: int, col: int) -> str:
    if not (0 <= row < MAX_ROWS and 0 <= col < MAX_COLS):
        raise EditError("place is out of the grid")
    return f"{column_letters(col)}{row + 1}"


def _children(node, name: str | None = None) -> list:
    return [c for c in node.childNodes if c.nodeType == c.ELEMENT_NODE and (name is None or c.localName == name or c.tagName.rpartition(":")[2] == name)]


def _all(node, name: str) -> list:
    return [e for e in node.getElementsByTagName("*") if e.tagName.rpartition(":")[2] == name]


class Package:
    def __init__(self, data: bytes):
        archive = open_zip(data)
        try:
            self.parts = {i.filename: archive.read(i) for i in archive.infolist() if not i.is_dir()}
        except (zipfile.BadZipFile, EOFError, OSError, ValueError) as e:
            raise ReadError("zip", str(e)) from None
        self.trees: dict[str, minidom.Document] = {}
        rels = self._targets("")
        self.main = next((t for k, t, _ in rels if k == "officeDocument"), "xl/workbook.xml")
        if self.main not in self.parts:
            raise ReadError("missing_workbook")
        if any("digital-signature" in n or n.startswith("_xmlsignatures/") for n in self.parts):
            raise EditError("signed packages are read-only")

    def tree(self, name: str) -> minidom.Document:
        if name not in self.trees:
            if b"<!DOCTYPE" in self.parts[name][:4096]:
                raise ReadError("xml", "document types are refused")
            try:
                self.trees[name] = minidom.parseString(self.parts[name])
            except ExpatError as e:
                raise ReadError("xml", str(e)) from None
        return self.trees[name]

    def _rels(self, of: str) -> str:
        folder, name = posixpath.split(of)
        return posixpath.join(folder, "_rels", name + ".rels")

    def _targets(self, of: str) -> list[tuple[str, str, str]]:
        """(kind, target, id)."""
        if self._rels(of) not in self.parts:
            return []
        out = []
        for e in _all(minidom.parseString(self.parts[self._rels(of)]), "Relationship"):
            target, folder = e.getAttribute("Target"), posixpath.dirname(of)
            if e.getAttribute("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out.append((e.getAttribute("Type").rpartition("/")[2], target, e.getAttribute("Id")))
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, raw in self.parts.items():
                made = self.trees[name].toxml("UTF-8", standalone=True) if name in self.trees else raw
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), made, zipfile.ZIP_DEFLATED)
        return out.getvalue()


class Editor:
    """Edits by sheet name. Rows and columns count from 0."""

    def __init__(self, data: bytes):
        self.package = Package(data)

    def save(self) -> bytes:
        return self.package.to_bytes()

    def transaction(self, change: Callable[[Editor], None]) -> None:
        """All of change's edits, or none."""
        trial = Editor(self.save())
        change(trial)
        self.package = Package(trial.save())

    # Finding

    def _book(self):
        return self.package.tree(self.package.main).documentElement

    def _listed(self) -> list:
        return _children(_children(self._book(), "sheets")[0], "sheet")

    def _entry(self, sheet: str):
        found = next((e for e in self._listed() if e.getAttribute("name") == sheet), None)
        if found is None:
            raise EditError(f"no sheet {sheet}")
        return found

    def _part(self, entry) -> str:
        rid = next(v for k, v in entry.attributes.items() if k.rpartition(":")[2] == "id")
        return next(t for _, t, i in self.package._targets(self.package.main) if i == rid)

    def _sheet(self, sheet: str):
        return self.package.tree(self._part(self._entry(sheet))).documentElement

    def _child(self, node, name: str, make: bool = True):
        """A worksheet's child, made in its place if it is missing."""
        found = _children(node, name)
        if found or not make:
            return found[0] if found else None
        new = self._new(node, name)
        after = [c for c in _children(node) if c.tagName.rpartition(":")[2] in ORDER and ORDER.index(c.tagName.rpartition(":")[2]) > ORDER.index(name)]
        node.insertBefore(new, after[0] if after else None)
        return new

    def _new(self, node, tag: str, /, **attrs: object):
        prefix = node.tagName.rpartition(":")[0]
        made = node.ownerDocument.createElement(f"{prefix}:{tag}" if prefix else tag)
        for k, v in attrs.items():
            made.setAttribute(k, str(v))
        return made

    def _row(self, sheet: str, row: int):
        data = self._child(self._sheet(sheet), "sheetData")
        for r in _children(data, "row"):
            at = int(r.getAttribute("r") or 0)
            if at == row + 1:
                return r
            if at > row + 1:
                return data.insertBefore(self._new(data, "row", r=row + 1), r)
        return data.appendChild(self._new(data, "row", r=row + 1))

    def _cell(self, sheet: str, row: int, col: int):
        label, line = _label(row, col), self._row(sheet, row)
        for c in _children(line, "c"):
            place = cell_place(c.getAttribute("r"))
            if place and place[1] == col:
                return c
            if place and place[1] > col:
                return line.insertBefore(self._new(line, "c", r=label), c)
        return line.appendChild(self._new(line, "c", r=label))

    def _stale(self) -> None:
        """Drops the calculation chain."""
        p = self.package
        for kind, target, rid in p._targets(p.main):
            if kind == "calcChain":
                p.parts.pop(target, None)
                rels = p.tree(p._rels(p.main))
                for e in _all(rels, "Relationship"):
                    if e.getAttribute("Id") == rid:
                        e.parentNode.removeChild(e)
                p.parts[p._rels(p.main)] = p.trees.pop(p._rels(p.main)).toxml("UTF-8")
                self._content_type(target, None)

    def _content_type(self, name: str, kind: str | None) -> None:
        root = self.package.tree("[Content_Types].xml").documentElement
        for e in _children(root, "Override"):
            if e.getAttribute("PartName").lstrip("/") == name:
                root.removeChild(e)
        if kind:
            root.appendChild(self._new(root, "Override", PartName="/" + name, ContentType=kind))

    # Cells

    def set_cell_value(self, sheet: str, row: int, col: int, value, formula: str | None = None) -> None:
        """A number, text, boolean or None (blank); the cell keeps its style."""
        cell = self._cell(sheet, row, col)
        for c in list(cell.childNodes):
            cell.removeChild(c)
        if cell.hasAttribute("t"):
            cell.removeAttribute("t")

        def put(name: str, text: str):
            node = cell.appendChild(self._new(cell, name))
            node.appendChild(cell.ownerDocument.createTextNode(text))
            return node

        if formula is not None:
            put("f", formula.removeprefix("="))
        if isinstance(value, bool):
            cell.setAttribute("t", "b")
            put("v", str(int(value)))
        elif isinstance(value, (int, float)):
            if value != value or value in (float("inf"), float("-inf")):
                raise EditError("numbers must be finite")
            put("v", number_text(float(value)))
        elif value is not None:
            text = str(value)
            if len(text.encode("utf-16-le")) // 2 > 32_767 or re.search("[\x00-\x08\x0b\x0c\x0e-\x1f]", text):
                raise EditError("text cannot be held by a cell")
            if formula is not None:
                cell.setAttribute("t", "str")
                put("v", text)
            else:
                cell.setAttribute("t", "inlineStr")
                inner = cell.appendChild(self._new(cell, "is")).appendChild(self._new(cell, "t"))
                inner.setAttribute("xml:space", "preserve")
                inner.appendChild(cell.ownerDocument.createTextNode(text))
        self._stale()

    def set_cell_formula(self, sheet: str, row: int, col: int, formula: str, cached=None) -> None:
        self.set_cell_value(sheet, row, col, cached, formula)

    def append_row(self, sheet: str, values: list) -> int:
        """Below the last numbered row; gives the new row."""
        if len(values) > MAX_APPEND:
            raise EditError("too many values")
        data = self._child(self._sheet(sheet), "sheetData")
        row = max((int(r.getAttribute("r") or 0) for r in _children(data, "row")), default=0)
        for col, value in enumerate(values):
            self.set_cell_value(sheet, row, col, value)
        return row

    def clear_range(self, sheet: str, r0: int, c0: int, r1: int, c1: int) -> None:
        if (r1 - r0 + 1) * (c1 - c0 + 1) > MAX_CLEAR:
            raise EditError("range is too large")
        for line in _children(self._child(self._sheet(sheet), "sheetData"), "row"):
            for c in _children(line, "c"):
                place = cell_place(c.getAttribute("r"))
                if place and r0 <= place[0] <= r1 and c0 <= place[1] <= c1:
                    for x in list(c.childNodes):
                        c.removeChild(x)
                    if c.hasAttribute("t"):
                        c.removeAttribute("t")
        self._stale()

    # Layout

    def merge_cells(self, sheet: str, r0: int, c0: int, r1: int, c1: int) -> None:
        if (r0, c0) == (r1, c1):
            raise EditError("a merge has two cells or more")
        root = self._sheet(sheet)
        held = self._child(root, "mergeCells")
        for m in _children(held, "mergeCell"):
            a = box(m.getAttribute("ref"))
            if a and a[0] <= r1 and r0 <= a[2] and a[1] <= c1 and c0 <= a[3]:
                raise EditError("merges may not overlap")
        held.appendChild(self._new(held, "mergeCell", ref=f"{_label(r0, c0)}:{_label(r1, c1)}"))
        held.setAttribute("count", str(len(_children(held))))

    def unmerge_cells(self, sheet: str, r0: int, c0: int, r1: int, c1: int) -> None:
        held = self._child(self._sheet(sheet), "mergeCells", make=False)
        found = [m for m in _children(held, "mergeCell") if box(m.getAttribute("ref")) == (r0, c0, r1, c1)] if held else []
        if not found:
            raise EditError("there is no such merge")
        held.removeChild(found[0])
        held.setAttribute("count", str(len(_children(held))))
        if not _children(held):
            held.parentNode.removeChild(held)

    def set_row_height(self, sheet: str, row: int, height: float, hidden: bool = False) -> None:
        line = self._row(sheet, row)
        line.setAttribute("ht", number_text(float(height)))
        line.setAttribute("customHeight", "1")
        line.setAttribute("hidden", str(int(hidden)))

    def set_column_width(self, sheet: str, col: int, width: float, hidden: bool = False) -> None:
        held, at = self._child(self._sheet(sheet), "cols"), col + 1
        for c in _children(held, "col"):
            low, high = int(c.getAttribute("min")), int(c.getAttribute("max"))
            if not low <= at <= high:
                continue
            for a, b in ((low, at - 1), (at + 1, high)):
                if a <= b:
                    part = c.cloneNode(True)
                    part.setAttribute("min", str(a))
                    part.setAttribute("max", str(b))
                    held.insertBefore(part, c)
            held.removeChild(c)
        later = [c for c in _children(held, "col") if int(c.getAttribute("min")) > at]
        held.insertBefore(self._new(held, "col", min=at, max=at, width=number_text(float(width)), customWidth=1, hidden=int(hidden)), later[0] if later else None)

    def set_freeze_panes(self, sheet: str, row: int, col: int) -> None:
        """Freezes above row and left of col; (0, 0) clears."""
        views = self._child(self._sheet(sheet), "sheetViews")
        view = (_children(views, "sheetView") or [views.appendChild(self._new(views, "sheetView", workbookViewId=0))])[0]
        for p in _children(view, "pane"):
            view.removeChild(p)
        if row or col:
            split = ({"xSplit": col} if col else {}) | ({"ySplit": row} if row else {})
            view.insertBefore(self._new(view, "pane", **split, topLeftCell=_label(row, col), state="frozen"), view.firstChild)

    def set_sheet_tab_color(self, sheet: str, rgb: str) -> None:
        props = self._child(self._sheet(sheet), "sheetPr")
        for c in _children(props, "tabColor"):
            props.removeChild(c)
        props.insertBefore(self._new(props, "tabColor", rgb="FF" + rgb.upper()), props.firstChild)

    def set_data_validation(self, sheet: str, ref: str, kind: str, formula1: str, formula2: str | None = None) -> None:
        """Replaces the validation of exactly this range."""
        self.delete_data_validation(sheet, ref, missing_ok=True)
        held = self._child(self._sheet(sheet), "dataValidations")
        rule = held.appendChild(self._new(held, "dataValidation", type=kind, sqref=ref, allowBlank=1))
        for name, text in (("formula1", formula1), ("formula2", formula2)):
            if text is not None:
                rule.appendChild(self._new(rule, name)).appendChild(rule.ownerDocument.createTextNode(text))
        held.setAttribute("count", str(len(_children(held))))

    def delete_data_validation(self, sheet: str, ref: str, missing_ok: bool = False) -> None:
        held = self._child(self._sheet(sheet), "dataValidations", make=False)
        found = [d for d in _children(held, "dataValidation") if d.getAttribute("sqref") == ref] if held else []
        if not found and not missing_ok:
            raise EditError("there is no such validation")
        for d in found:
            held.removeChild(d)
        if held is not None and not _children(held):
            held.parentNode.removeChild(held)

    # Relations of a sheet

    def _relation(self, of: str, kind: str, target: str, external: bool = False, base: str = RELS) -> str:
        """The id of a relation, which is made if it is missing."""
        p = self.package
        for k, t, rid in p._targets(of):
            if k == kind and t == target:
                return rid
        name = p._rels(of)
        rels = minidom.parseString(p.parts.get(name) or f'<Relationships xmlns="{PACKAGE}/relationships"/>'.encode())
        taken = {e.getAttribute("Id") for e in _all(rels, "Relationship")}
        rid = next(f"rId{n}" for n in range(1, len(taken) + 2) if f"rId{n}" not in taken)
        mode = {"TargetMode": "External"} if external else {}
        rels.documentElement.appendChild(self._new(rels.documentElement, "Relationship", Id=rid, Type=f"{base}/{kind}", Target=target if external else "/" + target, **mode))
        p.parts[name] = rels.toxml("UTF-8")
        return rid

    def _unrelate(self, of: str, rid: str) -> None:
        p = self.package
        if (name := p._rels(of)) not in p.parts:
            return
        rels = minidom.parseString(p.parts[name])
        for e in _all(rels, "Relationship"):
            if e.getAttribute("Id") == rid:
                e.parentNode.removeChild(e)
        p.parts[name] = rels.toxml("UTF-8")

    def _linked_part(self, sheet: str, kind: str, stem: str, ending: str, content: str, type_: str | None) -> str:
        """The sheet's part of a kind, which is made if it is missing."""
        p, path = self.package, self._part(self._entry(sheet))
        for k, target, _ in p._targets(path):
            if k == kind:
                return target
        n = next(n for n in range(1, len(p.parts) + 2) if f"{stem}{n}.{ending}" not in p.parts)
        made = f"{stem}{n}.{ending}"
        p.parts[made] = content.encode()
        if type_:
            self._content_type(made, type_)
        self._relation(path, kind, made)
        return made

    def set_hyperlink(self, sheet: str, row: int, col: int, target: str | None = None, location: str | None = None, tooltip: str | None = None) -> None:
        """A link of one cell to a target outside or to a place in the workbook."""
        if bool(target and target.strip()) == bool(location and location.strip()):
            raise EditError("a link has a target or a location")
        self.delete_hyperlink(sheet, row, col, missing_ok=True)
        root = self._sheet(sheet)
        held = self._child(root, "hyperlinks")
        link = held.appendChild(self._new(held, "hyperlink", ref=_label(row, col)))
        if target:
            link.setAttribute("xmlns:r", RELS)
            link.setAttribute("r:id", self._relation(self._part(self._entry(sheet)), "hyperlink", target, external=True))
        else:
            link.setAttribute("location", location.removeprefix("#"))
        if tooltip:
            link.setAttribute("tooltip", tooltip)

    def delete_hyperlink(self, sheet: str, row: int, col: int, missing_ok: bool = False) -> None:
        held = self._child(self._sheet(sheet), "hyperlinks", make=False)
        found = [h for h in _children(held, "hyperlink") if box(h.getAttribute("ref")) == (row, col, row, col)] if held else []
        if not found and not missing_ok:
            raise EditError("there is no such link")
        for h in found:
            rid = next((v for k, v in h.attributes.items() if k.rpartition(":")[2] == "id"), None)
            held.removeChild(h)
            if rid and not any(v == rid for o in _children(held) for k, v in o.attributes.items()):
                self._unrelate(self._part(self._entry(sheet)), rid)
        if held is not None and not _children(held):
            held.parentNode.removeChild(held)

    def set_comment(self, sheet: str, row: int, col: int, text: str, author: str = "") -> None:
        """A note of one cell, with the shape that shows it."""
        self.delete_comment(sheet, row, col, missing_ok=True)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml.comments+xml"
        notes = self._linked_part(sheet, "comments", "xl/comments", "xml", f'<comments xmlns="{MAIN}"><authors/><commentList/></comments>', kind)
        root = self.package.tree(notes).documentElement
        authors, listed = _children(root, "authors")[0], _children(root, "commentList")[0]
        names = ["".join(c.data for c in a.childNodes if c.nodeType == c.TEXT_NODE) for a in _children(authors)]
        if author not in names:
            authors.appendChild(self._new(authors, "author")).appendChild(root.ownerDocument.createTextNode(author))
            names.append(author)
        note = self._new(listed, "comment", ref=_label(row, col), authorId=names.index(author))
        said = note.appendChild(self._new(listed, "text")).appendChild(self._new(listed, "t"))
        said.setAttribute("xml:space", "preserve")
        said.appendChild(root.ownerDocument.createTextNode(text))
        later = [c for c in _children(listed) if (box(c.getAttribute("ref")) or (0, 0))[:2] > (row, col)]
        listed.insertBefore(note, later[0] if later else None)
        self._shape(sheet, row, col)

    def _shape(self, sheet: str, row: int, col: int) -> None:
        """The hidden box of a note, in the sheet's legacy drawing."""
        vml = f'<xml xmlns:v="{VML}:vml" xmlns:o="{VML}:office:office" xmlns:x="{VML}:office:excel"></xml>'
        drawn = self._linked_part(sheet, "vmlDrawing", "xl/drawings/vmlDrawing", "vml", vml, "application/vnd.openxmlformats-officedocument.vmlDrawing")
        root = self._sheet(sheet)
        held = self._child(root, "legacyDrawing")
        if not any(k.rpartition(":")[2] == "id" for k in held.attributes.keys()):
            held.setAttribute("xmlns:r", RELS)
            held.setAttribute("r:id", self._relation(self._part(self._entry(sheet)), "vmlDrawing", drawn))
        shapes = self.package.tree(drawn).documentElement
        n = 1 + max([int(m[1]) for e in _all(shapes, "shape") if (m := re.fullmatch(r"_x0000_s(\d+)", e.getAttribute("id")))], default=1024)
        shape = (
            f'<v:shape xmlns:v="{VML}:vml" xmlns:o="{VML}:office:office" xmlns:x="{VML}:office:excel" id="_x0000_s{n}" style="position:absolute;visibility:hidden" fillcolor="#ffffe1" o:insetmode="auto">'
            f'<x:ClientData ObjectType="Note"><x:MoveWithCells/><x:SizeWithCells/><x:Row>{row}</x:Row><x:Column>{col}</x:Column></x:ClientData></v:shape>'
        )
        shapes.appendChild(shapes.ownerDocument.importNode(minidom.parseString(shape).documentElement, True))

    def delete_comment(self, sheet: str, row: int, col: int, missing_ok: bool = False) -> None:
        p, found = self.package, False
        for kind, target, _ in p._targets(self._part(self._entry(sheet))):
            if kind == "comments":
                for c in _all(p.tree(target), "comment"):
                    if box(c.getAttribute("ref")) == (row, col, row, col):
                        c.parentNode.removeChild(c)
                        found = True
            elif kind == "vmlDrawing":
                at = lambda e, name: "".join(c.data for x in _all(e, name) for c in x.childNodes)
                for shape in _all(p.tree(target), "shape"):
                    if (at(shape, "Row").strip(), at(shape, "Column").strip()) == (str(row), str(col)):
                        shape.parentNode.removeChild(shape)
        if not found and not missing_ok:
            raise EditError("there is no such comment")

    def set_table_range(self, name: str, r0: int, c0: int, r1: int, c1: int) -> None:
        """A table's new range: its header row stays where it is, and as wide as it is."""
        p = self.package
        for entry in self._listed():
            for kind, target, _ in p._targets(self._part(entry)):
                root = p.tree(target).documentElement if kind == "table" else None
                if root is None or (root.getAttribute("displayName") or root.getAttribute("name")).lower() != name.lower():
                    continue
                old = box(root.getAttribute("ref"))
                if (r0, c0, c1) != (old[0], old[1], old[3]) or r1 <= r0:
                    raise EditError("a table keeps its header row and has a row below it")
                ref = f"{_label(r0, c0)}:{_label(r1, c1)}"
                root.setAttribute("ref", ref)
                totals = int(root.getAttribute("totalsRowCount") or 0)
                for f in _children(root, "autoFilter"):
                    f.setAttribute("ref", f"{_label(r0, c0)}:{_label(max(r0, r1 - totals), c1)}")
                return
        raise EditError(f"no table {name}")

    def set_print_area(self, sheet: str, area: tuple[int, int, int, int] | None) -> None:
        """The rectangle of a sheet that is printed; None for all."""
        book, at = self._book(), self._listed().index(self._entry(sheet))
        held = (_children(book, "definedNames") or [None])[0]
        if held is None:
            held = book.insertBefore(self._new(book, "definedNames"), _children(book, "sheets")[0].nextSibling)
        for e in _children(held, "definedName"):
            if e.getAttribute("name") == "_xlnm.Print_Area" and e.getAttribute("localSheetId") == str(at):
                held.removeChild(e)
        if area is not None:
            r0, c0, r1, c1 = area
            if r1 < r0 or c1 < c0:
                raise EditError("the area has no cell")
            place = lambda r, c: re.sub(r"^([A-Z]+)", r"$\1$", _label(r, c))
            made = held.appendChild(self._new(held, "definedName", name="_xlnm.Print_Area", localSheetId=at))
            quoted = "'" + sheet.replace("'", "''") + "'"
            made.appendChild(held.ownerDocument.createTextNode(f"{quoted}!{place(r0, c0)}:{place(r1, c1)}"))
        if not _children(held):
            book.removeChild(held)

    # Workbook

    def set_defined_name(self, name: str, refers_to: str | None) -> None:
        """A global name; None removes it."""
        if name.startswith("_xlnm."):
            raise EditError("built-in names are not edited")
        book = self._book()
        held = (_children(book, "definedNames") or [None])[0]
        if held is None:
            sheets = _children(book, "sheets")[0]
            held = book.insertBefore(self._new(book, "definedNames"), sheets.nextSibling)
        for e in _children(held, "definedName"):
            if e.getAttribute("name").lower() == name.lower() and not e.hasAttribute("localSheetId"):
                held.removeChild(e)
        if refers_to is not None:
            held.appendChild(self._new(held, "definedName", name=name)).appendChild(held.ownerDocument.createTextNode(refers_to))
        if not _children(held):
            book.removeChild(held)

    def set_active_sheet(self, sheet: str) -> None:
        at = self._listed().index(self._entry(sheet))
        for v in _all(self._book(), "workbookView"):
            v.setAttribute("activeTab", str(at))

    def set_sheet_visibility(self, sheet: str, state: str) -> None:
        entry = self._entry(sheet)
        if state not in ("visible", "hidden", "veryHidden"):
            raise EditError("no such state")
        seen = [e for e in self._listed() if e.getAttribute("state") in ("", "visible")]
        if state != "visible" and seen == [entry]:
            raise EditError("the last visible sheet stays visible")
        entry.setAttribute("state", state)

    def _free_name(self, name: str, but: str | None = None) -> None:
        if not 1 <= len(name) <= 31 or re.search(r"[:\\/?*\[\]]", name) or name.strip() != name:
            raise EditError(f"invalid sheet name: {name}")
        if any(e.getAttribute("name").lower() == name.lower() != (but or "").lower() for e in self._listed()):
            raise EditError(f"there is a sheet {name}")

    def add_sheet(self, name: str) -> None:
        self._free_name(name)
        p, k = self.package, 1
        while (path := f"xl/worksheets/sheet{k}.xml") in p.parts:
            k += 1
        p.parts[path] = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{MAIN}"><sheetData/></worksheet>'.encode()
        self._content_type(path, "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml")
        taken = {i for _, _, i in p._targets(p.main)}
        rid = next(f"rId{n}" for n in range(1, 10_000) if f"rId{n}" not in taken)
        rels = minidom.parseString(p.parts[p._rels(p.main)])
        rels.documentElement.appendChild(self._new(rels.documentElement, "Relationship", Id=rid, Type=f"{RELS}/worksheet", Target="/" + path))
        p.parts[p._rels(p.main)] = rels.toxml("UTF-8")
        sheets = _children(self._book(), "sheets")[0]
        entry = self._new(sheets, "sheet", name=name, sheetId=max(int(e.getAttribute("sheetId")) for e in self._listed()) + 1)
        entry.setAttribute("xmlns:r", RELS)
        entry.setAttribute("r:id", rid)
        sheets.appendChild(entry)

    def _rewrite(self, old: str, new: str | None) -> None:
        """Every formula and name that refers to a sheet."""
        p = self.package
        for path in [n for n in p.parts if n.endswith(".xml") and n.startswith("xl/") and old.lower().encode() in p.parts[n].lower() or n == p.main or n in p.trees]:
            if path == "[Content_Types].xml" or path not in p.parts:
                continue
            for e in _all(p.tree(path), "f") + _all(p.tree(path), "definedName") + [x for k in ("formula", "formula1", "formula2") for x in _all(p.tree(path), k)]:
                text = "".join(c.data for c in e.childNodes if c.nodeType == c.TEXT_NODE)
                if (made := rewritten(text, old, new)) != text:
                    for c in list(e.childNodes):
                        e.removeChild(c)
                    e.appendChild(e.ownerDocument.createTextNode(made))
            for e in _all(p.tree(path), "hyperlink"):
                if e.hasAttribute("location"):
                    e.setAttribute("location", rewritten(e.getAttribute("location"), old, new))
        self._stale()

    def rename_sheet(self, old: str, new: str) -> None:
        entry = self._entry(old)
        self._free_name(new, but=old)
        self._rewrite(old, new)
        entry.setAttribute("name", new)

    def delete_sheet(self, name: str) -> None:
        """References to it become #REF!; a sheet with pivots, queries, controls or the like is refused."""
        entry, p = self._entry(name), self.package
        if not [e for e in self._listed() if e is not entry and e.getAttribute("state") in ("", "visible")]:
            raise EditError("the last visible sheet stays")
        path, at = self._part(entry), self._listed().index(entry)
        if any(u.lower() in kind.lower() for kind, _, _ in p._targets(path) for u in UNSAFE):
            raise EditError("other parts depend on the sheet")
        self._rewrite(name, None)
        entry.parentNode.removeChild(entry)
        for e in _all(self._book(), "definedName"):
            if e.hasAttribute("localSheetId"):
                k = int(e.getAttribute("localSheetId"))
                if k == at:
                    e.parentNode.removeChild(e)
                elif k > at:
                    e.setAttribute("localSheetId", str(k - 1))
        rels = minidom.parseString(p.parts[p._rels(p.main)])
        for e in _all(rels, "Relationship"):
            if posixpath.basename(e.getAttribute("Target")) == posixpath.basename(path) and e.getAttribute("Type").endswith("/worksheet"):
                e.parentNode.removeChild(e)
        p.parts[p._rels(p.main)] = rels.toxml("UTF-8")
        for gone in (path, p._rels(path)):
            p.parts.pop(gone, None)
            p.trees.pop(gone, None)
        self._content_type(path, None)
        for v in _all(self._book(), "workbookView"):
            v.setAttribute("activeTab", "0")

    def set_document_properties(self, **values: str | None) -> None:
        """title, subject, creator, keywords, description or lastModifiedBy; None removes one."""
        path = next((t for k, t, _ in self.package._targets("") if k == "core-properties"), None)
        if path is None or path not in self.package.parts:
            path = "docProps/core.xml"
            self.package.parts[path] = f'<cp:coreProperties xmlns:cp="{PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"/>'.encode()
            self._content_type(path, "application/vnd.openxmlformats-package.core-properties+xml")
            self._relation("", "core-properties", path, base=f"{PACKAGE}/relationships/metadata")
        root = self.package.tree(path).documentElement
        for name, text in values.items():
            for e in _children(root, name):
                root.removeChild(e)
            if text is not None:
                prefix = "cp" if name in ("keywords", "lastModifiedBy") else "dc"
                node = root.ownerDocument.createElement(f"{prefix}:{name}")
                node.appendChild(root.ownerDocument.createTextNode(text))
                root.appendChild(node)


def edit_workbooks(files: DataFrame, edits: list[tuple[str, dict]]) -> DataFrame:
    """path, content and error of files (path, content) after the same edits, all or none in each."""
    import pandas as pd

    def one(content: bytes) -> tuple[bytes, str | None]:
        try:
            editor = Editor(content)
            editor.transaction(lambda e: [getattr(e, name)(**how) for name, how in edits] and None)
            return editor.save(), None
        except (EditError, ReadError) as e:
            return content, str(e)

    def run(batches):
        for pdf in batches:
            made = [one(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "content": [m[0] for m in made], "error": [m[1] for m in made]})

    return files.select("path", "content").mapInPandas(run, "path string, content binary, error string")
