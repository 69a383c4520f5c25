"""Binary Office Open XML workbooks (.xlsb): reading values, names, merges and links.

Formulas are token streams, which tokens.py tells.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import replace

from gridloom.plans.formula import Error
from gridloom.sources import numfmt, tokens
from gridloom.sources.model import ReadError, Workbook, open_zip, part
from gridloom.sources.xls import rk
from gridloom.sources.xlsx import relations

#: Record types.
ROW, BLANK, RK, ERROR, BOOL, REAL, ST, ISST, FMLA_ST, FMLA_NUM, FMLA_BOOL, FMLA_ERROR = range(12)
SST_ITEM, XF, FMT, BUNDLE, WB_PROP, MERGE, HLINK, NAME, CELL_XFS, CELL_XFS_END = 19, 47, 44, 156, 153, 176, 494, 39, 617, 618
#: Records of what formulas refer to, and of shared and array formulas.
COMMENT_AUTHOR, COMMENT, COMMENT_TEXT = 632, 635, 637
EXTERN_SHEETS, SUP_BOOK, SUP_SELF, SUP_SAME, ARRAY, SHARED = 362, 355, 357, 358, 426, 427


def is_xlsb(data: bytes) -> bool:
    archive = open_zip(data)
    return part(archive, "xl/workbook.bin") is not None


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, body); both type and size are written in groups of seven bits."""
    at = 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind & 0x80 and at < len(data):
            kind = kind & 0x7F | (data[at] & 0x7F) << 7
            at += 1
        size = shift = 0
        for _ in range(4):
            if at >= len(data):
                return
            size |= (data[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if not data[at - 1] & 0x80:
                break
        if at + size > len(data):
            raise ReadError("biff", "record runs over the end")
        yield kind, data[at : at + size]
        at += size


def wide(b: bytes, at: int) -> tuple[str, int]:
    """A string with its length in four bytes, and where it ends."""
    n = struct.unpack_from("<I", b, at)[0]
    if n == 0xFFFFFFFF:
        return "", at + 4
    return b[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def read(data: bytes) -> Workbook:
    archive = open_zip(data)
    main = next((t for kind, t in relations(archive, "").values() if kind == "officeDocument"), "xl/workbook.bin")
    body = part(archive, main)
    if body is None:
        raise ReadError("missing_workbook")
    try:
        return _read(archive, main, body)
    except (struct.error, IndexError) as e:
        raise ReadError("biff", str(e)) from None


def _read(archive, main: str, body: bytes) -> Workbook:
    book = Workbook(parts=[(i.filename, i.file_size, i.compress_size) for i in archive.infolist()])
    rels = relations(archive, main)
    by_kind = {kind: target for kind, target in rels.values()}
    strings = [wide(b, 1)[0] for kind, b in records(part(archive, by_kind.get("sharedStrings", "")) or b"") if kind == SST_ITEM]
    codes, kinds, within = {}, [], False
    for kind, b in records(part(archive, by_kind.get("styles", "")) or b""):
        within = kind == CELL_XFS or within and kind != CELL_XFS_END
        if kind == FMT:
            codes[struct.unpack_from("<H", b)[0]] = wide(b, 2)[0]
        elif kind == XF and within:
            ident = struct.unpack_from("<H", b, 2)[0]
            kinds.append(numfmt.class_of(ident, codes.get(ident)))
    listed, targets, named, books, externs = [], [], [], [], []
    for kind, b in records(body):
        if kind == WB_PROP:
            book.date1904 = bool(b[0] & 1)
        elif kind == BUNDLE:
            rel, at = wide(b, 8)
            title, _ = wide(b, at)
            listed.append(title)
            target = rels.get(rel, ("", ""))
            targets.append(target[1])
            state = ("visible", "hidden", "veryHidden")[min(struct.unpack_from("<I", b)[0], 2)]
            sort = {"chartsheet": "ChartSheet", "dialogsheet": "DialogSheet", "xlMacrosheet": "MacroSheet"}.get(target[0], "WorkSheet")
            book.sheets.append((len(listed) - 1, title, sort, state, None, None, None, False, True, None, False, None))
        elif kind in (SUP_BOOK, SUP_SELF, SUP_SAME):
            books.append(kind)
        elif kind == EXTERN_SHEETS:
            externs = [struct.unpack_from("<I2i", b, 4 + 12 * i) for i in range(struct.unpack_from("<I", b)[0])]
        elif kind == NAME:
            scope = struct.unpack_from("<I", b, 5)[0]
            name, at = wide(b, 9)
            named.append((listed[scope] if scope < len(listed) else None, name, *_tokens(b, at)))

    def prefix(index: int) -> str:
        """Only sheets of this workbook have one."""
        link, first, last = externs[index] if index < len(externs) else (-1, -1, -1)
        own = books[link] == SUP_SELF if link < len(books) else link == 0
        if not own or not 0 <= min(first, last) <= max(first, last) < len(listed):
            raise tokens.Untold
        return tokens.prefix(listed[first], listed[last])

    context = tokens.Context("biff12", [n[1] for n in named], prefix)
    for scoped, name, source, extra in named:
        book.names.append((scoped, name, tokens.told(source, extra, context) if source else ""))
    for index, (title, target) in enumerate(zip(listed, targets)):
        _sheet(book, archive, index, title, target, strings, kinds, context)
    return book


def _tokens(b: bytes, at: int) -> tuple[bytes, bytes]:
    """A token stream with its length in four bytes, and what stands behind it, likewise."""
    size = struct.unpack_from("<I", b, at)[0]
    end = at + 4 + size
    more = struct.unpack_from("<I", b, end)[0] if len(b) >= end + 4 else 0
    return b[at + 4 : end], b[end + 4 : end + 4 + more]


def _sheet(book: Workbook, archive, index: int, title: str, target: str, strings: list[str], kinds: list[str], context: tokens.Context) -> None:
    row, shares, shared, last = 0, {}, {}, (0, 0)
    rels = relations(archive, target)
    for kind, b in records(part(archive, target) or b""):
        if kind == ROW:
            row = struct.unpack_from("<I", b)[0]
        elif BLANK < kind <= FMLA_ERROR:
            col, style = struct.unpack_from("<2I", b)
            value, at = _value(kind, b, strings)
            source = None
            if kind >= FMLA_ST:
                body, extra = _tokens(b, at + 2)
                source, last = tokens.told(body, extra, replace(context, base=(row, col))), (row, col)
                if to := tokens.shared_with(body, "biff12"):
                    shares[row, col] = to[0], struct.unpack_from("<I", extra)[0] if len(extra) >= 4 else col
            fmt = kinds[style & 0xFFFFFF] if style & 0xFFFFFF < len(kinds) else "Plain"
            shown = numfmt.render(value, fmt, book.date1904) if isinstance(value, float) else ("TRUE" if value else "FALSE") if isinstance(value, bool) else str(value)
            if shown or source:
                book.add_cell(index, title, row, col, value, shown, "date" if isinstance(value, float) and numfmt.is_date(fmt) else None, source, style & 0xFFFFFF)
        elif kind in (ARRAY, SHARED):
            r0, _, c0, _ = struct.unpack_from("<4I", b)
            for place in {(r0, c0), last}:
                shared[place] = *_tokens(b, 16 if kind == SHARED else 17), kind == SHARED
        elif kind == MERGE:
            r0, r1, c0, c1 = struct.unpack_from("<4I", b)
            book.add_range(index, "merge", (r0, c0, r1, c1))
        elif kind == HLINK:
            r0, r1, c0, c1 = struct.unpack_from("<4I", b)
            book.add_range(index, "hyperlink", (r0, c0, r1, c1), text=rels.get(wide(b, 16)[0], ("", None))[1])
    for kind, target in rels.values():
        if kind == "comments":
            _comments(book, index, records(part(archive, target) or b""))
    for k, c in enumerate(book.cells):
        to = shares.get((c[3], c[4])) if c[0] == index else None
        if to in shared:
            body, extra, moves = shared[to]
            book.cells[k] = (*c[:10], tokens.told(body, extra, replace(context, base=(c[3], c[4]) if moves else to)), *c[11:])


def _comments(book: Workbook, index: int, found: Iterator[tuple[int, bytes]]) -> None:
    authors, at = [], None
    for kind, b in found:
        if kind == COMMENT_AUTHOR:
            authors.append(wide(b, 0)[0])
        elif kind == COMMENT:
            who, row, _, col, _ = struct.unpack_from("<5I", b)
            at = (row, col, row, col), authors[who] if who < len(authors) else ""
        elif kind == COMMENT_TEXT and at:
            book.add_range(index, "comment", at[0], text=wide(b, 1)[0], author=at[1])
            at = None


def _value(kind: int, b: bytes, strings: list[str]) -> tuple[object, int]:
    """The value of a cell record, and where what follows it begins."""
    if kind == RK:
        return rk(struct.unpack_from("<I", b, 8)[0]), 12
    if kind in (ERROR, FMLA_ERROR):
        return Error(tokens.ERROR_CODES.get(b[8], "#ERR!")), 9
    if kind in (BOOL, FMLA_BOOL):
        return bool(b[8]), 9
    if kind in (REAL, FMLA_NUM):
        return struct.unpack_from("<d", b, 8)[0], 16
    if kind == ISST:
        at = struct.unpack_from("<I", b, 8)[0]
        return strings[at] if at < len(strings) else "", 12
    return wide(b, 8)
