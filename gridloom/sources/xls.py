"""BIFF workbooks (.xls, versions 5 to 8): reading, with formulas from their tokens."""

from __future__ import annotations

import struct

from gridloom.plans.formula import Error
from gridloom.sources import cfb, numfmt, tokens
from gridloom.sources.model import ReadError, Workbook

#: Code pages by number, cp1252 where none is known.
CODEPAGES = {874: "cp874", 932: "cp932", 936: "gbk", 949: "cp949", 1361: "johab", 51949: "euc_kr", 950: "cp950", 1251: "cp1251", 65001: "utf-8", **{n: f"cp{n}" for n in range(1253, 1259)}}


def rk(raw: int) -> float:
    """A number in 30 bits: an integer or the top of a double, maybe in hundredths."""
    if raw & 2:
        value = float((raw & 0xFFFFFFFF) >> 2 if not raw & 0x80000000 else ((raw >> 2) | ~0x3FFFFFFF))
    else:
        value = struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


class _Strings:
    """Unicode strings that run over record boundaries; each piece starts with its own width flag."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.k, self.at = pieces, 0, 0

    def raw(self, n: int) -> bytes:
        out = b""
        while n > 0 and self.k < len(self.pieces):
            got = self.pieces[self.k][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if n > 0:
                self.k, self.at = self.k + 1, 0
        return out

    def text(self, n: int, wide: bool) -> str:
        out = ""
        while n > 0 and self.k < len(self.pieces):
            left = self.pieces[self.k][self.at :]
            take = min(n, len(left) // (2 if wide else 1))
            got = left[: take * (2 if wide else 1)]
            out += got.decode("utf-16-le" if wide else "latin-1", "replace")
            self.at, n = self.at + len(got), n - take
            if n > 0:
                self.k, self.at = self.k + 1, 1
                if self.k < len(self.pieces):
                    wide = bool(self.pieces[self.k][:1] and self.pieces[self.k][0] & 1)
        return out

    def string(self) -> str:
        head = self.raw(3)
        if len(head) < 3:
            return ""
        n, flags = struct.unpack("<HB", head)
        runs = struct.unpack("<H", self.raw(2).ljust(2, b"\0"))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.raw(4).ljust(4, b"\0"))[0] if flags & 4 else 0
        text = self.text(n, bool(flags & 1))
        self.raw(runs * 4 + extra)
        return text


def records(stream: bytes):
    """(kind, [pieces]) with continuations gathered; a cut record is an error, zeros at the end are not."""
    at, held = 0, None
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        if kind == 0 and not stream[at:].strip(b"\0"):
            break
        if at + 4 + size > len(stream):
            raise ReadError("biff", "record runs over the end")
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0x3C and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = (kind, [body])
    if held:
        yield held


def read(data: bytes, codepage: int | None = None) -> Workbook:
    if data[:2] == b"\x09\x08" or data[:4] in (b"\x09\x00\x04\x00", b"\x09\x02\x06\x00", b"\x09\x04\x06\x00"):
        raise ReadError("legacy_biff")
    found = cfb.streams(data)
    if "EncryptedPackage" in found:
        raise ReadError("encrypted_package")
    stream = found.get("Workbook", found.get("Book"))
    if stream is None:
        raise ReadError("missing_workbook")
    try:
        return _Reader(codepage).read(stream)
    except (struct.error, IndexError) as e:
        raise ReadError("biff", str(e)) from None


#: Class ids of links to addresses and to files.
URL_LINK, FILE_LINK = (bytes.fromhex(x) for x in ("e0c9ea79f9bace118c8200aa004ba90b", "0303000000000000c000000000000046"))


def link(b: bytes) -> str | None:
    """The target of a link record, behind its range: an address, a file or #place; None if it has none."""
    try:
        flags, at = struct.unpack_from("<I", b, 20)[0], 24

        def text() -> str:
            nonlocal at
            n = struct.unpack_from("<I", b, at)[0]
            at += 4 + 2 * n
            return b[at - 2 * n : at].decode("utf-16-le", "replace").rstrip("\0")

        for part in (0x14, 0x80):  # shown text, frame
            if flags & part:
                text()
        target = ""
        if flags & 0x101 == 0x101:  # a path as plain text
            target = text()
        elif flags & 1:
            kind, at = b[at : at + 16], at + 16
            if kind == URL_LINK:
                n = struct.unpack_from("<I", b, at)[0]
                target = b[at + 4 : at + 4 + n].decode("utf-16-le", "replace").split("\0")[0]
                at += 4 + n
            elif kind == FILE_LINK:
                up, n = struct.unpack_from("<HI", b, at)
                target = "../" * up + b[at + 6 : at + 6 + n].rstrip(b"\0").decode("latin-1").replace("\\", "/")
                at += 6 + n + 24
                at += 4 + struct.unpack_from("<I", b, at)[0]
            else:
                return None
        if flags & 8:
            target += "#" + text()
        return target or None
    except struct.error:
        return None


class _Reader:
    def __init__(self, codepage: int | None):
        self.book, self.codec, self.forced = Workbook(), CODEPAGES.get(codepage or 0, "cp1252"), codepage is not None
        self.titles: list[str] = []
        self.strings: list[str] = []
        self.codes: dict[int, str] = {}
        self.kinds: list[int] = []
        self.externs: list[tuple[int, int]] = []
        self.names: list[str] = []
        self.wide = True
        # Cells that share a formula, by sheet, row and column, with the cell it stands at; and those formulas.
        self.shares: dict[tuple, tuple] = {}
        self.shared: dict[tuple, tuple[bytes, bytes, bool]] = {}
        self.last = (0, 0)
        # The texts of drawn notes, by sheet and object, and the object at hand.
        self.notes: dict[tuple[int, int], str] = {}
        self.object: int | None = None

    def short(self, b: bytes, at: int) -> str:
        """A string with a length byte."""
        n = b[at]
        if not self.wide:
            return b[at + 1 : at + 1 + n].decode(self.codec, "replace")
        two = b[at + 1] & 1
        return b[at + 2 : at + 2 + n * (1 + two)].decode("utf-16-le" if two else "latin-1", "replace")

    def long(self, pieces: list[bytes], at: int) -> str:
        if self.wide:
            s = _Strings([pieces[0][at:], *pieces[1:]])
            return s.string()
        n = struct.unpack_from("<H", pieces[0], at)[0]
        return b"".join(pieces)[at + 2 : at + 2 + n].decode(self.codec, "replace")

    def read(self, stream: bytes) -> Workbook:
        depth, sheet, wait = 0, -1, None
        for kind, pieces in records(stream):
            b = pieces[0]
            if kind == 0x809:
                version = struct.unpack_from("<H", b)[0]
                if depth == 0:
                    if version not in (0x500, 0x600):
                        raise ReadError("legacy_biff")
                    self.wide = version == 0x600
                    if struct.unpack_from("<H", b, 2)[0] != 5:
                        sheet += 1
                depth += 1
            elif kind == 0x0A:
                depth = max(0, depth - 1)
            elif kind == 0x2F:
                raise ReadError("encrypted")
            elif sheet < 0:
                self.globals(kind, pieces)
            elif depth == 1:
                wait = self.cell(kind, pieces, sheet, wait)
        self.expand()
        return self.book

    def expand(self) -> None:
        """Gives cells that share a formula its text, relative places counted from each cell."""
        for k, c in enumerate(self.book.cells):
            at = self.shares.get((c[0], c[3], c[4]))
            found = self.shared.get((c[0], *at)) if at else None
            if found:
                body, extra, moves = found
                base = (c[3], c[4]) if moves else at
                self.book.cells[k] = (*c[:10], self.formula(body, extra, *base), *c[11:])

    def globals(self, kind: int, pieces: list[bytes]) -> None:
        b = pieces[0]
        if kind == 0x42 and not self.forced:
            self.codec = CODEPAGES.get(struct.unpack_from("<H", b)[0], "cp1252")
        elif kind == 0x22:
            self.book.date1904 = bool(b[0])
        elif kind == 0x85:
            title, state = self.short(b, 6), ("visible", "hidden", "veryHidden")[min(b[4] & 3, 2)]
            sort = {0: "WorkSheet", 1: "MacroSheet", 2: "ChartSheet", 6: "Vba"}.get(b[5], "WorkSheet")
            self.book.sheets.append((len(self.titles), title, sort, state, None, None, None, False, True, None, False, None))
            self.titles.append(title)
        elif kind == 0xFC:
            n, s = struct.unpack_from("<I", b, 4)[0], _Strings([b[8:], *pieces[1:]])
            while len(self.strings) < n and s.k < len(s.pieces):
                self.strings.append(s.string())
        elif kind == 0x41E:
            self.codes[struct.unpack_from("<H", b)[0]] = self.long(pieces, 2) if self.wide else self.short(b, 2)
        elif kind == 0xE0:
            self.kinds.append(struct.unpack_from("<H", b, 2)[0])
        elif kind == 0x17 and self.wide:
            self.externs = [struct.unpack_from("<HH", b, 4 + 6 * i) for i in range(struct.unpack_from("<H", b)[0])]
        elif kind == 0x18 and self.wide:
            n, size, scope = b[3], struct.unpack_from("<H", b, 4)[0], struct.unpack_from("<H", b, 8)[0]
            two = b[14] & 1
            name = b[15 : 15 + n * (1 + two)].decode("utf-16-le" if two else "latin-1", "replace")
            at = 15 + n * (1 + two)
            self.names.append(name)
            if not b[0] & 0x20:
                scoped = self.titles[scope - 1] if 0 < scope <= len(self.titles) else None
                self.book.names.append((scoped, name, self.formula(b[at : at + size], b[at + size :], 0, 0) if size else ""))

    def put(self, sheet: int, row: int, col: int, xf: int, value, formula: str | None = None) -> None:
        ident = self.kinds[xf] if xf < len(self.kinds) else 0
        kind = numfmt.class_of(ident, self.codes.get(ident))
        shown = numfmt.render(value, kind, self.book.date1904) if isinstance(value, float) else ("TRUE" if value else "FALSE") if isinstance(value, bool) else str(value)
        title = self.titles[sheet] if sheet < len(self.titles) else f"Sheet{sheet + 1}"
        if shown or formula:
            self.book.add_cell(sheet, title, row, col, value, shown, "date" if isinstance(value, float) and numfmt.is_date(kind) else None, formula, xf)

    def cell(self, kind: int, pieces: list[bytes], sheet: int, wait):
        b = pieces[0]
        if kind == 0x207 and wait:
            self.put(sheet, *wait[:3], self.long(pieces, 0), wait[3])
            return None
        if kind in (0xFD, 0x203, 0x27E, 0x205, 0x204, 0xD6, 0x06):
            row, col, xf = struct.unpack_from("<3H", b)
            if kind == 0xFD:
                at = struct.unpack_from("<I", b, 6)[0]
                self.put(sheet, row, col, xf, self.strings[at] if at < len(self.strings) else "")
            elif kind == 0x203:
                self.put(sheet, row, col, xf, struct.unpack_from("<d", b, 6)[0])
            elif kind == 0x27E:
                self.put(sheet, row, col, xf, rk(struct.unpack_from("<I", b, 6)[0]))
            elif kind == 0x205:
                self.put(sheet, row, col, xf, Error(tokens.ERROR_CODES.get(b[6], "#ERR!")) if b[7] else bool(b[6]))
            elif kind in (0x204, 0xD6):
                self.put(sheet, row, col, xf, self.long(pieces, 6))
            else:
                size = struct.unpack_from("<H", b, 20)[0]
                body, extra = b[22 : 22 + size], b"".join([b[22 + size :], *pieces[1:]])
                source, self.last = self.formula(body, extra, row, col), (row, col)
                if at := tokens.shared_with(body, "biff8"):
                    self.shares[sheet, row, col] = at
                if b[12:14] != b"\xff\xff":
                    self.put(sheet, row, col, xf, struct.unpack_from("<d", b, 6)[0], source)
                elif b[6] == 0:
                    return row, col, xf, source
                else:
                    self.put(sheet, row, col, xf, {1: bool(b[8]), 2: Error(tokens.ERROR_CODES.get(b[8], "#ERR!"))}.get(b[6], ""), source)
        elif kind in (0x4BC, 0x221):
            head = 8 if kind == 0x4BC else 12
            row, _, col = struct.unpack_from("<HHB", b)
            size, whole = struct.unpack_from("<H", b, head)[0], b"".join(pieces)
            for at in {(row, col), self.last}:
                self.shared[sheet, *at] = whole[head + 2 : head + 2 + size], whole[head + 2 + size :], kind == 0x4BC
            return wait
        elif kind == 0xBD:
            row, col = struct.unpack_from("<2H", b)
            for i in range((len(b) - 6) // 6):
                xf, raw = struct.unpack_from("<HI", b, 4 + 6 * i)
                self.put(sheet, row, col + i, xf, rk(raw))
        elif kind == 0x1B8:
            r0, r1, c0, c1 = struct.unpack_from("<4H", b)
            self.book.add_range(sheet, "hyperlink", (r0, c0, r1, c1), text=link(b"".join(pieces)[8:]))
        elif kind == 0x5D and len(b) >= 8:
            self.object = struct.unpack_from("<H", b, 6)[0] if struct.unpack_from("<H", b)[0] == 0x15 else None
        elif kind == 0x1B6 and self.object is not None and len(pieces) > 1 and len(b) >= 12:
            n, body = struct.unpack_from("<H", b, 10)[0], pieces[1]
            two = bool(body[:1]) and body[0] & 1
            self.notes[sheet, self.object] = body[1 : 1 + n * (1 + two)].decode("utf-16-le" if two else "latin-1", "replace")
        elif kind == 0x1C and self.wide and len(b) >= 11:
            row, col, _, shown, n = struct.unpack_from("<5H", b)
            two = b[10] & 1
            author = b[11 : 11 + n * (1 + two)].decode("utf-16-le" if two else "latin-1", "replace")
            self.book.add_range(sheet, "comment", (row, col, row, col), text=self.notes.get((sheet, shown), ""), author=author)
        elif kind == 0x1C and len(b) >= 6:
            row, col, n = struct.unpack_from("<3H", b)
            if row != 0xFFFF:
                self.book.add_range(sheet, "comment", (row, col, row, col), text=b[6 : 6 + n].decode(self.codec, "replace"))
        elif kind == 0xE5:
            for i in range(struct.unpack_from("<H", b)[0]):
                r0, r1, c0, c1 = struct.unpack_from("<4H", b, 2 + 8 * i)
                self.book.add_range(sheet, "merge", (r0, c0, r1, c1))
        return wait if kind != 0x06 else None

    # Formulas

    def context(self, row: int = 0, col: int = 0) -> tokens.Context:
        return tokens.Context("biff8" if self.wide else "biff5", self.names, self.sheet_prefix if self.wide else None, self.codec, (row, col))

    def sheet_prefix(self, index: int) -> str:
        first, last = self.externs[index] if index < len(self.externs) else (0xFFFF, 0xFFFF)
        if max(first, last) >= len(self.titles):
            raise tokens.Untold
        return tokens.prefix(self.titles[first], self.titles[last])

    def formula(self, body: bytes, extra: bytes, row: int, col: int) -> str:
        return tokens.told(body, extra, self.context(row, col))

