"""Formula token streams of the binary formats as text.

Three dialects: biff5 and biff8 (.xls) and biff12 (.xlsb). They differ in the
sizes of places and strings; operators, functions and the order of operands are
the same. A stream that cannot be told whole is marked as partial, with what is
known: the cell stays a formula, and no evaluator takes it for whole.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

from gridloom.plans.formula import column_letters

#: Error literals by code.
ERROR_CODES = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#DATA!"}
#: Binary operators by token.
BINARY = {0x03: "+", 0x04: "-", 0x05: "*", 0x06: "/", 0x07: "^", 0x08: "&", 0x09: "<", 0x0A: "<=", 0x0B: "=", 0x0C: ">=", 0x0D: ">", 0x0E: "<>", 0x0F: " ", 0x10: ",", 0x11: ":"}
#: Ids of the functions that are evaluated and of common ones, and their number of arguments if it is fixed.
FUNCTION_IDS = {
    0: ("COUNT", None), 1: ("IF", None), 2: ("ISNA", 1), 3: ("ISERROR", 1), 4: ("SUM", None), 5: ("AVERAGE", None), 6: ("MIN", None), 7: ("MAX", None), 8: ("ROW", None), 9: ("COLUMN", None), 10: ("NA", 0),
    11: ("NPV", None), 12: ("STDEV", None), 13: ("DOLLAR", None), 14: ("FIXED", None), 15: ("SIN", 1), 16: ("COS", 1), 17: ("TAN", 1), 18: ("ATAN", 1), 19: ("PI", 0), 20: ("SQRT", 1), 21: ("EXP", 1), 22: ("LN", 1),
    23: ("LOG10", 1), 24: ("ABS", 1), 25: ("INT", 1), 26: ("SIGN", 1), 27: ("ROUND", 2), 28: ("LOOKUP", None), 29: ("INDEX", None), 30: ("REPT", 2), 31: ("MID", 3), 32: ("LEN", 1), 33: ("VALUE", 1), 34: ("TRUE", 0),
    35: ("FALSE", 0), 36: ("AND", None), 37: ("OR", None), 38: ("NOT", 1), 39: ("MOD", 2), 46: ("VAR", None), 48: ("TEXT", 2), 56: ("PV", None), 57: ("FV", None), 58: ("NPER", None), 59: ("PMT", None),
    60: ("RATE", None), 62: ("IRR", None), 63: ("RAND", 0), 64: ("MATCH", None), 65: ("DATE", 3), 66: ("TIME", 3), 67: ("DAY", 1), 68: ("MONTH", 1), 69: ("YEAR", 1), 70: ("WEEKDAY", None), 71: ("HOUR", 1),
    72: ("MINUTE", 1), 73: ("SECOND", 1), 74: ("NOW", 0), 76: ("ROWS", 1), 77: ("COLUMNS", 1), 78: ("OFFSET", None), 82: ("SEARCH", None), 97: ("ATAN2", 2), 98: ("ASIN", 1), 99: ("ACOS", 1), 100: ("CHOOSE", None),
    101: ("HLOOKUP", None), 102: ("VLOOKUP", None), 105: ("ISREF", 1), 109: ("LOG", None), 111: ("CHAR", 1), 112: ("LOWER", 1), 113: ("UPPER", 1), 114: ("PROPER", 1), 115: ("LEFT", None), 116: ("RIGHT", None),
    117: ("EXACT", 2), 118: ("TRIM", 1), 119: ("REPLACE", 4), 120: ("SUBSTITUTE", None), 121: ("CODE", 1), 124: ("FIND", None), 126: ("ISERR", 1), 127: ("ISTEXT", 1), 128: ("ISNUMBER", 1), 129: ("ISBLANK", 1),
    130: ("T", 1), 131: ("N", 1), 140: ("DATEVALUE", 1), 148: ("INDIRECT", None), 162: ("CLEAN", 1), 169: ("COUNTA", None), 183: ("PRODUCT", None), 184: ("FACT", 1), 190: ("ISNONTEXT", 1), 193: ("STDEVP", None),
    194: ("VARP", None), 197: ("TRUNC", None), 198: ("ISLOGICAL", 1), 212: ("ROUNDUP", 2), 213: ("ROUNDDOWN", 2), 216: ("RANK", None), 219: ("ADDRESS", None), 220: ("DAYS360", None), 221: ("TODAY", 0),
    227: ("MEDIAN", None), 228: ("SUMPRODUCT", None), 229: ("SINH", 1), 247: ("DB", None), 261: ("ERROR.TYPE", 1), 269: ("AVEDEV", None), 276: ("COMBIN", 2), 285: ("FLOOR", 2), 288: ("CEILING", 2),
    325: ("LARGE", 2), 326: ("SMALL", 2), 330: ("MODE", None), 336: ("CONCATENATE", None), 337: ("POWER", 2), 342: ("RADIANS", 1), 343: ("DEGREES", 1), 344: ("SUBTOTAL", None), 345: ("SUMIF", None),
    346: ("COUNTIF", 2), 347: ("COUNTBLANK", 1), 354: ("ROMAN", None), 480: ("IFERROR", None), 481: ("COUNTIFS", None), 482: ("SUMIFS", None), 483: ("AVERAGEIF", None), 484: ("AVERAGEIFS", None),
}


class Untold(Exception):
    """A token that this module does not know, or not here."""


@dataclass
class Context:
    """What a stream refers to. sheet gives the prefix of an external-sheet index; base is the
    cell that relative places count from."""

    dialect: str = "biff8"
    names: list[str] = field(default_factory=list)
    sheet: Callable[[int], str] | None = None
    codec: str = "cp1252"
    base: tuple[int, int] = (0, 0)


def prefix(first: str, last: str) -> str:
    """Of one sheet or a span of sheets, quoted if need be."""
    name = first if first == last else f"{first}:{last}"
    plain = name.replace(":", "").replace("_", "").isalnum() and not name[:1].isdigit()
    return f"{name}!" if plain else "'" + name.replace("'", "''") + "'!"


def partial(stack: list[str]) -> str:
    return f"_xlfn.PARTIAL({','.join(stack)})"


class _Stream:
    def __init__(self, tokens: bytes, extra: bytes, context: Context):
        self.b, self.at, self.extra, self.extra_at, self.c = tokens, 0, extra, 0, context
        self.stack: list[str] = []
        self.biff5, self.biff12 = context.dialect == "biff5", context.dialect == "biff12"

    def take(self, form: str) -> tuple:
        found = struct.unpack_from("<" + form, self.b, self.at)
        self.at += struct.calcsize("<" + form)
        return found

    def pop(self, n: int) -> list[str]:
        if n > len(self.stack):
            raise Untold
        out = self.stack[len(self.stack) - n :]
        del self.stack[len(self.stack) - n :]
        return out

    def label(self, row: int, col: int, down: bool, across: bool) -> str:
        return f"{'' if across else '$'}{column_letters(col)}{'' if down else '$'}{row + 1}"

    def place(self, row: int, col: int, near: bool) -> str:
        """A place; its bits say which parts move, and if near is set those count from the base."""
        if self.biff5:
            down, across, row = bool(row & 0x8000), bool(row & 0x4000), row & 0x3FFF
            rows, cols, col = 1 << 14, 1 << 8, col & 0xFF
        else:
            down, across = bool(col & 0x8000), bool(col & 0x4000)
            rows, cols, col = (1 << 20, 1 << 14, col & 0x3FFF) if self.biff12 else (1 << 16, 1 << 8, col & 0xFF)
        if near:
            row = (row + self.c.base[0]) % rows if down else row
            col = (col + self.c.base[1]) % cols if across else col
        return self.label(row, col, down, across)

    def one(self, near: bool) -> str:
        return self.place(*self.take("HB" if self.biff5 else "IH" if self.biff12 else "HH"), near)

    def box(self, near: bool) -> str:
        r0, r1, c0, c1 = self.take("2H2B" if self.biff5 else "2I2H" if self.biff12 else "4H")
        return f"{self.place(r0, c0, near)}:{self.place(r1, c1, near)}"

    def text(self) -> str:
        if self.biff5:
            (n,) = self.take("B")
            raw, codec = self.b[self.at : self.at + n], self.c.codec
        elif self.biff12:
            (n,) = self.take("H")
            raw, codec = self.b[self.at : self.at + 2 * n], "utf-16-le"
        else:
            n, flags = self.take("BB")
            raw, codec = self.b[self.at : self.at + n * (1 + (flags & 1))], "utf-16-le" if flags & 1 else "latin-1"
        self.at += len(raw)
        return _quoted(raw.decode(codec, "replace"))

    def array(self) -> str:
        """An array constant, whose values stand behind the tokens."""
        e = self.extra
        if self.biff12:
            rows, cols = struct.unpack_from("<2I", e, self.extra_at)
            self.extra_at += 8
        else:
            cols, rows = (x + 1 for x in struct.unpack_from("<BH", e, self.extra_at))
            self.extra_at += 3
        if not 0 < rows * cols <= 65_536:
            raise Untold
        return "{" + ";".join(",".join(self.item() for _ in range(cols)) for _ in range(rows)) + "}"

    def item(self) -> str:
        e, at = self.extra, self.extra_at
        kind = e[at]
        number, string, flag, error = (0, 1, 2, 4) if self.biff12 else (1, 2, 4, 16)
        if kind == number:
            self.extra_at += 9
            return _number(struct.unpack_from("<d", e, at + 1)[0])
        if kind == string:
            if self.biff5:
                n = e[at + 1]
                raw, codec, head = e[at + 2 : at + 2 + n], self.c.codec, 2
            else:
                n = struct.unpack_from("<H", e, at + 1)[0]
                two = self.biff12 or e[at + 3] & 1
                head = 3 if self.biff12 else 4
                raw, codec = e[at + head : at + head + n * (2 if two else 1)], "utf-16-le" if two else "latin-1"
            self.extra_at += head + len(raw)
            return _quoted(raw.decode(codec, "replace"))
        if kind in (flag, error):
            self.extra_at += (2 if kind == flag else 5) if self.biff12 else 9
            return ("TRUE" if e[at + 1] else "FALSE") if kind == flag else ERROR_CODES[e[at + 1]]
        if kind == 0 and not self.biff12:
            self.extra_at += 9
            return ""
        raise Untold

    def sheet(self) -> str:
        if self.c.sheet is None or self.biff5:
            raise Untold
        return self.c.sheet(self.take("H")[0])

    def step(self) -> None:
        (t,) = self.take("B")
        kind = t if t < 0x20 else t & 0x1F | 0x20
        push = self.stack.append
        if t in BINARY:
            left, right = self.pop(2)
            push(left + BINARY[t] + right)
        elif t in (0x12, 0x13):
            push("+-"[t - 0x12] + self.pop(1)[0])
        elif t == 0x14:
            push(self.pop(1)[0] + "%")
        elif t == 0x15:
            push(f"({self.pop(1)[0]})")
        elif t == 0x16:
            push("")
        elif t == 0x17:
            push(self.text())
        elif t == 0x19:
            (what,) = self.take("B")
            (size,) = self.take("H")
            if what & 0x04:
                self.at += 2 * (size + 1)
            if what & 0x10:
                push(f"SUM({self.pop(1)[0]})")
        elif t == 0x1C:
            push(ERROR_CODES[self.take("B")[0]])
        elif t == 0x1D:
            push("TRUE" if self.take("B")[0] else "FALSE")
        elif t == 0x1E:
            push(str(self.take("H")[0]))
        elif t == 0x1F:
            push(_number(self.take("d")[0]))
        elif kind == 0x20:
            self.at += 14 if self.biff12 else 7
            push(self.array())
        elif kind == 0x21:
            name, n = FUNCTION_IDS.get(self.take("H")[0], (None, None))
            if n is None:
                raise Untold
            push(f"{name}({','.join(self.pop(n))})")
        elif kind == 0x22:
            n, ident = self.take("BH")
            args, ident = self.pop(n & 0x7F), ident & 0x7FFF
            name = args.pop(0) if ident == 0xFF and args else FUNCTION_IDS.get(ident, (f"FUNCTION_{ident}", None))[0]
            push(f"{name}({','.join(args)})")
        elif kind == 0x23:
            (n,) = self.take("I" if self.biff12 else "H")
            self.at += 12 if self.biff5 else 0 if self.biff12 else 2
            if not 0 < n <= len(self.c.names):
                raise Untold
            push(self.c.names[n - 1])
        elif kind in (0x24, 0x2C):
            push(self.one(kind == 0x2C))
        elif kind in (0x25, 0x2D):
            push(self.box(kind == 0x2D))
        elif kind in (0x26, 0x27, 0x28):
            self.at += 6  # the operands of a remembered area follow
        elif kind == 0x29:
            self.at += 2
        elif kind in (0x2A, 0x2B):
            self.at += {0x2A: 3 if self.biff5 else 6 if self.biff12 else 4, 0x2B: 6 if self.biff5 else 12 if self.biff12 else 8}[kind]
            push("#REF!")
        elif kind == 0x3A:
            push(self.sheet() + self.one(False))
        elif kind == 0x3B:
            push(self.sheet() + self.box(False))
        elif kind in (0x3C, 0x3D) and not self.biff5:
            push(self.sheet() + "#REF!")
            self.at += {0x3C: 6 if self.biff12 else 4, 0x3D: 12 if self.biff12 else 8}[kind]
        else:
            raise Untold


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def _number(x: float) -> str:
    from gridloom.plans.grid import number_text

    return number_text(x)


def told(tokens: bytes, extra: bytes = b"", context: Context | None = None) -> str:
    """The text of a token stream; extra holds the array constants behind it."""
    s = _Stream(tokens, extra, context or Context())
    try:
        while s.at < len(s.b):
            s.step()
    except (Untold, IndexError, KeyError, struct.error):
        return partial(s.stack)
    return s.stack[0] if len(s.stack) == 1 else partial(s.stack)


def shared_with(tokens: bytes, dialect: str) -> tuple[int, int] | None:
    """Where the formula stands that a cell shares or is part of, if its tokens are only that: row and, but in biff12, column."""
    if tokens[:1] != b"\x01":
        return None
    if dialect == "biff12":
        return (struct.unpack_from("<I", tokens, 1)[0], -1) if len(tokens) >= 5 else None
    return struct.unpack_from("<HH", tokens, 1) if len(tokens) >= 5 else None
