"""What readers give: rows of the tables in schema.py, and typed errors."""

from __future__ import annotations

import io
import pickle
import zipfile
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

#: Bounds on what is read, so that a hostile file cannot exhaust a worker.
MAX_TEXT, MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, MAX_NAME = 256 << 20, 65_536, 256 << 20, 512 << 20, 4096


PROPERTIES = ("title", "subject", "creator", "keywords", "description", "last_modified_by", "company", "created")


class ReadError(Exception):
    """kind is a code of report.DECISIONS."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


class Packed(Sequence):
    """A list that only grows, kept compressed but for its last rows: a sheet's cells as
    Python objects take many times what its file does. Reading it in order unpacks a block at a time."""

    BLOCK = 10_000

    def __init__(self):
        self.blocks: list[bytes] = []
        self.last: list[tuple] = []

    def append(self, row: tuple) -> None:
        self.last.append(row)
        if len(self.last) == self.BLOCK:
            self.blocks.append(zlib.compress(pickle.dumps(self.last, 5), 1))
            self.last = []

    def _block(self, k: int) -> list[tuple]:
        return pickle.loads(zlib.decompress(self.blocks[k])) if k < len(self.blocks) else self.last

    def __len__(self) -> int:
        return len(self.blocks) * self.BLOCK + len(self.last)

    def __getitem__(self, k):
        if isinstance(k, slice):
            return [self[i] for i in range(*k.indices(len(self)))]
        at = k + len(self) if k < 0 else k
        if not 0 <= at < len(self):
            raise IndexError(k)
        return self._block(at // self.BLOCK)[at % self.BLOCK]

    def __iter__(self):
        for k in range(len(self.blocks) + 1):
            yield from self._block(k)


@dataclass
class Workbook:
    """Rows without their workbook_id."""

    cells: Sequence[tuple] = field(default_factory=list)
    sheets: list[tuple] = field(default_factory=list)
    names: list[tuple] = field(default_factory=list)
    ranges: list[tuple] = field(default_factory=list)
    parts: list[tuple] = field(default_factory=list)
    #: Document properties by the names of schema.WORKBOOKS.
    properties: dict[str, str | None] = field(default_factory=dict)
    active_sheet: int | None = None
    structure_protected: bool = False
    format: str = ""
    date1904: bool = False
    text_left: int = MAX_TEXT
    truncated: bool = False

    def add_cell(self, index: int, sheet: str, row: int, col: int, value, display: str, kind: str | None = None, formula: str | None = None, style: int | None = None) -> None:
        """value: float, bool, str or Error; kind says date where a number is one. With a formula the value is its cache."""
        from gridloom.plans.grid import as_struct

        size = len(display) + len(formula or "")
        if size > self.text_left:
            self.truncated = True
            return
        self.text_left -= size
        v = as_struct(value)
        own = {"number": kind or "number", "blank": "text"}.get(v["kind"], v["kind"])
        place = (index, sheet, len(self.cells), row, col)
        if formula is not None:
            self.cells.append((*place, "formula", None, None, None, None, formula, v | {"kind": own}, display, style))
        else:
            self.cells.append((*place, own, v["num"], v["str"], v["bool"], v["err"], None, None, display, style))

    @property
    def workbooks(self) -> list[tuple]:
        told = [self.properties.get(k) for k in PROPERTIES]
        return [(self.format, *told, self.active_sheet, self.structure_protected, self.date1904, self.truncated)]

    def add_range(self, index: int, kind: str, box: tuple[int, int, int, int], name: str | None = None, text: str | None = None, author: str | None = None) -> None:
        self.ranges.append((index, kind, name, *box, text, author))


def open_zip(data: bytes) -> zipfile.ZipFile:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        raise ReadError("zip", str(e)) from None
    infos = archive.infolist()
    if len(infos) > MAX_ENTRIES or any(i.file_size > MAX_ENTRY or len(i.filename) > MAX_NAME for i in infos) or sum(i.file_size for i in infos) > MAX_TOTAL:
        raise ReadError("zip", "archive is larger than its limits")
    if any(i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) for i in infos):
        raise ReadError("unsupported_compression")
    return archive


def part(archive: zipfile.ZipFile, name: str) -> bytes | None:
    """A part by name, in any case; None if it is missing or damaged."""
    by = getattr(archive, "_by_name", None)
    if by is None:
        by = archive._by_name = {i.filename.lower().lstrip("/"): i for i in archive.infolist()}
    info = by.get(name.lower().lstrip("/"))
    if info is None:
        return None
    try:
        return archive.read(info)
    except (zipfile.BadZipFile, OSError, ValueError, EOFError):
        return None
