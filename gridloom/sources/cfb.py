"""Compound files: the container of .xls."""

from __future__ import annotations

import struct

from gridloom.sources.model import ReadError

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE = 0xFFFFFFFA  # this and above end a chain


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of the root storage by name. A chain that loops or leaves the file is cut."""
    if data[:8] != MAGIC:
        raise ReadError("not_ole2")
    try:
        return _streams(data)
    except struct.error as e:
        raise ReadError("invalid_cfb", str(e)) from None


def _streams(data: bytes) -> dict[str, bytes]:
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    if size not in (512, 4096) or small > size:
        raise ReadError("invalid_cfb")
    n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
    cutoff, first_mini, _, next_difat = struct.unpack_from("<4I", data, 56)

    def sector(k: int) -> bytes:
        return data[(k + 1) * size : (k + 2) * size]

    def numbers(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    difat, seen = [x for x in numbers(data[76:512])], set()
    while next_difat < FREE and next_difat not in seen:
        seen.add(next_difat)
        more = numbers(sector(next_difat))
        if not more:
            break
        difat, next_difat = difat + more[:-1], more[-1]
    fat: list[int] = []
    for k in [x for x in difat if x < FREE][:n_fat]:
        fat += numbers(sector(k))

    def chain(k: int, table: list[int], piece) -> bytes:
        out, seen = [], set()
        while k < len(table) and k not in seen:
            seen.add(k)
            out.append(piece(k))
            k = table[k]
        return b"".join(out)

    directory = chain(first_dir, fat, sector)
    mini_fat = numbers(chain(first_mini, fat, sector))
    found, mini = {}, b""
    for at in range(0, len(directory) - 127, 128):
        length, kind = struct.unpack_from("<HB", directory, at + 64)
        start, bytes_ = struct.unpack_from("<IQ", directory, at + 116)
        name = directory[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            mini = chain(start, fat, sector)[: bytes_ & 0xFFFFFFFF]
        elif kind == 2:
            found.setdefault(name, (start, bytes_ & 0xFFFFFFFF))
    return {n: (chain(s, mini_fat, lambda k: mini[k * small : (k + 1) * small]) if b < cutoff else chain(s, fat, sector))[:b] for n, (s, b) in found.items()}
