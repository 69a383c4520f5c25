import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.operators import cells as C
from gridloom.plans import grid
from gridloom.sources import numfmt, tokens, workbook, xls, xlsx
from gridloom.sources.model import ReadError

SHEET = {
    "title": "Calc: 1", "merges": [(3, 0, 3, 1)], "freeze": (1, 0),
    "cells": {(0, 0): ("text", "item & <co>", None), (0, 1): ("number", 5.0, None), (1, 0): ("bool", True, None), (1, 1): ("error", "#N/A", None), (2, 0): ("date", 45366.5, None),
              (2, 1): ("number", 10.0, "B1*2"), (4, 700): ("text", " spaced ", None), (5, 0): ("text", "kept", 'IF(A2,"kept",1)')},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    (path / "a.xlsx").write_bytes(xlsx.write([SHEET, {"title": "Hidden", "cells": {}, "state": "hidden"}], [(None, "Answer", "'Calc_ 1'!$B$1")]))
    (path / "b.xlsx").write_bytes(b"PK\x03\x04 no archive")
    (path / "c.bin").write_bytes(b"plain text")
    return str(path)


def test_xlsx_round_trip(spark, folder):
    spark.dataSource.register(workbook.WorkbookSource)
    read = spark.read.format("workbook").option("table", "cells").load(folder)
    got = {(r.row, r.col): r for r in read.collect()}
    assert len(got) == len(SHEET["cells"]) and {r.sheet for r in got.values()} == {"Calc_ 1"}
    assert got[0, 0].str == "item & <co>" and got[0, 1].num == 5 and got[1, 0].bool is True and got[1, 1].err == "#N/A"
    assert got[2, 0].kind == "date" and got[2, 0].display == "2024-03-15 12:00:00" and got[4, 700].str == " spaced "
    assert got[2, 1].kind == "formula" and got[2, 1].formula == "B1*2" and got[2, 1].cached.num == 10
    again = workbook.workbooks(spark, folder + "/*", "cells")
    assert sorted((r.row, r.col, r.display) for r in again.collect()) == sorted((r.row, r.col, r.display) for r in got.values())
    done = {(r.row, r.col): r for r in grid.evaluate(C.effective(read)).collect()}
    assert done[2, 1].value.num == 10 and done[5, 0].value.str == "kept"


def test_other_tables(spark, folder):
    spark.dataSource.register(workbook.WorkbookSource)
    table = lambda t: spark.read.format("workbook").option("table", t).load(folder).collect()
    assert [(r.name, r.visible, r.freeze_row) for r in table("sheets")] == [("Calc_ 1", "visible", 1), ("Hidden", "hidden", None)]
    assert [(r.kind, r.r0, r.c1) for r in table("ranges")] == [("merge", 3, 1)]
    assert [(r.name, r.refers_to) for r in table("names")] == [("Answer", "'Calc_ 1'!$B$1")]
    assert sorted(r.error_kind for r in table("errors")) == ["not_ole2", "zip"]
    assert "xl/workbook.xml" in {r.part for r in table("parts")}


def test_written_back(spark, folder):
    made = workbook.to_workbooks(C.effective(workbook.workbooks(spark, folder + "/a.xlsx"))).first()
    book = xlsx.read(bytes(made.content))
    assert len(book.cells) == len(SHEET["cells"]) and xlsx.write([SHEET]) == xlsx.write([SHEET])


def test_damaged_inputs():
    whole = xlsx.write([SHEET])
    for cut in range(0, len(whole), 97):
        with pytest.raises(ReadError):
            workbook.open_bytes(whole[:cut])
    with pytest.raises(ReadError):
        xls.read(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(600))


@pytest.mark.parametrize("raw,value", [(0x3FF00000, 1.0), (0x3FF00001, 0.01), (2 | 5 << 2, 5.0), (3 | 1234 << 2, 12.34), ((-7 << 2 | 2) & 0xFFFFFFFF, -7.0)])
def test_rk(raw, value):
    assert xls.rk(raw) == value


def test_shifted():
    assert xlsx.shifted('A1+$A$1+A$1&"A1"+\'A1\'!B2', 1, 1) == 'B2+$A$1+B$1&"A1"+\'A1\'!C3'


def test_formats_like_columns(spark):
    from gridloom.functions import dates

    values = [0.0, 1.0, 59.5, 60.0, 61.0, 45366.75, -1.5, 2958465.9, 3e6, 0.51]
    kinds = ["Plain", "Percent", "Date", "Time", "DateTime", "ElapsedTime"]
    df = spark.createDataFrame([(v, k) for v in values for k in kinds], "x double, k string")
    for r in df.select("x", "k", dates.render(F.col("x"), F.col("k")).alias("shown")).collect():
        assert r.shown == numfmt.render(r.x, r.k), (r.x, r.k)


def _record(kind, body):
    out = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
    size = len(body)
    return out + (bytes([size]) if size < 128 else bytes([size & 0x7F | 0x80, size >> 7])) + body


def _wide(text):
    return len(text).to_bytes(4, "little") + text.encode("utf-16-le")


def zipped(parts):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def test_xlsb():
    import struct

    rels = f'<Relationships xmlns="{xlsx.PACKAGE}/relationships"><Relationship Id="r1" Type="{xlsx.RELS}/worksheet" Target="s.bin"/><Relationship Id="r2" Type="{xlsx.RELS}/sharedStrings" Target="t.bin"/></Relationships>'
    place = lambda c: struct.pack("<2I", c, 0)
    tokens = b"\x44" + struct.pack("<IH", 0, 0xC001) + b"\x1e\x02\x00\x05"
    cells = _record(0, struct.pack("<I", 0)) + _record(7, place(0) + struct.pack("<I", 0)) + _record(2, place(1) + struct.pack("<I", 42 << 2 | 2))
    cells += _record(9, place(2) + struct.pack("<d", 84.0) + b"\0\0" + struct.pack("<I", len(tokens)) + tokens)
    data = zipped({
        "_rels/.rels": f'<Relationships xmlns="{xlsx.PACKAGE}/relationships"><Relationship Id="a" Type="{xlsx.RELS}/officeDocument" Target="xl/workbook.bin"/></Relationships>',
        "xl/workbook.bin": _record(156, struct.pack("<2I", 1, 1) + _wide("r1") + _wide("Data")), "xl/_rels/workbook.bin.rels": rels,
        "xl/s.bin": cells + _record(176, struct.pack("<4I", 2, 2, 0, 3)), "xl/t.bin": _record(19, b"\0" + _wide("road")),
    })
    book = workbook.open_bytes(data)
    assert [(c[3], c[4], c[5], c[6], c[7], c[10]) for c in book.cells] == [(0, 0, "text", None, "road", None), (0, 1, "number", 42.0, None, None), (0, 2, "formula", None, None, "B1*2")]
    assert book.sheets[0][3] == "hidden" and book.ranges[0][3:7] == (2, 0, 2, 3)


def test_ods():
    t, o, x = "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    cell = lambda kind, attrs, text: f'<t:table-cell o:value-type="{kind}" {attrs}><x:p>{text}</x:p></t:table-cell>'
    body = f'<t:table t:name="V"><t:table-row t:number-rows-repeated="2">{cell("string", "", "road")}{cell("float", chr(111) + ":value=" + chr(34) + "125" + chr(34) + " t:formula=" + chr(34) + "of:=[.A1]*2" + chr(34), "125")}</t:table-row><t:table-row>{cell("time", "o:time-value=" + chr(34) + "PT12H" + chr(34), "12:00")}</t:table-row></t:table>'
    content = f'<o:document-content xmlns:t="{t}" xmlns:o="{o}" xmlns:x="{x}"><o:body><o:spreadsheet>{body}</o:spreadsheet></o:body></o:document-content>'
    book = workbook.open_bytes(zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": content}))
    assert [(c[3], c[4], c[5], c[10]) for c in book.cells] == [(0, 0, "text", None), (0, 1, "formula", "[.A1]*2"), (1, 0, "text", None), (1, 1, "formula", "[.A1]*2"), (2, 0, "number", None)]
    assert book.cells[-1][6] == 0.5


def _biff(kind, body=b""):
    import struct

    return struct.pack("<HH", kind, len(body)) + body


def xls_book(stream):
    """A workbook stream in a compound file of one FAT sector, read."""
    import struct

    stream = stream.ljust(4096, b"\0")
    stream += bytes(-len(stream) % 512)
    n = len(stream) // 512
    fat = struct.pack("<2I", 0xFFFFFFFD, 0xFFFFFFFE) + struct.pack(f"<{n}I", *range(3, n + 2), 0xFFFFFFFE)
    entry = lambda name, kind, start, size: (name.encode("utf-16-le")).ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack("<3I", *[0xFFFFFFFF] * 3) + bytes(36) + struct.pack("<IQ", start, size)
    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream))).ljust(512, b"\0")
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<III", 0, 1, 1) + bytes(4) + struct.pack("<4I", 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE) + bytes(4)
    return workbook.open_bytes(header[:76].ljust(76, b"\0") + struct.pack("<I", 0) + b"\xff" * 432 + fat.ljust(512, b"\xff") + directory + stream)


def test_xls():
    """A workbook stream in a compound file of one FAT sector."""
    import struct

    bof = lambda kind: _biff(0x809, struct.pack("<HHHH", 0x600, kind, 0, 0) + bytes(8))
    sst = struct.pack("<II", 2, 2) + struct.pack("<HB", 4, 0) + b"road" + struct.pack("<HB", 2, 1) + "도로".encode("utf-16-le")
    xfs = _biff(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + _biff(0xE0, struct.pack("<HH", 0, 14) + bytes(16))
    head = bof(5) + _biff(0x85, struct.pack("<IBB", 0, 1, 0) + bytes([4, 0]) + b"Data") + xfs + _biff(0xFC, sst) + _biff(0x0A)
    tokens = b"\x44" + struct.pack("<HH", 0, 0xC001) + b"\x1e\x02\x00\x05"
    sheet = bof(16) + _biff(0xFD, struct.pack("<HHHI", 0, 0, 0, 1)) + _biff(0x27E, struct.pack("<HHHI", 0, 1, 0, 42 << 2 | 2)) + _biff(0x203, struct.pack("<HHHd", 1, 0, 1, 45366.0))
    sheet += _biff(0x06, struct.pack("<HHHd", 2, 0, 0, 84.0) + bytes(6) + struct.pack("<H", len(tokens)) + tokens) + _biff(0xE5, struct.pack("<5H", 1, 3, 3, 0, 2)) + _biff(0x0A)
    stream = (head + sheet).ljust(4096, b"\0")
    stream += bytes(-len(stream) % 512)
    n = len(stream) // 512
    fat = struct.pack("<2I", 0xFFFFFFFD, 0xFFFFFFFE) + struct.pack(f"<{n}I", *range(3, n + 2), 0xFFFFFFFE)
    entry = lambda name, kind, start, size: (name.encode("utf-16-le")).ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack("<3I", *[0xFFFFFFFF] * 3) + bytes(36) + struct.pack("<IQ", start, size)
    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream))).ljust(512, b"\0")
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<III", 0, 1, 1) + bytes(4) + struct.pack("<4I", 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE) + bytes(4)
    data = header[:76].ljust(76, b"\0") + struct.pack("<I", 0) + b"\xff" * 432 + fat.ljust(512, b"\xff") + directory + stream
    book = workbook.open_bytes(data)
    assert [(c[3], c[4], c[5], c[6], c[7], c[10]) for c in book.cells] == [(0, 0, "text", None, "도로", None), (0, 1, "number", 42.0, None, None), (1, 0, "date", 45366.0, None, None), (2, 0, "formula", None, None, "B1*2")]
    assert book.cells[2][11 + 1] == "2024-03-15" and book.sheets[0][3] == "hidden" and book.ranges[0][3:7] == (3, 0, 3, 2)


def ods_book(rows):
    t, o, x = "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    content = f'<o:document-content xmlns:t="{t}" xmlns:o="{o}" xmlns:x="{x}"><o:body><o:spreadsheet><t:table t:name="V">{rows}</t:table></o:spreadsheet></o:body></o:document-content>'
    return workbook.open_bytes(zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": content}))


def test_ods_keeps_every_cell():
    """Cells written out are never counted against the budget for copies; copies beyond it are told of."""
    cell = '<t:table-cell o:value-type="float" o:value="1"><x:p>1</x:p></t:table-cell>'
    book = ods_book(f"<t:table-row>{cell * 100}</t:table-row>" * 1200)
    assert len(book.cells) == 120_000 and not book.truncated
    book = ods_book(f'<t:table-row t:number-rows-repeated="3">{cell}<t:table-cell t:number-columns-repeated="4" o:value-type="string"><x:p>a</x:p></t:table-cell></t:table-row>')
    assert [(c[3], c[4]) for c in book.cells] == [(r, c) for r in range(3) for c in range(5)] and not book.truncated
    book = ods_book(f'<t:table-row t:number-rows-repeated="1000000">{cell}</t:table-row><t:table-row>{cell}</t:table-row>')
    assert 130_000 < len(book.cells) < 132_000 and book.truncated and book.cells[-1][3] == 1_000_000


def test_a_damaged_file_is_its_own_error():
    """Whatever goes wrong within a file shows in table errors, and the scan goes on."""
    sheet = f'<worksheet xmlns="{xlsx.MAIN}"><sheetData><row r="1"><c r="A1" s="x"><v>1</v></c></row></sheetData></worksheet>'
    good = xlsx.write([{"title": "S", "cells": {(0, 0): ("number", 1.0, None)}}])
    parts = {i.filename: zipfile.ZipFile(io.BytesIO(good)).read(i) for i in zipfile.ZipFile(io.BytesIO(good)).infolist()}
    for data in (zipped({**{k: v.decode() for k, v in parts.items()}, "xl/worksheets/sheet1.xml": sheet}), b"PK\x03\x04junk", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\xff" * 600, b""):
        assert not list(workbook.rows("f", data, "cells")) and len(list(workbook.rows("f", data, "errors"))) == 1
        with pytest.raises(Exception):
            list(workbook.rows("f", data, "cells", "FAILFAST"))


#: Token streams: dialect, tokens, what stands behind them, base cell, text.
TOKENS = [
    ("biff5", "17036f6c64", "", (0, 0), '"old"'), ("biff8", "2400000000", "", (0, 0), "$A$1"), ("biff8", "2400000080", "", (4, 0), "$A1"), ("biff8", "2400000040", "", (0, 2), "A$1"),
    ("biff8", "2cffffffff", "", (5, 2), "B5"), ("biff8", "1e0500211800", "", (0, 0), "ABS(5)"), ("biff8", "1e050019100000", "", (0, 0), "SUM(5)"),
    ("biff8", "2000000000000000", "01000001000000000000f03f010000000000000040", (0, 0), "{1,2}"), ("biff12", "24040000000200", "", (0, 0), "$C$5"), ("biff12", "212200", "", (0, 0), "TRUE()"),
    ("biff12", "20" + "00" * 14, "020000000100000001020061006200" + "0201", (0, 0), '{"ab";TRUE}'), ("biff8", "2a00000000", "", (0, 0), "#REF!"), ("biff8", "161e020022020100", "", (0, 0), "IF(,2)"),
    ("biff8", "230100000023020000000b", "", (0, 0), "First=Second"), ("biff8", "3a0000000000c0", "", (0, 0), "'In put'!A1"), ("biff12", "3b0000000000000100000000c001c0", "", (0, 0), "'In put'!A1:B2"),
    ("biff12", "2d" + "ffffffff" + "00000000" + "ffff" + "00c0", "", (3, 3), "C3:D4"), ("biff8", "21ffff", "", (0, 0), "_xlfn.PARTIAL()"), ("biff8", "1e0200ff", "", (0, 0), "_xlfn.PARTIAL(2)"),
    ("biff8", "1e0200420200ff0f", "", (0, 0), "_xlfn.PARTIAL(2)"), ("biff8", "03", "", (0, 0), "_xlfn.PARTIAL()"),
]


@pytest.mark.parametrize(("dialect", "body", "extra", "base", "want"), TOKENS)
def test_tokens(dialect, body, extra, base, want):
    context = tokens.Context(dialect, ["First", "Second"], lambda i: tokens.prefix("In put", "In put"), base=base)
    assert tokens.told(bytes.fromhex(body), bytes.fromhex(extra), context) == want


def test_xlsb_names_sheets_and_shared_formulas():
    import struct

    rels = "".join(f'<Relationship Id="r{i}" Type="{xlsx.RELS}/worksheet" Target="s{i}.bin"/>' for i in (1, 2))
    place = lambda c: struct.pack("<2I", c, 0)

    def formula(col, body, extra=b""):
        return _record(9, place(col) + struct.pack("<d", 1.0) + b"\0\0" + struct.pack("<I", len(body)) + body + struct.pack("<I", len(extra)) + extra)

    near = b"\x4c" + struct.pack("<IH", 0, 0xC000 | 0x3FFF) + b"\x1e\x02\x00\x05"
    exp = lambda: (b"\x01" + struct.pack("<I", 0), struct.pack("<I", 1))
    cells = _record(0, struct.pack("<I", 0)) + formula(0, b"\x3a\x00\x00" + struct.pack("<IH", 4, 0xC002)) + formula(1, *exp()) + _record(427, struct.pack("<4I", 0, 1, 1, 1) + struct.pack("<I", len(near)) + near)
    cells += formula(2, b"\x23" + struct.pack("<I", 1)) + _record(0, struct.pack("<I", 1)) + formula(1, *exp())
    ref = b"\x3a\x00\x00" + struct.pack("<IH", 0, 0)
    data = zipped({
        "_rels/.rels": f'<Relationships xmlns="{xlsx.PACKAGE}/relationships"><Relationship Id="a" Type="{xlsx.RELS}/officeDocument" Target="xl/workbook.bin"/></Relationships>',
        "xl/workbook.bin": _record(156, struct.pack("<2I", 0, 1) + _wide("r1") + _wide("Calc")) + _record(156, struct.pack("<2I", 0, 2) + _wide("r2") + _wide("Input Data")) + _record(357, b"")
        + _record(362, struct.pack("<I", 1) + struct.pack("<I2i", 0, 1, 1)) + _record(39, struct.pack("<IBI", 0, 0, 0xFFFFFFFF) + _wide("Answer") + struct.pack("<I", len(ref)) + ref + struct.pack("<I", 0)),
        "xl/_rels/workbook.bin.rels": f'<Relationships xmlns="{xlsx.PACKAGE}/relationships">{rels}</Relationships>', "xl/s1.bin": cells, "xl/s2.bin": _record(0, struct.pack("<I", 0)),
    })
    book = workbook.open_bytes(data)
    assert [(c[3], c[4], c[10]) for c in book.cells] == [(0, 0, "'Input Data'!C5"), (0, 1, "A1*2"), (0, 2, "Answer"), (1, 1, "A2*2")]
    assert book.names == [(None, "Answer", "'Input Data'!$A$1")]


def test_writer_refuses_what_it_cannot_hold():
    """Nothing is cut: a text of 32,767 UTF-16 units is written whole, a longer one is an error."""
    whole = "a" * 32_765 + "😀"
    book = workbook.open_bytes(xlsx.write([{"title": "S", "cells": {(0, 0): ("text", whole, None)}}]))
    assert book.cells[0][7] == whole
    for place, cell, rule in (((0, 0), ("text", whole + "b", None), "CellTextTooLong"), ((1 << 20, 0), ("number", 1.0, None), "CellOutOfGrid"), ((0, 3), ("number", float("inf"), None), "NonFiniteNumber")):
        with pytest.raises(xlsx.WriteError, match=rule):
            xlsx.write([{"title": "S", "cells": {place: cell}}])


def test_workbooks_with_all_their_tables(spark, tmp_path):
    """Sheets' states, order and panes, merges and names go through; a workbook that cannot be written has an error."""
    sheets = [
        {"title": "Data", "cells": {(0, 0): ("text", "a", None), (2, 1): ("number", 2.0, "A1+1")}, "merges": [(0, 0, 0, 2)], "freeze": (1, 2)}, {"title": "Empty", "cells": {}, "state": "hidden"},
    ]
    (tmp_path / "a.xlsx").write_bytes(xlsx.write(sheets, [(None, "Answer", "Data!$A$1"), ("Data", "Own", "42")]))
    (tmp_path / "b.xlsx").write_bytes(xlsx.write([{"title": "B", "cells": {(0, 0): ("text", "fine", None)}}]))
    tables = {t: workbook.workbooks(spark, str(tmp_path), t) for t in ("cells", "sheets", "names", "ranges")}
    long = tables["cells"].withColumn("str", F.when(F.col("str") == "fine", F.repeat(F.lit("x"), 40_000)).otherwise(F.col("str")))
    made = {r.workbook_id[-6:]: r for r in workbook.to_workbooks(long, tables["sheets"], tables["names"], tables["ranges"]).collect()}
    assert made["b.xlsx"].content is None and "CellTextTooLong: B!A1" in made["b.xlsx"].error
    book = workbook.open_bytes(bytes(made["a.xlsx"].content))
    assert [(s[1], s[3], s[4], s[5]) for s in book.sheets] == [("Data", "visible", 1, 2), ("Empty", "hidden", book.sheets[1][4], book.sheets[1][5])]
    assert sorted(book.names, key=str) == sorted([(None, "Answer", "Data!$A$1"), ("Data", "Own", "42")], key=str)
    assert [r[3:7] for r in book.ranges if r[1] == "merge"] == [(0, 0, 0, 2)] and [c[10] for c in book.cells] == [None, "A1+1"]


def test_xls_links_and_notes():
    import struct

    bof = lambda kind: _biff(0x809, struct.pack("<HHHH", 0x600, kind, 0, 0) + bytes(8))
    text = lambda x: struct.pack("<I", len(x) + 1) + (x + "\0").encode("utf-16-le")
    url = "https://example.org/".encode("utf-16-le") + b"\0\0"
    head = bytes(16) + struct.pack("<I", 2)
    links = [struct.pack("<I", 0x17) + text("shown") + xls.URL_LINK + struct.pack("<I", len(url)) + url, struct.pack("<I", 8) + text("Data!A1"), struct.pack("<I", 1) + xls.FILE_LINK + struct.pack("<HI", 1, 6) + b"b.xls\0" + bytes(24) + struct.pack("<I", 0)]
    assert [xls.link(head + x) for x in links] == ["https://example.org/", "#Data!A1", "../b.xls"] and xls.link(b"") is None
    stream = bof(5) + _biff(0x85, struct.pack("<IBB", 0, 0, 0) + bytes([4, 0]) + b"Data") + _biff(0x0A) + bof(16)
    stream += _biff(0x1B8, struct.pack("<4H", 1, 1, 0, 2) + head + links[0])
    stream += _biff(0x5D, struct.pack("<4H", 0x15, 0x12, 0x19, 7) + bytes(14)) + _biff(0x1B6, bytes(10) + struct.pack("<H", 4) + bytes(6)) + _biff(0x3C, b"\0note")
    stream += _biff(0x1C, struct.pack("<5H", 2, 3, 0, 7, 3) + b"\0Ann") + _biff(0x0A)
    book = xls_book(stream)
    assert [(r[1], r[3:7], r[7], r[8]) for r in book.ranges] == [("hyperlink", (1, 0, 1, 2), "https://example.org/", None), ("comment", (2, 3, 2, 3), "note", "Ann")]


def test_xls_shared_formulas():
    import struct

    bof = lambda kind: _biff(0x809, struct.pack("<HHHH", 0x600, kind, 0, 0) + bytes(8))
    head = bof(5) + _biff(0x85, struct.pack("<IBB", 0, 0, 0) + bytes([4, 0]) + b"Data") + _biff(0x0A) + bof(16)
    exp = b"\x01" + struct.pack("<HH", 0, 1)
    cell = lambda row, body: _biff(0x06, struct.pack("<HHHd", row, 1, 0, 1.0) + bytes(6) + struct.pack("<H", len(body)) + body)
    near = b"\x4c" + struct.pack("<HH", 0, 0xC0FF) + b"\x1e\x02\x00\x05"
    shared = _biff(0x4BC, struct.pack("<HHBBBB", 0, 2, 1, 1, 0, 3) + struct.pack("<H", len(near)) + near)
    book = xls_book(head + cell(0, exp) + shared + cell(1, exp) + cell(2, exp) + _biff(0x0A))
    assert [(c[3], c[10]) for c in book.cells] == [(0, "A1*2"), (1, "A2*2"), (2, "A3*2")]


def test_ods_validations_and_database_ranges():
    t, o, x = "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    body = (
        '<t:content-validations><t:content-validation t:name="v" t:condition="cell-content()&gt;0"/></t:content-validations>'
        '<t:table t:name="It\'s"><t:table-row t:number-rows-repeated="2"><t:table-cell t:content-validation-name="v" o:value-type="float" o:value="1"><x:p>1</x:p></t:table-cell></t:table-row></t:table>'
        '<t:database-ranges><t:database-range t:name="Block" t:target-range-address="\'It\'\'s\'.A1:\'It\'\'s\'.B9" t:display-filter-buttons="true"/><t:database-range t:name="Gone" t:target-range-address="No.A1"/></t:database-ranges>'
    )
    content = f'<o:document-content xmlns:t="{t}" xmlns:o="{o}" xmlns:x="{x}"><o:body><o:spreadsheet>{body}</o:spreadsheet></o:body></o:document-content>'
    book = workbook.open_bytes(zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": content}))
    assert [(r[1], r[2], r[3:7], r[7]) for r in book.ranges] == [("validation", None, (0, 0, 1, 0), "cell-content()>0"), ("table", "Block", (0, 0, 8, 1), None)]
    assert book.sheets[0][-1] == "A1:B9" and len(book.cells) == 2


def test_workbooks_table_and_report(spark):
    import json

    from gridloom.operators import report as R
    from gridloom.sources import package

    e = package.Editor(xlsx.write([SHEET, {"title": "Hidden", "cells": {}, "state": "hidden"}], [(None, "Answer", "1"), ("Hidden", "Own", "2")]))
    e.set_document_properties(title="a & <b>", keywords="k")
    e.set_comment("Calc_ 1", 0, 0, "note")
    files = spark.createDataFrame([("books/a.xlsx", bytearray(e.save()))], "path string, content binary")
    tables = workbook.read_tables(files)
    assert all(sorted(map(str, df.collect())) == sorted(map(str, workbook.read_files(files, t).collect())) for t, df in tables.items())
    row = tables["workbooks"].first()
    assert (row.format, row.title, row.keywords, row.creator, row.structure_protected, row.text_truncated) == ("xlsx", "a & <b>", "k", None, False, False)
    evaluated = grid.evaluate(C.effective(tables["cells"]), tables["names"]).withColumn("sheet_index", F.lit(0))
    got = json.loads(R.report_v1(tables, evaluated).first().report)
    assert list(got) == ["schema_version", "format", "stats", "properties", "defined_names_count", "local_defined_names_count", "features", "evaluation", "warnings"]
    assert list(got["features"]) == list(R.FEATURES) and got["features"]["hidden_sheets"] == got["features"]["comments"] == got["features"]["merged_ranges"] == 1
    assert (got["defined_names_count"], got["local_defined_names_count"], got["stats"]["sheets"], got["features"]["vba_project"]) == (1, 1, 2, False)
    assert got["evaluation"]["computed"] + got["evaluation"]["errors"] + got["evaluation"]["cached"] == got["stats"]["formulas"] == 2
