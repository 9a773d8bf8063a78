"""Dates of documents by their cross-references, and the vendor's data source."""

import csv
import datetime as dt
import zlib

import pytest
from pyspark.sql import functions as F

from larkspur.operators import changes
from larkspur.sources import html, pdf, vendor


def table_pdf(objects, info, root=None, prev=None, base=b"%PDF-1.4\n"):
    """A document with a cross-reference table; objects are {number: bytes}."""
    out, places = bytearray(base), {}
    for k, body in objects.items():
        places[k] = len(out)
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (k, p) for k, p in places.items())
    out += b"trailer\n<< /Size 99" + (b" /Info %d 0 R" % info if info else b"") + (b" /Root %d 0 R" % root if root else b"") + (b" /Prev %d" % prev if prev is not None else b"") + b" >>\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out), at


def stream_pdf(objects, info, predictor=True):
    """A document whose objects lie in a compressed stream, with a compressed cross-reference stream."""
    head, body = [], b""
    for k, x in objects.items():
        head.append(b"%d %d" % (k, len(body)))
        body += x + b" "
    first = b" ".join(head) + b" "
    packed = zlib.compress(first + body)
    out = bytearray(b"%PDF-1.5\n")
    at_objects = len(out)
    out += b"20 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length 21 0 R >>\nstream\n" % (len(objects), len(first)) + packed + b"\nendstream endobj\n"
    at_length = len(out)
    out += b"21 0 obj %d endobj\n" % len(packed)
    at = len(out)
    rows = {k: (2, 20, i) for i, k in enumerate(objects)} | {20: (1, at_objects, 0), 21: (1, at_length, 0)}
    raw, before = b"", bytes(4)
    for k in sorted(rows):
        row = bytes([rows[k][0]]) + rows[k][1].to_bytes(2, "big") + bytes([rows[k][2]])
        raw += (b"\2" + bytes((a - b) & 255 for a, b in zip(row, before))) if predictor else row
        before = row
    index = b" ".join(b"%d 1" % k for k in sorted(rows))
    data = zlib.compress(raw)
    parms = b"/DecodeParms << /Predictor 12 /Columns 4 >>" if predictor else b""
    out += b"30 0 obj << /Type /XRef /Size 31 /W [1 2 1] /Index [" + index + b"] /Info %d 0 R /Filter [/FlateDecode] " % info + parms + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % at
    return bytes(out)


def test_strings():
    assert pdf.value(rb"(a\(b\) (c) \101\n\\)", 0)[0] == b"a(b) (c) A\n\\"
    assert pdf.value(b"<48 656C6C6F7>", 0)[0] == b"Hellop"
    assert pdf.value(b"<< /A [1 2 0 R (x)] % note\n /B << /C /D >> >>", 0)[0] == {"/A": [1, pdf.Ref(2), b"x"], "/B": {"/C": "/D"}}
    assert pdf.said(b"\xfe\xff" + "D:2024".encode("utf-16-be")) == pdf.said(b"D:2024") == "D:2024"


@pytest.mark.parametrize("info", [b"(D:20240305101500+02'00')", b"<" + b"D:20240305101500".hex().encode() + b">", b"<" + b"\xfe\xff".hex().encode() + "D:20240305101500".encode("utf-16-be").hex().encode() + b">", rb"(D:2024\060305101500)"])
def test_document_day(info):
    want = dt.datetime(2024, 3, 5, 10, 15)
    plain, _ = table_pdf({7: b"<< /CreationDate " + info + b" >>"}, 7)
    assert html.document_day(plain) == want
    assert html.document_day(stream_pdf({7: b"<< /CreationDate " + info + b" /ModDate (D:2030) >>", 8: b"[]"}, 7)) == want
    assert html.document_day(stream_pdf({5: b"null", 7: b"<< /CreationDate 5 0 R /ModDate " + info + b" >>"}, 7, predictor=False)) == want


def test_newest_section_counts():
    """A later section replaces an object of an earlier one, and only objects in use count."""
    old, at = table_pdf({7: b"<< /CreationDate (D:20200101) >>", 9: b"<< /CreationDate (D:20990101) >>"}, 7)
    new, _ = table_pdf({7: b"<< /CreationDate (D:20210203) >>"}, 7, prev=at, base=old)
    assert html.document_day(old) == dt.datetime(2020, 1, 1) and html.document_day(new) == dt.datetime(2021, 2, 3)
    kept, _ = table_pdf({8: b"<<>>"}, 7, prev=at, base=old)
    assert html.document_day(kept) == dt.datetime(2020, 1, 1)


def test_packet_and_damage():
    packet = b"<x:xmpmeta><xmp:CreateDate>2024-05-06T07:08:09Z</xmp:CreateDate></x:xmpmeta>"
    doc, _ = table_pdf({1: b"<< /Type /Catalog /Metadata 2 0 R >>", 2: b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(zlib.compress(packet)) + zlib.compress(packet) + b"\nendstream", 7: b"<< /CreationDate (D:20240101) >>"}, 7, root=1)
    assert html.document_day(doc) == dt.datetime(2024, 5, 6, 7, 8, 9)
    broken = doc.replace(b"startxref", b"startxxxx")
    assert html.document_day(broken) == dt.datetime(2024, 1, 1)  # a search of the bytes finds what isn't compressed
    loop, at = table_pdf({7: b"7 0 R"}, 7, prev=9)
    assert html.document_day(loop) is None and html.document_day(None) is None and html.document_day(b"") is None
    rng = __import__("random").Random(1)
    for _ in range(300):  # whatever bytes are damaged, there is an answer
        b = bytearray(doc)
        for _ in range(5):
            b[rng.randrange(len(b))] = rng.randrange(256)
        html.document_day(bytes(b))


def test_vendor_source(spark, tmp_path):
    good = "d,open,high,low,close,volume\n2024-01-02,1,2,0.5,1.5,10\n2024-01-03,,2,0.5,1.7,\n"
    for symbol, text in {"A": good, "B%2FC": good.replace("1.5", "9.5"), "BAD": good.replace("1.7", "n/a"), "EMPTY": None}.items():
        (tmp_path / f"symbol={symbol}").mkdir()
        if text:
            (tmp_path / f"symbol={symbol}" / "part-0.csv").write_text(text)
    symbols = ["A", "B/C", "BAD", "EMPTY", "GONE"]
    df = vendor.prices(spark, f"file://{tmp_path}", symbols, block=2)
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert sorted(r["symbol"] for r in rows if r["error"] is None) == ["A", "A", "B/C", "B/C"]
    failed = {r["symbol"]: r["error"].split(":")[0] for r in rows if r["error"]}
    assert failed == {"BAD": "ValueError", "EMPTY": "FileNotFoundError", "GONE": "FileNotFoundError"}  # of BAD no row is kept
    assert {(r["d"], r["open"], r["volume"]) for r in rows if r["symbol"] == "A"} == {(dt.date(2024, 1, 2), 1.0, 10), (dt.date(2024, 1, 3), None, None)}
    few = vendor.prices(spark, f"file://{tmp_path}", symbols, "symbol string, close double")
    assert few.columns == ["symbol", "close"]
    assert sorted(r["close"] for r in few.where("symbol = 'B/C'").collect()) == [1.7, 9.5]
    assert few.where(F.col("symbol").isin("A", "GONE")).count() == 3
    # BAD's prices can't be read, but its days can: only what is asked for is read.
    assert vendor.prices(spark, f"file://{tmp_path}", ["BAD"], "symbol string, d date").where("d IS NOT NULL").count() == 2
    assert vendor.prices(spark, f"file://{tmp_path}", []).count() == 0


def test_shorter_later_row(spark):
    """A later row of a field fills cell by cell: what it hasn't stays."""
    page = "<table><tr><td>x</td><td>Mar 2020</td><td>Sep 2019</td></tr><tr><td>12 Month HEPS</td><td>1</td><td>2</td></tr><tr><td>12 Month HEPS again</td><td>3</td></tr></table>"
    rows = html.share_statistics(spark.createDataFrame([(1, page)], "page_id int, html string")).orderBy("results_period_end").collect()
    assert [r["heps_12m_zarc"] for r in rows] == [2.0, 3.0]


def test_export_is_read_by_others(spark, tmp_path):
    rows = [(1, 'a "b", c'), (2, "  two\nlines "), (3, ""), (4, None), (5, '\\"x\\'), (6, '"')]
    folder = str(tmp_path / "out")
    changes.export(spark.createDataFrame(rows, "id int, text string").coalesce(1), folder)
    assert sorted(tuple(r) for r in changes.exported(spark, folder, "id int, text string").collect()) == rows
    (part,) = (tmp_path / "out").glob("part-*.csv")
    with open(part, newline="") as f:
        assert list(csv.reader(f)) == [["id", "text"], *([str(i), t or ""] for i, t in rows)]
