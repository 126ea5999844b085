"""Files made here: plain and deflated streams, object streams, broken ones."""

import zlib

from textloom.sources import pdf, pdf_fonts, readers


def make(pages, deflate=True, packed=False):
    out, kids = {}, []
    for i, text in enumerate(pages):
        body = ("BT /F1 12 Tf 72 700 Td " + " ".join(f"({line}) Tj 0 -14 Td" for line in text) + " ET").encode("cp1252")
        data = zlib.compress(body) if deflate else body
        out[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        out[11 + 2 * i] = b"<< /Length %d%s >>\nstream\n" % (len(data), b" /Filter /FlateDecode" if deflate else b"") + data + b"\nendstream"
        kids.append(b"%d 0 R" % (10 + 2 * i))
    out[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    out[2] = b"<< /Type /Pages /Count %d /Kids [" % len(kids) + b" ".join(kids) + b"] >>"
    if packed:  # all but the streams move into one object stream
        inner = {n: b for n, b in out.items() if b"stream" not in b}
        bodies, head, at = [], [], 0
        for n, b in inner.items():
            head += [n, at]
            bodies.append(b + b" ")
            at += len(b) + 1
        first = (" ".join(map(str, head)) + " ").encode()
        data = zlib.compress(first + b"".join(bodies))
        out = {n: b for n, b in out.items() if n not in inner}
        out[90] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode >>\nstream\n" % (len(inner), len(first)) + data + b"\nendstream"
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n" % n + b + b"\nendobj\n" for n, b in out.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = [["head", "Fire doors \\(wide\\)", "caf\\351 – x", "foot", "1"], ["head", "second page", "foot", "2"]]


def test_pages_in_order():
    want = "head\nFire doors (wide)\ncafé – x\nfoot\n1\fhead\nsecond page\nfoot\n2\f"
    for deflate in (True, False):
        for packed in (True, False):
            assert pdf.extract(make(PAGES, deflate, packed)) == want


def test_arrays_and_hex():
    assert pdf._page(b"BT [(Hel) -20 (lo) -300 (you)] TJ T* <48692e> Tj ET") == "Hello you\nHi."


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.pdf").write_bytes(make(PAGES))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4\n10 0 obj << /Type /Page /Contents 11 0 R >> endobj 11 0 obj << /Filter /FlateDecode >>\nstream\nnot deflated\nendstream endobj")
    (tmp_path / "junk.pdf").write_bytes(b"<p>")
    files = readers.file_scan(spark, str(tmp_path), "*.pdf")
    pattern, pages = readers.reader_for("pdf")
    out = pages(readers.file_scan(spark, str(tmp_path), pattern)).collect()
    assert {(r.id, r.page_nr): r.text for r in out if r.error is None} == {("one.pdf", 1): "Fire doors (wide) café – x", ("one.pdf", 2): "second page"}
    assert {(r.id, r.page_nr, r.text) for r in out if r.error} == {("bad.pdf", None, None), ("junk.pdf", None, None)}
    assert pdf.pages(files.limit(0)).count() == 0
    (tmp_path / "page.html").write_text("<body><p>One</p><p>two</p></body>")
    pattern, pages = readers.reader_for("html")
    assert [(r.id, r.page_nr, r.text, r.error) for r in pages(readers.file_scan(spark, str(tmp_path), pattern)).orderBy("page_nr").collect()] == [("page.html", 1, "One", None), ("page.html", 2, "two", None)]


def with_fonts(fonts, shown, extra=()):
    """One page whose resources come from the node above it; fonts: name -> dictionary."""
    listed = b" ".join(b"/%s %s" % (n, f) for n, f in fonts.items())
    objects = [b"1 0 obj << /Type /Pages /Kids [2 0 R] /Resources 6 0 R >> endobj", b"2 0 obj << /Type /Page /Parent 1 0 R /Contents 5 0 R >> endobj"]
    objects += [b"5 0 obj << /Length %d >>\nstream\n%s\nendstream endobj" % (len(shown), shown), b"6 0 obj << /Font << %s >> >> endobj" % listed, *extra]
    return b"%PDF-1.7\n" + b"\n".join(objects)


def mapped(source):
    data = zlib.compress(source)
    return b"7 0 obj << /Length %d /Filter [/FlateDecode] >>\nstream\n%s\nendstream endobj" % (len(data), data)


SUBSET = b"""1 begincodespacerange <0000> <FFFF> endcodespacerange
3 beginbfchar <0001> <0046> <0002> <00660069> <0009> <D83DDE00> endbfchar
2 beginbfrange <0010> <0029> <0061> <0030> <0032> [<0031> <00E9> <0020>] endbfrange"""


def test_subset_font_by_its_map():
    font = {b"F1": b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 7 0 R >>"}
    raw = with_fonts(font, b"BT /F1 9 Tf [<00010018> -20 <0021>] TJ <0014> Tj T* <0002001D0014> Tj <0031003200300009> Tj ET", [mapped(SUBSET)])
    assert pdf.extract(raw) == "Fire\nfineé 1\U0001f600\f"
    # Codes that the map leaves out, and a font of glyph numbers without a map, show as unknown.
    assert pdf.extract(with_fonts(font, b"BT /F1 9 Tf <00010099> Tj ET", [mapped(SUBSET)])) == "F\ufffd\f"
    assert pdf.extract(with_fonts({b"F1": b"<< /Subtype /Type0 /Encoding /Identity-H >>"}, b"BT /F1 9 Tf <00010002> Tj ET")) == "\ufffd\ufffd\f"


def test_codes_of_one_and_two_bytes():
    source = b"2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 1 beginbfrange <20> <7E> <0020> endbfrange 1 beginbfchar <8001> <4E2D> endbfchar"
    raw = with_fonts({b"F1": b"<< /Subtype /Type0 /ToUnicode 7 0 R >>"}, b"BT /F1 9 Tf <4180014263> Tj ET", [mapped(source)])
    assert pdf.extract(raw) == "A中Bc\f"


def test_encodings_and_differences():
    fonts = {
        b"A": b"<< /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /fi /eacute 65 /B /uni0416 /f_i.alt /u1F600 /g77] >> >>",
        b"B": b"<< /Subtype /TrueType /Encoding /MacRomanEncoding >>",
        b"C": b"8 0 R",
    }
    extra = [b"8 0 obj << /Subtype /Type1 /Encoding 9 0 R >> endobj", b"9 0 obj << /Differences [97/quotedblleft/scaron] >> endobj"]
    raw = with_fonts(fonts, b"BT /A 9 Tf <010241424344457A> Tj T* /B 9 Tf <8E> Tj T* /C 9 Tf (abc) Tj T* /None 9 Tf (d\\351) Tj ET", extra)
    assert pdf.extract(raw) == "fiéBЖfi\U0001f600\ufffdz\né\n“šc\ndé\f"
    assert [pdf_fonts.glyph(x) for x in ("Adieresis", "zcaron", "ccedilla", "seven", ".notdef")] == ["Ä", "ž", "ç", "7", "\ufffd"]


def test_a_wide_range_stays_a_range():
    codes = pdf_fonts.CodeMap.read(b"beginbfrange <00000000> <FFFFFFFF> <0041> endbfrange")
    assert codes.text(b"\0\0\0\2") == "C" and not codes.chars


def test_what_cannot_be_read_says_so():
    plain = with_fonts({}, b"BT (a) Tj ET")
    assert pdf._safe(pdf.extract, plain) == ("a\f", None)
    assert pdf._safe(pdf.extract, plain + b"\ntrailer << /Encrypt 4 0 R >>") == (None, "ValueError: encrypted")
    assert pdf._safe(pdf.extract, plain.replace(b"/Length", b"/Filter /LZWDecode /Length")) == (None, "ValueError: filter LZWDecode")
    assert pdf.extract(with_fonts({}, b"<~6<#'\\7PQ#@1a#b~>").replace(b"/Length", b"/Filter /ASCII85Decode /Length")) != ""
    assert pdf.extract(with_fonts({}, b"42 54 20 28 61 29 20 54 6A>").replace(b"/Length", b"/Filter [/ASCIIHexDecode] /Length")) == "a\f"
    assert pdf._safe(pdf.extract, None) == (None, "no PDF file")
