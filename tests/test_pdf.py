"""PDF files made by hand: plain and compressed streams, object streams, outlines, maps to Unicode."""

import base64
import zlib

from quillgraph.plans import pipeline
from quillgraph.sources import documents, pdf


def pdf_file(objects):
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, body) for n, body in objects.items()) + b"\ntrailer\n<< /Root 1 0 R >>\n%%EOF"


def stream(data, extra=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), extra, data)


CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0416> endbfchar 2 beginbfrange <0010> <0012> <0430> <0020> <0021> [<00660069> <0041>] endbfrange"
FIRST = b"BT /F1 12 Tf 72 700 Td (One \\(1\\) \\101 caf\\351) Tj 0 -14 Td [(sp) -20 (lit) -300 (word)] TJ ET"
SECOND = b"BT /F2 12 Tf 1 0 0 1 72 700 Tm <0001001000110020> Tj 1 0 0 1 72 680 Tm <0021> Tj ET"


def example():
    packed = b"7 0 8 40 " + b"<< /Type /Font /Subtype /Type1 >>".ljust(40) + b"<< /Type /Font /ToUnicode 9 0 R >>"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 10 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>",
        5: stream(zlib.compress(FIRST), b"/Filter /FlateDecode"),
        6: stream(base64.a85encode(SECOND) + b"~>", b"/Filter [/ASCII85Decode]"),
        9: stream(CMAP),
        10: b"<< /Type /Outlines /First 11 0 R >>",
        11: b"<< /Title (Intro) /Dest [3 0 R /Fit] /Next 12 0 R /First 13 0 R >>",
        12: b"<< /Title <FEFF04160031> /A << /S /GoTo /D [4 0 R /Fit] >> >>",
        13: b"<< /Title (Deeper) /Dest [3 0 R /Fit] >>",
        14: stream(zlib.compress(packed), b"/Type /ObjStm /N 2 /First 9 /Filter /FlateDecode"),
    }
    return pdf_file(objects)


def test_pages_and_outline():
    assert pdf.pdf_pages(example()) == ["One (1) A café\nsplit word", "Жабfi\nA"]
    assert pdf.Document(example()).outline() == [(1, "Intro", 1), (2, "Deeper", 1), (1, "Ж1", 2)]


def test_files_become_sections(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(example())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "c.pdf").write_bytes(example().replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"))
    pages, toc = pdf.read_pdfs(spark, str(tmp_path))
    assert sorted((r.page_no, r.text) for r in pages.collect()) == [(0, "One (1) A café\nsplit word"), (1, "Жабfi\nA")]
    assert sorted((r.entry_no, r.level, r.title, r.page_no) for r in toc.collect()) == [(0, 1, "Intro", 1), (1, 2, "Deeper", 1), (2, 1, "Ж1", 2)]
    assert documents.sections_from_toc(pages, toc).count() == 0  # all sections are shorter than the least
    (tmp_path / "b.pdf").unlink()
    (tmp_path / "c.pdf").unlink()
    got = documents.read_files(spark, str(tmp_path)).first().text
    assert got == "One (1) A café\nsplit word\nЖабfi\nA"


def test_outlines_and_blocks_become_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "LEAST_CHARS", 3)
    (tmp_path / "a.pdf").write_bytes(example())
    (tmp_path / "d.pdf").write_bytes(example().replace(b"/Outlines 10 0 R", b""))
    sections = pipeline.pdf_sections(spark, str(tmp_path))
    got = {(r.doc_id.rsplit("/", 1)[-1], r.title): r.text for r in sections.collect()}
    assert got == {
        ("a.pdf", "Deeper"): "One (1) A café\nsplit word", ("a.pdf", "Ж1"): "Жабfi\nA",
        ("d.pdf", "pages_1_2"): "One (1) A café\nsplit word\nЖабfi\nA",
    }
    chunks = pipeline.chunk_sections(sections).collect()
    assert len(chunks) == 3 and len({r.chunk_id for r in chunks}) == 3
