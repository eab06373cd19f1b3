import io
import zipfile

import pytest

from quillon.functions.excerpt import Anchor, describe
from quillon.sources import readers as R
from quillon.sources import scan as S
from quillon.sources.sink import Sink, Stop


def zipped(**entries) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in entries.items():
            z.writestr(k.replace("__", "/"), v)
    return out.getvalue()


def make(entries: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return out.getvalue()


W = 'xmlns:w="w"'
REL = '<Relationships xmlns="r"><Relationship Id="{}" Target="{}"/></Relationships>'
DOCX = make({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Growth of twelve</w:t></w:r><w:r><w:t> percent</w:t></w:r></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>", "word/footnotes.xml": f"<w:x {W}><w:p><w:t>a note</w:t></w:p></w:x>", "docProps/core.xml": '<c xmlns:d="d"><d:title>Tidewater Tables</d:title><d:creator>Ann</d:creator></c>'})
XLSX = make({
    "xl/workbook.xml": '<workbook xmlns:r="http://x/relationships"><sheets><sheet name="Stores" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": REL.format("rId1", "worksheets/s1.xml"),
    "xl/sharedStrings.xml": "<sst><si><t>Item</t></si><si><r><t>pet</t></r><r><t>rel</t></r></si></sst>",
    "xl/worksheets/s1.xml": '<w><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3"><f>1+1</f><v>2</v></c></row></sheetData></w>',
})
PPTX = make({
    "ppt/presentation.xml": '<p xmlns:r="http://x/relationships" xmlns:p="p"><p:sldId r:id="b"/><p:sldId r:id="a"/></p>',
    "ppt/_rels/presentation.xml.rels": '<R xmlns="r"><Relationship Id="a" Target="slides/s1.xml"/><Relationship Id="b" Target="slides/s2.xml"/></R>',
    "ppt/slides/s1.xml": '<s xmlns:p="p" xmlns:a="a"><p:sp><p:ph type="title"/><a:p><a:t>Soundings</a:t></a:p></p:sp><p:sp><a:p><a:t>cormorant</a:t></a:p></p:sp></s>', "ppt/slides/s2.xml": '<s xmlns:a="a"><a:p><a:t>First</a:t></a:p></s>',
})
ODS = make({"content.xml": '<o xmlns:table="urn:table" xmlns:text="urn:text"><table:table table:name="T"><table:table-row><table:table-cell table:number-columns-repeated="2"><text:p>v</text:p></table:table-cell><table:table-cell><text:p>w</text:p></table:table-cell></table:table-row></table:table></o>'})
EPUB = make({"META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>', "O/p.opf": '<package><metadata><title>Book</title></metadata><manifest><item id="c1" href="c1.xhtml"/></manifest><spine><itemref idref="c1"/></spine></package>', "O/c1.xhtml": "<html><head><title>One</title></head><body><p>chapter text</p></body></html>"})
EML = b"Subject: =?utf-8?q?Caf=C3=A9?=\r\nFrom: a@x\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nbody words\r\n--B\r\nContent-Type: text/plain; name=n.txt\r\nContent-Disposition: attachment; filename=n.txt\r\n\r\nattached words\r\n--B--\r\n"


@pytest.mark.parametrize(
    "name, data, words, title",
    [
        ("a.txt", "naïve".encode("cp1252"), ["naïve"], None), ("a.txt", "héllo wörld abc".encode("utf-16-le"), ["héllo"], None), ("a.json", b'{"k\\u00e9": ["v", 12.5, true, null, "\\ud83d\\ude00"]', ["ké: v", "12.5", "😀"], None),
        ("a.html", b"<title>T &amp; x</title><script>var hidden</script><p>one<p>two &copy;<table><tr><td>c1</td><td>c2</td></tr></table>", ["one\ntwo ©", "c1\tc2"], "T & x"),
        ("a.xml", b'<!DOCTYPE a [<!ENTITY e "EXPANDED">]><a k="attr"><title>T</title><![CDATA[raw]]>&e; x</a>', ["attr", "raw"], "T"),
        ("a.rtf", rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\info{\title Tt}}Legacy \b rich\b0  text\par caf\'e9 \u8364? end}", ["Legacy rich text", "café €"], "Tt"),
        ("q.docx", DOCX, ["Growth of twelve percent\nSecond", "a note"], "Tidewater Tables"), ("b.xlsx", XLSX, ["Item\t\tTRUE", "\tpetrel\t2"], None), ("d.pptx", PPTX, ["First\nSoundings", "cormorant"], None),
        ("t.ods", ODS, ["v\tv\tw"], None), ("e.epub", EPUB, ["chapter text"], "Book"), ("m.eml", EML, ["Subject: Café", "body words", "n.txt\nattached words"], "Café"), ("z.zip", make({"in/a.txt": "inner words", "q.docx": DOCX}), ["in/a.txt\ninner words", "Growth of twelve"], None),
    ],
)
def test_readers(name, data, words, title):
    got = R.extract(name, data)
    assert got["status"] == "indexed", got
    for w in words:
        assert w in got["content"], (w, got["content"])
    assert got["title"] == title
    assert "hidden" not in got["content"] and "EXPANDED" not in got["content"]


def test_locations():
    def at(name, data, word):
        got = R.extract(name, data)
        return describe(got["content"], [Anchor(**a) for a in got["anchors"]], got["content"].index(word))

    assert at("b.xlsx", XLSX, "petrel") == "Stores!B3"
    assert at("d.pptx", PPTX, "cormorant") == "Slide 2 — Soundings"
    assert at("q.docx", DOCX, "a note") == "Footnotes"
    assert at("z.zip", make({"b.xlsx": XLSX}), "petrel") == "b.xlsx › Stores!B3"
    assert at("m.eml", EML, "attached") == "n.txt"


@pytest.mark.parametrize(
    "name, data, status",
    [
        ("broken.docx", b"not a zip", "failed"), ("junk.xlsx", make({"x": "y"}), "failed"), ("a.exe", b"MZ\0\0", "name_only"), ("b.bin", b"\0\1\2", "name_only"), ("bomb.docx", make({"word/document.xml": b"0" * (40 << 20)}), "failed"),
        ("deep.json", b"[" * 200_000, "indexed"), ("deep.rtf", b"{\\rtf1" + b"{" * 100_001, "indexed"), ("trunc.xml", b"<a><b>text", "indexed"), ("empty.txt", b"", "indexed"), ("null.txt", None, "indexed"),
    ],
)
def test_hostile_inputs_end_in_a_status(name, data, status):
    assert R.extract(name, data)["status"] == status


def test_sink_tidies_and_stops():
    s = Sink(most=20)
    s.write("a\r")
    s.write("\nb\x00c\n\n\n\nd")
    assert s.text() == "a\nb c\n\nd"
    with pytest.raises(Stop):
        s.write("x" * 50)
    assert len(s.text()) == 20 and s.truncated


def test_sniff():
    assert [S.sniff(x) for x in (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"PK\x03\x04", b"xx%PDF-1.4", b"\xff\xfea\0", b"{\\rtf1", b"a\0b", b"  <!DOCTYPE HTML>", b"<?xml ?>", b"\x01" * 9 + b"a" * 9, b"hello")] == ["compound", "zip", "pdf", "utf16", "rtf", "binary", "html", "xml", "binary", "text"]


def test_scan_filters(spark, tmp_path):
    for p in ("a.txt", "node_modules/x.js", ".hid/b.txt", "sub/c.MD", "sub/tmp_1.log"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    names = lambda **k: sorted(r.name for r in S.scan(spark, str(tmp_path), S.Filter(**k)).select("name").collect())
    assert names() == ["a.txt", "c.MD", "tmp_1.log"]
    assert names(globs=("tmp_*",)) == ["a.txt", "c.MD"] and names(only_exts=("md",)) == ["c.MD"] and names(paths=(f"{tmp_path}/sub",)) == ["a.txt"]
    got = R.extracted(S.scan(spark, str(tmp_path)).select("name", "content")).collect()
    assert all(r.content == "x" and r.status == "indexed" for r in got)


def test_batches_of_tables_are_bounded_unless_they_were_set(spark):
    from quillon.plans.corpus import BATCHES, table

    for key, own, smaller in BATCHES:
        was = spark.conf.get(key)
        try:
            spark.conf.set(key, own)
            table(spark, "/root/testdata/sf0.001", "pages")
            assert spark.conf.get(key).rstrip("b") == smaller
            spark.conf.set(key, "77")
            table(spark, "/root/testdata/sf0.001", "pages")
            assert spark.conf.get(key).rstrip("b") == "77"
        finally:
            spark.conf.set(key, was)
