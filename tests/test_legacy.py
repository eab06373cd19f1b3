import struct
import zlib

import pytest

from quillon.functions import text as T
from quillon.plans import index as I
from quillon.plans import scan as S
from quillon.plans.corpus import with_paths
from quillon.sources.compound import rk, word_text
from quillon.sources.kinds import kind_of
from quillon.sources.readers import extract, html_title


def made_pdf(pages, packed=True):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages)))), b"<< /Title (Tide \\(low\\) tables) >>"]
    for k, body in enumerate(pages):
        data = zlib.compress(body) if packed else body
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 600 800] /Contents %d 0 R >>" % (5 + 2 * k))
        objects.append(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if packed else b"", data))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R /Info 3 0 R >>\n%%EOF"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_pages(packed):
    got = extract("t.pdf", made_pdf([b"BT /F1 12 Tf (High) Tj ( water) Tj 0 -14 Td (at noon) Tj ET", b"BT [(Sl) 20 (ack) -300 (tide)] TJ ET"], packed))
    assert got["status"] == "indexed" and got["title"] == "Tide (low) tables"
    assert "High water\nat noon" in got["content"] and "Slack tide" in got["content"]
    assert [a["num"] for a in got["anchors"] if a["kind"] == "Page"] == [1, 2]


def test_damaged_pdf_ends_in_a_status():
    assert extract("t.pdf", b"%PDF-1.4 nothing")["status"] == "failed"
    assert extract("t.pdf", made_pdf([b"BT (x) Tj ET"])[:200])["status"] in ("failed", "indexed")
    assert extract("t.pdf", made_pdf([b"q 600 0 0 800 0 0 cm BI /W 1 ID x EI Q"]))["status"] == "needs_ocr"


def test_damaged_compound_files():
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    for name in ("a.doc", "a.xls", "a.ppt", "a.msg", "a.docx"):
        assert extract(name, head + bytes(600))["status"] in ("failed", "name_only")


def test_pieces_of_old_formats():
    assert word_text("a\x13 LINK x \x14shown\x15 b\rc\x07") == "ashown b\nc\t"
    assert rk(struct.unpack("<I", struct.pack("<i", -5 << 2 | 2))[0]) == -5 and rk(1234 << 2 | 3) == 12.34
    assert [kind_of(e) for e in ("epub", "sql", "eml", "zip", "rs")] == ["ebook", "data", "text", "other", "code"]


def test_every_script_by_scan_and_index(spark):
    rows = [(1, "/a.txt", "Η Ελλάδα και το 東京タワー"), (2, "/b.txt", "قرأت الكتاب اليوم ١٢٣"), (3, "/c.txt", "город Йошкар-Ола"), (4, "/d.txt", "한국어 문서")]
    docs = with_paths(spark.createDataFrame(rows, "doc_id long, path string, content string")).selectExpr("*", "'' as meta", "1 as size", "1 as mtime", "'text' as kind").cache()
    index = I.Index(docs, I.postings(docs).cache())
    for query, want in (("ελλαδα", [1]), ("京", [1]), ("東京", [1]), ("كتاب", [2]), ("الكتاب", [2]), ("123", [2]), ("ИОШКАР", [3]), ("한국어", [4])):
        assert [r.doc_id for r in S.smart(docs, query).collect()] == want, query
        assert [r.doc_id for r in index.matches(query).collect()] == want, query
    assert [r.doc_id for r in S.exact(spark.createDataFrame([(1, "the ſea front", "n")], "doc_id long, content string, name string"), "the sea front").collect()] == [1]


def test_folding_in_the_jvm_is_that_of_single_words(spark):
    words = ["Straße", "Éléphant", "Ἑλλάς", "ЙОД", "ىٰة", "がぎ", "豈", "ـكـ", "٣۴", "Ærø", "한국"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(T.fold("w").alias("f")).collect()
    assert [r.f for r in got] == [T.normalize(w) for w in words]


def test_titles_are_decoded(spark):
    df = spark.createDataFrame([("<title>T &amp; <b>x</b>\n y</title>",)], "h string")
    assert df.select(html_title(df.h).alias("t")).first().t == "T & x y"
