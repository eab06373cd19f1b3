import hashlib
import struct
import zlib

import pytest

from quillon.llm import media, warc
from quillon.llm.base import shared_dir
from quillon.llm.files import open_file


@pytest.mark.parametrize("frames", [1, 7, 8, 9, 200])
def test_media_round_trip(frames):
    payload = bytes(i * 7 % 256 for i in range(192 * frames))
    data = media.write_frames(payload)
    (t,) = media.parse(data)
    assert t.payload(data) == payload and t.codec == "raw " and t.duration == frames and len(t.keyframes()) == -(-frames // 25)
    assert all(data[o : o + s] == payload[192 * 25 * k :][:192] for k, (o, s) in enumerate(t.keyframes()))
    with pytest.raises(ValueError):
        media.write_frames(payload + b"x")


def test_media_fragments_and_wide_boxes():
    trex = media.full(b"trex", struct.pack(">5I", 1, 1, 10, 5, 0x10000))
    head = media.box(b"moov", media.box(b"trak", media.full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, 0)), media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 0, 0, 0)))), media.box(b"mvex", trex))
    run = media.full(b"trun", struct.pack(">IiI", 3, 0, 0), flags=5)
    moof = media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 1)), run))
    offset = len(moof) + 16
    run = media.full(b"trun", struct.pack(">IiI", 3, offset, 0), flags=5)
    moof = media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 1)), run))
    data = head + moof + struct.pack(">I4sQ", 1, b"mdat", 16 + 15) + b"AAAAABBBBBCCCCC"
    (t,) = media.parse(data)
    assert t.payload(data) == b"AAAAABBBBBCCCCC" and t.key.tolist() == [True, False, False] and t.duration == 30


@pytest.mark.parametrize("damage", [b"", b"junk", b"\0\0\0\x08moov", b"\xff\xff\xff\xffmoov", b"\0\0\0\x10moov" + b"\0\0\0\x20trak"])
def test_damaged_media_is_null(damage):
    assert media.describe(damage) is None or media.describe(damage)["samples"] == 0


def test_media_columns(odd, nothing, spark):
    texts = {r.doc_id: r.text for r in odd.collect()}
    got = media.media_columns(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        p = t + b" " * (-len(t) % 192 or 192 * (not t))
        if r.doc_id is not None:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    same = [r for r in got if r.doc_id in (9, 10)]
    assert same[0][1:] == same[1][1:]
    assert media.media_columns(nothing).count() == 0
    files = spark.createDataFrame([(1, bytearray(media.write_frames(b"x" * 384))), (2, bytearray(b"no")), (3, None)], "id long, data binary")
    rows = {r.id: r for r in media.keyframe_table(files, "id", "data").collect()}
    assert rows[1].samples == 2 and rows[1].seconds == 0.08 and len(rows[1].keyframes) == 1 and rows[2].codec is None and rows[3].keyframes is None


PAGES = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nX: y", "other"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (2, "again", "same"), (7, "u", "long " * 400_000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as frame", "'x' as file").repartition(3)
    index = warc.write_archives(pages, shared_dir(spark), frame_bytes=100)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(index).collect()), key=str)
    d = lambda t: (len(t), warc.digest(t.encode()))
    want = [(1, *d("same"), "revisit", 2), (2, *d("same"), "response", None), (2, *d("same"), "response", None), (3, *d("other"), "response", None), (4, *d(""), "revisit", 5), (5, *d(""), "response", None), (None, *d("same"), "response", None), (7, *d("long " * 400_000), "response", None)]
    assert got == sorted(want, key=str)
    for r in index.filter("page_id in (3, 7)").collect():
        head, block = warc.read_record(r.file, r.frame, r.offset)
        assert head["WARC-Record-ID"] == r.record_id and warc.payload_of(block)[1].decode() == {3: "other", 7: "long " * 400_000}[r.page_id]
        with open_file(r.file) as f:
            assert len(warc.seek_table(f)) >= 1
    names = [r.record_id for r in index.collect()]
    assert len(names) == len(set(names)) == len(PAGES)
    for r in index.filter("page_id = 1").collect():  # its response is one of two rows alike, so it is named by its id only
        assert "WARC-Refers-To" not in warc.read_record(r.file, r.frame, r.offset)[0]
    four, five = (index.filter(f"page_id = {k}").first() for k in (4, 5))
    assert warc.read_record(four.file, four.frame, four.offset)[0]["WARC-Refers-To"] == five.record_id
    assert warc.read_archives(index).rdd.getNumPartitions() == index.select("file").distinct().count()
    assert warc.write_archives(pages.limit(0), shared_dir(spark)).count() == 0


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame(PAGES[:2] + PAGES[3:5], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(pages, shared_dir(spark), least=3)).collect()}
    assert got == {1: "revisit", 2: "response", 4: "response", 5: "response"}


def test_bundles_are_plain_zstandard(spark, tmp_path):
    import zstandard

    b = warc.Bundle(f"file://{tmp_path}/b.warc.zst", 10)
    at = [b.add(warc.record(k, None, b"p%d" % k)[1]) for k in range(3)]
    b.close()
    data = (tmp_path / "b.warc.zst").read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(list(warc.parse_records(whole))) == 3 and [x[0] for x in at] == [0, 1, 2]


@pytest.mark.parametrize("name, table", [("op5_warc", "pages"), ("op7_suffix_dedup", "documents")])
def test_queries_are_their_sql(spark, name, table):
    import duckdb

    from quillon.llm import registry

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    want = db.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, registry.QUERIES[name](spark, d).select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)
