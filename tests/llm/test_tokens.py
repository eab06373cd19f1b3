import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillon.llm import binary, bpe, tokencount
from quillon.llm.base import shared_dir
from quillon.llm.wordtable import Library, Memo, WordIds

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(sample, odd, nothing):
    for df in (sample, odd):
        rows = df.select("doc_id", "text").collect()
        want = sorted((r.doc_id is None, r.doc_id, len((r.text or "").encode()), len(library_ids(r.text))) for r in rows)
        got = [(r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.token_counts(df, PATH).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert tokencount.token_counts(nothing, PATH).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (200, 16), (1000, 64)])
def test_spliced_chunks_are_the_whole(chunk, overlap):
    rng = random.Random(chunk)
    c = tokencount.Counter(PATH, 10, chunk, overlap)
    texts = ["many words, " * 3000 + "e\u0301 x" * 900] + ["".join(rng.choice("abc,. \n\té!1") for _ in range(rng.randint(0, 5000))) for _ in range(20)] + ["z" * 5000, "q" * 700 + " " + "r" * 900 + " end", " " * 3000 + "a"]
    got = c([t.encode() for t in texts])
    assert got["n_tokens"].tolist() == [len(library_ids(t)) for t in texts]
    assert got["over_limit"].tolist() == [len(library_ids(t)) > 10 for t in texts]


def test_words_are_never_taken_for_one_another(spark):
    """Thue-Morse words and their complements collide under every polynomial hash modulo a power of two."""
    for log in (10, 11, 13):
        t = "".join("er"[i.bit_count() & 1] for i in range(1 << log))
        other = t.translate(str.maketrans("er", "re"))
        df = spark.createDataFrame([(1, t), (2, other), (3, f"{other} {t}")], "doc_id long, text string").coalesce(1)
        assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(df, PATH).collect()} == {1: len(library_ids(t)), 2: len(library_ids(other)), 3: len(library_ids(t)) + len(library_ids(other))}


def test_memo_forgets_without_a_change():
    asked = []

    def learn(keys):
        asked.extend(keys)
        return [k * 2 for k in keys]

    m, rng = Memo(learn, most=8, longest=3), random.Random(0)
    for _ in range(200):
        rows = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.randint(0, 6))] for _ in range(2)]
        assert m.look(rows) == [[k * 2 for k in r] for r in rows]
    assert len(m.young) + len(m.old) < 40 and all(len(k) <= 3 for k in m.young)


def test_packed_words_are_the_librarys():
    words, rng = WordIds(PATH, 2, most=64), random.Random(2)
    texts = ["".join(rng.choice("ab ★<|>end\n\u0301É1's●") for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["<|endoftext|> a<|startoftext|>b ★", "★", "a ★ b"]
    for got, t in zip(words.packed([t.encode() for t in texts]), texts):
        assert np.frombuffer(got, "<u2").tolist() == library_ids(t)
    assert Library(PATH).between


def test_bpe_is_tiktokens(sample, odd, nothing):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rng = random.Random(1)
    texts = [r.text or "" for r in sample.collect()] + ["".join(rng.choice(" \n\tab1'.é sl\x1c\x85　") for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    c = bpe.Codec(RANKS, P.PATTERN, most=50)
    for t in texts:
        ids = c.encode(t)
        assert ids == library.encode_ordinary(t)
        assert c.decode(ids) == t.encode()
    for r in bpe.bpe_roundtrip(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).join(odd.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        ids = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert bpe.bpe_roundtrip(nothing, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, True).count() == 0


def test_merges_take_the_lowest_rank_then_the_leftmost():
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"aa": 0, b"ab": 1, b"aaa": 2, b"bc": 1}

    def slow(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(3)
    for n in range(1, 40):
        for _ in range(20):
            piece = bytes(rng.choice(b"abc") for _ in range(n))
            assert bpe.merge(piece, ranks) == slow(piece)
    pairs = bpe.Pairs(ranks)
    for size in (1, 2, 4, 32):
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(max(2, size // 2 + 2), size + 1))) for _ in range(300)]
        ids, count = bpe.merge_together(pieces, size, pairs)
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [slow(p) for p in pieces]


def test_crc32c():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in [*range(12), 127, 128, 129, 4000]]
    got = binary.crc32c(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts]))
    assert got.tolist() == [binary._plain(p) for p in parts]
    assert binary._plain(b"123456789") == 0xE3069283


def test_frames_show_damage():
    data = b"".join(binary.frame([b"", b"abc", b"x" * 1000]))
    assert binary.unframe(data) == [b"", b"abc", b"x" * 1000]
    for at in (0, 9, 20, len(data) - 1):
        with pytest.raises(ValueError):
            binary.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        binary.unframe(data[:-1])


@pytest.mark.parametrize("vocabulary", [49_408, 100_000])
def test_records_round_trip(spark, sample, odd, nothing, vocabulary):
    for df in (sample, odd):
        index = binary.write_records(df, PATH, vocabulary, 1, shared_dir(spark), 3)
        got = sorted(binary.read_records(index).collect(), key=lambda r: r.start)
        ids = [(-1 if r.doc_id is None else r.doc_id) for r in got]
        assert ids == sorted(ids)
        texts: dict = {}
        for r in df.collect():
            texts.setdefault(r.doc_id, []).append(zlib.crc32(np.array([*library_ids(r.text), 1], "<u4").tobytes()))
        start = 0
        for r in got:
            assert r.start == start and r.ids_crc32 in texts[r.doc_id]
            texts[r.doc_id].remove(r.ids_crc32)
            start += r.n_tokens
        assert not any(texts.values())
    one = index.filter("doc_id = 6").first()
    assert binary.read_record(one.file, one.offset, one.length)[1].tolist() == [*library_ids(odd.filter("doc_id = 6").first().text), 1]
    assert binary.read_records(binary.write_records(nothing, PATH, vocabulary, 1, shared_dir(spark), 2)).count() == 0


def test_kept_columns_that_clash_are_refused_before_running(odd):
    with pytest.raises(ValueError):
        tokencount.token_counts(odd, PATH, keep=("n_tokens",))
    assert tokencount.token_counts(odd, PATH, keep=("score",)).columns == ["doc_id", "score", "n_bytes", "n_tokens", "over_limit"]
