"""Token output and token counts against the libraries themselves."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest

from docloom.llm import tokenbin, token_counts
from docloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
BPE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PIECES = [" ", "word", "été", ".", ",", "%%%", "-", "—", "ª", "²", "  ", "\t", "\n", "a", "the", "é", "1", "!!", "<|endoftext|>", "<s>", "'s", "　", "\xa0", "\x1c", "日本", "▁", "▁▁", "😀", "\r\n", "A", "\x00"]


def _texts(n, seed=0):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(PIECES, rng.integers(0, 14))) for _ in range(n)]


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(BPE), tokenbin.Encoder(BPE, words=300)
    for t in _texts(3000):
        assert tok.encode(t, add_special_tokens=False).ids == np.frombuffer(enc.encode(t), "<u4").tolist(), repr(t)


def test_piece_counts_equal_library():
    import sentencepiece

    sp, pc = sentencepiece.SentencePieceProcessor(model_file=PIECE), token_counts.PieceCounter(PIECE, most=500)
    for t in _texts(4000, 1):
        assert sum(pc.counts(token_counts.pre_tokens(t))) == len(sp.encode(t)), repr(t)


@pytest.mark.parametrize("most", [1, 2, 300, 70_000, 2**32])
def test_block_round_trip(most):
    rng = np.random.default_rng(most % 97)
    for n in (1, 7, 4096):
        a = rng.integers(0, most, n).astype(np.uint32)
        assert (tokenbin.unpack_block(memoryview(tokenbin.pack_block(a))) == a).all()


def test_outliers_become_exceptions():
    a = np.full(4096, 5, np.uint32)
    a[[3, 99]] = 60_000
    packed = tokenbin.pack_block(a)
    assert len(packed) < 60 and (tokenbin.unpack_block(memoryview(packed)) == a).all()


def test_segment_index():
    ids = np.arange(10_000, dtype=np.uint32) % 777
    data = tokenbin.pack_segment([None, 4], [4000, 6000], ids)
    docs, lengths, back = tokenbin.unpack_segment(data)
    assert docs == [None, 4] and lengths.tolist() == [4000, 6000] and (back == ids).all()
    assert (tokenbin.read_block(data, 1) == ids[4096:8192]).all()
    with pytest.raises(ValueError):
        tokenbin.unpack_segment(b"XXXX" + data[4:])


def test_token_blocks_equal_direct_encoding(spark):
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(BPE), 0
    got = {r.doc_id: r for r in Q.op3_token_blocks(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_counts_equal_direct_encoding(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r for r in Q.op6_token_counts(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n = len(sp.encode(r.text))
        assert tuple(got[r.doc_id]) == (r.doc_id, len(r.text.encode()), n, n > 4096)


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, 0), (None, "a b", 1), (1, "a", 2), (2, "", 3), (2, "  ", 4)], "doc_id long, text string, n_tokens int")
    counts = token_counts.count_tokens(rows, PIECE, vocabulary_bytes=3).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counts) == [(0, 3, 2), (1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 2, 1)]
    out = tokenbin.round_trip(rows, BPE).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 1, 1, 2, 2] and out[0].start == 0
    assert token_counts.count_tokens(rows.limit(0), PIECE).count() == 0
    assert tokenbin.round_trip(rows.limit(0), BPE).count() == 0


def test_very_long_text(spark):
    t = "lorem ipsum, dolor\nsit " * 60_000
    rows = spark.createDataFrame([(1, t), (2, "x")], "doc_id long, text string")
    from tokenizers import Tokenizer

    n = len(Tokenizer.from_file(BPE).encode(t, add_special_tokens=False).ids) + 1
    assert {r.doc_id: r.n_tokens for r in tokenbin.round_trip(rows, BPE).collect()}[1] == n
