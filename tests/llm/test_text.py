"""Tokens: encoding, decoding, token files, counts."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evenhand.llm import bpe, pfor, transducer
from tests.llm.samples import frame, texts

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_encoding_and_decoding_agree_with_the_library(spark, library):
    rows, want = texts(spark), Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert rows_of(bpe.encode_decode_digests(frame(spark, rows), WORD)) == want


def test_tokens_decode_back(spark, library):
    rows = texts(spark, 20)
    tokens = bpe.encode_texts(frame(spark, rows), WORD)
    got = rows_of(bpe.decode_tokens(tokens, WORD))
    assert got == Counter((i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows)


def test_every_character_to_u0250_and_odd_marks(library):
    import pyarrow as pa

    enc = bpe.Encoder(open(WORD, "rb").read())
    some = [f"{chr(c)}A{chr(c)} {chr(c)}'s" for c in range(0x250)] + ["'''s", "x're'll'd've'mzz'", "a<|endoftext|>b <|ENDOFTEXT|>", "ΑΣ ς", "1234 ²³ ١"]
    flat, n = enc.ids(pa.array(some))
    ends = np.cumsum(n)
    assert [flat[e - k: e].tolist() for e, k in zip(ends, n)] == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]


def test_the_word_table_grows(library, monkeypatch):
    import signal

    import pyarrow as pa

    monkeypatch.setattr(bpe, "SLOTS", 16)
    signal.signal(signal.SIGALRM, lambda *_: pytest.fail("the table is full and does not grow"))
    signal.alarm(10)
    try:
        enc = bpe.Encoder(open(WORD, "rb").read())
        some = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(k)) for k in (5, 300, 40, 600)]
        flat, n = enc.ids(pa.array(some[:2]))
        more, m = enc.ids(pa.array(some[2:]))
    finally:
        signal.alarm(0)
    ends = np.cumsum(np.r_[n, m])
    assert [np.r_[flat, more][e - k: e].tolist() for e, k in zip(ends, np.r_[n, m])] == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
    assert len(enc.slot_word) >= 2 * enc.words


@pytest.mark.parametrize("rows_of_a_shard, ids_of_a_shard", [(16, 1 << 22), (4096, 500)])
def test_token_files_round_trip(spark, library, monkeypatch, rows_of_a_shard, ids_of_a_shard):
    monkeypatch.setattr(pfor, "SHARD_ROWS", rows_of_a_shard)
    monkeypatch.setattr(pfor, "SHARD_IDS", ids_of_a_shard)
    rows = texts(spark, 40)
    rows += [(77, rows[5][1])] * 40 + [(77, "another")] * 10 + [(None, "no id")] * 20 + [(-(1 << 63), "least")]  # one id, and none, hold a large part
    got = [tuple(r) for r in pfor.token_files(frame(spark, rows), WORD).orderBy("start").collect()]
    ids_in_order = [r[0] for r in got]
    assert ids_in_order[:21] == [None] * 21 and ids_in_order[21:] == sorted(ids_in_order[21:])
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    ids = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in rows)


def test_ties_are_dealt_to_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(pfor, "SAMPLED", 20)
    df = frame(spark, [(5, f"text {i % 3}") for i in range(300)])
    shards = pfor.write_tokens(df, WORD, "file:" + __import__("tempfile").mkdtemp(dir="/tmp"))
    assert max(r["n_docs"] for r in shards.collect()) < 200 and shards.agg({"n_docs": "sum"}).first()[0] == 300


def test_token_files_of_nothing(spark):
    assert pfor.token_files(frame(spark, [(1, "a")]).where("doc_id = 2"), WORD).count() == 0


def test_blocks_hold_any_values():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 3000):
        for top in (1, 2, 300, 50_000, 2**31):
            x = rnd.integers(0, top, n)
            x[rnd.random(n) < 0.03] = 0
            starts, body = pfor.pack(x)
            assert (pfor.unpack(np.frombuffer(body, np.uint8), starts, n) == x).all()


def test_counts_agree_with_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = texts(spark) + [(9100 + k, " " * k + "the" + " " * k) for k in range(40)] + [(9200, "▁a ▁ b"), (9201, "<s>x</s>"), (9202, "a\x00b"), (9203, "x" * 30_000)]
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in rows)
    assert rows_of(transducer.token_counts(frame(spark, rows), PIECE)) == want


def test_counts_survive_a_full_table(spark, monkeypatch):
    import pyarrow as pa

    from evenhand.llm.common import flat_bytes

    monkeypatch.setattr(transducer, "MOST_STATES", 50)
    machine = transducer.Transducer(open(PIECE, "rb").read())
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for _, t in texts(spark, 10):
        assert machine.counts(*flat_bytes(pa.array([t], pa.string())))[0] == len(model.encode(t or ""))
