import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from claimgrid.llm import token_counts, token_store
from claimgrid.llm.encoder import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "B", " ", "  ", "\n", "\n\n", "\t", ".", ",", "!", "'ll", "'s", "é", "ß", "12", "<|endoftext|>", "\xa0", "中", "́", "the", " of", "ª", "'", "\x1c"]
SCHEMA = "doc_id long, text string, start string, tie int, shard int"


def ids(text):
    return encoder(PATH).lib.encode(text or "", add_special_tokens=False).ids


def test_word_cache_equals_library():
    rnd = random.Random(3)
    enc = encoder(PATH)
    for _ in range(5000):
        text = "".join(rnd.choices(ODD, k=rnd.randint(0, 14)))
        assert enc.ids(text) == np.array(ids(text), "<u4").tobytes(), repr(text)


def test_resynchronised_count_equals_whole_text():
    rnd = random.Random(1)
    lib = encoder(PATH).lib
    for _ in range(25):
        text = "".join(rnd.choices(ODD, k=2000))
        assert token_counts.resync_count(lib, text, 200, 40) == len(ids(text))
    for text in ("a" * 4000, " " * 3000 + "b", "word" * 1500 + " x" * 2000):     # overlaps without a common boundary
        assert token_counts.resync_count(lib, text, 500, 50) == len(ids(text))


def test_packed_ids_round_trip_and_random_access():
    rnd = np.random.default_rng(2)
    for own in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], rnd.integers(0, 50257, 3000), rnd.integers(0, 2**32, 1500), np.zeros(600)):
        own = np.asarray(own, np.uint32)
        seg = token_store.Segment(token_store.pack(own))
        assert (seg.all() == own).all() and len(seg) == len(own)
        assert [seg[i] for i in range(len(own))] == own.tolist()
        with pytest.raises(IndexError):
            seg[len(own)]


ROWS = [(5, "one two", "s", 1, 1), (None, "null id", "s", 1, 1), (2, None, "s", 1, 1), (5, "one two", "s", 1, 1), (5, "another", "s", 1, 1), (9, "", None, None, None), (7, "long text " * 30000, "s", 2, 2)]


def test_token_files(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    segments = token_store.write_tokens(df, PATH, shards=3, segment_ids=50)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_documents(segments).collect()))
    assert [g[1] for g in got] == sorted([r[0] for r in ROWS], key=lambda i: (i is not None, i))
    assert [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got[:-1]]).tolist()
    crc = lambda t: (len(ids(t)) + 1, zlib.crc32(np.array([*ids(t), 2], "<u4").tobytes()))
    assert sorted(g[2:] for g in got) == sorted(crc(r[1]) for r in ROWS)
    every = [t for i in (None, 2) for r in ROWS if r[0] == i for t in [*ids(r[1]), 2]]
    asked = spark.createDataFrame([(i,) for i in range(len(every))] + [(10**9,)], "position long")
    assert [r.token_id for r in token_store.tokens_at(segments, asked).orderBy("position").collect()] == every
    assert token_store.read_documents(token_store.write_tokens(df.limit(0), PATH)).count() == 0


def test_counts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted(token_counts.token_counts(df, PATH, chunk=10_000).collect(), key=str)
    assert {tuple(g) for g in got} == {(i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for i, t, *_ in ROWS}
    assert len(got) == len(ROWS) and token_counts.token_counts(df.limit(0), PATH).count() == 0
    import sentencepiece
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {r.n_tokens for r in token_counts.token_counts(df, model).where("doc_id = 5").collect()} == {len(sp.encode("one two")), len(sp.encode("another"))}
