import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from glyphray.llm import bpe
from tests.llm import plain

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"
PARTS = [
    "a", "e", "th", "ing", " ", "  ", "\n", "é", "漢", "1", "23", "'s", "'ll", "<|endoftext|>", "\x1c", "\x85", "\xa0", "!!",
    "...", "\U0001f600", "ZZ", "\t", "‍", "ñ", "Ω", "٣", "　", "=" * 9, "-" * 7, " " * 11, "a" * 30, "x" * 200,
]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_random_texts(encoder, library):
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 25)))
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert "".join(bpe.decode(ids, encoder.machine.tokens, 3)) == text


def test_hard_texts_and_long_pieces(encoder, library):
    draw = random.Random(4)
    long = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)) for _ in range(60)]
    for text in [*plain.HARD, *long, " ".join(long) * 15]:
        assert encoder.encode(text or "") == library.encode_ordinary(text or "")


def test_small_bounds_change_nothing(library):
    small = bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN, max_pieces=5)
    small.machine.max_states = 20
    for text in plain.HARD:
        assert small.encode(text or "") == library.encode_ordinary(text or "")


def test_new_words_side_by_side(library):
    """Answers are those of the library, and words that occur once leave no states behind."""
    draw = random.Random(7)
    fresh = bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN, max_pieces=20_000)
    word = lambda: "".join(draw.choice("etaoinshrdluéñ漢") for _ in range(draw.randint(1, 30)))
    texts = [" ".join(word() for _ in range(300)) for _ in range(100)]
    texts[3:3] = [None, "", "a" * 500, " ".join(word() for _ in range(30_000)), *plain.HARD]
    assert list(fresh.encode_all(texts)) == [library.encode_ordinary(t or "") for t in texts]
    assert len(fresh.machine.walks) < 20_000
    assert len(fresh.machine.pairs) < 20_000


def test_walks_agree_with_states(encoder):
    draw = random.Random(8)
    pieces = ["".join(draw.choice(PARTS) for _ in range(5)).encode()[:bpe.SHORT] for _ in range(3000)]
    pieces = [p for p in pieces if p]
    assert [list(ids) for ids in encoder.machine.encode_side_by_side(pieces)] == [encoder.machine.encode(p) for p in pieces]
    assert encoder.machine.encode_side_by_side([]) == []


def test_fixed_map():
    given = {k * k: k for k in range(0, 3000, 3)}
    keys = range(0, 100_000)
    assert bpe.FixedMap(given).get(np.array(keys)).tolist() == [given.get(k, -1) for k in keys]
    assert bpe.FixedMap({}).get(np.array([0, 5])).tolist() == [-1, -1]


def test_pair_rule_is_merging(encoder):
    machine, draw = encoder.machine, random.Random(5)
    tokens = [t for t in machine.tokens if len(machine.tokens[t]) < 12]
    for _ in range(3000):
        a, b = draw.choice(tokens[:3000]), draw.choice(tokens[:3000])
        merged = machine._merge(machine.tokens[a] + machine.tokens[b])
        assert machine._may_follow(a, b) == (merged == [machine.tokens[a], machine.tokens[b]])


def test_stream_holds_unfinished_characters():
    raw = "aé漢\U0001f600z".encode()
    for cut in range(len(raw) + 1):
        s = bpe.Utf8Stream()
        first = s.feed(raw[:cut])
        assert "�" not in first
        assert first + s.feed(raw[cut:]) + s.finish() == "aé漢\U0001f600z"


def test_stream_marks_what_is_no_text():
    draw = random.Random(6)
    for _ in range(3000):
        raw = bytes(draw.choice([0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC0, 0xC3, 0xE0, 0xE2, 0xED, 0xF0, 0xF4, 0xFF]) for _ in range(8))
        s, out = bpe.Utf8Stream(), ""
        for i in range(8):
            out += s.feed(raw[i:i + 1])
        assert out + s.finish() == raw.decode("utf-8", "replace")


def test_query(spark, library):
    import __spark_entry__ as entry

    got = {r.doc_id: r for r in entry.queries()["op8_byte_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text)
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_table_round_trip(spark):
    rows = [(None if i == 3 else i % 5, t, i) for i, t in enumerate(plain.HARD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "ids"]
    back = bpe.decode_column(out, PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for t in plain.HARD)
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(nothing, PATH, public_tokenizers.PATTERN).collect() == []
    assert bpe.digests(nothing, PATH, public_tokenizers.PATTERN).collect() == []
