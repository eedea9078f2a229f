import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphray.llm import lm, textops
from tests.llm import plain

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lattice():
    return lm.Lattice(lm.load_pieces(PATH))


def _ways(text, table):
    """Every segmentation, as lists of piece numbers."""
    if not text:
        return [[]]
    out = []
    for n in range(1, len(text) + 1):
        for number in table.get(text[:n], ()):
            out += [[number, *rest] for rest in _ways(text[n:], table)]
    return out


def _table(pieces):
    table = {}
    for i, t in enumerate(pieces.texts):
        if t:
            table.setdefault(t, []).append(i)
    for b in range(256):
        table.setdefault(bytes([b]), []).append(int(pieces.byte[b]))
    return table


def _run(lattice, words, weights=None):
    data, offsets = textops.buffers(pa.array(words))
    return lattice.run(data, offsets[:-1], offsets[1:], weights)


def test_sums_over_all_segmentations(lattice, monkeypatch):
    words = ["a", "the", "thing", "xyz", "é", "漢字", "q!", "een", "zürich"]
    table, logp = _table(lattice.pieces), lattice.pieces.logp
    weights = np.arange(1.0, len(words) + 1)
    expected = np.zeros(len(logp))
    truth = []
    for word, weight in zip(words, weights, strict=True):
        ways = _ways(lm.SPACE + word.encode(), table)
        values = np.array([sum(logp[i] for i in way) for way in ways])
        truth.append(np.logaddexp.reduce(values))
        for way, value in zip(ways, values, strict=True):
            for i in way:
                expected[i] += weight * math.exp(value - truth[-1])
    for limit in (lm.TOGETHER, 0):  # all at once, and each alone
        monkeypatch.setattr(lm, "TOGETHER", limit)
        got, counts = _run(lattice, words, weights)
        assert np.allclose(got, truth) and np.allclose(counts, expected)
        assert np.allclose(_run(lattice, words), truth)


def test_long_words_agree_both_ways(lattice, monkeypatch):
    words = ["abc" * n for n in range(1, 21)]
    together = _run(lattice, words)
    monkeypatch.setattr(lm, "TOGETHER", 0)
    assert np.allclose(together, _run(lattice, words))


def test_every_piece_is_found(lattice):
    data, offsets = textops.buffers(pa.array([t.decode() for t in lattice.ids]))
    keys = lm._hash(lm._sums(data), offsets[:-1], offsets[1:])
    found, numbers = lattice._find(keys)
    order = np.argsort(found)
    assert found[order].tolist() == list(range(len(keys)))
    assert numbers[order].tolist() == list(lattice.ids.values())


def _base(rows, learned):
    counts = Counter()
    for (_, text), use in zip(rows, learned, strict=True):
        if use:
            counts.update([*plain.words(text), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for _, text in rows:
        tokens = [*plain.words(text), None]
        out.append((len(tokens), sum(t in counts for t in tokens), n,
                    sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)))
    return out


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 50, 0])
def test_scores_of_all_documents(spark, frequent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rem = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7
    got = {r.doc_id: r for r in lm.score(docs, rem != 2, PATH, frequent=frequent).collect()}
    learned = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    for (i, _), use, (tokens, known, n, base) in zip(rows, learned, _base(rows, learned), strict=True):
        r = got[i]
        assert (r.learned, r.n_tokens, r.n_known, r.train_tokens) == (use, tokens, known, n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.score < 0


def test_score_is_the_sum_over_words(spark):
    rows = [(1, "the cat sat on the mat"), (2, "A dog ate the cat"), (3, "zebra")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, F.col("doc_id") < 3, PATH).collect()}
    counts = Counter(w for _, t in rows[:2] for w in plain.words(t))
    first = lm.load_pieces(PATH)
    words = list(counts)
    _, expected = _run(lm.Lattice(first), words, np.array([float(counts[w]) for w in words]))
    expected[first.end] += 2
    p = (expected + lm.SMOOTHING) / (expected + lm.SMOOTHING).sum()
    table = _table(first)
    for i, text in rows:
        total = math.log10(p[first.end])
        for word in plain.words(text):
            ways = _ways(lm.SPACE + word.encode(), {k: v for k, v in table.items() if k in lm.SPACE + word.encode()})
            total += math.log10(sum(math.prod(p[n] for n in way) for way in ways))
        assert abs(got[i].score - total) < 1e-8


def test_trained_model_beats_the_untrained(spark):
    import __spark_entry__ as entry

    got = entry.queries()["op9_lm_scoring"](spark, SF).collect()
    fresh = lm.Lattice(lm.load_pieces(PATH))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert held and len(got) == len(docs)
    before = sum(_run(fresh, plain.words(docs[r.doc_id])).sum() / lm.LOG10 for r in held)
    assert sum(r.score for r in held) > before


def test_hard_rows(spark):
    rows = [(i if i else None, t, 1.0) for i, t in enumerate(plain.HARD)] + [(3, plain.HARD[3], 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = lm.score(df, F.col("doc_id") % 2 == 0, PATH).collect()
    learned = [i is not None and i % 2 == 0 for i, _, _ in rows]
    truth = _base([(i, t) for i, t, _ in rows], learned)
    mine = sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert mine == sorted((a, b, c, round(d, 6)) for a, b, c, d in truth)
    assert lm.score(df.limit(0), F.lit(True), PATH).collect() == []
    none = lm.score(df, F.lit(False), PATH).collect()
    assert len(none) == len(rows) and {r.base_score for r in none} == {0.0}


def test_a_top_step_that_overflows_gives_no_table(spark):
    counts = spark.createDataFrame([(i, f"w{i}", 20_000) for i in range(9)] + [(50, "", 30_000)], "h long, word string, c long")
    assert len(lm._frequent(counts, 5)[0]) == 0
    assert len(lm._frequent(counts, 10)[0]) == 9
    docs = spark.createDataFrame([(i, "a b a c") for i in range(6)], "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [sorted(map(tuple, lm.score(docs, F.lit(True), path, frequent=n).collect())) for n in (0, 1 << 20)]
    assert [r[:5] for r in rows[0]] == [r[:5] for r in rows[1]]
    assert [r[5] for r in rows[0]] == pytest.approx([r[5] for r in rows[1]])
