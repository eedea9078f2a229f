import numpy as np
import pytest

from glyphray.llm import langid, textops
from tests.llm import plain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 2 = 0"))


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op2_language_id"](spark, SF).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert 0.15 < len(held) / len(got) < 0.35
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 7):
        scores = rng.normal(0, 3, (n, 3))
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        value = lambda p: scores[np.arange(n), p].sum() - 2.5 * (np.diff(p) != 0).sum()
        assert np.isclose(value(langid.viterbi(scores, 2.5)), max(value(p) for p in paths))


def test_shortcut_gives_the_same_value():
    rng = np.random.default_rng(1)
    lengths = [0, 1, 50, 0, 3, 200, 1, 0]
    first = np.concatenate([[0], np.cumsum(lengths)])
    for spread in (1, 4, 12):
        scores = rng.normal(0, spread, (first[-1], 4)) + rng.normal(0, 1, 4) * 2
        labels = langid._labels(scores, first, 6.0)
        for a, b in zip(first, first[1:]):
            if a < b:
                value = lambda p: scores[np.arange(a, b), p].sum() - 6 * (np.diff(p) != 0).sum()  # noqa: E731, B023
                assert np.isclose(value(labels[a:b]), value(langid.viterbi(scores[a:b], 6.0)))


def test_scripts():
    text = "abc Ωμέγα Привет 漢字 かな 한국 ไทย עברית «quoted» \U00020000x"
    data, offsets = textops.buffers(__import__("pyarrow").array([text]))
    w = langid._words(data, offsets)
    assert [langid.SCRIPTS[s] for s in w.scripts] == [
        "Latin", "Greek", "Cyrillic", "Han", "Kana", "Hangul", "Thai", "Hebrew", "", "Han"]


def test_scripts_narrow_candidates(spark):
    rows = [(i, "the cat sat on the mat with a hat", "en") for i in range(5)] + [(i, "кошка сидела на окне и спала", "ru") for i in range(5, 10)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(1, "zzz qqq xxx"), (2, "ъыъ"), (3, "the cat sat on the mat, кошка сидела на окне и спала долго очень")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), m).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "ru" and got[3].lang_pred == "ru"
    assert [s.lang for s in got[3].spans] == ["en", "ru"]
    assert texts[2][1][got[3].spans[1].start:].startswith("кошка")


def test_mixed_text(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars between 1500 and 3000 and doc_id % 2 = 1").collect()}
    text = docs["en"] + " " + docs["de"]
    got = langid.predict(spark.createDataFrame([(text,)], "text string"), model).first()
    assert {s.lang for s in got.spans} >= {"en", "de"}
    assert got.spans[0].start == 0 and got.spans[-1].end == len(text)
    assert all(a.end == b.start for a, b in zip(got.spans, got.spans[1:]))


def test_hard_rows(spark, model):
    texts = [*plain.HARD, "123 456", "***", "漢字", "«»", "the of and " * 400_000]
    df = spark.createDataFrame([(i if i else None, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = langid.predict(df, model).collect()
    assert len(got) == len(texts)
    for r in got:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has_letter)
        assert r.lang_pred in (*model.langs, "und")
        if has_letter:
            assert r.spans[0].start == 0 and r.spans[-1].end == len(r.text)
    assert langid.predict(df.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark):
    none = langid.train(spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame([("abc",)], "text string"), none).first()
    assert got.lang_pred == "und" and got.score == 0


def test_sample_bound(spark):
    rows = spark.createDataFrame([(i, f"word{i} the", "en" if i % 2 else "de") for i in range(2000)], "doc_id long, text string, lang string")
    assert langid.train(rows, max_training=100).langs == ["de", "en"]


def test_memory_follows_the_run_not_the_batch():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    m = langid.Model(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.ones((len(langid.SCRIPTS), 2), bool))
    data, offsets = textops.buffers(pa.array(["some words of a text " * 100] * 1500))
    tracemalloc.start()
    for i, j in textops.runs_of_texts(offsets, langid.RUN):
        langid._predict(m, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], 1e9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
