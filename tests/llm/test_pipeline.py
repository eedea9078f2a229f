import hashlib
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from glyphray.llm import bpe, langid
from tests.llm import plain
from tests.llm.test_mixing import plain_mix
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.01"


def test_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = langid.predict(docs, langid.train(docs)).collect()  # held to account by its own tests
    rows = [r for r in labels if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    last = {}
    for r in rows:
        key = r.text.translate(plain.LOWER)
        if key not in last or r.doc_id > last[key].doc_id:
            last[key] = r
    unique = list(last.values())
    keep = {c for _, _, c in brute([(r.doc_id, r.text) for r in unique])}
    near = [r for r in unique if r.doc_id in keep]
    taken = plain_mix([(r.doc_id, r.source, len(plain.words(r.text))) for r in near])
    library = tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
    )
    wanted = Counter()
    for r in near:
        if taken[r.doc_id]:
            ids = library.encode_ordinary(r.text)
            wanted[r.doc_id, tuple(ids), hashlib.sha256(r.text.encode()).hexdigest()] += taken[r.doc_id]
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in got) == wanted
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert 0 < len(near) < len(unique) < len(labels)


def test_hard_rows_go_through_every_stage(spark):
    rows = [(i if i else None, t, "en" if i % 2 else None, None if i % 3 else f"s{i}", 0, "x") for i, t in enumerate(plain.HARD)]
    rows += [(5, "five words are in this", "en", "a", 1, "y")] * 2 + [(5, "another five words are here", "en", "a", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for docs_in in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs_in, SF)
            assert out.columns == docs.columns
            assert out.collect() is not None
        assert corpus_pipeline.STAGES[-1][1](spark, docs_in, SF).count() == docs_in.count()


def test_near_copies_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, 1), (None, text + " x", 2), (4, "", 3), (4, None, 4), (4, "alone here now too yes", 5), (4, "alone here now too yes", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class int")
    kept = corpus_pipeline.near(spark, docs, SF).collect()
    assert len(kept) == 4 and sum(r.doc_id is None for r in kept) == 1
