import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphray.llm import lexical
from tests.llm import plain

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(plain.LOWER))


def plain_search(docs, items, most=10):
    """Rows ``item_id, rank, doc_id, score``, sorted; documents and items are lists of id and text."""
    counted = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in counted), sum(len(t) for _, t in counted)
    df = Counter(t for _, ts in counted for t in set(ts))
    vectors = [(i, Counter(ts), 25 + 75 * len(ts) * n_docs // total) for i, ts in counted if ts]
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for i, tf, m in vectors:
            score = sum(
                c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                for t, c in asked.items() if t in tf
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored, key=lambda r: r[:3])[:most], 1)]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
            spark.createDataFrame(items, "item_id long, text string").repartition(2))


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 8, 30, 120])))) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 6, 20])))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize("leaf,block,cells", [(24, 8192, 1 << 22), (1, 64, 100), (3, 40, 1)])
def test_against_brute_force(spark, monkeypatch, leaf, block, cells):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "CELLS", cells)
    docs, items = corpus(leaf, 500)
    docs += [(1000 + k, docs[7][1]) for k in range(260)]  # a third are copies
    docs += [(2000 + k, docs[8][1] + f" w{k % 5}") for k in range(40)]
    assert found(lexical.search(*frames(spark, docs, items))) == plain_search(docs, items)


def test_hard_texts_nulls_ties_and_repeated_rows(spark):
    long_text = " ".join(f"t{k}" for k in range(40_000)) + " needle needle"
    texts = [*plain.HARD, "Needle", "needle\x00NEEDLE", "née été", "NÉE", "a-b_c", "1 2 3", "\x7f\x80x", long_text]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "needle five"), (None, "needle five"), (3, "needle five"), (3, "needle five")]
    items = [(1, "needle needle a"), (2, None), (3, ""), (4, "?! \n"), (5, "née É Ü 漢字"), (6, "absent"), (None, "five"), (None, "five"),
             (7, long_text), (1, "b")]
    assert found(lexical.search(*frames(spark, docs, items))) == plain_search(docs, items)


def test_several_passes(spark, monkeypatch):
    docs, items = corpus(9, 200)
    want = plain_search(docs, items)
    monkeypatch.setattr(lexical, "ENTRIES", 15)
    sizes = [p.agg(F.sum(F.size("terms")).alias("t"), F.count("*").alias("c")).first()
             for p in lexical._passes(lexical._item_terms(frames(spark, docs, items)[1]))]
    assert len(sizes) > 2 and all(s.t is None or s.t <= 15 or s.c == 1 for s in sizes)
    assert found(lexical.search(*frames(spark, docs, items[:4]))) == plain_search(docs, items[:4])
    assert want


def test_empty_tables_and_clashing_columns(spark):
    docs, items = [(1, "a b"), (2, "b")], [(1, "b")]
    columns = ["item_id long, rank int, doc_id long, score long"]
    for d, i in (([], items), (docs, []), ([], []), ([(1, None), (2, "?")], items), (docs, [(1, None)])):
        got = lexical.search(*frames(spark, d, i))
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == [], columns
    d, i = frames(spark, docs, items)
    extra = [F.lit(1).alias(c) for c in ("n", "m", "terms", "slot", "score", "rank")]
    got = lexical.search(d.select("*", *extra, F.lit(2).alias("item_id")), i.select("*", *extra, F.lit(2).alias("doc_id")))
    assert found(got) == plain_search(docs, items)


def test_bounds_leave_documents_out_and_hold(spark):
    """Fewer scores than documents times items are worked out, and no bound is below a score under its node."""
    docs, items = corpus(5, 3000, 400)
    names = sorted({t for _, text in docs for t in terms(text)})
    df = Counter(t for _, text in docs for t in set(terms(text)))
    place = {t: k for k, t in enumerate(sorted(names, key=lambda t: (-df[t], t)))}
    vectors = [sorted((place[t], c) for t, c in Counter(terms(text)).items()) for _, text in docs]
    first = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    term, tf = (np.array([e[k] for v in vectors for e in v], np.int64) for k in (0, 1))
    m = lexical._length_terms(np.array([len(terms(t)) for _, t in docs]), len(docs), sum(len(terms(t)) for _, t in docs))
    weights = np.array([lexical.weight(len(docs), df[t]) for t in place])
    table = np.zeros((len(place), len(items)))
    for k, (_, text) in enumerate(items):
        for t, c in Counter(terms(text)).items():
            if t in place:
                table[place[t], k] = c
    trie = lexical.Trie(first, term, tf, m)
    search = lexical.Search(trie, table, weights, np.arange(len(docs)), np.zeros((len(items), 10), np.int64))
    search.run()
    assert search.scored < 0.7 * len(docs) * len(items)
    for part, depth in trie.children(np.arange(len(docs)), 0):
        bound = search.bound(part, np.arange(len(items)))
        search.found = []
        search.best = np.zeros((len(items), 1), np.int64)
        search.score(part, np.arange(len(items)))
        assert (search.best[:, 0] <= bound).all() and depth == 1
