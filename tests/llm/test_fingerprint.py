import hashlib

import numpy as np
import pyarrow as pa
import pytest

from glyphray.llm import fingerprint, textops
from tests.llm import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("piece", [16, 1 << 21])
def test_shingle_sets_have_the_sizes_of_word_sets(monkeypatch, piece):
    monkeypatch.setattr(textops, "PIECE", piece)
    monkeypatch.setattr(textops, "_powers", None)
    seen = {}
    for i, j, values, offsets in textops.shingle_sets(pa.array(plain.HARD, pa.string())):
        for d in range(i, j):
            seen[d] = values[offsets[d - i]:offsets[d - i + 1]]
    sets = [plain.shingles(t) for t in plain.HARD]
    assert [len(seen[d]) for d in range(len(sets))] == [len(s) for s in sets]
    for a, s in enumerate(sets):
        for b, t in enumerate(sets):
            assert len(np.intersect1d(seen[a], seen[b])) == len(s & t)


def test_empty_column():
    assert list(textops.shingle_sets(pa.array([], pa.string()))) == []
    assert fingerprint.signatures(pa.array([], pa.string())).shape == (0, fingerprint.PERMUTATIONS)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    for part in (20, 60, 120):
        other = base[:-part] + [f"v{i}" for i in range(part)]
        texts = [" ".join(base), " ".join(other)]
        a, b = fingerprint.signatures(pa.array(texts), 512)
        true = plain.jaccard(plain.shingles(texts[0]), plain.shingles(texts[1]))
        assert abs((a == b).mean() - true) < 0.08


def _expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", ["1", "3", "8"])
def test_edits_follow_descending_ids(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = [(i * 7 % 31, t) for i, t in enumerate(plain.HARD)] + [(None, "no id here"), (5, "tie one"), (5, "tie two"), (5, "tie two")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, part int, head string").repartition(4)
    got = fingerprint.compare_with_edits(df).collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == _expected(rows)
    same = {r.fingerprint for r in got if r.n_chars == 7}
    assert len(same) == 2  # "tie one", "tie two"


def test_edits_of_few_rows(spark):
    kind = "doc_id long, text string"
    assert fingerprint.compare_with_edits(spark.createDataFrame([], kind)).collect() == []
    one = fingerprint.compare_with_edits(spark.createDataFrame([(3, "abcdef")], kind)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    nulls = fingerprint.compare_with_edits(spark.createDataFrame([(None, "b"), (None, None)], kind)).collect()
    assert len(nulls) == 2


def test_query_on_all_documents(spark):
    import __spark_entry__ as entry

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op10_fingerprints"](spark, SF).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == _expected(list(docs.items()))
    ids = sorted(docs, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    off = []
    for r in got:
        a, b = plain.shingles(docs[r.doc_id]), plain.shingles(docs[after[r.doc_id]])
        cut = len(docs[r.doc_id]) // 3
        c = plain.shingles(docs[r.doc_id][:len(docs[r.doc_id]) - cut] + docs[after[r.doc_id]][:cut])
        off += [r.near_next - plain.jaccard(a, b), r.near_edited - plain.jaccard(a, c)]
        assert (docs[r.doc_id] == docs[after[r.doc_id]]) <= (r.near_next == 1)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_near_duplicates_by_bands(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    texts = [" ".join(base[:300 - i] + [f"x{i}-{j}" for j in range(i)]) for i in range(8)]
    texts += [" ".join(f"y{i}-{j}" for j in range(100)) for i in range(20)] + [None, "", "   "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = fingerprint.near_duplicates(df).collect()
    assert {r.doc_id for r in links} == set(range(1, 8)) and {r.other_id for r in links} <= set(range(8))
    for r in links:
        assert abs(r.jaccard - plain.jaccard(plain.shingles(texts[r.doc_id]), plain.shingles(texts[r.other_id]))) < 1e-12
    a, b = (fingerprint.fingerprints(df).filter(f"doc_id = {i}").first().fingerprint for i in (0, 1))
    both = spark.createDataFrame([(a, b)], "a string, b string")
    assert both.select(fingerprint.likeness("a", "b")).first()[0] > 0.8


def test_near_duplicates_below_an_unlike_head(spark):
    def family(seed):
        base = [f"w{i}" for i in np.random.default_rng(seed).integers(0, 5000, 300)]
        edit = lambda at, size, to: [*base[:at], *[f"{to}{j}" for j in range(size)], *base[at + size:]]
        return [" ".join(w) for w in (edit(10, 45, "h"), base, edit(200, 5, "b"), base, edit(100, 45, "c"))]

    # one permutation, one band: a seed where all share the one bucket, whose head is unlike the others
    texts = next(t for t in map(family, range(100)) if len(np.unique(fingerprint.signatures(pa.array(t), 1))) == 1)
    alike = {
        (i, j) for i in range(5) for j in range(i)
        if plain.jaccard(plain.shingles(texts[i]), plain.shingles(texts[j])) >= 0.8
    }
    assert alike == {(2, 1), (3, 1), (3, 2)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = {(r.doc_id, r.other_id) for r in fingerprint.near_duplicates(df, bands=1, n=1).collect()}
    assert links <= alike and len(links) >= 2 and {i for pair in links for i in pair} == {1, 2, 3}
