import hashlib
from collections import defaultdict

from glyphray.llm import exact_dedup
from glyphray.llm.store import shared_folder
from tests.llm import plain


def expected(rows):
    groups = defaultdict(list)
    digest = lambda t: hashlib.sha256((t or "").translate(plain.LOWER).encode()).digest()
    for i, t in rows:
        groups[digest(t)].append(i)
    out, used = [], set()
    for i, t in rows:
        d = digest(t)
        keep = max((x for x in groups[d] if x is not None), default=None)
        kept = i == keep and (i, d) not in used
        if kept:
            used.add((i, d))
        out.append((i, d, keep, len(groups[d]), kept))
    return sorted(out, key=repr)


ROWS = [(i, t) for i, t in enumerate(plain.HARD)] + [
    (70, "ÉA"), (71, "Éa"), (72, "éa"), (5, "Same"), (9, "sAME"), (9, "same"), (9, "same"), (None, "same"), (None, "alone"),
    (None, "ALONE"), (3, "other"), (3, "text"), (8, None), (90, ""),
]


def test_membership(spark):
    df = spark.createDataFrame([(i, t, "q") for i, t in ROWS], "doc_id long, text string, digest string").repartition(4)
    got = exact_dedup.membership(df).collect()
    assert sorted(((r.doc_id, bytes(r.digest), r.keep_id, r.group_size, r.kept) for r in got), key=repr) == expected(ROWS)
    assert exact_dedup.membership(df.limit(0)).collect() == []


def test_kept_rows(spark):
    df = spark.createDataFrame([(i, t, "q") for i, t in ROWS], "doc_id long, text string, keep_id string").repartition(4)
    out = exact_dedup.kept_rows(df)
    assert out.columns == df.columns
    wanted = [(i, d) for i, d, _, _, kept in expected(ROWS) if kept]
    got = [(r.doc_id, hashlib.sha256((r.text or "").translate(plain.LOWER).encode()).digest()) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_index_lasts_and_grows(spark):
    path = shared_folder(spark, "index-test")
    batch = lambda rows: exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    index = exact_dedup.DigestIndex(spark, path, 4)
    index.add(batch([(1, "a"), (2, "A"), (3, "b")]))
    assert sorted(r.keep_id for r in index.table().collect()) == [2, 3]
    again = exact_dedup.DigestIndex(spark, path, 4)  # another name for the same files
    again.add(batch([(9, "a"), (10, "c"), (11, "c")]))
    assert sorted(r.keep_id for r in again.table().collect()) == [2, 3, 11]
    again.add(batch([]))
    assert again.table().count() == 3
    again.drop()
    index.drop()


def test_new_data_is_not_joined_by_broadcast(spark):
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "index-test"), 4)
    new = exact_dedup.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = new.join(index.table().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    index.drop()
