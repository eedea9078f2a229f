import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from glyphray.llm import components, ngram_join, store
from tests.llm import plain


def roots_of(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows):
    sets = [plain.shingles(t) for _, t in rows]
    by = defaultdict(list)
    for d, s in enumerate(sets):
        for x in s:
            by[x].append(d)
    close = {p for ds in by.values() for p in itertools.combinations(ds, 2)} if len(rows) < 3000 else None
    links = [(a, b) for a, b in close if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots_of(len(rows), links)
    least = {}
    for d, r in enumerate(root):
        if rows[d][0] is not None:
            least[r] = min(least.get(r, rows[d][0]), rows[d][0])
    return sorted(((rows[d][0], len(sets[d]), least.get(root[d])) for d in range(len(rows))), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(5)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.component_ids(df).collect()), key=repr)


def test_all_documents(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = entry.queries()["op5_ngram_jaccard_join"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def _copies(seed):
    """Groups of edited copies of texts of many sizes, chains, shared passages, short texts."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randint(0, 400)}"
    rows = []
    passage = [word() for _ in range(60)]
    for size in [1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 22, 30, 60, 150, 400]:
        base = [word() for _ in range(size)]
        for _ in range(7):
            text = list(base)
            for _ in range(draw.randint(0, max(1, size // 25))):
                kind, at = draw.random(), draw.randrange(len(text))
                if kind < 0.4:
                    text[at] = word()
                elif kind < 0.7 and len(text) > 1:
                    del text[at]
                else:
                    text.insert(at, word())
            rows.append(" ".join(text))
    for _ in range(25):
        rows.append(" ".join([word() for _ in range(draw.randint(0, 80))] + passage))
    chain = [word() for _ in range(100)]
    for i in range(10):  # each like the next only
        rows.append(" ".join(chain))
        chain = chain[4:] + [word() for _ in range(4)]
    rows += [rows[3].upper(), rows[3], " " + rows[40] + " ", "", None, "  ", "\x1c"]
    draw.shuffle(rows)
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)]


def test_against_brute_force(spark):
    rows = _copies(1)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("change", [
    {"MOST_SMALL": 0, "SPREAD": 1, "OFTEN": 1}, {"boundary": lambda h, x: 16, "SPREAD": 2, "OFTEN": 2},
    {"boundary": lambda h, x: 10, "FREQUENT": 10, "FILTER_BITS": 6},
])
def test_no_setting_changes_the_result(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = _copies(3)
    assert run(spark, rows) == brute(rows)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(None, text), (7, text + " b"), (7, text), (7, text), (None, "only null"), (None, "only null"), (None, None), (2, "")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]


def test_group_of_copies_takes_few_comparisons(spark, monkeypatch):
    base = [f"w{i}" for i in range(150)]
    draw = random.Random(5)
    rows = [(0, " ".join(base))]
    for d in range(1, 300):
        text = list(base)
        for _ in range(draw.randint(1, 2)):
            text[draw.randrange(150)] = f"x{d}-{draw.random()}"
        rows.append((d, " ".join(text)))
    compared = []
    whole = ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda docs, pairs: (compared.append(pairs.count()), whole(docs, pairs))[1])
    assert run(spark, rows) == brute(rows)
    assert sum(compared) < 3 * len(rows)


def test_needed_and_front():
    for a in range(1, 60):
        for b in range(a, 5 * a // 4 + 1):
            o = ngram_join.needed(a, b)
            assert 100 * o >= 80 * (a + b - o) and not 100 * (o - 1) >= 80 * (a + b - o + 1)
            assert a - o < ngram_join.front(a) and b - o < ngram_join.front(b)


def test_boundary_follows_cost():
    assert ngram_join.boundary({5: 1000, 8: 10}, 100.0) >= 5
    assert ngram_join.boundary({}, 1.0) == 0
    assert ngram_join.boundary({16: 1000}, 0.0) < 16


def test_components_of_random_graphs(spark):
    draw = random.Random(7)
    for n, m in ((30, 25), (60, 30), (40, 0)):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]
        edges += [(i, i + 1) for i in range(n, n + 33)]  # a long chain
        root = roots_of(n + 40, edges)
        got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
        touched = {x for a, b in edges if a != b for x in (a, b)}
        assert {(r.node, r.root) for r in got} == {(x, root[x]) for x in touched}
        assert len(got) == len(touched)
    assert np.isfinite(len(got))


def test_pairs_come_once_and_long_lists_lose_none(spark, monkeypatch):
    """Two families that differ by a quarter, where every class of one shares most of its lists with all of the other."""
    draw = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for family in range(4):
        own = list(base)
        for at in draw.sample(range(200), 6):
            own[at] = f"f{family}-{at}"
        for d in range(12):
            text = list(own)
            for at in draw.sample(range(200), draw.randint(0, 5)):
                text[at] = f"x{family}-{d}-{at}"
            rows.append((family * 100 + d, " ".join(text)))
    draw.shuffle(rows)
    for early in (8, 1):
        monkeypatch.setattr(ngram_join, "EARLY", early)
        assert run(spark, rows) == brute(rows)


def test_tables_of_a_join_are_removed(spark, tmp_path, monkeypatch):
    made = itertools.count()
    monkeypatch.setattr(store, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}-{next(made)}")
    assert run(spark, _copies(2)[:60])
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert left == {"join-survey", "join-roots", "join-rooted", "join-named", "join-answer"} and next(made) > 20


def test_limit_of_a_table_that_goes_to_tasks(spark):
    from glyphray.llm.store import count_limit

    counts = spark.createDataFrame([(n,) for n in [9_000] * 5 + [20_000, 70_000, 3, 3, 8_191, 8_192]], "n long")
    at_least = lambda limit: counts.filter(counts.n >= limit).count()
    for most, reach in ((100, 11), (8, 8), (9, 9), (2, 2), (1, 1)):
        assert at_least(count_limit(counts, "n", most)) == reach
    assert count_limit(spark.createDataFrame([(1 << 40,)] * 3, "n long"), "n", 2) is None
    assert count_limit(counts.limit(0), "n", 2) is None
