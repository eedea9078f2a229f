"""Jaccard self-join of word shingle sets: subsets of small sets, inverted lists for large ones, and components.

Every document becomes the set of its 5-word shingles, as 64-bit hashes. Documents with equal sets are one class, named
by a 64-bit hash of the set. Two classes of sizes a <= b link when the Jaccard similarity is at least 4/5, which takes
``o = ceil(4 (a + b) / 9)`` common shingles. Both kinds of sets turn into keys such that linked sets share one:

* small sets: all subsets of the o shingles that a partner of each possible size needs;
* large sets (and small ones that a large one may match): the shingles that come first in one global order, as many as
  a set can have before its o-th last. Linked sets share one of these at places that leave room for o in common.

Where small ends is chosen by cost from the histogram of set sizes. The global order puts shingles that are frequent,
as far as counts inside batches of rows show, after all others. The order only steers cost, whatever it is the result is exact.

Lists are first cut down by a star: each class is compared with one other, the one that most often heads its lists (the
head has the fewest rare shingles of its own, like the original of a group of copies). What remains are pairs in one
list from different components; all of those that sizes and places allow are compared. A pair comes out of the list of
its first common shingle only, however many lists it shares. So copies of one text, however many, cost one comparison
each, and no link between different texts is lost.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glyphray.llm import textops
from glyphray.llm.components import components
from glyphray.llm.store import count_limit, scratch, shuffle_partitions, stored

# Small sets have at most so many shingles; beyond that subsets are too many to consider.
MOST_SMALL = 16
# Frequent shingles known to every task, at most.
FREQUENT = 1 << 18
# A shingle counts as frequent if so many different texts of one batch of rows have it.
OFTEN = 3
# Lists that may be longer than this are spread over tasks.
SPREAD = 20_000
# Bits of the filter for the texts that are to be compared.
FILTER_BITS = 23
# First lists of a class by which it is known whether a pair has met in an earlier list.
EARLY = 8
# Bytes of text whose sets are worked out together.
PIECE = 1 << 19
# Pairs with one class that are compared side by side.
CHUNK = 256
_SIZE_LIMIT = (1 << 22) - 1


def needed(a, b):
    """Common shingles that sets of sizes ``a`` and ``b`` need for a similarity of 4/5."""
    return (4 * (a + b) + 8) // 9


def front(n: int) -> int:
    """How many first shingles of a set of ``n`` go to lists: no partner leaves it fewer than ``ceil(0.8 n)`` common."""
    return n - -(-4 * n // 5) + 1


def _partners(n: int, most: int) -> range:
    return range(-(-4 * n // 5), min(5 * n // 4, most) + 1)


def subset_count(n: int, most: int) -> int:
    return sum(math.comb(n, needed(n, m)) for m in _partners(n, most) if needed(n, m) <= n)


def boundary(histogram: dict[int, int], list_length: float) -> int:
    """Largest size of small sets, for the least cost: one for each subset, one for each entry of a scanned list."""
    costs = []
    for x in range(MOST_SMALL + 1):
        cost = 0.0
        for n, sets in histogram.items():
            if n <= x:
                cost += sets * subset_count(n, x)
            if n > x or 5 * n >= 4 * (x + 1):
                cost += sets * front(n) * (1 + list_length)
        costs.append(cost)
    return int(np.argmin(costs))


def _class(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, j, values, offsets in textops.shingle_sets(batch.column("text"), limit=PIECE):
        for d in range(i, j):
            yield d, values[offsets[d - i]:offsets[d - i + 1]]


def _survey(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document's set size and class, and for each task the shingles that several of its documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, seen, gathered = [], [], set(), []
            for _, values in _sets(batch):
                name = _class(values) if len(values) else None
                sizes.append(len(values))
                names.append(name)
                if name is not None and name not in seen:
                    seen.add(name)
                    gathered.append(values.copy())
            blank = pa.nulls(len(batch), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), blank], columns
            )
            if gathered:
                tokens, counts = np.unique(np.concatenate(gathered), return_counts=True)
                often = np.flatnonzero(counts >= OFTEN)
                for at in range(0, len(often), 50_000):
                    w = often[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(w), batch.column("doc_id").type), pa.array(counts[w]), pa.nulls(len(w), pa.int64()),
                         pa.array(tokens[w].view(np.int64))], columns
                    )

    columns = ["doc_id", "n", "class", "shingle"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = stored(
        docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, class long, shingle long"), "join-survey"
    )
    return both.filter("shingle is null").drop("shingle"), both.filter("shingle is not null").select("shingle", "n")


def _frequent(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and their counts: as many steps of equal count as ``most`` rows have room for."""
    sums = stored(counted.groupBy("shingle").agg(F.sum("n").alias("n")), "join-frequent")
    limit = count_limit(sums, "n", most)
    rows = sums.filter(F.col("n") >= limit).toArrow() if limit is not None else sums.limit(0).toArrow()
    shingles = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows.column("n").to_numpy()[order].astype(np.int64)


def _subset_keys(values: np.ndarray, most: int) -> np.ndarray:
    """Hashes of the subsets of a small set, one kind for each size of a partner."""
    n, out = len(values), []
    for m in _partners(n, most):
        o = needed(n, m)
        if o <= n:
            chosen = np.array(list(itertools.combinations(range(n), o)), np.int64)
            kind = textops.stream(11, 1 + min(n, m) * 64 + max(n, m))[-1]
            total = np.full(len(chosen), kind, np.uint64)
            for t in range(o):
                total = textops.mix(total + values[chosen[:, t]])
            out.append(total)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _keys(docs: DataFrame, small: int, shingles: np.ndarray, counts: np.ndarray, buckets: int) -> DataFrame:
    """Keys of all classes, packed: one row holds what a batch has for a bucket of keys.

    A row's ``entries`` are 16 bytes each: 32 bits of the key, the class, and the set's size (22 bits) with the place of
    the key in 4096ths of it (10 bits). Keys of frequent shingles whose lists may be long are dealt by class instead, as
    whole keys (20 bytes an entry).
    """
    shared = docs.sparkSession.sparkContext.broadcast((shingles, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, often = shared.value
        for batch in batches:
            keys, names, metas, spread, seen = [], [], [], [], set()
            for _, values in _sets(batch):
                n = len(values)
                if not n or (name := _class(values)) in seen:
                    continue
                seen.add(name)
                if n <= small:
                    subsets = _subset_keys(values, small)
                    keys.append(subsets)
                    names.append(np.full(len(subsets), name, np.int64))
                    metas.append(np.full(len(subsets), n << 10, np.uint32))
                    spread.append(np.zeros(len(subsets), bool))
                    if 5 * n < 4 * (small + 1):
                        continue
                length = front(n)
                at = np.minimum(np.searchsorted(frequent, values), max(len(frequent) - 1, 0))
                count = np.where(frequent[at] == values, often[at], 0) if len(frequent) else np.zeros(n, np.int64)
                rare = np.flatnonzero(count == 0)[:length]
                if len(rare) < length:
                    known = np.flatnonzero(count)
                    rare = np.concatenate([rare, known[np.argsort(count[known], kind="stable")][:length - len(rare)]])
                keys.append(textops.mix(values[rare]))
                names.append(np.full(length, name, np.int64))
                place = np.minimum(np.arange(length) * 4096 // n, 1023).astype(np.uint32)
                metas.append(np.uint32(min(n, _SIZE_LIMIT) << 10) | place)
                spread.append(count[rare] >= SPREAD)
            if not keys:
                continue
            key, name, meta, wide = (np.concatenate(x) for x in (keys, names, metas, spread))
            bucket = np.where(wide, name.view(np.uint64), key >> np.uint64(32)) % np.uint64(buckets)
            group = bucket.astype(np.int64) * 2 + wide
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                w = order[a:b]
                own = _listed(key[w], buckets) if wide[w[0]] else key[w].astype(np.uint32)
                rows.append((int(bucket[w[0]]), bool(wide[w[0]]), own.tobytes(), name[w].tobytes(), meta[w].tobytes()))
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[at:at + 1000], strict=True), kinds, strict=True)], columns
                )

    kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    columns = ["bucket", "wide", "keys", "names", "metas"]
    return docs.select("doc_id", "text").mapInArrow(
        run, "bucket int, wide boolean, keys binary, names binary, metas binary"
    )


def _listed(key: np.ndarray, buckets: int) -> np.ndarray:
    """The key by which a list is known: bucket and 32 bits of the key."""
    return ((key >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (key & np.uint64(0xFFFFFFFF))


def _fits(n, place, m, other):
    """Whether a key at these places leaves room for enough common shingles (places are rounded down)."""
    o = needed(n, m)
    allowed = (n * place // 4096 <= n - o) & (m * other // 4096 <= m - o)
    return allowed | (n >= _SIZE_LIMIT) | (m >= _SIZE_LIMIT)


def _lists(packed: DataFrame, parts: int) -> DataFrame:
    """Lists with two classes or more: rows ``key, class, n, place``, and for each entry the head of its list.

    A partition holds all entries of its keys but those of wide keys, which pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, metas = [], [], []
        for batch in batches:
            for bucket, wide, key, name, meta in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                name, meta = np.frombuffer(name, np.int64), np.frombuffer(meta, np.uint32)
                if wide:
                    yield from rows(np.frombuffer(key, np.uint64), name, meta, np.zeros(len(name), np.int64), False)
                else:
                    keys.append(np.frombuffer(key, np.uint32) | np.uint64(bucket << 32))
                    names.append(name)
                    metas.append(meta)
        if not keys:
            return
        key, name, meta = (np.concatenate(x) for x in (keys, names, metas))
        keys, names, metas = [], [], []
        # keys that occur once are most; they go before anything is sorted by more
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        shared = same[1:] | same[:-1]
        order, key = order[shared], key[shared]
        name, meta = name[order], meta[order]
        order = np.lexsort((name, meta & np.uint32(1023), key))
        key, name, meta = key[order], name[order], meta[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, meta = key[fresh], name[fresh], meta[fresh]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        head = np.repeat(first, size)
        keep = np.repeat(size > 1, size)
        n, place = (meta >> np.uint32(10)).astype(np.int64), (meta & np.uint32(1023)).astype(np.int64)
        fits = _fits(n, place, n[head], place[head]) & (name != name[head])
        yield from rows(key[keep], name[keep], meta[keep], name[head][keep], fits[keep])

    def rows(key, name, meta, head, fits):
        n, place = (meta >> np.uint32(10)).astype(np.int32), (meta & np.uint32(1023)).astype(np.int32)
        fits = np.broadcast_to(fits, len(key))
        for a in range(0, len(key), 50_000):
            w = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[w].view(np.int64)), pa.array(name[w]), pa.array(n[w]), pa.array(place[w]),
                 pa.array(head[w], mask=~fits[w])], ["key", "class", "n", "place", "head"]
            )

    return packed.repartition(parts, "bucket").mapInArrow(run, "key long, class long, n int, place int, head long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, text`` of one document at least of each class in ``wanted``, and of some others.

    A filter of ``2^FILTER_BITS`` bits, the same at any size, keeps most other texts out.
    """
    low = F.col("class").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = wanted.select(low.alias("bit")).groupBy(F.floor(F.col("bit") / 32).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")
    ).toArrow()
    filled = np.zeros(1 << (FILTER_BITS - 5), np.uint64)
    filled[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            seen, names, at = set(), [], []
            for d, values in _sets(batch):
                if len(values) and (name := _class(values)) not in seen:
                    low = name & ((1 << FILTER_BITS) - 1)
                    if int(bits[low >> 5]) >> (low & 31) & 1:
                        seen.add(name)
                        names.append(name)
                        at.append(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), batch.column("text").take(pa.array(at, pa.int64()))], ["class", "text"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "class long, text string")


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (``a, b``) whose sets really are similar enough; their texts are fetched and compared.

    Pairs with one ``b`` lie side by side, in chunks of about ``CHUNK``: its text comes once for a chunk, ahead of the
    others. A hot ``b`` has many chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            yes, members, names = [], batch.column("member").to_pylist(), batch.column("class").to_pylist()
            for d, values in _sets(batch):
                if members[d]:
                    both = len(np.intersect1d(values, head, assume_unique=True))
                    if 100 * both >= 80 * (len(values) + len(head) - both):
                        yes.append(d)
                else:
                    head = values.copy()
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[d] for d in yes], pa.int64()), batch.column("b").take(pa.array(yes, pa.int64()))], ["a", "b"]
            )

    chunks = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = pairs.join(chunks, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).alias("chunk"))
    heads = dealt.select(F.col("b").alias("class"), "b", "chunk", F.lit(False).alias("member")).distinct()
    routes = stored(dealt.select(F.col("a").alias("class"), "b", "chunk", F.lit(True).alias("member")).union(heads), "join-routes")
    parts = shuffle_partitions(docs.sparkSession)
    return (
        _texts(docs, routes.select("class")).dropDuplicates(["class"]).join(routes, "class")
        .repartition(parts, "b", "chunk").sortWithinPartitions("b", "chunk", "member")
        .mapInArrow(run, "a long, b long")
    )


def _star_pairs(lists: DataFrame) -> DataFrame:
    """For each class the one that heads most of its lists."""
    wide = lists.filter("head is null")
    heads = wide.groupBy("key").agg(
        F.min(F.struct("place", "class", "n")).alias("h"), F.max(F.struct("place", "class", "n")).alias("last")
    ).filter("h < last").select("key", "h")
    fits = _sql_fits(F.col("n"), F.col("place"), F.col("h.n"), F.col("h.place")) & (F.col("class") != F.col("h.class"))
    more = wide.join(heads, "key").filter(fits).select("class", F.col("h.class").alias("head"))
    counted = (
        lists.filter("head is not null").select("class", "head").union(more)
        .groupBy("class", "head").agg(F.count(F.lit(1)).alias("c"))
    )
    return counted.groupBy("class").agg(F.max(F.struct("c", "head")).alias("m")).select(
        F.col("class").alias("a"), F.col("m.head").alias("b")
    )


def _sql_fits(n: Column, place: Column, m: Column, other: Column) -> Column:
    o = F.floor((4 * (n + m) + 8) / 9)
    room = (F.floor(n.cast("long") * place / 4096) <= n - o) & (F.floor(m.cast("long") * other / 4096) <= m - o)
    return room | (n >= _SIZE_LIMIT) | (m >= _SIZE_LIMIT)


def _remaining_pairs(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """All pairs that share a list and may be similar, but are not yet in one component.

    Lists that lie inside one component are left out, and lists of two are their pair. In longer lists pairs are made
    between components only, and only in the list of the first shingle, in the global order, that both have: that is
    known of two classes if one of their ``EARLY`` first lists is common. Where none is, and where places are rounded (sets
    of over 4096), the pair comes from every list it shares.
    """
    tagged = stored(
        lists.join(roots.withColumnRenamed("node", "class"), "class", "left")
        .select("key", "class", "n", "place", F.coalesce("root", "class").alias("root")), "join-tagged"
    )
    entry = F.struct("class", "n", "place")
    mixed = stored(
        tagged.groupBy("key").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("entries"),
            F.min(entry).alias("x"), F.max(entry).alias("y"),
        ).filter("lo < hi").select("key", "entries", "x", "y"), "join-mixed"
    )
    twos = mixed.filter("entries = 2").filter(
        _sql_fits(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"))
    ).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    longer = stored(tagged.join(mixed.filter("entries > 2").select("key"), "key", "left_semi"), "join-live")
    early = longer.groupBy("class").agg(F.collect_list(F.struct("place", "key")).alias("own")).select(
        "class", F.slice(F.sort_array("own"), 1, EARLY)["key"].alias("early")
    )
    live = stored(longer.join(early, "class"), "join-early")
    of = lambda i: live.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("class", "n", "place", "root", "early")])
    fits = _sql_fits(F.col("n1"), F.col("place1"), F.col("n2"), F.col("place2"))
    first = F.get(F.array_intersect("early1", "early2"), F.lit(0))
    once = F.coalesce(first == F.col("key"), F.lit(True)) | (F.greatest("n1", "n2") > 4096)
    pairs = (
        of(1).join(of(2), "key").filter((F.col("root1") < F.col("root2")) & fits & once)
        .select(F.least("class1", "class2").alias("a"), F.greatest("class1", "class2").alias("b"))
    )
    return twos.union(pairs).distinct()


def similar_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, class`` of every document (class null for an empty set), and ``node, root`` of linked classes."""
    spark = docs.sparkSession
    members, counted = _survey(docs)
    with scratch(spark):
        shingles, counts = _frequent(counted, FREQUENT)
        sizes = members.filter("class is not null").groupBy("class").agg(F.min("n").alias("n"))
        histogram = {r.n: r.sets for r in sizes.filter(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count(F.lit(1)).alias("sets")).collect()}
        total = members.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first().t
        typical = 1 + float((counts.astype(np.float64) ** 2).sum()) / max(total, 1)
        small = boundary(histogram, typical)
        parts = shuffle_partitions(spark)
        lists = stored(_lists(_keys(docs, small, shingles, counts, 8 * parts), parts), "join-lists")
        with scratch(spark):
            star = stored(_linked(docs, stored(_star_pairs(lists), "join-star")), "join-links", keep=True)
        roots = components(star)
        with scratch(spark):
            rest = stored(_remaining_pairs(lists, roots), "join-rest", keep=True)
        links = stored(_linked(docs, rest), "join-links")
        # the components so far stand for the links that made them
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)
        return members, stored(components(edges), "join-roots", keep=True)


def component_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``doc_id, text``; more columns are ignored.

    Links are similarities of at least 0.8 between sets of 5-word shingles (A-Z lower-cased; words are runs of anything
    but ASCII white space; with fewer words the whole sequence is the one shingle). ``component_id`` is the smallest
    ``doc_id`` that links lead to. A text without words, or null, has no shingles and is linked with nothing. Rows without
    id take part; a component whose rows all lack one has none. Repeated rows are answered each.
    """
    members, roots = similar_classes(docs)
    classes = members.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = stored(
        classes.join(roots.withColumnRenamed("node", "class"), "class", "left")
        .select("class", "least", F.coalesce("root", "class").alias("root")), "join-rooted"
    )
    named = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "join-named")
    answer = stored(rooted.join(named, "root").select("class", "component_id"), "join-answer")
    full = members.filter("class is not null").join(answer, "class").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    )
    empty = members.filter("class is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.union(empty)


def kept_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest ``doc_id``; all columns as they were.

    Of rows with that id the one whose class comes first stays, once. Where no row has an id, one row stays. Texts
    without words are linked with nothing and all stay.
    """
    members, roots = similar_classes(docs)
    rooted = members.filter("class is not null").join(roots.withColumnRenamed("node", "class"), "class", "left").select(
        "doc_id", "class", F.coalesce("root", "class").alias("root")
    )
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "class")
    key = lambda name: F.struct(F.col(name).alias("class"), "doc_id").alias("__key")
    keep = stored(
        rooted.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.class").alias("class"), F.col("o.doc_id").alias("doc_id"))
        .select(key("class")), "join-keep"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [_class(values) for _, values in _sets(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], [*batch.schema.names, "__class"])

    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    classed = docs.filter(worded).mapInArrow(run, StructType([*docs.schema.fields, StructField("__class", LongType())]))
    return (
        classed.select("*", key("__class")).join(keep, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
        .union(docs.filter(~worded))
    )
