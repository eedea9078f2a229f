"""Ranked lexical search: the best documents for every item, by branch and bound over tries of term vectors.

Of every document only the terms that some item has are kept, as term and number of occurrences (``tf``), with the
document's length. Terms are put in order of falling document frequency, so that vectors share their first terms, and the
vectors are dealt into ranges of that order: a task holds neighbouring paths of one trie over all documents, and works on
them in blocks. Below a node of the trie no document can score more for an item than the node's largest ``tf`` of
every term and its smallest length allow. A depth-first search leaves out what cannot reach an item's tenth best score so
far; it goes down for all items at once that the node may still serve.

All scores are 64-bit integers; see ``search``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphray.llm import textops
from glyphray.llm.store import shuffle_partitions, stored

# Entries (terms of items) that one pass over the documents serves, at most, unless a single item has more.
ENTRIES = 1 << 20
# Cells of the table of items by terms that a task holds for one group of items, unless a single item has more.
CELLS = 1 << 22
# Documents and entries of a block, and documents of a node that are scored rather than split.
BLOCK, BLOCK_ENTRIES, LEAF = 8192, 1 << 20, 24
# First terms of a vector by which documents are dealt.
HEAD = 8
_EXACT = 1 << 53

_BLANK = np.ones(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _BLANK[_a:_b + 1] = False


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts from ``i`` on: hashes of all terms (mixed with their lengths), and the index of every text's first."""
    data, offsets = textops.buffers(column)
    for i, j in textops.runs_of_texts(offsets):
        piece, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        starts, ends, first = textops.words(piece, at, _BLANK)
        yield i, textops.mix(textops.hash_spans(piece, starts, ends) + (ends - starts).astype(np.uint64)), first


def _lists(values: np.ndarray, owners: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """One list for each of ``n`` rows; ``owners`` is sorted."""
    offsets = np.searchsorted(owners, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _item_terms(items: DataFrame) -> DataFrame:
    """``item_no, item_id, terms, counts`` of every item with a term, written once so that the numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, hashes, first in _terms(batch.column("text")):
                n = len(first) - 1
                pair = np.empty(len(hashes), [("at", np.int64), ("term", np.uint64)])
                pair["at"], pair["term"] = np.repeat(np.arange(n), np.diff(first)), hashes
                found, counts = np.unique(pair, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").slice(i, n), _lists(found["term"].view(np.int64), found["at"], n, pa.int64()),
                     _lists(counts, found["at"], n, pa.int64())], ["item_id", "terms", "counts"]
                )

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<long>, counts array<long>")
    return stored(rows.filter("size(terms) > 0").select(F.monotonically_increasing_id().alias("item_no"), "*"), "lexical-items")


def _passes(items: DataFrame) -> list[DataFrame]:
    """Items in as few groups as bring every group of two items or more to ``ENTRIES`` entries at most."""
    total = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("t")).first().t
    count = -(-total // ENTRIES)
    while count > 1:
        turn = F.pmod(F.xxhash64("item_no"), F.lit(count))
        sizes = items.groupBy(turn.alias("turn")).agg(F.sum(F.size("terms")).alias("t"), F.count(F.lit(1)).alias("c"))
        if not sizes.filter((F.col("t") > ENTRIES) & (F.col("c") > 1)).limit(1).count():
            return [items.filter(turn == k) for k in range(count)]
        count *= 2
    return [items] if total else []


@dataclass
class Query:
    """Items of one pass: entry ``e`` says that item ``item[e]`` (its place in ``numbers``) has ``term[e]`` ``count[e]`` times."""

    numbers: np.ndarray
    vocabulary: np.ndarray
    item: np.ndarray
    term: np.ndarray
    count: np.ndarray


def _query(items: DataFrame) -> Query:
    rows = items.select("item_no", "terms", "counts").toArrow()
    numbers = rows.column("item_no").to_numpy()
    flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy()
    vocabulary, term = np.unique(flat("terms").view(np.uint64), return_inverse=True)
    sizes = pc.list_value_length(rows.column("terms")).to_numpy()
    return Query(numbers, vocabulary, np.repeat(np.arange(len(numbers)), sizes), term, flat("counts"))


def _vectors(docs: DataFrame, known: Broadcast) -> DataFrame:
    """Every document's number of terms ``n``, and the vocabulary's terms in it with their numbers of occurrences.

    ``slot`` numbers the rows of a task, so that equal rows can be dealt apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value
        maybe = np.zeros(1 << 20, bool)
        low = lambda h: (h & np.uint64((1 << 20) - 1)).astype(np.int64)
        maybe[low(vocabulary)] = True
        slot = 0
        for batch in batches:
            for i, hashes, first in _terms(batch.column("text")):
                n = len(first) - 1
                owner = np.repeat(np.arange(n), np.diff(first))
                near = maybe[low(hashes)]
                hashes, owner = hashes[near], owner[near]
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                same = vocabulary[at] == hashes
                keys, tf = np.unique(owner[same] * len(vocabulary) + at[same], return_counts=True)
                owner, term = np.divmod(keys, len(vocabulary))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), pa.array(np.diff(first), pa.int64()),
                     pa.array(np.arange(slot, slot + n), pa.int64()), _lists(term, owner, n, pa.int32()),
                     _lists(tf, owner, n, pa.int64())], ["doc_id", "n", "slot", "terms", "tfs"]
                )
                slot += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(
        docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, slot long, terms array<int>, tfs array<long>"),
        "lexical-vectors",
    )


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents every term of the vocabulary is; a task sends one row for each term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["term", "df"])

    found = vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return df


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _length_terms(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """``m`` of documents with ``n`` terms."""
    wide = n if 75 * n_docs * int(n.max(initial=0)) < 1 << 63 else n.astype(object)
    return (25 + 75 * wide * n_docs // total).astype(np.int64)


def _paths(vectors: DataFrame, place: Broadcast, n_docs: int, total: int) -> DataFrame:
    """Vectors with terms renamed to their places in the order of frequency and sorted by them, dealt by their first terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())
            owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            term = place.value[batch.column("terms").flatten().to_numpy()]
            order = np.lexsort((term, owner))
            term, tf = term[order], batch.column("tfs").flatten().to_numpy()[order]
            depth = np.arange(len(term)) - (ends - np.diff(ends, prepend=0))[owner]
            head = np.zeros((len(ends), HEAD), ">u4")
            early = depth < HEAD
            head[owner[early], depth[early]] = term[early] + 1
            m = _length_terms(batch.column("n").to_numpy(), n_docs, total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([h.tobytes() for h in head], pa.binary()), batch.column("slot"), pa.array(m),
                 _lists(term, owner, len(ends), pa.int32()), _lists(tf, owner, len(ends), pa.int64())],
                ["doc_id", "head", "slot", "m", "terms", "tfs"],
            )

    kind = vectors.schema["doc_id"].dataType.simpleString()
    parts = shuffle_partitions(vectors.sparkSession)
    return (
        vectors.filter("size(terms) > 0")
        .mapInArrow(run, f"doc_id {kind}, head binary, slot long, m long, terms array<int>, tfs array<long>")
        .repartitionByRange(parts, "head", "slot").sortWithinPartitions("head", "slot")
    )


# --- branch and bound over one block ------------------------------------------------------------


def contribution(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score: rises with ``tf``, falls with ``m``."""
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Trie:
    """A block's documents as a trie: a node is a range of documents that share their first terms.

    Ranges are split as the search reaches them; chains without branches are one node.
    """

    def __init__(self, first: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray):
        self.first, self.length, self.term, self.tf, self.m = first[:-1], np.diff(first), term, tf, m

    def at(self, docs: np.ndarray, depth: int) -> np.ndarray:
        """Term of every document at ``depth``; -1 where the vector has ended."""
        inside = self.length[docs] > depth
        return np.where(inside, self.term[np.where(inside, self.first[docs] + depth, 0)], -1)

    def children(self, docs: np.ndarray, depth: int) -> list[tuple[np.ndarray, int]]:
        """The parts of ``docs`` by the first term in which they differ, each with the depth below it; none if all are alike."""
        least = int(self.length[docs].min())
        while True:
            found = self.at(docs, depth)
            if (found != found[0]).any():
                order = np.argsort(found, kind="stable")
                cuts = np.flatnonzero(np.diff(found[order])) + 1
                return [(part, depth + 1) for part in np.split(docs[order], cuts)]
            if depth >= least:
                return []
            depth += 1

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of ``docs`` in order, and where each document's begin."""
        length = self.length[docs]
        begin = np.cumsum(length) - length
        return np.arange(int(length.sum())) + np.repeat(self.first[docs] - begin, length), begin


class Search:
    """The best documents of a block for a group of items, given scores that they must reach."""

    def __init__(self, trie: Trie, table: np.ndarray, weights: np.ndarray, ids: np.ndarray, best: np.ndarray):
        """``table`` has a row for each term and a column for each item; ``ids`` order documents with equal scores.

        ``best`` holds every item's highest scores so far, rising; it is kept up to date.
        """
        self.trie, self.table, self.weights, self.ids, self.best = trie, table, weights, ids, best
        self.largest = np.zeros(len(table), np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scored = 0

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, documents and scores: every document that may be among an item's best."""
        everything = np.arange(len(self.trie.m))
        stack = [(everything, 0, self.bound(everything, np.arange(self.table.shape[1])), np.arange(self.table.shape[1]))]
        while stack:
            docs, depth, bound, items = stack.pop()
            live = (bound > 0) & (bound >= self.best[items, 0])
            items = items[live]
            if not len(items):
                continue
            parts = self.trie.children(docs, depth) if len(docs) > LEAF else []
            if not parts:
                for at in range(0, len(docs), 4 * LEAF):
                    self.score(docs[at:at + 4 * LEAF], items)
                continue
            below = [(part, d, self.bound(part, items), items) for part, d in parts]
            # the most promising part comes off the stack first
            stack += sorted(below, key=lambda b: int((b[2] - self.best[items, 0]).max()))
        if not self.found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*self.found, strict=True))

    def bound(self, docs: np.ndarray, items: np.ndarray) -> np.ndarray:
        """No document of ``docs`` scores more for ``items``: largest tf of every term, smallest length."""
        places, _ = self.trie.entries(docs)
        terms, tf = self.trie.term[places], self.trie.tf[places]
        np.maximum.at(self.largest, terms, tf)
        at = np.flatnonzero(self.largest) if len(terms) > len(self.largest) else np.unique(terms)
        most = contribution(self.weights[at], self.largest[at], self.trie.m[docs].min())
        self.largest[at] = 0
        return most.astype(self.table.dtype) @ self.rows(at, items)

    def rows(self, terms: np.ndarray, items: np.ndarray) -> np.ndarray:
        return self.table[terms] if len(items) == self.table.shape[1] else self.table[np.ix_(terms, items)]

    def score(self, docs: np.ndarray, items: np.ndarray) -> None:
        """Exact scores of ``docs`` for ``items``; those that reach an item's best are noted."""
        places, begin = self.trie.entries(docs)
        terms = self.trie.term[places]
        m = np.repeat(self.trie.m[docs], self.trie.length[docs])
        gain = contribution(self.weights[terms], self.trie.tf[places], m).astype(self.table.dtype)
        scores = np.add.reduceat(self.rows(terms, items) * gain[:, None], begin, axis=0).astype(np.int64)
        self.scored += len(docs) * len(items)
        good = (scores > 0) & (scores >= self.best[items, 0])
        if good.any():
            doc, item = np.nonzero(good)
            self.found.append((items[item], docs[doc], scores[doc, item]))
            touched = np.flatnonzero(good.any(axis=0))
            both = np.concatenate([self.best[items[touched]], scores[:, touched].T], axis=1)
            self.best[items[touched]] = np.sort(both, axis=1)[:, -self.best.shape[1]:]


def _best_of_block(found: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, most: int) -> np.ndarray:
    """Of what a search has noted, the ``most`` best for each item: highest score, then lowest place among ids."""
    item, doc, score = found
    order = np.lexsort((ids[doc], -score, item))
    ordered = item[order]
    rank = np.arange(len(order)) - np.searchsorted(ordered, ordered)
    return order[rank < most]


def _searched(paths: DataFrame, query: Broadcast, order: Broadcast, most: int) -> DataFrame:
    """``item_no, doc_id, score``: from every block the best documents of every item."""

    def groups(query: Query, place: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items in groups with a table of terms by items each; other tables have no more than ``CELLS`` cells."""
        size = max(1, CELLS // max(len(place), 1))
        term = place[query.term]
        gains = np.bincount(query.item, query.count * weights[term].astype(np.float64) * 1e6, len(query.numbers))
        kind = np.float64 if gains.max(initial=0) < _EXACT else np.int64
        for at in range(0, len(query.numbers), size):
            own = (query.item >= at) & (query.item < at + size)
            items = np.arange(at, min(at + size, len(query.numbers)))
            table = np.zeros((len(place), len(items)), kind)
            table[term[own], query.item[own] - at] = query.count[own]
            yield items, table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, (place, weights) = query.value, order.value
        best = np.zeros((len(asked.numbers), most), np.int64)
        small = len(asked.numbers) * len(place) <= CELLS
        kept = list(groups(asked, place, weights)) if small else []
        for block in blocks(batches):
            length = pc.list_value_length(block.column("terms")).to_numpy()
            flat = lambda name, block=block: block.column(name).combine_chunks().flatten().to_numpy()
            trie = Trie(np.concatenate([[0], np.cumsum(length)]), flat("terms"), flat("tfs"), block.column("m").to_numpy())
            ids = np.empty(len(length), np.int64)
            ids[pc.sort_indices(block.column("doc_id"), null_placement="at_end").to_numpy()] = np.arange(len(length))
            for items, table in kept or groups(asked, place, weights):
                own = best[items]
                found = Search(trie, table, weights, ids, own).run()
                best[items] = own
                at = _best_of_block(found, ids, most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked.numbers[items[found[0][at]]]), block.column("doc_id").combine_chunks().take(pa.array(found[1][at])),
                     pa.array(found[2][at])], ["item_no", "doc_id", "score"]
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        waiting, rows, entries = [], 0, 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK // 8):
                part = batch.slice(at, BLOCK // 8)
                waiting.append(part)
                rows += len(part)
                entries += len(part.column("terms").flatten())
                if rows >= BLOCK or entries >= BLOCK_ENTRIES:
                    yield pa.Table.from_batches(waiting)
                    waiting, rows, entries = [], 0, 0
        if waiting:
            yield pa.Table.from_batches(waiting)

    kind = paths.schema["doc_id"].dataType.simpleString()
    return paths.select("doc_id", "m", "terms", "tfs").mapInArrow(run, f"item_no long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` best documents of every item: ``item_id, rank, doc_id, score``, scores above 0 only.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased, in whole texts. With N
    documents that have a term, L terms in them and df documents that hold a term, its weight is
    ``floor(1000 ln((2N + 2) / (2 df + 1)))``. A document of n terms has ``m = 25 + 75 n N div L``; a term that it holds tf
    times adds ``weight * (10^9 tf div (1000 tf + 8 m))`` for each time that the item has it. Equal scores are ranked by
    ``doc_id``, nulls last. Every document counts against every item; nothing is left out but what a bound excludes.

    Null and empty texts have no terms: such items have no rows, such documents are never found. Repeated rows of either
    table count and are answered each; null ids stay; more columns are ignored. A term is known by a 64-bit hash and
    its length. Items go in passes of at most ``ENTRIES`` terms of items, which bounds what is broadcast (a single longer
    item is a pass of its own); every pass reads the texts once and shuffles its vectors once.
    """
    spark = docs.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("item_id", items), ("doc_id", docs))}
    numbered = _item_terms(items)
    found = spark.createDataFrame([], f"item_no long, doc_id {kinds['doc_id']}, score long")
    for asked in _passes(numbered):
        query = _query(asked)
        vectors = _vectors(docs, spark.sparkContext.broadcast(query.vocabulary))
        total = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not total.terms:
            continue
        df = _frequencies(vectors, len(query.vocabulary))
        place = np.empty(len(df), np.int64)
        place[np.argsort(-df, kind="stable")] = np.arange(len(df))
        weights = np.empty(len(df), np.int64)
        weights[place] = [weight(total.docs, d) for d in df.tolist()]
        order = spark.sparkContext.broadcast((place, weights))
        paths = _paths(vectors, spark.sparkContext.broadcast(place), total.docs, total.terms)
        found = found.union(stored(_searched(paths, spark.sparkContext.broadcast(query), order, most), "lexical-found"))
    best = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
        .join(numbered.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
    )
