"""MinHash fingerprints over word shingles, near duplicates by joined signature bands, and a sequence test for them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphray.llm import textops
from glyphray.llm.components import components
from glyphray.llm.store import shuffle_partitions, stored

PERMUTATIONS = 128
_ROWS = 1024


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets: ``a * x + b`` modulo 2^32 permutes the 32-bit numbers."""
    draws = textops.stream(7, 2 * n)
    return (draws[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (draws[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(column: pa.Array, n: int = PERMUTATIONS) -> np.ndarray:
    """Per text the low 16 bits of the smallest image of its shingles under each permutation; 0xFFFF for no shingle."""
    factor, shift = permutations(n)
    out = np.full((len(column), n), 0xFFFFFFFF, np.uint32)
    for i, _, values, offsets in textops.shingle_sets(column):
        x = (values >> np.uint64(32)).astype(np.uint32)
        for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), i):
            for at in range(a, b, _ROWS):
                images = x[at:min(b, at + _ROWS), None] * factor + shift
                np.minimum(out[d], images.min(axis=0), out=out[d])
    return (out & np.uint32(0xFFFF)).astype(">u2")


def _hex(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature]


def fingerprints(docs: DataFrame, n: int = PERMUTATIONS) -> DataFrame:
    """``doc_id`` and ``fingerprint``: ``n`` permutations, 4 hex digits each. One pass, no shuffle.

    Texts with equal words have equal fingerprints; null counts as empty, and a text without words has only ``f``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _hex(signatures(batch.column("text"), n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def likeness(a: Column, b: Column, n: int = PERMUTATIONS) -> Column:
    """Share of permutations in which two fingerprints agree: an estimate of the Jaccard similarity."""
    at = F.sequence(F.lit(0), F.lit(n - 1))
    same = F.filter(at, lambda i: F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)))
    return F.size(same) / F.lit(float(n))


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = len(batch)
        both = pa.concat_arrays([batch.column("text").cast(pa.large_string()), batch.column("other_text").cast(pa.large_string())])
        sets = {}
        for i, j, values, offsets in textops.shingle_sets(both):
            for d in range(i, j):
                sets[d] = values[offsets[d - i]:offsets[d - i + 1]]
        scores = []
        for d in range(n):
            common = len(np.intersect1d(sets[d], sets[d + n], assume_unique=True))
            union = len(sets[d]) + len(sets[d + n]) - common
            scores.append(common / union if union else 0.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("other_id"), pa.array(scores, pa.float64())], ["doc_id", "other_id", "jaccard"]
        )


def _verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``doc_id, other_id``) whose true similarity reaches ``threshold``, with it as ``jaccard``."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = text.select(F.col("doc_id").alias("other_id"), F.col("text").alias("other_text"))
    return (
        pairs.join(text, "doc_id").join(other, "other_id").select("doc_id", "other_id", "text", "other_text")
        .mapInArrow(_jaccard, "doc_id long, other_id long, jaccard double")
        .filter(F.col("jaccard") >= threshold)
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 32, n: int = PERMUTATIONS) -> DataFrame:
    """Links of documents to a document with a smaller id that looks alike: ``doc_id, other_id, jaccard``.

    Signatures are cut into ``bands``; documents that agree on a whole band share a bucket. Every document is compared
    with the smallest id of each of its buckets and of its fingerprint; then all documents that share a bucket but are not
    in one component of the links so far are compared, where one document stands for those of equal fingerprint and
    words. The links whose true Jaccard similarity reaches ``threshold`` stay: their components are those of all pairs
    that share a bucket. Documents without words or id are linked with nothing.
    """
    width = 4 * n // bands
    prints = stored(
        fingerprints(docs, n).filter(F.col("doc_id").isNotNull() & (F.col("fingerprint") != "f" * 4 * n)), "fingerprints"
    )
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(
        i.alias("band"), F.substring("fingerprint", i * width + 1, F.lit(width)).alias("part")))
    keyed = prints.select("doc_id", F.inline(cut))
    heads = stored(keyed.groupBy("band", "part").agg(F.min("doc_id").alias("other_id"), F.max("doc_id").alias("last"))
                   .filter("other_id < last").drop("last"), "fingerprint-heads")
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("other_id"))
    twins = stored(prints.join(first, "fingerprint").filter("other_id < doc_id"), "fingerprint-twins")
    pairs = stored(
        keyed.join(heads, ["band", "part"]).filter("other_id < doc_id").select("doc_id", "other_id")
        .union(twins.select("doc_id", "other_id")).distinct(), "fingerprint-pairs"
    )
    links = stored(_verified(docs, pairs, threshold), "fingerprint-links")
    return links.union(_verified(docs, _remaining_pairs(prints, cut, twins, pairs, links), threshold))


def _remaining_pairs(prints: DataFrame, cut: Column, twins: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs that share a bucket, are in different components of ``links`` and not among ``pairs``."""
    same = twins.join(links.filter("jaccard = 1").select("doc_id", "other_id").distinct(), ["doc_id", "other_id"])
    rest = prints.join(same.select("doc_id", "fingerprint"), ["doc_id", "fingerprint"], "left_anti")
    roots = components(links.select(F.col("doc_id").alias("a"), F.col("other_id").alias("b"))).withColumnRenamed("node", "doc_id")
    tagged = stored(
        rest.join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"), F.inline(cut)),
        "fingerprint-tagged",
    )
    mixed = tagged.groupBy("band", "part").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    live = stored(tagged.join(mixed.select("band", "part"), ["band", "part"], "left_semi"), "fingerprint-live")
    of = lambda i: live.select("band", "part", *[F.col(c).alias(f"{c}{i}") for c in ("doc_id", "root")])
    found = of(1).join(of(2), ["band", "part"]).filter("root1 < root2").select(
        F.greatest("doc_id1", "doc_id2").alias("doc_id"), F.least("doc_id1", "doc_id2").alias("other_id")
    )
    return stored(found.distinct().join(pairs, ["doc_id", "other_id"], "left_anti"), "fingerprint-rest")


# --- every document against an edited copy of itself and its successor --------------------------


def _slot(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are below ``value``, by binary search."""
    if not bounds:
        return F.lit(0)
    limits = F.lit(bounds)
    steps = F.lit([1 << i for i in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda lo, s: F.when(
        (lo + s <= len(bounds)) & (F.get(limits, lo + s - 1) < value), lo + s).otherwise(lo))
    return F.coalesce(found, F.lit(0))


def _with_successor(docs: DataFrame) -> DataFrame:
    """Rows in ranges of ``doc_id``, each range followed by a copy of the next range's first row (``guest``).

    The range limits are quantiles of the ids, a few numbers for each shuffle partition. A range's first id and its
    predecessor range are one row for each range; only that table is broadcast.
    """
    parts = 2 * shuffle_partitions(docs.sparkSession)
    wanted = [i / parts for i in range(1, parts)]
    limits = docs.agg(F.percentile_approx("doc_id", wanted, 10 * parts)).first()[0] or []
    placed = docs.select("doc_id", "text").withColumn("part", _slot(F.col("doc_id"), sorted(set(limits))))
    downwards = Window.orderBy(F.col("part").desc())
    everything = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = placed.groupBy("part").agg(F.max("doc_id").alias("head")).select(
        "part", "head", F.coalesce(F.lag("part").over(downwards), F.last("part").over(everything)).alias("before")
    )
    place = lambda part, guest: F.struct(part.alias("part"), F.lit(guest).alias("guest"))
    places = F.when(
        F.col("doc_id").eqNullSafe(F.col("head")), F.array(place(F.col("part"), False), place(F.col("before"), True))
    ).otherwise(F.array(place(F.col("part"), False)))
    return (
        placed.join(F.broadcast(heads), "part").select("doc_id", "text", F.inline(places))
        .repartition(parts, "part")
        .sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    )


def compare_with_edits(docs: DataFrame, n: int = PERMUTATIONS) -> DataFrame:
    """Fingerprints of every text, of an edited copy, and how alike they and the next document are.

    In the edited copy the last third of the code points gives way to as many from the start of the next document in
    descending ``doc_id`` (after the last: the first). Null text is empty; rows without id come last; rows with equal id
    are ordered by text, descending. The text is shuffled once, into ranges of ids that are sorted and read as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = pa.Table.from_batches([batch.slice(at, 1000)])
                part = pa.concat_tables([held, part]) if held is not None else part
                held = part.slice(len(part) - 1)
                if len(part) > 1:
                    yield from rows(part)

    def rows(part: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in part.column("text").to_pylist()]
        guest = np.array(part.column("guest").to_pylist())
        edited = []
        for text, following in zip(texts, texts[1:], strict=False):
            cut = len(text) // 3
            edited.append(text[:len(text) - cut] + following[:cut])
        mine = signatures(pa.array(texts, pa.string()), n)
        theirs = signatures(pa.array(edited, pa.string()), n)
        own = ~guest[:-1]
        columns = [
            part.column("doc_id").combine_chunks().slice(0, len(edited)),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(_hex(mine[:-1]), pa.string()), pa.array(_hex(theirs), pa.string()),
            pa.array((mine[:-1] == theirs).mean(axis=1)), pa.array((mine[:-1] == mine[1:]).mean(axis=1)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(own))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), "long", "string", "string", "string", "double", "double"]
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds, strict=True))
    return _with_successor(docs).mapInArrow(run, schema)
