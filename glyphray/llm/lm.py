"""Probability of texts under a unigram model of subwords, summed over all segmentations, and a plain word model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphray.llm import textops
from glyphray.llm.store import count_limit, stored

SPACE = "▁".encode()
# Words up to so many bytes (with the mark of a word's start) go through the lattice together; longer ones alone.
TOGETHER = 64
# Texts of about this many bytes share one table of words inside a task.
BLOCK = 8 << 20
# Most entries of the table of frequent words that every task gets; the counts of all other words come by a join.
FREQUENT = 1 << 20
SMOOTHING = 0.1
CAPITAL = re.compile(rb"[A-Z]")
LOG10 = float(np.log(10))


@dataclass
class Pieces:
    """A vocabulary: pieces as bytes, where the 256 byte pieces and the end are, natural log probabilities."""

    texts: list[bytes]
    byte: np.ndarray
    end: int
    logp: np.ndarray


def load_pieces(path: str) -> Pieces:
    """Read a sentencepiece file. Its scores order the pieces; their ranks weigh them by Zipf's law to begin with."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    texts, byte = [], np.zeros(256, np.int64)
    for i in range(count):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(piece[3:5], 16)] = i
        texts.append(b"" if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) else piece.encode())
    scores = np.array([model.get_score(i) for i in range(count)])
    rank = np.empty(count)
    rank[np.argsort(-scores, kind="stable")] = np.arange(count)
    weight = 1 / (rank + 3)
    return Pieces(texts, byte, model.eos_id(), np.log(weight / weight.sum()))


class Lattice:
    """All segmentations of words into pieces: forward sums, and expected counts of pieces, for many words at once."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.longest = max((len(t) for t in pieces.texts if len(t) <= TOGETHER), default=1)
        # texts are lower-cased, so pieces with capitals can't occur
        self.ids = {t: i for i, t in enumerate(pieces.texts) if t and not CAPITAL.search(t)}
        # a table of hashes; the few that share a slot with another are looked up by bisection
        texts = list(self.ids)
        ends = np.cumsum([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        keys = _hash(_sums(data), ends - [len(t) for t in texts], ends)
        at = (keys >> np.uint64(44)).astype(np.int64)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[at] = np.arange(len(texts))
        self.keys, self.numbers = keys, np.array(list(self.ids.values()))
        spilled = np.flatnonzero(self.slot[at] != np.arange(len(texts)))
        spilled = spilled[np.argsort(keys[spilled])]
        self.spilled, self.spilled_numbers = keys[spilled], self.numbers[spilled]
        self.crowded = np.zeros(1 << 20, bool)
        self.crowded[at[spilled]] = True

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose hash is that of a piece, and the piece."""
        at = (keys >> np.uint64(44)).astype(np.int64)
        entry = self.slot[at]
        hit = np.flatnonzero((entry >= 0) & (self.keys[entry] == keys))
        found, numbers = hit, self.numbers[entry[hit]]
        crowded = np.flatnonzero(self.crowded[at])
        if len(crowded):
            place = np.minimum(np.searchsorted(self.spilled, keys[crowded]), len(self.spilled) - 1)
            right = self.spilled[place] == keys[crowded]
            found = np.concatenate([found, crowded[right]])
            numbers = np.concatenate([numbers, self.spilled_numbers[place[right]]])
        return found, numbers

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray | None = None):
        """Log probability of every word ``data[start:end]``; with ``weights``, also the expected counts of pieces."""
        out = np.empty(len(starts))
        expected = None if weights is None else np.zeros(len(self.pieces.texts))
        length = ends - starts + len(SPACE)
        for w in np.flatnonzero(length > TOGETHER).tolist():
            out[w] = self._alone(data[starts[w]:ends[w]].tobytes(), expected, weights[w] if weights is not None else 0)
        together = np.flatnonzero(length <= TOGETHER)
        together = together[np.argsort(-length[together], kind="stable")]
        for a in range(0, len(together), 20_000):
            w = together[a:a + 20_000]
            out[w] = self._many(data, starts[w], length[w], expected, weights[w] if weights is not None else None)
        return out if weights is None else (out, expected)

    def _many(self, data, starts, length, expected, weights):
        """Words of falling length, one column for each byte position."""
        n, most, logp = len(starts), int(length[0]), self.pieces.logp
        grid = np.zeros((most, n), np.uint8)
        grid[:len(SPACE)] = np.frombuffer(SPACE, np.uint8)[:, None]
        live = [int(np.searchsorted(-length, -j, "right")) for j in range(most + 1)]
        for j in range(len(SPACE), most):
            grid[j, :live[j + 1]] = data[starts[:live[j + 1]] + (j - len(SPACE))]
        power, inverse = textops.powers(TOGETHER + 1)
        sums = np.zeros((most + 1, n), np.uint64)
        np.cumsum(textops.BYTES[grid] * power[:most, None], axis=0, out=sums[1:])
        forward = np.full((most + 1, n), -np.inf)
        forward[0] = 0
        arcs = []
        for j in range(1, most + 1):
            m = live[j]
            number = self.pieces.byte[grid[j - 1, :m]]
            forward[j, :m] = forward[j - 1, :m] + logp[number]
            if expected is not None:
                arcs.append((j - 1, j, slice(0, m), number))
            for i in range(max(0, j - self.longest), j):
                found, number = self._find(textops.mix((sums[j, :m] - sums[i, :m]) * inverse[i]))
                if len(found):
                    forward[j, found] = np.logaddexp(forward[j, found], forward[i, found] + logp[number])
                    if expected is not None:
                        arcs.append((i, j, found, number))
        total = forward[length, np.arange(n)]
        if expected is not None:
            backward = np.full((most + 1, n), -np.inf)
            backward[length, np.arange(n)] = 0
            for i, j, found, number in reversed(arcs):
                step = backward[j, found] + logp[number]
                backward[i, found] = np.logaddexp(backward[i, found], step)
                share = np.exp(forward[i, found] + step - total[found]) * weights[found]
                np.add(expected, np.bincount(number, share, len(expected)), out=expected)
        return total

    def _alone(self, word: bytes, expected, weight) -> float:
        """One long word, position by position."""
        text, logp = SPACE + word, self.pieces.logp
        forward, arcs = np.full(len(text) + 1, -np.inf), []
        forward[0] = 0
        for j in range(1, len(text) + 1):
            best = [(j - 1, int(self.pieces.byte[text[j - 1]]))]
            for i in range(max(0, j - self.longest), j):
                number = self.ids.get(text[i:j])
                if number is not None:
                    best.append((i, number))
            forward[j] = np.logaddexp.reduce([forward[i] + logp[number] for i, number in best])
            if expected is not None:
                arcs.append(best)
        if expected is not None:
            backward = np.full(len(text) + 1, -np.inf)
            backward[-1] = 0
            for j in range(len(text), 0, -1):
                for i, number in arcs[j - 1]:
                    step = backward[j] + logp[number]
                    backward[i] = np.logaddexp(backward[i], step)
                    expected[number] += weight * np.exp(forward[i] + step - forward[-1])
        return float(forward[-1])


def _sums(data: np.ndarray) -> np.ndarray:
    power, _ = textops.powers(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(textops.BYTES[data] * power[:len(data)])])


def _hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = textops.powers(len(sums))
    return textops.mix((sums[ends] - sums[starts]) * inverse[starts])


def _blocks(column: pa.Array):
    """For runs of texts: bytes in lower case, distinct words (hash, span), word of each occurrence, first by text."""
    data, offsets = textops.buffers(column)
    for i, j in textops.runs_of_texts(offsets, BLOCK):
        piece = textops.LOWER[data[offsets[i]:offsets[j]]]
        starts, ends, first = textops.words(piece, offsets[i:j + 1] - offsets[i])
        hashes, where, which = np.unique(
            textops.hash_spans(piece, starts, ends), return_index=True, return_inverse=True
        )
        yield i, j, piece, hashes, starts[where], ends[where], which, first


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, word, c``: how often each word occurs; the empty word is the end of a text. Combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, piece, hashes, starts, ends, which, _ in _blocks(batch.column("text")):
                counts = np.bincount(which, minlength=len(hashes))
                words = _spans(piece, starts, ends)
                for a in range(0, len(hashes), 50_000):
                    b = a + 50_000
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[a:b].view(np.int64)), words.slice(a, 50_000), pa.array(counts[a:b])], ["h", "word", "c"]
                    )
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([""]), pa.array([j - i])], ["h", "word", "c"])

    rows = docs.select("text").mapInArrow(run, "h long, word string, c long")
    return rows.groupBy("h", "word").agg(F.sum("c").alias("c"))


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings."""
    length = ends - starts
    at = np.concatenate([[0], np.cumsum(length)])
    index = np.arange(at[-1]) + np.repeat(starts - at[:-1], length)
    return pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[index])]
    ).cast(pa.string())


def train(counts: DataFrame, pieces: Pieces, rounds: int = 1) -> Pieces:
    """Piece probabilities from word counts by expectation maximisation.

    Every round sums the expected counts of pieces over all distinct words, weighted by their counts; each task sends
    at most one number for each piece of the vocabulary.
    """
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(pieces)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(shared.value), np.zeros(len(shared.value.texts))
            for batch in batches:
                data, offsets = textops.buffers(batch.column("word"))
                weights = batch.column("c").to_numpy(zero_copy_only=False).astype(np.float64)
                ended = np.diff(offsets) == 0
                total[shared.value.end] += weights[ended].sum()
                words = np.flatnonzero(~ended)
                total += lattice.run(data, offsets[words], offsets[words + 1], weights[words])[1]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "n"])

        sums = counts.select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        expected = np.full(len(pieces.texts), SMOOTHING)
        for row in sums.collect():
            expected[row.piece] += row.n
        pieces = Pieces(pieces.texts, pieces.byte, pieces.end, np.log(expected / expected.sum()))
    return pieces


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Hashes (sorted) and counts of the most frequent words, at most ``most``, and the least count among them (None: no words)."""
    limit = count_limit(counts, "c", most)
    known = counts.filter("word != ''")
    rows = (known.filter(F.col("c") >= limit) if limit is not None else known.limit(0)).select("h", "c").toArrow()
    hashes = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows.column("c").to_numpy()[order], limit


def score(docs: DataFrame, learn: Column, path: str, rounds: int = 1, frequent: int = FREQUENT) -> DataFrame:
    """Log10 probabilities of all texts: ``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score``.

    Both models learn from the rows where ``learn`` is true. Texts are lower-cased in A-Z; tokens are words and one end;
    null text is empty. ``score``: each word, marked by a word start, is the sum over all its segmentations into pieces
    of the vocabulary at ``path`` (single bytes included, so that every word has some), and an end follows.
    ``base_score``: add-one smoothed word counts.

    Words are counted by one aggregation. Texts are read once more: each task scores its distinct words, and gets the
    counts of the most frequent ones (at most ``frequent``) as a table. All rarer occurrences are joined with the counts
    by word hash (64 bits) and summed by document. Documents need no unique id.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learned"))
    counts = stored(word_counts(rows.filter("learned")), "lm-counts")
    size = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
        F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0)).alias("ends"),
    ).first()
    pieces = train(counts, load_pieces(path), rounds)
    hashes, known, limit = _frequent(counts, frequent)
    shared = spark.sparkContext.broadcast((pieces, hashes, known))
    log_ends = float(np.log10(size.ends + 1))
    per_token = float(np.log10(size.n + size.v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, hashes, known = shared.value
        lattice, row = Lattice(pieces), TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, data, own, starts, ends, which, first in _blocks(batch.column("text")):
                total = lattice.run(data, starts, ends)
                at = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
                seen = (hashes[at] == own) if len(hashes) else np.zeros(len(own), bool)
                count = np.where(seen, known[at], 0) if len(hashes) else np.zeros(len(own), np.int64)
                sums = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[which])])[first])  # noqa: E731, B023
                rare = ~seen[which]
                cuts = np.concatenate([[0], np.cumsum(rare)])[first]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + j - i)), part.column("doc_id"), part.column("learned"),
                        pa.array(np.diff(first) + 1), pa.array(sums(seen.astype(np.int64)) + (1 if log_ends > 0 else 0)),
                        pa.array(sums(np.log10(count + 1.0)) + log_ends),
                        pa.array((sums(total) + pieces.logp[pieces.end]) / LOG10),
                        pa.LargeListArray.from_arrays(cuts, pa.array(own[which[rare]].view(np.int64))).cast(pa.list_(pa.int64())),
                    ],
                    names,
                )
                row += j - i

    names = ["row", "doc_id", "learned", "n_tokens", "n_known", "base", "score", "rare"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = stored(
        rows.mapInArrow(run, f"row long, doc_id {kind}, learned boolean, n_tokens long, n_known long, base double, "
                             "score double, rare array<long>"),
        "lm-texts",
    )
    # words of the frequent table are known already: what is left to join are the rarer ones
    rest = counts.filter(F.lit(limit is None) | (F.col("c") < F.lit(limit))).filter("word != ''").select("h", "c")
    more = (
        texts.select("row", F.explode("rare").alias("h")).join(rest, "h")
        .groupBy("row").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more"))
    )
    return texts.drop("rare").join(more, "row", "left").select(
        "doc_id", "learned", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(size.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"), "score",
    )
