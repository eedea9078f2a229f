"""Language of texts and of the spans in mixed texts: scripts narrow the candidates, Viterbi labels the words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphray.llm import textops

UNKNOWN = "und"
BUCKETS = 1 << 16
# Documents that the model is fitted on at most, on average; they are drawn by a hash of their id.
MAX_TRAINING = 40_000
# What one change of language costs, in natural log units of likelihood.
SWITCH = 12.0
# A language is a candidate for a script that makes up at least this share of its words.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.3
# Bytes of texts that are looked at together: every one of them takes about 50 bytes of arrays meanwhile.
RUN = 1 << 17

# First code points of ranges and the script that starts there ("" is no script in particular).
SCRIPT_RANGES = (
    (0x0000, ""), (0x0041, "Latin"), (0x005B, ""), (0x0061, "Latin"), (0x007B, ""), (0x00C0, "Latin"),
    (0x0250, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""), (0x3040, "Kana"), (0x3100, ""),
    (0x3130, "Hangul"), (0x3190, ""), (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"), (0xA000, ""),
    (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFEFF, ""), (0xFF21, "Latin"), (0xFF3B, ""),
    (0xFF41, "Latin"), (0xFF5B, ""), (0x20000, "Han"), (0x32000, ""),
)
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_RANGE_STARTS = np.array([start for start, _ in SCRIPT_RANGES])
_RANGE_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])

# letters keep their byte, in lower case; bytes of other scripts count as letters; all else is a gap
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Log probabilities of hashed letter triples (buckets x languages), and which scripts each language uses."""

    langs: list[str]
    table: np.ndarray
    candidates: np.ndarray


@dataclass
class Words:
    """The words of a run of texts: bytes with one gap after each text, spans, first word of each text, triples, scripts."""

    plain: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    codes: np.ndarray
    scripts: np.ndarray
    shift: np.ndarray


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    count = len(offsets) - 1
    plain = np.full(len(data) + count, 0x20, np.uint8)
    plain[np.arange(len(data)) + np.repeat(np.arange(count), np.diff(offsets))] = _PLAIN[data]
    bounds = offsets + np.arange(count + 1)
    inside = plain != 0x20
    before = np.concatenate([[False], inside[:-1]])
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    one = np.concatenate([np.full(1, 0x20, np.uint8), plain[:-1]]).astype(np.uint32)
    two = np.concatenate([np.full(1, 0x20, np.uint32), one[:-1]])
    two[one == 0x20] = 0x20
    codes = ((two * np.uint32(0x9E3779B1)) ^ (one * np.uint32(0x85EBCA77)) ^ (plain * np.uint32(0xC2B2AE3D)))
    codes = (codes * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    return Words(plain, starts, ends, np.searchsorted(starts, bounds), codes, _scripts(plain, starts), bounds)


def _scripts(plain: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script of each word's first character."""
    at = [plain[np.minimum(starts + i, len(plain) - 1)].astype(np.int64) if len(plain) else starts for i in range(4)]
    low = [a & 0x3F for a in at]
    point = np.select(
        [at[0] < 0x80, at[0] < 0xE0, at[0] < 0xF0],
        [at[0], (at[0] & 0x1F) << 6 | low[1], (at[0] & 0x0F) << 12 | low[1] << 6 | low[2]],
        (at[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3],
    )
    return _RANGE_SCRIPT[np.searchsorted(_RANGE_STARTS, point, "right") - 1]


def train(labelled: DataFrame, max_training: int = MAX_TRAINING) -> Model:
    """Fit the model on ``doc_id, text, lang``; rows without text or lang don't count.

    On average at most ``max_training`` rows are used, drawn by a hash of ``doc_id`` and text. Counts of letter triples
    and of scripts are summed in Spark; the model has a fixed number of buckets for each language.
    """
    rows = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    total = rows.count()
    if total > max_training:
        drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(max_training / total * (1 << 30))
        rows = rows.filter(drawn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            data, offsets = textops.buffers(batch.column("text"))
            for i, j in textops.runs_of_texts(offsets, RUN):
                w = _words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                used = w.plain != 0x20
                used[w.ends] = True
                for d in range(i, j):
                    a, b = w.shift[d - i], w.shift[d - i + 1]
                    if names[d] not in sums:
                        sums[names[d]] = np.zeros(BUCKETS + len(SCRIPTS), np.int64)
                    sums[names[d]][:BUCKETS] += np.bincount(w.codes[a:b][used[a:b]], minlength=BUCKETS)
                    spoken = w.scripts[w.first[d - i]:w.first[d - i + 1]]
                    sums[names[d]][BUCKETS:] += np.bincount(spoken, minlength=len(SCRIPTS))
        for name, values in sums.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(values[at])], ["lang", "at", "n"]
            )

    counted = rows.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    parts = counted.groupBy("lang").agg(F.collect_list(F.struct("at", "n")).alias("c")).orderBy("lang").collect()
    langs = [p.lang for p in parts]
    sums = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    for k, p in enumerate(parts):
        for at, n in p.c:
            sums[at, k] = n
    triples, scripts = sums[:BUCKETS], sums[BUCKETS:]
    table = np.log((triples + SMOOTHING) / (triples.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    shares = scripts / np.maximum(scripts.sum(axis=0), 1)
    candidates = shares >= SCRIPT_SHARE
    candidates[SCRIPTS.index("")] = True
    candidates[~candidates.any(axis=1)] = True
    return Model(langs, table, candidates)


def word_scores(model: Model, w: Words) -> np.ndarray:
    """Words x languages: log likelihood of each word's triples; what its script rules out is far below."""
    out = np.empty((len(w.starts), len(model.langs)))
    for k in range(len(model.langs)):
        sums = np.concatenate([[0.0], np.cumsum(model.table[w.codes, k], dtype=np.float64)])
        out[:, k] = sums[w.ends + 1] - sums[w.starts]
    return np.where(model.candidates[w.scripts], out, out.min(axis=1, keepdims=True, initial=0) - 50)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word when a change of label costs ``switch``."""
    count, k = scores.shape
    best, back = scores[0].copy(), np.zeros((count, k), np.int32)
    same = np.arange(k)
    for t in range(1, count):
        top = int(best.argmax())
        moved = best < best[top] - switch
        back[t] = np.where(moved, top, same)
        best = np.where(moved, best[top] - switch, best) + scores[t]
    labels = np.empty(count, np.int32)
    labels[-1] = best.argmax()
    for t in range(count - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def _labels(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi labels of all texts of a run.

    Where no stretch of words gains more than one change costs by leaving the text's best language, the best path
    stays in that language: that is seen from running sums, and only the other texts are walked word by word.
    """
    count = len(first) - 1
    owner = np.repeat(np.arange(count), np.diff(first))
    sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)])
    best = (sums[first[1:]] - sums[first[:-1]]).argmax(axis=1)
    labels = best[owner]
    if scores.shape[1] < 2 or not len(scores):
        return labels
    others = scores.copy()
    at = np.arange(len(scores))
    others[at, labels] = -np.inf
    gain = others.max(axis=1) - scores[at, labels]
    steep = 2 * np.abs(gain).sum() + 1
    running = np.cumsum(gain) - owner * steep
    ahead = np.concatenate([[0.0], running[:-1]])
    # a text starts from the sum before its first word, moved down to the text's own level
    starts = first[:-1][np.diff(first) > 0]
    ahead[starts] = running[starts] - gain[starts]
    stretch = running - np.minimum.accumulate(ahead)
    for d in np.unique(owner[stretch > switch]).tolist():
        labels[first[d]:first[d + 1]] = viterbi(scores[first[d]:first[d + 1]], switch)
    return labels


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans array<struct<start, end, lang>>``. One pass, no shuffle.

    ``lang_pred`` is the label of most letters, ``und`` for null or a text without a letter (score 0, no spans) or
    where nothing was learned. ``score`` is the mean probability, over letters, of that language given their word alone
    (0 to 1). Spans are in code points and cover the text; ties go to the language first in order. Only the text is
    looked at. Columns of these names are replaced, all others stay.
    """
    out = ("lang_pred", "score", "spans")
    docs = docs.drop(*out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = textops.buffers(batch.column("text"))
            for i, j in textops.runs_of_texts(offsets, RUN):
                part = batch.slice(i, j - i)
                preds, scores, spans = _predict(m, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], switch)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                    [*part.schema.names, *out],
                )

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    more = StructType.fromDDL("lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more.fields]))


def _predict(m: Model, data: np.ndarray, offsets: np.ndarray, switch: float):
    count = len(offsets) - 1
    preds, scores, spans = [UNKNOWN] * count, [0.0] * count, [[] for _ in range(count)]
    if not m.langs:
        return preds, scores, spans
    w = _words(data, offsets)
    likely = word_scores(m, w)
    labels = _labels(likely, w.first, switch)
    letters = (w.ends - w.starts).astype(np.float64)
    odds = np.exp(likely - likely.max(axis=1, keepdims=True, initial=-np.inf)) if len(likely) else likely
    odds = odds / odds.sum(axis=1, keepdims=True) if len(odds) else odds
    plain_ascii = np.concatenate([[0], np.cumsum((w.plain > 0x20) & (w.plain < 0x80))])
    for d in range(count):
        a, b = w.first[d], w.first[d + 1]
        if a == b:
            continue
        text = data[offsets[d]:offsets[d + 1]].tobytes()
        if plain_ascii[w.shift[d + 1]] == plain_ascii[w.shift[d]] and not _LETTER.search(text.decode()):
            continue
        own, share = labels[a:b], np.zeros(len(m.langs))
        np.add.at(share, own, letters[a:b])
        top = int(share.argmax())
        preds[d] = m.langs[top]
        scores[d] = float(min(1.0, (odds[a:b, top] * letters[a:b]).sum() / letters[a:b].sum()))
        turns = np.flatnonzero(np.diff(own)) + 1
        # a span ends where the next one's first word starts
        cuts = [0, *(int(w.starts[a + t]) - int(w.shift[d]) for t in turns), len(text)]
        points = [0]
        for x, y in zip(cuts, cuts[1:], strict=False):
            points.append(points[-1] + len(text[x:y].decode()))
        names = [own[0], *own[turns]]
        spans[d] = [
            {"start": x, "end": y, "lang": m.langs[n]} for x, y, n in zip(points, points[1:], names, strict=False)
        ]
    return preds, scores, spans
