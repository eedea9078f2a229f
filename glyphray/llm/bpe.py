"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

The nondeterministic machine walks the trie of the vocabulary from every position where a token may start. A token may
follow another only if BPE, run on the two tokens' bytes alone, gives back just these two; with that rule exactly one
way leads to each position, the one that BPE itself takes. A deterministic state is the set of walks that are still
open, each with the tokens it has not emitted; tokens on which all walks agree are emitted at once, so the machine lags
by at most the longest token. States and moves are made when first needed and kept up to a bound, then started afresh.

Most pieces are short words that occur once, and a state made for one of them is rarely met again. They go through the
nondeterministic machine many at a time: all their open walks, in flat arrays, take one byte in each step.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections import ChainMap
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

MAX_STATES = 150_000
MAX_PIECES = 250_000
NEVER = 1 << 60
LONG = 1 << 18
SHORT = 64  # pieces of at most so many bytes go side by side, about SIDE_BYTES at a time
SIDE_BYTES = 1 << 16
PAIR_SLOTS = 1 << 20

# Fixed value: the white space of Unicode, which the pattern's \s stands for.
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def compile_pattern(pattern: str) -> regex.Pattern:
    """The pattern that cuts text into pieces, with \\s as Unicode's white space property."""
    inside = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]")
    return regex.compile(inside.replace(r"\s", f"[{WHITE_SPACE}]"))


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: a token in base64 and its rank on each line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def _spread(keys: np.ndarray, slots: int) -> np.ndarray:
    """A place below ``slots``, a power of two, for each key."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


class FixedMap:
    """From numbers to numbers, both not negative, for many look-ups at once: open places in two arrays."""

    def __init__(self, given: dict[int, int]):
        keys, values = (np.fromiter(part, np.int64, len(given)) for part in (given.keys(), given.values()))
        self.slots = 1 << max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(self.slots, -1, np.int64), np.full(self.slots, -1, np.int32)
        at = _spread(keys, self.slots)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of keys that meet, the last one stays
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & (self.slots - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of all keys, -1 where there is none."""
        at = _spread(keys, self.slots)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        other = np.flatnonzero((found != keys) & (found >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (self.slots - 1)
            found = self.keys[at[other]]
            same = found == keys[other]
            out[other[same]] = self.values[at[other[same]]]
            other = other[~same & (found >= 0)]
        return out


class Transducer:
    """Encodes one piece of text at a time; equal to merging the pair of lowest rank again and again."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.max_states = max_states
        # the trie: node -> {byte: node}, and the token that ends at a node
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.halves: dict[int, tuple[int, int] | None] = {}
        for token, rank in ranks.items():
            parts = self._merge(token, 2)
            if len(parts) > 2:
                continue  # merging never yields this token
            self.halves[rank] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
            node = 0
            for byte in token:
                after = self.children[node].get(byte)
                if after is None:
                    after = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = after
            self.ends[node] = rank
        self.edges: dict[tuple[int, int], list[tuple[bytes, int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._restart()
        # the same trie for many walks at once, and which pairs may follow: a place keeps the last pair that fell there
        self.child = FixedMap({n << 8 | b: to for n, after in enumerate(self.children) for b, to in after.items()})
        self.inner = np.array([bool(after) for after in self.children])
        self.ending = np.array([-1 if rank is None else rank for rank in self.ends], np.int32)
        self.length = np.zeros(max(self.tokens) + 1, np.int32)
        self.length[list(self.tokens)] = [len(token) for token in self.tokens.values()]
        self.pair_keys, self.pair_follows = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    def _restart(self) -> None:
        start = ((0, None, ()),)
        self.number = {start: 0}
        self.walks = [start]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.rest: list[tuple[int, ...]] = [()]

    def _merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """Merge plainly until ``stop`` parts are left: shows how each token of the vocabulary comes about."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            best = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == NEVER:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts that make up the left (0) or right (1) edge of a token while it is merged.

        Each comes with the rank of the merge that made it and of the merge that took it up. Later parts first.
        """
        known = self.edges.get((token, side))
        if known is None:
            known, taken, at = [], NEVER, token
            while True:
                split = self.halves[at]
                known.append((self.tokens[at], at if split else -1, taken))
                if split is None:
                    break
                taken, at = at, split[side]
            self.edges[token, side] = known
        return known

    def _may_follow(self, before: int | None, token: int) -> bool:
        """Whether merging leaves the border between two tokens alone.

        It does not if, while both edge parts are there, they would merge first: before the left one is taken up, and
        no later than the right one (of equal merges the left comes first).
        """
        if before is None:
            return True
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) > 4 * self.max_states:
                self.pairs.clear()
            known = self.pairs[before, token] = self._border_stays(before, token)
        return known

    def _border_stays(self, before: int, token: int) -> bool:
        for left, made, taken in self._edge(before, 1):
            for right, made_too, taken_too in self._edge(token, 0):
                if made < taken_too and made_too < taken:
                    rank = self.ranks.get(left + right, NEVER)
                    if rank < taken and rank <= taken_too and rank != NEVER:
                        return False
        return True

    def _may_all_follow(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``_may_follow`` for many pairs; a token below zero stands for none."""
        keys = before.astype(np.int64) << 32 | token
        at = _spread(keys, PAIR_SLOTS)
        follows = (before < 0) | self.pair_follows[at]
        new = np.flatnonzero((before >= 0) & (self.pair_keys[at] != keys))
        if len(new):
            pairs, back = np.unique(keys[new], return_inverse=True)
            stays = np.array([self._border_stays(k >> 32, k & 0xFFFFFFFF) for k in pairs.tolist()])
            follows[new] = stays[back]
            # of pairs that meet in one place either may stay, with its own answer
            places, one = np.unique(_spread(pairs, PAIR_SLOTS), return_index=True)
            self.pair_keys[places], self.pair_follows[places] = pairs[one], stays[one]
        return follows

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after ``byte`` and the tokens emitted on the way."""
        walks, reached = [], None
        children, ends = self.children, self.ends
        for node, before, pending in self.walks[state]:
            node = children[node].get(byte)
            if node is None:
                continue
            if children[node]:
                walks.append((node, before, pending))
            # one way leads to each position: the first that is right is the only one
            if reached is None and (token := ends[node]) is not None and self._may_follow(before, token):
                reached = (0, token, (*pending, token))
        walks.append(reached)
        shortest = walks[0][2]
        for walk in walks:
            if len(walk[2]) < len(shortest):
                shortest = walk[2]
        agreed = 0
        for i, token in enumerate(shortest):
            if any(w[2][i] != token for w in walks):
                break
            agreed = i + 1
        after = tuple([(n, b, p[agreed:]) for n, b, p in walks]) if agreed else tuple(walks)
        target = self.number.get(after)
        if target is None:
            target = self.number[after] = len(self.walks)
            self.walks.append(after)
            self.moves.append({})
            self.rest.append(after[-1][2])
        self.moves[state][byte] = target, shortest[:agreed]
        return self.moves[state][byte]

    def encode(self, piece: bytes) -> list[int]:
        if len(self.walks) > self.max_states:
            self._restart()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            step = moves[state].get(byte)
            if step is None:
                step = self._move(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        out += self.rest[state]
        return out

    def encode_side_by_side(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Encode short pieces, none of them empty; pieces of about the same length go together."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]), reverse=True)
        at = 0
        while at < len(order):
            some = order[at:at + max(1, SIDE_BYTES // len(pieces[order[at]]))]
            for i, ids in zip(some, self._walk([pieces[i] for i in some]), strict=True):
                out[i] = ids
            at += len(some)
        return out

    def _walk(self, pieces: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Ids of the pieces, which come longest first: those with a byte at a position are the first ones."""
        count, longest = len(pieces), len(pieces[0])
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        data = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in pieces), np.uint8).reshape(count, longest).T
        ends_with = np.full((longest + 1, count), -1, np.int32)  # the token on the one way to each position
        piece, node, before = np.arange(count), np.zeros(count, np.int64), np.full(count, -1, np.int32)
        for i in range(longest):
            if lengths[-1] <= i:
                live = piece < np.searchsorted(-lengths, -i)
                piece, node, before = piece[live], node[live], before[live]
            node = self.child.get(node << 8 | data[i, piece])
            on = np.flatnonzero(node >= 0)
            piece, node, before = piece[on], node[on], before[on]
            token = self.ending[node]
            whole = np.flatnonzero(token >= 0)
            whole = whole[self._may_all_follow(before[whole], token[whole])]
            reached, token = piece[whole], token[whole]
            ends_with[i + 1, reached] = token
            on = np.flatnonzero(self.inner[node])
            piece = np.concatenate([piece[on], reached])
            node = np.concatenate([node[on].astype(np.int64), np.zeros(len(reached), np.int64)])
            before = np.concatenate([before[on], token])
        starts_with = np.full((count, longest), -1, np.int32)
        left, at = np.arange(count), lengths
        while len(left):
            token = ends_with[at, left]
            at = at - self.length[token]
            starts_with[left, at] = token
            left, at = left[at > 0], at[at > 0]
        taken = starts_with >= 0
        ids = iter(starts_with[taken].tolist())
        return (tuple(itertools.islice(ids, n)) for n in taken.sum(axis=1).tolist())


class Encoder:
    """Cuts texts by a pattern and encodes the pieces; answers for short pieces are kept up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES):
        self.machine = Transducer(ranks)
        self.pattern = compile_pattern(pattern)
        self.max_pieces = max_pieces
        self.names = {rank: str(rank) for rank in self.machine.tokens}
        self.kept: dict[str, Sequence[int]] = {}

    def encode(self, text: str) -> list[int]:
        # a very long text is cut as it is read
        if len(text) < LONG:
            return self._ids(self.pattern.findall(text))
        pieces, out = (m[0] for m in self.pattern.finditer(text)), []
        while part := list(itertools.islice(pieces, LONG // 4)):
            out += self._ids(part)
        return out

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of every text in order; null counts as empty. New pieces of about ``LONG`` characters are encoded together."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            if text and len(text) >= LONG:
                yield from self._groups(group)
                yield self.encode(text)
                group, size = [], 0
                continue
            group.append(self.pattern.findall(text) if text else [])
            size += len(text or "")
            if size >= LONG:
                yield from self._groups(group)
                group, size = [], 0
        yield from self._groups(group)

    def _groups(self, group: list[list[str]]) -> Iterator[list[int]]:
        long = self._learn(set().union(*group))
        for pieces in group:
            yield self._joined(pieces, long)

    def _ids(self, pieces: list[str]) -> list[int]:
        return self._joined(pieces, self._learn(set(pieces)))

    def _joined(self, pieces: list[str], long: dict[str, list[int]]) -> list[int]:
        known = ChainMap(long, self.kept) if long else self.kept
        return list(itertools.chain.from_iterable(map(known.__getitem__, pieces)))

    def _learn(self, pieces: set[str]) -> dict[str, list[int]]:
        """Have the answers for all short pieces kept; those for long ones are given back."""
        new = [p for p in pieces if p not in self.kept]
        if len(self.kept) + len(new) > self.max_pieces:
            self.kept.clear()
            new = list(pieces)
        raw = [p.encode() for p in new]
        short = [i for i, piece in enumerate(raw) if len(piece) <= SHORT]
        answers = self.machine.encode_side_by_side([raw[i] for i in short])
        self.kept.update(zip((new[i] for i in short), answers, strict=True))
        return {p: self.machine.encode(piece) for p, piece in zip(new, raw, strict=True) if len(piece) > SHORT}


# How many bytes follow each leading byte in UTF-8, and the range of the byte right after it.
FOLLOWERS = {range(0x00, 0x80): 0, range(0xC2, 0xE0): 1, range(0xE0, 0xF0): 2, range(0xF0, 0xF5): 3}
SECOND = {0xE0: range(0xA0, 0xC0), 0xED: range(0x80, 0xA0), 0xF0: range(0x90, 0xC0), 0xF4: range(0x80, 0x90)}
ANY = range(0x80, 0xC0)


class Utf8Stream:
    """Text from bytes that arrive in any pieces: holds back an unfinished character, marks what is no UTF-8."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        whole = len(data) - self._unfinished(data)
        self.held = data[whole:]
        return data[:whole].decode("utf-8", "replace")

    def finish(self) -> str:
        """The end of the stream: an unfinished character becomes a mark."""
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that start a character which later bytes may complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead in ANY:
                continue
            need = next((n for leads, n in FOLLOWERS.items() if lead in leads), 0)
            fits = back == 1 or data[len(data) - back + 1] in SECOND.get(lead, ANY)
            return back if need >= back and fits else 0
        return 0


def decode(ids: Iterable[int], tokens: dict[int, bytes], chunk: int = 4096) -> Iterator[str]:
    """Text of the ids, a piece at a time."""
    stream, given = Utf8Stream(), map(tokens.__getitem__, ids)
    while part := list(itertools.islice(given, chunk)):
        yield stream.feed(b"".join(part))
    yield stream.finish()


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    """One per worker process: loading the ranks takes longer than most batches."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids array<int>``: every text encoded by the rank file at ``path``, without special tokens.

    Null text counts as empty and gives no ids. All columns stay. ``path`` must be readable on every worker. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                ids = list(encoder.encode_all(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, "ids"])

    schema = docs.drop("ids").schema.add("ids", ArrayType(IntegerType()))
    return docs.drop("ids").mapInArrow(run, schema)


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``text`` put back from ``ids``, and without ``ids``. Unknown ids fail. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _encoder(path, "").machine.tokens
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [None if ids is None else "".join(decode(ids, tokens)) for ids in part.column("ids").to_pylist()]
                kept = [n for n in part.schema.names if n not in ("ids", "text")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in kept), pa.array(texts, pa.string())], [*kept, "text"]
                )

    schema = encoded.drop("ids", "text").schema.add("text", "string")
    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass, and keep hashes: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    With ``keep_ids`` the ids follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        tokens = encoder.machine.tokens
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                counts, hashed, decoded, kept = [], [], [], []
                for ids in encoder.encode_all(part.column("text").to_pylist()):
                    counts.append(len(ids))
                    if keep_ids:
                        kept.append(pa.array(ids, pa.int32()))
                    hashed.append(hashlib.sha256(" ".join(map(encoder.names.__getitem__, ids)).encode()).hexdigest())
                    back = hashlib.sha256()
                    for piece in decode(ids, tokens):
                        back.update(piece.encode())
                    decoded.append(back.hexdigest())
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashed), pa.array(decoded)]
                if keep_ids:
                    at = pa.array([0, *itertools.accumulate(counts)], pa.int32())
                    columns.append(pa.ListArray.from_arrays(at, pa.concat_arrays(kept)))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), "long", "string", "string", "array<int>"]
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds, strict=False))
    return docs.select("doc_id", "text").mapInArrow(run, schema)
