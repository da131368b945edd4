"""Byte-level BPE with a hierarchical-bitmap rank queue.

Merging a pre-token needs the lowest merge rank among all adjacent parts, leftmost first.
The queue keeps a bucket for each rank that is present, holding the positions of linked-list
parts, and a two-level bitmap over the ranks: a summary whose bits name the blocks of ranks
with entries, and the bits of each block. Find-first-set on the two levels gives the next
rank. Entries are never removed when a neighbour's merge overtakes them; an entry whose part
has gone, or whose pair's rank has changed, is stale and is skipped on arrival. Work follows
the bytes, however long a pre-token is.

Pre-tokens repeat, so a Python worker remembers, from task to task, the ids of those it has met, within a bound, and
sends the new ones of a batch through the queue together. Merging holds about 64 bytes for
each byte of the longest pre-token: one of 30 MB takes 2 GB.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import held_by_worker, id_text, per_texts

#: Pre-tokens that one worker remembers, and that it merges at once; bytes of text whose new pre-tokens are merged together.
REMEMBERED, MERGED_AT_ONCE, TOGETHER = 700_000, 100_000, 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


#: Ranks that one word of the lower bitmap covers.
BLOCK = 256


class RankQueue:
    """Positions by merge rank; pop() gives the lowest rank that has any, and its positions.

    `present` is the bitmap of ranks, a row for each block, and `blocks` the summary bitmap.
    A bucket is a linked list of runs of positions: head[rank] names its newest run, and
    `runs` has each run's start and length in the store and the run before it.
    """

    def __init__(self, n_ranks: int) -> None:
        rows = -(-n_ranks // BLOCK)
        self._present, self._blocks = np.zeros((rows, BLOCK), bool), np.zeros(rows, bool)
        self._flat, self._head = self._present.reshape(-1), np.full(rows * BLOCK, -1, np.int64)
        self._store, self._used = np.empty(1 << 12, np.int64), 0
        self._runs, self._n_runs = np.empty((3, 1 << 10), np.int64), 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks = ranks[order]
        first = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        while self._used + len(ranks) > len(self._store):
            self._store = np.concatenate((self._store, np.empty_like(self._store)))
        while self._n_runs + len(first) > self._runs.shape[1]:
            self._runs = np.concatenate((self._runs, np.empty_like(self._runs)), axis=1)
        self._store[self._used : self._used + len(ranks)] = positions[order]
        new, of = slice(self._n_runs, self._n_runs + len(first)), ranks[first]
        self._runs[0, new] = first + self._used
        self._runs[1, new] = np.diff(first, append=len(ranks))
        self._runs[2, new] = self._head[of]
        self._head[of] = np.arange(new.start, new.stop)
        self._flat[of] = True
        self._blocks[of // BLOCK] = True
        self._used += len(ranks)
        self._n_runs = new.stop

    def pop(self) -> tuple[int, np.ndarray] | None:
        block = int(self._blocks.argmax())
        if not self._blocks[block]:
            return None
        row = self._present[block]
        rank = block * BLOCK + int(row.argmax())
        parts, run = [], int(self._head[rank])
        while run >= 0:
            start, length, run = self._runs[:, run].tolist()
            parts.append(self._store[start : start + length])
        self._head[rank] = -1
        row[rank - block * BLOCK] = False
        if not row.any():
            self._blocks[block] = False
        return rank, np.concatenate(parts)


class Merger:
    """Merges many pre-tokens at once: one linked list of parts, with a barrier between pre-tokens.

    Pre-tokens don't touch each other, so the order of their own merges, lowest rank first and
    leftmost among equals, is kept when the queue goes through all of them together.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self._n = max(ranks.values()) + 1
        self._byte = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * (self._n + 1) + right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.iinfo(np.int64).max)
        self._ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)
        # A part of such a rank may next take part in a merge of a lower rank, so its merges go one by one.
        left, right, made = self._keys[:-1] // (self._n + 1), self._keys[:-1] % (self._n + 1), self._ranks[:-1]
        self._early = np.zeros(self._n, bool)
        self._early[left[made < left]] = True
        self._early[right[made < right]] = True

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self._n + 1) + right
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at], -1)

    def _until_lower(self, rank, at, all_at, value, after, before, ends, queue) -> np.ndarray:
        """The positions, in each piece up to the first whose merge makes a pair of a lower rank; the rest waits again."""
        made, stop = np.full(len(at), rank), after[after[at]]
        lower = np.zeros(len(at), bool)
        for new in (self._pair(made, value[stop]), self._pair(value[before[at]], made), self._pair(made, made)):
            lower |= (new >= 0) & (new < rank)
        if not lower.any():
            return at
        piece = np.searchsorted(ends, at)
        first = np.concatenate(([True], piece[1:] != piece[:-1]))
        seen = np.cumsum(lower) - lower
        keep = seen == np.maximum.accumulate(np.where(first, seen, 0))
        last = dict(zip(piece[keep].tolist(), at[keep].tolist(), strict=True))
        pieces = np.fromiter(last, np.int64, len(last))
        ends_at = np.fromiter(last.values(), np.int64, len(last))
        rest = all_at[all_at > ends_at[np.searchsorted(pieces, np.searchsorted(ends, all_at))]]
        queue.push(np.full(len(rest), rank), rest)
        return at[keep]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        barrier = self._n
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths + 1)
        size = int(ends[-1]) + 1 if len(pieces) else 1
        value = np.full(size, barrier, np.int64)
        inside = np.ones(size, bool)
        inside[0] = False
        inside[ends] = False
        value[inside] = self._byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        after[-1] = size - 1
        pair = np.full(size, -1, np.int64)
        pair[:-1] = self._pair(value[:-1], value[1:])
        alive = np.ones(size, bool)
        queue = RankQueue(self._n)
        waiting = np.flatnonzero(pair >= 0)
        queue.push(pair[waiting], waiting)
        while (entry := queue.pop()) is not None:
            rank, at = entry
            at = at[pair[at] == rank]  # the others are stale
            if not len(at):
                continue
            at.sort()
            if len(at) > 1:
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                all_at, count = at, np.arange(len(at))
                starts = np.concatenate(([True], after[at[:-1]] != at[1:]))
                at = at[(count - np.maximum.accumulate(np.where(starts, count, 0))) % 2 == 0]  # every other one of pairs that overlap
                if self._early[rank] and len(at) > 1:
                    at = self._until_lower(rank, at, all_at, value, after, before, ends, queue)
            gone = after[at]
            stop = after[gone]
            value[at] = rank
            after[at] = stop
            before[stop] = at
            alive[gone] = False
            pair[gone] = -1
            fresh = np.concatenate((at, before[at]))
            made = self._pair(value[fresh], value[after[fresh]])
            pair[fresh] = made
            some = made >= 0
            queue.push(made[some], fresh[some])
        ids = value[alive]
        cuts = (4 * np.flatnonzero(ids == barrier)).tolist()
        ids = ids.astype("<u4").tobytes()
        return [ids[a + 4 : b] for a, b in zip(cuts, cuts[1:], strict=False)]


#: Matches a text whose letters and digits are all of the blocks named here, and whose white space is plain.
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u024f]*")
_PLAIN_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern with the letter and digit classes written out for plain texts, for the faster matcher.

    None if the pattern has other classes than these.
    """
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{_PLAIN_LETTERS}0-9]").replace(r"\p{L}", f"[{_PLAIN_LETTERS}]").replace(r"\p{N}", "[0-9]")
    return None if re.search(r"\\[pPwWdDbBXx]", spelled) else re.compile(spelled)


class Encoder:
    """Whole texts to little-endian 32-bit ids, each match of the pattern on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self._merger = Merger(ranks)
        self._find, plain = regex.compile(pattern).findall, plain_pattern(pattern)
        self._find_plain = plain.findall if plain else None
        self._known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self._find_plain and _PLAIN.fullmatch(text):
            return self._find_plain(text)
        return self._find(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Pre-tokens not met before are merged together; the worker remembers up to REMEMBERED of them."""
        found = [self.pieces(text) if text else [] for text in texts]
        new = list(set().union(*found).difference(self._known)) if found else []
        if len(self._known) + len(new) > REMEMBERED:
            self._known = {}
            new = list(set().union(*found))
        for start in range(0, len(new), MERGED_AT_ONCE):
            some = new[start : start + MERGED_AT_ONCE]
            self._known.update(zip(some, self._merger.merge([t.encode("utf-8", "surrogatepass") for t in some]), strict=True))
        known = self._known.__getitem__
        return [b"".join(map(known, pieces)) for pieces in found]


def worker_encoder(ranks_path: str, pattern: str) -> Encoder:
    """The encoder of this Python worker: its next tasks of this operator neither build it nor merge again what it remembers."""
    return held_by_worker(("encoder", ranks_path, pattern), lambda: Encoder(read_ranks(ranks_path), pattern))


class Decoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self._lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        """Fails on an id beyond the vocabulary."""
        ids = np.frombuffer(ids, "<u4")
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        shift = self._starts[ids] - ends + lengths
        return self._bytes[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) for every row of docs.

    ranks_path is a tiktoken rank file that every executor can read. No special tokens. A
    null or empty text has no ids. Other columns are ignored whatever their names; repeated
    rows stay repeated; an empty table gives none.
    """

    def make():
        encoder = worker_encoder(ranks_path, pattern)
        return lambda texts: [(ids,) for ids in encoder.encode(texts)]

    return per_texts(id_text(docs, id_col, text_col), make, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]), "doc_id long, ids binary", TOGETHER, keep=True)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and bytes (binary) for rows of doc_id and ids, as encode() returns them; null ids have no bytes."""

    def make():
        decoder = Decoder(read_ranks(ranks_path))
        return lambda rows: [(decoder.decode(ids or b""),) for ids in rows]

    return per_texts(encoded.select("doc_id", "ids"), make, pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())]), "doc_id long, bytes binary")


_TRIP = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text and decodes its ids."""

    def make():
        encoder, decoder = worker_encoder(ranks_path, pattern), Decoder(read_ranks(ranks_path))

        def of(texts: list[str | None]) -> list[tuple]:
            return [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoder.decode(ids)).hexdigest()) for ids in encoder.encode(texts)]

        return of

    return per_texts(id_text(docs, id_col, text_col), make, _TRIP, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", TOGETHER, keep=True)
