"""Runs of words: stretches that repeat themselves at least four times in a row.

A suffix automaton of the words gives the tree of suffix links, whose nodes on the way from
a prefix to the root are the suffixes of that prefix. Each node's colour is the place where
its words ended last. Appending a word is the access of a link-cut tree: the whole way from the
new prefix to the root takes the new place as its colour. Before that, the way falls
into segments of one colour; a segment whose longest suffix has h words and which ended d
words ago says that the last h words also stood d words earlier, and that nothing longer did.
With h >= d that is a square of period d, the smallest one there, and the d + h words are
as much of a run as has been read; the last place that reports it is the run's end. The
segments (preferred paths) are kept as stacks along heavy paths, so that an access touches
few of them.

Only stretches of a text that can hold a run go through the automaton. A run of a short
period shows as equal words that far apart; in a run of a longer period q every eight words
were seen at most q words before, for three periods less seven words. Both are necessary,
so no run is lost, and stretches that touch are taken as one, so none is cut.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of the sequences that a longer period is looked for with; periods up to it are looked for word by word.
GRAM = 8

Run = tuple[int, int, int]


def automaton(words: Iterable[int]) -> tuple[array, array, array]:
    """The suffix automaton's states: the most words of each, its suffix link (-1 at the root), and the state of each prefix.

    A state keeps its first way on in two arrays and others in a dict, as most have one only.
    """
    length, link, word_on, to = array("i", [0]), array("i", [-1]), array("i", [-1]), array("i", [0])
    more: dict[int, dict[int, int]] = {}
    ends, last = array("i"), 0
    for w in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        word_on.append(-1)
        to.append(0)
        at, found = last, -1
        while at >= 0:
            if (first := word_on[at]) == w:
                found = to[at]
                break
            if first < 0:
                word_on[at], to[at] = w, new
            elif (others := more.get(at)) is None:
                more[at] = {w: new}
            elif (found := others.get(w, -1)) >= 0:
                break
            else:
                others[w] = new
            at = link[at]
        if found >= 0:
            if length[at] + 1 == length[found]:
                link[new] = found
            else:
                twin = len(length)
                length.append(length[at] + 1)
                link.append(link[found])
                word_on.append(word_on[found])
                to.append(to[found])
                if found in more:
                    more[twin] = dict(more[found])
                link[found] = link[new] = twin
                while at >= 0:
                    if word_on[at] == w:
                        if to[at] != found:
                            break
                        to[at] = twin
                    elif (others := more.get(at)) is not None and others.get(w) == found:
                        others[w] = twin
                    else:
                        break
                    at = link[at]
        ends.append(new)
        last = new
    return length, link, ends


def _heads(length: array, link: array) -> array:
    """The top state of each state's heavy path."""
    down = np.argsort(np.frombuffer(length, np.int32), kind="stable").tolist()  # a link leads to fewer words
    size, heavy, head = array("i", [1]) * len(length), array("i", [-1]) * len(length), array("i", range(len(length)))
    for v in reversed(down):
        if (up := link[v]) >= 0:
            size[up] += size[v]
            if heavy[up] < 0 or size[v] > size[heavy[up]]:
                heavy[up] = v
    for v in down:
        if (below := heavy[v]) >= 0:
            head[below] = head[v]
    return head


def runs_of(words: list[int]) -> list[Run]:
    """start, length and period of every run of a sequence, by start and period."""
    length, link, ends = automaton(words)
    head = _heads(length, link)
    stacks: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of a heavy path: (words of the deepest state, colour), the shallowest segment last
    ended: dict[tuple[int, int], int] = {}
    for now, state in enumerate(ends):
        seen = -1
        while state > 0:
            top, deep = head[state], length[state]
            stack, above = stacks[top], 0
            met = []
            while stack and stack[-1][0] <= deep:
                met.append(stack.pop())
            if met:
                above = met[-1][0]
            if stack and above < deep:
                met.append((deep, stack[-1][1]))
            for held, colour in reversed(met):  # the deepest state of a colour comes first
                if colour != seen:
                    seen, apart = colour, now - colour
                    if held >= (LEAST_PERIODS - 1) * apart and held + apart >= LEAST_WORDS:
                        ended[now - apart - held + 1, apart] = now
            stack.append((deep, now))
            state = link[top]
    return [(start, end - start + 1, period) for (start, period), end in sorted(ended.items())]


def _stretches(held: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """First and last place of each stretch of true values, at least so many long."""
    if held.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).view(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= least:
                yield int(a), int(b) - 1


def candidates(ids: np.ndarray, text_no: np.ndarray) -> list[tuple[int, int]]:
    """Ranges (end exclusive) that hold every run of a sequence of word ids, cut into texts by text_no; no two touch."""
    found, n = [], len(ids)
    for q in range(1, min(GRAM, n - 1) + 1):
        same = (ids[q:] == ids[:-q]) & (text_no[q:] == text_no[:-q])
        found += [(a, b + q + 1) for a, b in _stretches(same, max(LEAST_WORDS, LEAST_PERIODS * q) - q)]
    if n > GRAM:
        mixed = ids.astype(np.uint64) + np.uint64(1)
        grams = np.zeros(n - GRAM + 1, np.uint64)
        for k in range(GRAM):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + len(grams)]
        order = np.argsort(grams, kind="stable")
        repeats = grams[order[1:]] == grams[order[:-1]]
        after, before = order[1:][repeats], order[:-1][repeats]
        inside = (text_no[after + GRAM - 1] == text_no[before]) & (text_no[after] == text_no[after + GRAM - 1])
        gap = np.full(len(grams), n, np.int64)
        gap[after[inside]] = (after - before)[inside]
        most = GRAM
        while LEAST_PERIODS * most < n:
            least, most = most + 1, most * 2
            found += [(max(0, a - most), b + GRAM) for a, b in _stretches(gap <= most, (LEAST_PERIODS - 1) * least - GRAM + 1)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def runs_of_texts(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, a list of words."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter((number[w] for words in texts for w in words), np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    text_no, begins = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    found: list[list[Run]] = [[] for _ in texts]
    for a, b in candidates(ids, text_no):
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(text_no[a:b]))).tolist(), b]
        for x, y in zip(cuts, cuts[1:], strict=False):
            k = int(text_no[x])
            found[k] += [(start + x - int(begins[k]), length, period) for start, length, period in runs_of(ids[x:y].tolist())]
    return found


def strongest(runs: list[Run]) -> Run | None:
    """The run with the most periods; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not inside]


def wound(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of one document in ten repeated from some word on: what the query puts in to have runs to find.

    A null doc_id changes nothing.
    """
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length and period of each, in words) and collapsed (the text without the repeats) for every row of docs.

    Words are divided by ASCII white space and compared as they are. Null, empty and short
    texts have no runs. Repeated rows each get a row; an empty table gives none; other columns
    are ignored. Memory follows the longest text: some 40 bytes a word beside its words.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4 << 20):
            texts = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]
            runs = runs_of_texts(texts)
            short = [b" ".join(collapsed(words, r)).decode("utf-8", "replace") for words, r in zip(texts, runs, strict=True)]
            named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in each] for each in runs]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, RUNS), pa.array(short)], names=["doc_id", "runs", "collapsed"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


_DIGEST = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of every row's wound() words as counts and digests, with the strongest run; four nulls where there is none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4 << 20):
            ids = part.column(0).to_pylist()
            texts = [wound((t or b"").split(), i) for t, i in zip(part.column(1).cast(pa.binary()).to_pylist(), ids, strict=True)]
            rows = []
            for doc_id, words, runs in zip(ids, texts, runs_of_texts(texts), strict=True):
                best = strongest(runs)
                listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
                shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                rows.append((doc_id, len(runs), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [()] * len(_DIGEST)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DIGEST, strict=True)], schema=_DIGEST)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
