"""Periodic runs of words by a Re-Pair grammar, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period q and a length of at least
`least` and 2 q words that no neighbouring word extends with period q.

Each text gets a grammar of its own by Re-Pair over its word ids: pairs of
neighbouring symbols become a new symbol (a nonterminal) where they are the most
frequent pair around them, round after round, until no pair of a text occurs
twice; what is left is joined in balanced pairs. A nonterminal is looked at once,
at its first place in the text: runs that cross the boundary of its two parts
start at words equal to those beside the boundary, and matches forwards and
backwards (by ranks of the words' 2^k-grams) give their lengths, cut to the
nonterminal. Every run lies within a smallest node that covers it and crosses the
boundary there, so none is missed. Runs found are carried to all places where the
nonterminal was made; stretches of one period that lie within longer ones merge
into these, and equal stretches keep the smallest period.

Texts are handled many at a time in numpy arrays, a long one alone. Memory
follows the words of one slice, the work n log n.

Defined results: a NULL text has no words and no runs and collapses to an empty
text; a text of any length is one row; rows are independent, so repeated ids give
repeated rows; NULL ids stay; an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_text, pieces, utf8

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
KIND = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def split(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the index of every word among them, and the n + 1 row bounds in words."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.append(0, np.cumsum(end - start)).astype(np.int64)
    kept = np.ascontiguousarray(data[inside])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), np.searchsorted(start, bounds)


def spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of all integers start[i] .. start[i] + count[i] - 1."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


class Grammar:
    """Nonterminals as (lo, mid, hi) of their first place, and all places where each was made."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        self.lo, self.mid, self.hi, self.node, self.place = [], [], [], [], []
        self.n = 0
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = np.arange(len(symbols))
        to = at + 1
        symbol, fresh = symbols, int(symbols.max()) + 1 if len(symbols) else 0
        done = []
        while len(symbol):
            made = self.round(symbol, at, to, doc, fresh)
            if made is None:
                done.append((doc, at, to))
                break
            symbol, at, to, doc, fresh, open_docs = made
            # a text without any repeated pair left will never have one again
            still = open_docs[doc]
            if not still.all():
                done.append((doc[~still], at[~still], to[~still]))
                symbol, at, to, doc = symbol[still], at[still], to[still], doc[still]
        if done:
            doc, at, to = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(at)
            self.join(doc[order], at[order], to[order])

    def add(self, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, which: np.ndarray, place: np.ndarray) -> None:
        self.lo.append(lo)
        self.mid.append(mid)
        self.hi.append(hi)
        self.node.append(which + self.n)
        self.place.append(place)
        self.n += len(lo)

    def round(self, symbol, at, to, doc, fresh):
        same_doc = doc[1:] == doc[:-1]
        pair = symbol[:-1] * np.int64(fresh) + symbol[1:]
        # within equal symbols every second pair counts, so that occurrences do not overlap
        equal = same_doc & (symbol[1:] == symbol[:-1])
        index = np.arange(len(pair))
        since = np.maximum.accumulate(np.where(equal, -1, index)) if len(pair) else index
        usable = same_doc & ~(equal & ((index - since) % 2 == 0))
        where = np.flatnonzero(usable)
        codes, inverse, count = np.unique(pair[where], return_inverse=True, return_counts=True)
        if not (count > 1).any():
            return None
        # order by count, ties by a scrambled code so that neighbours seldom form chains
        scrambled = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rank = np.empty(len(codes), np.int64)
        rank[np.lexsort((scrambled ^ (scrambled >> np.uint64(29)), count))] = np.arange(1, len(codes) + 1)
        rank[count < 2] = 0
        strength = np.zeros(len(pair) + 2, np.int64)
        strength[where + 1] = rank[inverse]
        wins = (strength[1:-1] > strength[:-2]) & (strength[1:-1] > strength[2:])
        won = np.flatnonzero(wins[where])
        times = np.bincount(inverse[won], minlength=len(codes))
        won = won[times[inverse[won]] > 1]
        chosen = where[won]
        names, which = np.unique(inverse[won], return_inverse=True)
        first = np.full(len(names), len(at))
        np.minimum.at(first, which, chosen)
        self.add(at[first], to[first], to[first + 1], which, at[chosen])
        symbol, to = symbol.copy(), to.copy()
        symbol[chosen] = fresh + which
        to[chosen] = to[chosen + 1]
        keep = np.ones(len(symbol), bool)
        keep[chosen + 1] = False
        open_docs = np.zeros(int(doc[-1]) + 1, bool)
        open_docs[doc[where[count[inverse] > 1]]] = True
        return symbol[keep], at[keep], to[keep], doc[keep], fresh + len(names), open_docs

    def join(self, doc, at, to):
        """Balanced pairs over the symbols that are left of each text."""
        while True:
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            place = np.arange(len(doc)) - starts[np.searchsorted(starts, np.arange(len(doc)), "right") - 1]
            left = np.flatnonzero((place[:-1] % 2 == 0) & (doc[1:] == doc[:-1]))
            if not len(left):
                return
            self.add(at[left], to[left], to[left + 1], np.arange(len(left)), at[left])
            to = to.copy()
            to[left] = to[left + 1]
            keep = np.ones(len(doc), bool)
            keep[left + 1] = False
            doc, at, to = doc[keep], at[keep], to[keep]


class Matches:
    """Lengths of equal stretches from ranks of 2^k-grams; a gram that occurs once never matches."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        self.n = len(symbols)
        end = np.repeat(bounds[1:], np.diff(bounds))
        self.levels = []
        rank, step = symbols, 1
        while True:
            self.levels.append(rank)
            at = np.flatnonzero(rank >= 0)
            at = at[at + 2 * step <= end[at]]
            at = at[rank[at + step] >= 0]
            if not len(at):
                return
            base = int(rank.max()) + 1
            _, inverse, count = np.unique(rank[at] * np.int64(base) + rank[at + step], return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            if not again.any():
                return
            rank = np.full(self.n, -1, np.int64)
            rank[at[again]] = inverse[again]
            step *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on; symbols differ from text to text, so no match leaves one."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], 1 << k
            a, b = i + out, j + out
            fits = (a < self.n) & (b < self.n)
            a, b = np.minimum(a, self.n - 1), np.minimum(b, self.n - 1)
            out[fits & (rank[a] >= 0) & (rank[a] == rank[b])] += step
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j backwards, both included."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], 1 << k
            a, b = i - out - step + 1, j - out - step + 1
            fits = (a >= 0) & (b >= 0)
            a, b = np.maximum(a, 0), np.maximum(b, 0)
            out[fits & (rank[a] >= 0) & (rank[a] == rank[b])] += step
        return out


def crossing(symbols: np.ndarray, grammar: Grammar, matches: Matches, least: int, block: int = 1 << 20):
    """(node, start, end, period) of the runs that cross each node's boundary, cut to the node."""
    if not grammar.n:
        return
    lo, mid, hi = (np.concatenate(x) for x in (grammar.lo, grammar.mid, grammar.hi))
    order = np.argsort(symbols, kind="stable")
    n = len(symbols)
    # place of (symbol, position) pairs in the sorted list
    keys = symbols[order] * np.int64(n + 1) + order
    long = np.flatnonzero(hi - lo >= least)
    for right in (True, False):
        beside = symbols[mid[long] - 1] if right else symbols[mid[long]]
        # the repeated word lies within half of the node's length of the boundary
        half = (hi[long] - lo[long]) // 2
        near = mid[long] if right else np.maximum(lo[long], mid[long] - half)
        far = np.minimum(hi[long], mid[long] + half) if right else mid[long]
        a = np.searchsorted(keys, beside * np.int64(n + 1) + near)
        count = np.searchsorted(keys, beside * np.int64(n + 1) + far) - a
        upto = np.cumsum(count)
        done = 0
        while done < len(long):
            base = upto[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(upto, base + block, "right")))
            owner, spot = spread(a[done:stop], count[done:stop])
            node = long[done:stop][owner]
            done = stop
            if not len(node):
                continue
            j, b = order[spot], mid[node]
            if right:
                period = j - b + 1
                ahead = np.minimum(matches.forward(b, j + 1), hi[node] - j - 1)
                behind = np.minimum(matches.backward(b - 1, j), b - lo[node])
                start, end = b - behind, b + period + ahead
            else:
                period = b - j
                ahead = np.minimum(matches.forward(j, b), hi[node] - b)
                behind = np.where(j > lo[node], np.minimum(matches.backward(j - 1, b - 1), j - lo[node]), 0)
                start, end = j - behind, b + ahead
            good = end - start >= np.maximum(least, 2 * period)
            yield node[good], start[good], end[good], period[good]


def find(symbols: np.ndarray, bounds: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start and period; `symbols` differ from text to text."""
    empty = np.zeros(0, np.int64)
    if not len(symbols):
        return empty, empty, empty
    grammar = Grammar(symbols, bounds)
    found = [part for part in crossing(symbols, grammar, Matches(symbols, bounds), least) if len(part[0])]
    if not found:
        return empty, empty, empty
    node, start, end, period = (np.concatenate(x) for x in zip(*found))
    # a run may be found from both sides of its boundary
    once = np.unique(np.stack([node, period, start, end], 1), axis=0)
    node, period, start, end = once.T
    lo = np.concatenate(grammar.lo)
    made, place = np.concatenate(grammar.node), np.concatenate(grammar.place)
    by_node = np.argsort(made, kind="stable")
    first = np.searchsorted(made, node, sorter=by_node)
    times = np.searchsorted(made, node, "right", sorter=by_node) - first
    owner, spot = spread(first, times)
    shift = place[by_node[spot]] - lo[node[owner]]
    start, end, period = start[owner] + shift, end[owner] + shift, period[owner]
    # by period and start; a stretch that ends no later than an earlier one of its period lies within it
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    far = np.maximum.accumulate(end + period * np.int64(len(symbols) + 1))
    new = np.append(True, far[1:] > far[:-1])
    start, end, period = start[new], end[new], period[new]
    # multiples of a period have the same stretch
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0))
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def handled(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    data, offsets = utf8(batch.column(1))
    words, index, bounds = split(data, offsets)
    row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    # symbols of a text's own: words numbered over (text, word)
    symbols = np.unique(row * np.int64(len(words) + 1) + index, return_inverse=True)[1].astype(np.int64) if len(index) else index
    start, end, period = find(symbols, bounds, least)
    owner = np.searchsorted(bounds, start, "right") - 1
    cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    # words after the first q of a run go: count how many runs cover each
    change = np.zeros(len(index) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    kept_row = row[kept]
    size = np.diff(np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)) if len(words) else np.zeros(0, np.int64)
    texts = collapse(words, index[kept], size, np.searchsorted(kept_row, np.arange(batch.num_rows + 1)))
    base = bounds[owner]
    runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - start), pa.array(period)], ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(bounds).astype(np.int64)), runs, texts], ["doc_id", "n_words", "runs", "collapsed"])


def collapse(words: pa.Array, index: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The words of each row joined by single spaces."""
    names = words.to_pylist()
    return pa.array([b" ".join([names[i] for i in index[a:b].tolist()]) for a, b in zip(bounds, bounds[1:])], pa.binary()).cast(pa.string())


def runs(docs: DataFrame, least: int = 12, most: int = 2 << 20) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) by start and period, and the collapsed text of every row of `docs`.

    Texts are taken together up to `most` bytes; a longer text is taken alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, most=most):
                yield handled(piece, least)

    return id_text(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, KIND)


def periodised(doc_id: Column, text: Column) -> Column:
    """Words of one text in ten repeat from word a on with period p, both set by the CRC32 of its id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    def again(w: Column) -> Column:
        n, g = F.size(w).cast("bigint"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.element_at(w, i + 1)), " ")).otherwise(text)

    # a lambda's argument is evaluated once, where a column would be split again for every word
    whole = F.element_at(F.transform(F.array(words), again), 1)
    return F.when(h % 10 == 0, whole).otherwise(text)
