"""Runs of repeated words, found on a Re-Pair grammar of the word ids.

A run is a stretch of words with smallest period q and a length of at least ``min_length`` and ``exponent`` periods that no
neighbouring word extends with that period.

The documents of a chunk are laid end to end as word ids, and pairs of neighbouring symbols that occur more than once (never
across documents) are replaced by nonterminals: in each round every place whose pair is more frequent than those it
overlaps with. When no pair repeats, what is left of each document is paired evenly, so that a document is one symbol.
Each run lies across the boundary of the lowest nonterminal that covers it, and that nonterminal's text shows all of it. So
each nonterminal's boundary is searched once, where it first occurs: for every period up to a third of its length whose
four words beside the boundary return at that distance (half of any run lies on one side), by lists of equal
four-word groups, and extended by binary search over prefix hashes. The runs found are moved to every place that the
nonterminal derives, and intervals of one period that overlap by a period or more are merged: parts of a run that
smaller or larger nonterminals cut off go into the whole.

Words are compared by exact ids, stretches by two hashes modulo primes near 2**31 with random bases. A chunk has about ``CHUNK``
words (one document, if that is longer); memory goes with the chunk, time with n log n of the longest document.

Defined results: null texts and texts without words have no runs and collapse to the empty text; repeated rows each get their row;
ids of any type; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskframe.llm._shared import known_columns
from riskframe.llm.shingles import mix, utf8

#: Words of a chunk, and candidates of periods looked at together.
CHUNK, CANDIDATES = 1 << 18, 1 << 20
#: Words beside a boundary that must return.
GROUP = 4
PRIMES = (2147483647, 2147483629)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BASES = [int(_rng.integers(1 << 20, p - 1)) for p in PRIMES]
_powers: list[np.ndarray] = [np.ones(1, np.uint64) for _ in PRIMES]
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_SQL = "struct<start: long, length: long, period: long>"


def powers(k: int, n: int) -> np.ndarray:
    """Powers of the base modulo the prime, n at least."""
    while len(_powers[k]) < n:
        _powers[k] = np.concatenate((_powers[k], _powers[k] * np.uint64(pow(_BASES[k], len(_powers[k]), PRIMES[k])) % np.uint64(PRIMES[k])))
    return _powers[k]


class Stretches:
    """Comparison of stretches of ids by prefix hashes."""

    def __init__(self, ids: np.ndarray):
        self.n, self.sums = len(ids), []
        for k, p in enumerate(PRIMES):
            sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * powers(k, len(ids))[: len(ids)] % np.uint64(p), out=sums[1:])
            self.sums.append(sums % np.uint64(p))

    def same(self, at: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n ids from at equal those q later."""
        out = np.ones(len(at), bool)
        for k, (p, sums) in enumerate(zip(PRIMES, self.sums)):
            p = np.uint64(p)
            out &= (sums[at + n] + p - sums[at]) % p * powers(k, self.n + 1)[q] % p == (sums[at + q + n] + p - sums[at + q]) % p
        return out

    def reach(self, at: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The largest n up to most for which n ids from at (before at, if back) equal those q later."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            fits = self.same(at - mid if back else at, q, mid)
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        return low


class Grammar:
    """Symbols of a grammar: the ids first, then nonterminals with their two parts and where they first occur."""

    def __init__(self, n_ids: int):
        self.n_ids, self.size = n_ids, n_ids
        self.rules: dict[int, int] = {}
        self.left, self.right, self.first = [], [], []

    def name(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The nonterminal of each pair, a new one where there's none."""
        keys, first, which = np.unique(left << 32 | right, return_index=True, return_inverse=True)
        names = np.fromiter((self.rules.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        new = np.flatnonzero(names < 0)
        names[new] = self.size + np.arange(len(new))
        self.rules.update(zip(keys[new].tolist(), names[new].tolist()))
        self.add(left[first[new]], right[first[new]], at[first[new]])
        return names[which]

    def add(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A new nonterminal for each pair."""
        self.left.append(left)
        self.right.append(right)
        self.first.append(at)
        self.size += len(left)
        return np.arange(self.size - len(left), self.size)


def chosen(count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of places i of pairs (i, i + 1), with their counts (0: not to be replaced), those that beat their neighbours; equal pairs in a row take turns."""
    live = count > 1
    before = np.r_[False, live[:-1] & live[1:] & (key[:-1] == key[1:])]
    above = np.zeros(len(count), bool)  # the pair before is the better one
    better = (count[:-1] > count[1:]) | ((count[:-1] == count[1:]) & (key[:-1] < key[1:]))
    above[1:] = better & ~before[1:] & live[:-1]
    below = np.zeros(len(count), bool)  # the pair after is the better one
    below[:-1] = ~better & ~before[1:] & live[1:]
    heads = np.flatnonzero(~before)
    head = np.repeat(heads, np.diff(np.r_[heads, len(count)]))
    turn = (np.arange(len(count)) - head) % 2 == above[head]
    return live & turn & ~below


def compress(ids: np.ndarray, n_ids: int, doc: np.ndarray) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """The grammar of the ids of documents, and each document's symbol with its place."""
    grammar, symbols, at = Grammar(n_ids), ids, np.arange(len(ids))
    old, count = np.full(max(0, len(ids) - 1), 2), None
    while len(symbols) > 1:
        # Pairs without a new symbol that were alone before are alone.
        key = symbols[:-1] << 32 | symbols[1:]
        look = np.flatnonzero((old > 1) & (doc[at[:-1]] == doc[at[1:]]))
        count = np.zeros(len(key), np.int64)
        if len(look):
            _, which, times = np.unique(key[look], return_inverse=True, return_counts=True)
            count[look] = times[which]
        take = np.flatnonzero(chosen(count, key))
        if not len(take):
            break
        symbols = symbols.copy()
        symbols[take] = grammar.name(symbols[take], symbols[take + 1], at[take])
        fresh = np.zeros(len(symbols), bool)
        fresh[take] = True
        stay = np.ones(len(symbols), bool)
        stay[take + 1] = False
        old = np.r_[count, 0][stay]
        symbols, at, fresh = symbols[stay], at[stay], fresh[stay]
        old = np.where(fresh[:-1] | fresh[1:], 2, old[:-1])
    while len(symbols) > 1:
        edges = np.r_[True, doc[at[1:]] != doc[at[:-1]]]
        heads = np.flatnonzero(edges)
        place = np.arange(len(symbols)) - np.repeat(heads, np.diff(np.r_[heads, len(symbols)]))
        take = np.flatnonzero((place[:-1] % 2 == 0) & ~edges[1:])
        if not len(take):
            break
        symbols = symbols.copy()
        symbols[take] = grammar.add(symbols[take], symbols[take + 1], at[take])
        stay = np.ones(len(symbols), bool)
        stay[take + 1] = False
        symbols, at = symbols[stay], at[stay]
    return grammar, symbols, at


def expanded(heads: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, k) for k from 1 to counts[index], about CANDIDATES at a time."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
        many = counts[at:stop]
        if many.sum():
            which = np.repeat(np.arange(at, stop), many)
            yield heads[which], np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + 1
        at = stop


def boundary_runs(ids: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray, min_length: int, exponent: int) -> tuple[np.ndarray, ...]:
    """(which, start, stop, period) of the runs within [low, high) at whose middle half of them or more lies on one side."""
    n = len(ids)
    spread = mix(ids.astype(np.uint64) + np.uint64(1))
    group = np.zeros(max(0, n - GROUP + 1), np.uint64)
    for k in range(GROUP):
        group = mix(group + spread[k : n - GROUP + 1 + k])
    _, names = np.unique(group, return_inverse=True)
    listed = np.sort(names.astype(np.int64) << 32 | np.arange(len(names)))
    places = listed & 0xFFFFFFFF
    widest = (high - low) // exponent
    stretches, out = Stretches(ids), []
    for back in (False, True):
        anchor = middle - GROUP if back else middle
        some = np.flatnonzero((anchor >= low) & (anchor + GROUP <= high) & (widest > 0))
        here = anchor[some]
        mine = names[here].astype(np.int64) << 32
        rank = np.searchsorted(listed, mine | here)
        if back:
            counts = rank - np.searchsorted(listed, mine | np.maximum(here - widest[some], low[some]))
        else:
            counts = np.searchsorted(listed, mine | np.minimum(here + widest[some], high[some] - GROUP), "right") - rank - 1
        for which, k in expanded(np.arange(len(some)), np.maximum(counts, 0)):
            node = some[which]
            q = np.abs(places[rank[which] + (-k if back else k)] - here[which])
            # Half of a run, on the side that is searched.
            need = np.maximum(-(-min_length // 2), -(-exponent * q // 2)) - q
            need = np.maximum(need, 1)
            first = middle[node] - q if back else middle[node]
            at = first - need if back else first
            fits = (at >= low[node]) & (at + need + q <= high[node])
            node, q, first, at, need = (x[fits] for x in (node, q, first, at, need))
            fits = stretches.same(at, q, need)
            node, q, first = (x[fits] for x in (node, q, first))
            start = first - stretches.reach(first, q, first - low[node], True)
            stop = first + q + stretches.reach(first, q, high[node] - first - q, False)
            long = stop - start >= np.maximum(min_length, exponent * q)
            out.append((node[long], start[long], stop[long], q[long]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(4))


def runs_of(ids: np.ndarray, n_ids: int, doc: np.ndarray, min_length: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs of documents laid end to end, sorted by start, then period."""
    grammar, tops, top_at = compress(ids, n_ids, doc)
    none = tuple(np.empty(0, np.int64) for _ in range(3))
    if not grammar.left:
        return none
    left, right, first = (np.concatenate(x) for x in (grammar.left, grammar.right, grammar.first))
    sizes = np.ones(grammar.size, np.int64)
    end = n_ids
    for a, b in zip(grammar.left, grammar.right):  # parts are named before the whole
        sizes[end : end + len(a)] = sizes[a] + sizes[b]
        end += len(a)
    wide = np.flatnonzero(sizes[n_ids:] >= min_length)
    low = first[wide]
    node, start, stop, q = boundary_runs(ids, low, low + sizes[left[wide]], low + sizes[wide + n_ids], min_length, exponent)
    if not len(node):
        return none
    # Runs of each symbol, side by side, relative to its beginning.
    symbol = wide[node]
    order = np.argsort(symbol, kind="stable")
    symbol, start, stop, q = symbol[order], start[order] - first[symbol[order]], stop[order] - first[symbol[order]], q[order]
    begin, end = np.searchsorted(symbol, np.arange(len(left))), np.searchsorted(symbol, np.arange(len(left)), "right")
    found, symbols, at = [], tops, top_at
    while True:
        keep = sizes[symbols] >= min_length
        symbols, at = symbols[keep] - n_ids, at[keep]
        if not len(symbols):
            break
        many = end[symbols] - begin[symbols]
        take = np.repeat(begin[symbols] - np.cumsum(many) + many, many) + np.arange(many.sum())
        move = np.repeat(at, many)
        found.append((start[take] + move, stop[take] + move, q[take]))
        symbols, at = np.concatenate((left[symbols], right[symbols])), np.concatenate((at, at + sizes[left[symbols]]))
    start, stop, q = (np.concatenate(x) for x in zip(*found))
    return merged(start, stop, q)


def merged(start: np.ndarray, stop: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that overlap by it or more made one; of equal intervals the one of the smallest period."""
    order = np.lexsort((stop, start, q))
    start, stop, q = start[order], stop[order], q[order]
    if len(q):
        # The furthest stop so far of each period: periods are set apart by more than all places.
        apart = q * (int(stop.max()) + 1)
        reach = np.maximum.accumulate(stop + apart) - apart
        heads = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (start[1:] > reach[:-1] - q[1:])])
        start, q, stop = start[heads], q[heads], np.maximum.reduceat(stop, heads)
        order = np.lexsort((q, stop, start))
        start, stop, q = start[order], stop[order], q[order]
        keep = np.r_[True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])]
        start, stop, q = start[keep], stop[keep], q[keep]
        order = np.lexsort((q, start))
        start, stop, q = start[order], stop[order], q[order]
    return start, stop, q


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Of (start, length, period) the one of most periods, then first."""
    return min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]))


def _chunks(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """Words of texts, of about CHUNK words together."""
    chunk, size = [], 0
    for text in texts:
        words = utf8(text).split()
        if chunk and size + len(words) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(words)
        size += len(words)
    if chunk:
        yield chunk


def _searched(min_length: int, exponent: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for chunk in _chunks(batch.column(1)):
                lengths = np.array([len(words) for words in chunk])
                heads = np.cumsum(lengths) - lengths
                numbers: dict[bytes, int] = {}
                ids = np.array([numbers.setdefault(w, len(numbers)) for words in chunk for w in words], np.int64)
                doc = np.repeat(np.arange(len(chunk)), lengths)
                start, stop, period = runs_of(ids, len(numbers), doc, min_length, exponent)
                runs: list[list[tuple[int, int, int]]] = [[] for _ in chunk]
                for d, a, b, q in zip(doc[start].tolist(), start.tolist(), stop.tolist(), period.tolist()):
                    runs[d].append((a - int(heads[d]), b - a, q))
                # Words after the first period of any run go.
                gone = np.zeros(len(ids) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, stop, -1)
                stays = np.cumsum(gone)[:-1] == 0
                collapsed = []
                for d, words in enumerate(chunk):
                    if runs[d]:
                        words = [words[i] for i in np.flatnonzero(stays[heads[d] : heads[d] + lengths[d]]).tolist()]
                    collapsed.append(b" ".join(words))
                keys = ("start", "length", "period")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(chunk)),
                        pa.array(lengths, pa.int64()),
                        pa.array([[dict(zip(keys, r)) for r in rs] for rs in runs], pa.list_(RUN)),
                        pa.array([dict(zip(keys, best_run(rs))) if rs else None for rs in runs], RUN),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "best", "collapsed"],
                )
                done += len(chunk)

    return searched


def periodic_runs(df: DataFrame, min_length: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) for each row of df: the runs by start, then period, the one of most periods, and the text
    without the words of runs after their first period, joined by single spaces.

    From 24 words and three periods on, the half of a run on one side of a boundary and its first period leave four words that return.
    """
    if min_length < 24 or exponent < 3:
        raise ValueError("runs are searched from 24 words and three periods on")
    docs = known_columns(df, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_searched(min_length, exponent), f"doc_id {kind}, n_words long, runs array<{RUN_SQL}>, best {RUN_SQL}, collapsed string")
