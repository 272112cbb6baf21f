"""Periodic runs of words, found by internal pattern matching, and their collapse.

A run is a stretch of words with smallest period q (words q apart are equal), of
at least ``max(least, times * q)`` words, that no neighbouring word extends.

A run of period q, 2**k <= q < 2**(k + 1), holds a dyadic block of 2**k words
within its first 2**(k + 1) - 1 words, and the block occurs again q words on.
So every block of every level asks for its occurrences that start 2**k to
2**(k + 1) - 1 words after it: range successor queries, by a wavelet matrix over
the suffix array, inside the block's suffix interval. As they start in a window
no longer than the block, they form an arithmetic progression. Of one or two
occurrences each distance is a candidate period; of three or more, with step t,
the block itself has period t, and only the first distance and the distance
between the ends of the two t-periodic stretches can be a period. A candidate is
extended to both sides by longest common extensions, read from the ranks of all
power-of-two blocks that building the suffix array leaves behind. The smallest
candidate of a stretch is its period. Exact: blocks are passed over only if a
run's block would have more occurrences than they have.

Texts share no symbols, so no match crosses from one to the next. Texts are handled
in chunks of about ``CHUNK`` bytes; a longer text is a chunk of its own and takes
about 60 bytes a word, and 4 more for each doubling of its longest candidate block.

Null, empty and blank texts have no words and no runs; their collapsed text is
empty. Rows stay apart whatever their id: a null or repeated id changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plan_alloc.llm.common import map_batches, text_bytes

CHUNK = 500_000  # bytes of text handled at a time in a task
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def block_ranks(symbols: np.ndarray, rare: int, top: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array by the first 2**top symbols, and for every level k the place of the
    first suffix that shares a suffix's first 2**k symbols. Symbols seen under ``rare``
    times equal nothing, not even themselves elsewhere."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.ones(n, bool)
    first[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(first)
    size = np.diff(begin, append=n)
    first |= np.repeat(size < rare, size)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels = [rank]
    for k in range(top):
        alone = first & np.append(first[1:], True)
        at = np.flatnonzero(~alone)
        rank = rank.copy()
        if len(at):
            some = order[at]
            after = some + (1 << k)
            key = rank[some].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            key, some = key[by], some[by]
            order[at] = some
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            first[at] = new
            rank[some] = np.maximum.accumulate(np.where(new, at, 0))
        levels.append(rank)
    return order, levels


class WaveletMatrix:
    """Bit planes of a permutation, from the highest; answers range successor queries for arrays of queries."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.planes = []
        for bit in range(max(1, int(n - 1).bit_length()) - 1, -1, -1):
            zero = (values >> bit & 1) == 0
            count = np.zeros(n + 1, np.int32)
            np.cumsum(zero, out=count[1:])
            self.planes.append((bit, count))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values at places lo..hi are less than ``bound`` (itself within the planes' bits)."""
        found = np.zeros(len(lo), np.int64)
        for bit, count in self.planes:
            low, high = count[lo], count[hi]
            one = (bound >> bit & 1) == 1
            found += np.where(one, high - low, 0)
            lo, hi = np.where(one, count[-1] + lo - low, low), np.where(one, count[-1] + hi - high, high)
        return found

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest value (from 0) at places lo..hi."""
        value = np.zeros(len(lo), np.int64)
        for bit, count in self.planes:
            low, high = count[lo], count[hi]
            one = n >= high - low
            n = np.where(one, n - (high - low), n)
            value |= one.astype(np.int64) << bit
            lo, hi = np.where(one, count[-1] + lo - low, low), np.where(one, count[-1] + hi - high, high)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``bound`` at places lo..hi; the number of values if there is none."""
        size = len(self.planes[0][1]) - 1
        out = np.full(len(lo), size, np.int64)
        inside = np.flatnonzero(bound < size)
        lo, hi = lo[inside], hi[inside]
        less = self.below(lo, hi, bound[inside])
        there = less < hi - lo
        out[inside[there]] = self.nth(lo[there], hi[there], less[there])
        return out


def _extent(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
    """How far the words from i and j on (or, not ``ahead``, before i and j) are equal; i < j."""
    n = len(levels[0])
    i, j = i.copy(), j.copy()
    far = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step, rank = 1 << k, levels[k]
        on = np.arange(len(i))
        while len(on):  # at the top level as often as it goes, then once a level
            on = on[(j[on] < n) if ahead else (i[on] >= step)]
            a, b = (i[on], j[on]) if ahead else (i[on] - step, j[on] - step)
            on = on[rank[a] == rank[b]]
            far[on] += step
            i[on] += step if ahead else -step
            j[on] += step if ahead else -step
            if k < len(levels) - 1:
                break
    return far


def find_runs(symbols: np.ndarray, longest: int, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run, by start and then period. ``longest``: the
    longest stretch of symbols that can repeat (a text's length). ``times``: 4 or more."""
    none = np.zeros(0, np.int64)
    n = len(symbols)
    if longest < max(least, times):
        return none, none, none
    top = (longest // times).bit_length() - 1
    order, levels = block_ranks(symbols, times, top + 1)
    if (np.bincount(levels[0], minlength=n) < 2).all():
        return none, none, none
    tree = None
    at, by = [], []
    size = np.bincount(levels[0], minlength=n)
    for k in range(top + 1):
        block, size_next = 1 << k, np.bincount(levels[k + 1], minlength=n)
        p = np.arange(0, n, block)
        # In a run the block occurs three times, and the block of twice its length twice.
        p = p[(size[levels[k][p]] >= 3) & (size_next[levels[k + 1][p]] >= 2)]
        if len(p):
            tree = tree or WaveletMatrix(order)
            lo = levels[k][p].astype(np.int64)
            hi = lo + size[lo]
            hit = tree.successor(lo, hi, p + block)
            here = np.flatnonzero(hit < p + 2 * block)
            p, lo, hi, one = p[here], lo[here], hi[here], hit[here]
            at.append(p)
            by.append(one - p)
            two = tree.successor(lo, hi, one + 1)
            here = np.flatnonzero(two < p + 2 * block)
            p, lo, hi, one, two = p[here], lo[here], hi[here], one[here], two[here]
            more = tree.successor(lo, hi, two + 1) < p + 2 * block
            at.append(p[~more])
            by.append(two[~more] - p[~more])
            p, one, step = p[more], one[more], two[more] - one[more]
            ends = one + _extent(levels, one, one + step, True) - p - _extent(levels, p, p + step, True)
            here = (ends >= block) & (ends < 2 * block)
            at.append(p[here])
            by.append(ends[here])
            for part in (-3, -2, -1):
                a, d = at[part], by[part]
                same = np.flatnonzero(a + d < n)
                same = same[levels[k + 1][a[same]] == levels[k + 1][a[same] + d[same]]]
                at[part], by[part] = a[same], d[same]
        size = size_next
    if not at:
        return none, none, none
    p, d = np.concatenate(at), np.concatenate(by)
    end = p + d + _extent(levels, p, p + d, True)
    start = p - _extent(levels, p, p + d, False)
    fit = end - start >= np.maximum(least, times * d)
    start, end, d = start[fit], end[fit], d[fit]
    by = np.lexsort((d, end, start))
    start, end, d = start[by], end[by], d[by]
    new = np.ones(len(by), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, d = start[new], end[new], d[new]
    by = np.lexsort((d, start))
    return start[by], end[by], d[by]


def _words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word of the texts, and the number of its text."""
    letter = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text's first byte
    begin[edge] = letter[edge]
    start = np.flatnonzero(begin)
    count = np.cumsum(letter)
    length = np.diff(count[start] - 1, append=count[-1] if len(count) else 0)
    return start, length, np.searchsorted(offsets, start, "right") - 1


def collapse_chunk(flat: np.ndarray, offsets: np.ndarray, least: int, times: int) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Of the texts between ``offsets``: words each; runs as text, start, length and period;
    the collapsed texts' bytes and their sizes."""
    texts = len(offsets) - 1
    start, length, of = _words(flat, offsets)
    n_words = np.bincount(of, minlength=texts)
    before = np.cumsum(n_words) - n_words
    kept = np.ones(len(start), bool)
    runs = (np.zeros(0, np.int64),) * 4
    if len(start):
        index = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(flat[index])]).dictionary_encode()
        symbols = of * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        a, z, period = find_runs(symbols, int(n_words.max()), least, times)
        if len(a):
            edge = np.zeros(len(start) + 1, np.int64)
            np.add.at(edge, a + period, 1)
            np.add.at(edge, z, -1)
            kept = np.cumsum(edge[:-1]) == 0
            runs = (of[a], a - before[of[a]], z - a, period)
    start, length, of = start[kept], length[kept], of[kept]
    # Every word with the space after it, but for a text's last word.
    last = np.ones(len(of), bool)
    last[:-1] = of[1:] != of[:-1]
    size = length + ~last
    put = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(put, length) + within] = flat[np.repeat(start, length) + within]
    return n_words, runs, out, np.bincount(of, weights=size, minlength=texts).astype(np.int64)


def collapse(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """Per row: id, n_words, runs (start and length in words, period; by start, then
    period) and ``collapsed``, the words joined by one space without those that any run
    holds after its first period. ``times`` must be 4 or more."""
    if times < 4 or least < 1:
        raise ValueError("times must be 4 or more and least 1 or more")

    def work(batch):
        flat, offsets = text_bytes(batch.column(1))
        first = 0
        while first < batch.num_rows:
            stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
            own = offsets[first : stop + 1]
            n_words, (of, start, length, period), kept, size = collapse_chunk(flat[own[0] : own[-1]], own - own[0], least, times)
            fields = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            edges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=stop - first))])
            runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), fields)
            ends = np.concatenate([[0], np.cumsum(size)])
            wide = ends[-1] >= 1 << 31
            text = pa.Array.from_buffers(pa.large_string() if wide else pa.string(), stop - first, [None, pa.py_buffer(ends.astype(np.int64 if wide else np.int32)), pa.py_buffer(kept)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), pa.array(n_words, pa.int64()), runs, text], ["id", "n_words", "runs", "collapsed"])
            first = stop

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)
