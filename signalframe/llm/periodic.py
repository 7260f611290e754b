"""Periodic runs of words: branching tandem repeats from an enhanced suffix array.

The word sequences of many documents share one suffix array whose keys start with
the document, so no repeat crosses documents. For every boundary between adjacent
suffixes, its LCP ``depth`` names an LCP interval that the boundary parts in two;
the suffixes i of the smaller part look up with the inverse suffix array whether
``i + depth`` or ``i - depth`` lies in the other part. Where it does, a square of
period ``depth`` ends that cannot move right. Rotating it left gives its run;
squares of one run meet at one end. Intervals are pairs of indices: no tree nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that one suffix array holds; a longer document has one for itself.
WORDS = 400_000
#: Words of two adjacent suffixes that are compared for all pairs at a time.
HEAD = 8


def suffix_array(words: np.ndarray, doc_end: np.ndarray):
    """``sa, rank`` of all suffixes, documents in order; a suffix ends with its document.

    ``doc_end[i]`` is where the document of word i ends. Only suffixes that are not
    yet alone are sorted again, each round by twice as many words.
    """
    n = len(words)
    base = np.int64(words.max(initial=0)) + 2
    key = doc_end * base + words
    order = np.argsort(key, kind="stable")
    group = np.r_[True, key[order][1:] != key[order][:-1]]
    start = np.flatnonzero(group)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
    length = np.repeat(np.diff(np.r_[start, n]), np.diff(np.r_[start, n]))
    open_ = order[length > 1]
    step = 1
    while len(open_):
        ahead = open_ + step
        inside = ahead < doc_end[open_]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        own = rank[open_]
        key = own * np.int64(n + 1) + second
        at = np.argsort(key, kind="stable")
        open_, own, key = open_[at], own[at], key[at]
        index = np.arange(len(open_))
        new = np.r_[True, key[1:] != key[:-1]]
        old = np.r_[True, own[1:] != own[:-1]]
        first = np.maximum.accumulate(np.where(new, index, 0))
        rank[open_] = own + first - np.maximum.accumulate(np.where(old, index, 0))
        size = np.diff(np.r_[np.flatnonzero(new), len(open_)])
        open_ = open_[np.repeat(size, size) > 1]
        step *= 2
    sa = np.empty(n, dtype=np.int64)
    sa[rank] = np.arange(n)
    return sa, rank


def lcp_array(words: np.ndarray, doc_end: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common words of each suffix with the one before it in the array, 0 for a document's first."""
    n = len(words)
    lcp = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(np.r_[False, doc_end[sa[1:]] == doc_end[sa[:-1]]])
    for depth in range(HEAD):
        a, b = sa[at - 1] + depth, sa[at] + depth
        inside = np.maximum(a, b) < doc_end[sa[at]]
        at, a, b = at[inside], a[inside], b[inside]
        at = at[words[a] == words[b]]
        lcp[at] = depth + 1
    if len(at):
        # The rest in text order: from one position to the next at most one word is lost.
        text, ends, where, before, last, have = words.tolist(), doc_end.tolist(), rank.tolist(), sa.tolist(), -2, 0
        for i in np.sort(sa[at]).tolist():
            k = where[i]
            j = before[k - 1]
            have = max(have - 1, HEAD) if i == last + 1 else HEAD
            most = ends[i] - max(i, j)
            while have < most and text[i + have] == text[j + have]:
                have += 1
            lcp[k] = have
            last = i
    return lcp


def parts(lcp: list[int]):
    """Begin of the part left of each boundary and end of the part right of it (0 and 0 without a common word).

    Of equal depths in one interval the first boundary parts the whole, the next
    ones its right side, so two suffixes are parted by one boundary, at the depth
    of their common words.
    """
    lo, hi, stack, floor = [0] * len(lcp), [0] * len(lcp), [], 0
    for k, depth in enumerate(lcp):
        while stack and lcp[stack[-1]] > depth:
            hi[stack.pop()] = k
        if depth:
            lo[k] = stack[-1] if stack else floor
            stack.append(k)
        else:
            floor = k
    for k in stack:
        hi[k] = len(lcp)
    return lo, hi


def branching_squares(sa, rank, lcp, doc_start, doc_end, indices):
    """``end, period`` of every square that cannot move right, among the suffixes at ``indices`` of the array."""
    lo, hi = parts(lcp[indices].tolist())
    at = np.flatnonzero(lcp[indices])
    k = indices[at]
    left, right = at - np.array(lo, dtype=np.int64)[at], np.array(hi, dtype=np.int64)[at] - at
    depth = lcp[k]
    # No square is longer than its document.
    fits = 2 * depth <= doc_end[sa[k]] - doc_start[sa[k]]
    k, left, right, depth = k[fits], left[fits], right[fits], depth[fits]
    # The smaller part's suffixes look for their partners in the other one.
    small = np.minimum(left, right)
    begin = np.where(left <= right, k - left, k)
    other_lo = np.where(left <= right, k, k - left)
    other_hi = np.where(left <= right, k + right, k)
    ends, periods = [], []
    stop = np.cumsum(small)
    for a, b in _slices(stop):
        n = small[a:b]
        own = np.repeat(np.arange(a, b), n)
        i = sa[begin[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)]
        d = depth[own]
        for j, inside in ((i + d, i + d < doc_end[i]), (i - d, i - d >= doc_start[i])):
            where = rank[np.where(inside, j, 0)]
            found = inside & (where >= other_lo[own]) & (where < other_hi[own])
            ends.append(np.minimum(i, j)[found] + 2 * d[found])
            periods.append(d[found])
    empty = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(ends or empty), np.concatenate(periods or empty)


def _slices(stop: np.ndarray, most: int = 1_000_000):
    """Index ranges whose sizes, with running total ``stop``, stay near ``most``."""
    a, before = 0, 0
    while a < len(stop):
        b = max(a + 1, int(np.searchsorted(stop, before + most, side="right")))
        yield a, b
        a, before = b, int(stop[b - 1])


def _rotate(words, start, period, floor):
    """How far each square at ``start`` can move left inside its document."""
    moved = np.zeros(len(start), dtype=np.int64)
    live = np.arange(len(start))
    for step in range(1, 17):
        a = start[live] - step
        live = live[a >= floor[live]]
        a = start[live] - step
        live = live[words[a] == words[a + period[live]]]
        moved[live] = step
    for i in live.tolist():
        at, d, low, block = int(start[i]) - 16, int(period[i]), int(floor[i]), 64
        while at > low:
            a = max(low, at - block)
            same = words[a:at] == words[a + d : at + d]
            if not same.all():
                at = at - int(same[::-1].argmin())
                break
            at, block = a, block * 2
        moved[i] = start[i] - at
    return moved


def runs_of(words: np.ndarray, sizes: np.ndarray, exponent: int = 4, least: int = 6):
    """``document, start, length, period`` of all runs, by document, start and period.

    ``words`` are numbers, one document after another; only runs of at least
    ``least`` words and ``exponent`` periods are given.
    """
    none = (np.zeros(0, dtype=np.int64),) * 4
    if not len(words):
        return none
    stops = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    doc_end, doc_start = stops[doc], (stops - sizes)[doc]
    sa, rank = suffix_array(words, doc_end)
    lcp = lcp_array(words, doc_end, sa, rank)
    # A wanted run of period q and its copy q words on share all but q words of it.
    share = min(max(least, exponent * q) - q for q in range(1, least + 1))
    longest = np.zeros(len(sizes), dtype=np.int64)
    np.maximum.at(longest, doc, lcp)
    indices = np.flatnonzero(longest[doc] >= share)
    if not len(indices):
        return none
    end, period = branching_squares(sa, rank, lcp, doc_start, doc_end, indices)
    if not len(end):
        return none
    order = np.lexsort((period, end))
    end, period = end[order], period[order]
    found_start, found_end, found_period = [], [], []
    while len(end):
        first = np.r_[True, end[1:] != end[:-1]]
        e, q = end[first], period[first]
        start = e - 2 * q
        start = start - _rotate(words, start, q, doc_start[start])
        found_start.append(start)
        found_end.append(e)
        found_period.append(q)
        # Squares that end here and lie inside repeat this run with a multiple of its period.
        begins = np.repeat(start, np.diff(np.r_[np.flatnonzero(first), len(end)]))
        rest = ~first & (2 * period > end - begins)
        end, period = end[rest], period[rest]
    start, end, period = map(np.concatenate, (found_start, found_end, found_period))
    wanted = end - start >= np.maximum(least, exponent * period)
    start, end, period = start[wanted], end[wanted], period[wanted]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    return doc[start], start - doc_start[start], end - start, period


def _chunks(sizes: np.ndarray):
    a, total = 0, 0
    for b, n in enumerate(sizes.tolist()):
        if total and total + n > WORDS:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def _find(exponent, least, carried):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            lists = batch.column(carried)
            for a, b in _chunks(np.diff(lists.offsets.to_numpy())):
                part = lists.slice(a, b - a)
                sizes = np.diff(part.offsets.to_numpy()).astype(np.int64)
                flat = part.flatten()
                words = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
                doc, start, length, period = runs_of(words, sizes, exponent, least)
                offsets = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                found = pa.StructArray.from_arrays([pa.array(v) for v in (start, length, period)], fields=list(kind))
                found = pa.ListArray.from_arrays(offsets(np.bincount(doc, minlength=b - a)), found)
                base = (np.cumsum(sizes) - sizes)[doc] + start
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, base + period, 1)
                np.add.at(edge, base + length, -1)
                kept = np.cumsum(edge[:-1]) == 0
                left = np.add.reduceat(np.r_[kept, False].astype(np.int64), np.minimum(np.cumsum(sizes) - sizes, len(words)))
                left[sizes == 0] = 0
                text = pc.binary_join(pa.ListArray.from_arrays(offsets(left), flat.filter(pa.array(kept))), " ")
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(a, b - a) for i in range(carried)], pa.array(sizes), found, text],
                    [*batch.schema.names[:carried], "n_words", "runs", "collapsed"],
                )

    return run


def find_runs(docs: DataFrame, words: Column, key=("doc_id",), exponent: int = 4, least: int = 6) -> DataFrame:
    """``key, n_words, runs, collapsed``: the runs of each row's word list, and its words without their repeats.

    A run is a longest stretch of words that repeat with a smallest period q, of
    at least ``exponent`` periods and ``least`` words; ``runs`` holds ``start``
    (from 0), ``length`` and ``period``, by start and period. A word that any run
    contains after that run's first period is left out of ``collapsed``, which is
    joined by single spaces.

    A null list counts as empty: no runs, an empty text. Rows that repeat give
    their results again, an empty table an empty one. Other columns, whatever
    their names, are not read. Rows are taken where they are, without a shuffle;
    a task holds the words of one Arrow batch.
    """
    key = list(key)
    rows = docs.select(*key, F.coalesce(words, F.array().cast("array<string>")).alias("__words"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    return rows.mapInArrow(_find(exponent, least, len(key)), schema + ", n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(words: Column, key: Column) -> Column:
    """The words of ``key``'s row, with a periodic tail for one key in ten.

    ``h`` is the crc32 of the key's decimal text and ``g = floor(h / 10)``. If h ends in 0
    and there are n > 0 words, each word i from ``a = g % n`` on becomes word
    ``a + (i - a) % p``, ``p = 1 + floor((n - a) / (3 + g % 8))``. A null key plants nothing.
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def edit(w):
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + F.pmod(i - a, p)))
        return F.when((h % 10 == 0) & (n > 0), F.concat(F.slice(w, 1, a), tail)).otherwise(w)

    return F.get(F.transform(F.array(words), edit), F.lit(0))
