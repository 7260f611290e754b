"""Bigram scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to ``1 + floor(log_b(count))``. An
n-gram with quantised count q is put into the filter q times, as (n-gram, 1) ..
(n-gram, q); a reader probes j = 1, 2, ... until the first miss and takes the
middle of that step as the count. The filter's size is fixed; words and pairs
enter from the smallest count on at which all of them fit at the wanted error, so
the broadcast never passes ``filter_bytes``. Counting covers every training text.

N-grams with smaller counts are not in the filter, and none of them is left out:
texts are dealt to chunks, a chunk asks for the n-grams that the filter does not
have, the counts answer slice by slice of the hashes, and the chunk is scored with
both. An answer is quantised like the filter's counts. A training text's pair that no
one else holds counts one; pairs seen once are kept only if a held-out text has them.

The base score needs exact counts of all words. The most frequent ones (at most
``FREQUENT``, chosen from a table of counts of counts) travel as a broadcast; a
chunk asks for the others with its n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, distinct, keep, mix64, text_of

FREQUENT = 1 << 18
FILTER_BYTES = 1 << 25
BITS_PER_ITEM = 9
PROBES = 4
BASE = 1.3
#: Weight of the word distribution against a context's own pairs.
PRIOR = 60.0
#: Tokens a task gathers before it sends counts on.
FLUSH = 3_000_000
SEGMENT = 1 << 17
#: Characters of text that ask and are scored together.
CHUNK = 1 << 22
_LINE = 1 << 9  # bits of one filter line, in which all probes of an item lie
_END = np.uint64(0x5851F42D4C957F2D)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _tokens(texts: list[bytes]):
    """Word hashes of all texts with one end token after each, and the texts' lengths in tokens."""
    words = Words(texts, lower=True)
    sizes = words.counts + 1
    out = np.full(int(sizes.sum()), _END, dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = words.hashes()
    return out, sizes


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """Hash of (token before, token); the end stands before a text's first token."""
    before = np.r_[_END, tokens[:-1]]  # a text's last token is the end
    return mix64(before * _GOLD + tokens)


def _pieces(texts, most=1 << 22):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield texts[at : i + 1], at
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:], at


def _sliced(values: np.ndarray, slices: int):
    """``(slice, from, to)`` of sorted hashes for every slice that has some."""
    where = (values >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    cuts = np.searchsorted(where, np.arange(slices + 1, dtype=np.uint64)).tolist()
    return [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def _count(slices: int):
    """(text, held out) -> (kind, slice, blob of hashes, blob of counts), sorted and added up per task.

    A held-out text's pairs go along with count 0, so that their slice keeps them.
    """

    def flush(kind, hashes, seen=1):
        values, counts = np.unique(np.concatenate(hashes), return_counts=True)
        counts = counts * seen
        rows = [(kind, s, values[a:b].tobytes(), np.minimum(counts[a:b], 2**31 - 1).astype("<u4").tobytes()) for s, a, b in _sliced(values, slices)]
        cols = list(zip(*rows))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["kind", "slice", "hashes", "counts"])

    def run(batches):
        words, pairs, asked, n = [], [], [], 0

        def send():
            for kind, hashes, seen in ((1, words, 1), (2, pairs, 1), (2, asked, 0)):
                if any(map(len, hashes)):
                    yield flush(kind, hashes, seen)
                hashes.clear()

        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for texts, at in _pieces(batch.column(0).cast(pa.binary()).to_pylist()):
                tokens, sizes = _tokens(texts)
                out = np.repeat(held[at : at + len(texts)].astype(bool), sizes)
                both = _pairs(tokens)
                words.append(tokens[~out])
                pairs.append(both[~out])
                asked.append(both[out])
                n += len(tokens)
                if n >= FLUSH:
                    yield from send()
                    n = 0
        yield from send()

    return run


def _merge(batches):
    """Blobs of one (kind, slice), sorted together by Spark -> rows (kind, hash, count).

    Pairs seen once are left out if no held-out text has them.
    """

    def done(key, parts):
        hashes = np.concatenate([np.frombuffer(h, "<u8") for h, _ in parts])
        counts = np.concatenate([np.frombuffer(c, "<u4") for _, c in parts]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        start = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        total = np.add.reduceat(counts, start)
        kept = (total > 1) | ((total == 1) & (np.minimum.reduceat(counts, start) == 0)) if key[0] == 2 else total > 0
        values = hashes[start][kept].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), key[0], np.int32)), pa.array(values), pa.array(total[kept])], ["kind", "hash", "count"])

    key, parts = None, []
    for batch in batches:
        for k, s, h, c in zip(*[col.to_pylist() for col in batch.columns]):
            if key != (k, s) and parts:
                yield done(key, parts)
                parts = []
            key = (k, s)
            parts.append((h, c))
    if parts:
        yield done(key, parts)


def counts(docs: DataFrame, held, slices: int) -> DataFrame:
    """``(kind, hash, count)`` in training texts: every word (kind 1), and every pair (kind 2)
    seen at least twice or seen once and again in a held-out text."""
    blobs = docs.select(text_of().alias("text"), held.alias("held")).mapInArrow(_count(slices), "kind int, slice int, hashes binary, counts binary")
    blobs = blobs.repartition("kind", "slice").sortWithinPartitions("kind", "slice")
    return keep(blobs.mapInArrow(_merge, "kind int, hash long, count long"), "counts")


def _levels(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def _middle(level):
    """The count that stands for a step."""
    return np.where(level > 1, BASE ** (level - 0.5), 1.0)


def _bits(items: np.ndarray, lines: int):
    """Line of each item and its bit positions inside."""
    line = ((items >> np.uint64(32)) * np.uint64(lines)) >> np.uint64(32)
    low = mix64(items + _GOLD)
    return line.astype(np.int64), [((low >> np.uint64(9 * i)) & np.uint64(_LINE - 1)).astype(np.int64) for i in range(PROBES)]


def _item(hashes: np.ndarray, kind, level) -> np.ndarray:
    return mix64(hashes + np.asarray(kind, np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.asarray(level, np.uint64) * _GOLD)


def _item_rows(lines: int, per: int):
    """(kind, hash, count) -> (segment, blob of items)."""

    def run(batches):
        for batch in batches:
            kind, hashes, count = (c.to_numpy() for c in batch.columns)
            level = _levels(count)
            at = np.repeat(np.arange(len(level)), level)
            j = np.arange(len(at)) - np.repeat(np.cumsum(level) - level, level) + 1
            items = _item(hashes.view(np.uint64)[at], kind[at], j)
            items.sort()
            segment = _bits(items, lines)[0] // per
            cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(items) else np.array([], int)
            ends = np.r_[cuts[1:], len(items)] if len(items) else cuts
            blobs = [items[a:b].tobytes() for a, b in zip(cuts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(segment[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], ["segment", "items"])

    return run


def _build(lines: int, per: int):
    """Sorted (segment, items) -> (segment, bits of its lines)."""

    def run(batches):
        now, bits = None, None
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])
        for batch in batches:
            for segment, items in zip(*[c.to_pylist() for c in batch.columns]):
                if segment != now:
                    if now is not None:
                        yield pack()
                    now, bits = segment, np.zeros(per * _LINE, dtype=bool)
                line, spots = _bits(np.frombuffer(items, "<u8"), lines)
                for s in spots:
                    bits[(line - now * per) * _LINE + s] = True
        if now is not None:
            yield pack()

    return run


def build_filter(table: DataFrame, filter_bytes: int = FILTER_BYTES) -> tuple[np.ndarray, int, int]:
    """Filter bytes (at most ``filter_bytes``), number of lines, and the least count that entered."""
    level = (F.floor(F.log(F.col("count").cast("double")) / float(np.log(BASE)) + 1e-9) + 1).cast("long")
    # One row per quantised count: a few hundred at most.
    steps = table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).collect()
    steps = sorted((r.level, r.n, r.least) for r in steps)
    room = filter_bytes * 8 // BITS_PER_ITEM
    total = sum(lv * n for lv, n, _ in steps)
    least = 1
    for lv, n, _ in steps:
        if total <= room:
            break
        total -= lv * n
        least = next((s[2] for s in steps if s[0] > lv), 1 << 62)
    per = SEGMENT * 8 // _LINE
    lines = max(1, min(-(-total * BITS_PER_ITEM // _LINE), filter_bytes * 8 // _LINE))
    items = table.filter(F.col("count") >= least).select("kind", "hash", "count").mapInArrow(_item_rows(lines, per), "segment int, items binary")
    built = items.repartition("segment").sortWithinPartitions("segment").mapInArrow(_build(lines, per), "segment int, bits binary")
    out = np.zeros(-(-lines // per) * SEGMENT, dtype=np.uint8)
    for r in keep(built, "filter").collect():  # in all at most filter_bytes and one segment
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.bits, np.uint8)
    return out, lines, least


def probe(bits: np.ndarray, lines: int, hashes: np.ndarray, kind: int) -> np.ndarray:
    """Estimated counts by repeated membership probes; 0 if the first one misses."""
    out, live, level = np.zeros(len(hashes)), np.arange(len(hashes)), 0
    while len(live):
        level += 1
        line, spots = _bits(_item(hashes[live], kind, level), lines)
        hit = np.ones(len(live), bool)
        for s in spots:
            at = line * _LINE + s
            hit &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        live = live[hit]
        out[live] = _middle(level)
    return out


def _lookup(hashes: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of ``wanted`` in sorted ``hashes``, 0 for those that are not there."""
    if not len(hashes):
        return np.zeros(len(wanted))
    spot = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[spot] == wanted, counts[spot], 0)


def _texts_of(table: pa.Table):
    """Texts of a chunk and whether each is held out."""
    table = table.combine_chunks()
    return table.column("text").cast(pa.binary()).to_pylist(), table.column("held_out").to_numpy().astype(bool)


def _asked_pairs(bits, lines, least, tokens, sizes, held):
    """A chunk's pairs that need an answer.

    Pairs seen ``least`` times are in the filter. With a least of two, a training text's
    own pair is in it or seen once; with one, no pair is missing.
    """
    open_ = np.repeat((held & (least > 1)) | (least > 2), sizes)
    pair = distinct(_pairs(tokens)[open_])
    return pair[probe(bits, lines, pair, 2) == 0]


def _ask(shared, least: int, slices: int):
    """A chunk -> (chunk, kind, slice, blob of sorted hashes) of what the broadcasts do not say."""

    def run(table):
        bits, lines, frequent, _ = shared.value
        texts, held = _texts_of(table)
        tokens, sizes = _tokens(texts)
        word = distinct(tokens)
        asked = word[_lookup(frequent, np.ones(len(frequent)), word) == 0], _asked_pairs(bits, lines, least, tokens, sizes, held)
        rows = [(k + 1, s, h[a:b].tobytes()) for k, h in enumerate(asked) for s, a, b in _sliced(h, slices)]
        kinds, where, blobs = zip(*rows) if rows else ((), (), ())
        chunk = np.full(len(rows), table.column("chunk")[0].as_py(), np.int32)
        return pa.table([pa.array(chunk), pa.array(kinds, pa.int32()), pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "kind", "slice", "hashes"])

    return run


def _answer(asked, table):
    """What chunks ask of one (kind, slice), and its counts -> (chunk, kind, slice, blob of counts)."""
    hashes, found = table.column("hash").to_numpy().view(np.uint64), table.column("count").to_numpy()
    order = np.argsort(hashes)
    hashes, found = hashes[order], found[order]
    blobs = [_lookup(hashes, found, np.frombuffer(h, "<u8")).astype("<i8").tobytes() for h in asked.column("hashes").to_pylist()]
    return pa.table([*(asked.column(c) for c in ("chunk", "kind", "slice")), pa.array(blobs, pa.binary())], ["chunk", "kind", "slice", "counts"])


_ROW = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shared, least: int, n_train: int, n_words: int):
    """A chunk and the answers to what it asked, in its order -> one row per text."""

    def run(table, answers):
        bits, lines, frequent, frequent_count = shared.value
        floor = n_train + 0.5 * (n_words + 1)
        texts, held = _texts_of(table)
        said = {1: b"", 2: b""}
        for kind, _, blob in sorted(zip(*[answers.column(c).to_pylist() for c in ("kind", "slice", "counts")])):
            said[kind] += blob
        tokens, sizes = _tokens(texts)
        n = len(sizes)
        doc = np.repeat(np.arange(n), sizes)
        word, back = np.unique(tokens, return_inverse=True)
        exact = _lookup(frequent, frequent_count, word).astype(np.float64)
        exact[exact == 0] = np.frombuffer(said[1], "<i8")
        base = np.bincount(doc, np.log10((exact + 0.5) / floor)[back], n)
        n_known = np.bincount(doc, (exact > 0)[back], n).astype(np.int64)
        seen = probe(bits, lines, word, 1)
        below = (seen == 0) & (exact > 0)
        seen[below] = _middle(_levels(exact[below]))
        uni = (seen + 0.5) / floor
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        end = np.searchsorted(word, _END)
        before = np.r_[end, back[:-1]]
        before[first] = end
        pair, where = np.unique(_pairs(tokens), return_inverse=True)
        together = probe(bits, lines, pair, 2)
        asked = pair[together == 0] if least > 2 else _asked_pairs(bits, lines, least, tokens, sizes, held)
        exact = _lookup(asked, np.frombuffer(said[2], "<i8"), pair)
        below = (together == 0) & (exact > 0)
        together[below] = _middle(_levels(exact[below]))
        # A training text holds its own pairs: one that no one counted is there once.
        together = np.maximum(together[where], ~held[doc])
        context = seen[before]
        # Pairs of a context cannot outnumber it; the rest of the mass follows the words.
        p = (np.minimum(together, context) + PRIOR * uni[back]) / (context + PRIOR)
        score = np.bincount(doc, np.log10(p), n)
        trained = np.full(n, n_train, np.int64)
        return pa.table([table.column("doc_id"), table.column("held_out"), *map(pa.array, (sizes, n_known, trained, base, score))], _NAMES)

    return run


_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def score(docs: DataFrame, held_out=None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    ``held_out`` is a condition on ``doc_id`` (default: crc32 of its text mod 5 is
    1); the rest is learned from. Tokens are the words, A-Z lower-cased, and one
    end. A null text is empty; a null ``doc_id`` is never held out; rows that
    repeat are each counted and each scored; without training text every count
    is 0; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    if held_out is None:
        held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    held = F.coalesce(held_out, F.lit(False))
    chars = docs.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    slices = max(1, chars // 12_000_000)  # about two million different pairs each
    table = counts(docs, held, slices)
    words = table.filter("kind = 1")
    n_train, n_words = words.agg(F.sum("count"), F.count(F.lit(1))).collect()[0]
    n_train, n_words = n_train or 0, n_words or 0
    # Counts of counts, in steps: how many words have at least so many.
    steps = words.groupBy(F.floor(F.log2(F.col("count").cast("double")) * 16).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).collect()
    least, have = 1 << 62, 0
    for r in sorted(steps, key=lambda r: -r.step):
        if have + r.n > FREQUENT:
            break
        have, least = have + r.n, r.least
    top = words.filter(F.col("count") >= least).select("hash", "count").toPandas()  # at most FREQUENT rows
    order = np.argsort(top["hash"].to_numpy().astype(np.int64).view(np.uint64))
    frequent = top["hash"].to_numpy().astype(np.int64).view(np.uint64)[order]
    bits, lines, entered = build_filter(table, filter_bytes)
    shared = spark.sparkContext.broadcast((bits, lines, frequent, top["count"].to_numpy().astype(np.float64)[order]))
    doc_id, chunk = F.col("doc_id").cast("long"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chars // CHUNK + 1)).cast("int")
    rows = docs.select(doc_id.alias("doc_id"), held.alias("held_out"), text_of().alias("text"), chunk.alias("chunk"))
    asked = rows.groupBy("chunk").applyInArrow(_ask(shared, entered, slices), "chunk int, kind int, slice int, hashes binary")
    rest = table.filter(F.col("count") < F.when(F.col("kind") == 1, F.lit(least)).otherwise(F.lit(entered)))
    rest = rest.withColumn("slice", F.shiftright(F.shiftrightunsigned("hash", 32) * slices, 32).cast("int"))
    answers = asked.groupBy("kind", "slice").cogroup(rest.groupBy("kind", "slice")).applyInArrow(_answer, "chunk int, kind int, slice int, counts binary")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(shared, entered, n_train, n_words), _ROW)
