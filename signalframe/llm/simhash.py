"""SimHash fingerprints and near-duplicate groups by the generalised pigeonhole.

The bits of a fingerprint are cut into parts; part *i* gets a threshold *e_i*
(-1: never looked up) with ``sum(e_i) = d - parts + 1``. Two fingerprints within
``d`` bits then agree within ``e_i`` bits in at least one part. Bits that go
together share a part, and a dynamic program spreads the thresholds by candidate
counts estimated on a bounded sample, for every number of parts; the cheapest
plan wins. The plan changes cost only: any plan finds every pair.

A part is probed by setting up to ``e_i`` zero bits. Two values that differ in at
most ``e_i`` bits meet at their bitwise or, so one kind of row serves as index and
as probe. A bucket over ``BLOCK`` rows is compared block against block in several
tasks. A task checks whole fingerprints and returns only a least spanning forest
of the pairs that pass, so a group of n near copies gives about n links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, row_key, shingle_hashes, text_of, words_of
from .components import components

BLOCK = 512
#: Distinct fingerprints the plan is estimated on.
SAMPLE = 2048
#: Pairs a row up to which a bucket gives all of them at once for exact tests.
PAIRS = 64
#: Cost of one emitted row in units of one compared pair.
ROW_COST = 400.0
_STEP = 1 << 15


def _mix64(h: np.ndarray) -> np.ndarray:
    """Second 64 bits from the first (the finaliser of splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingles(words: list[bytes], k: int):
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*[words[i:] for i in range(k)]))


def fingerprint(text: bytes, k: int, lanes: int, once: bool = False) -> str:
    """Hex fingerprint of ``64 * lanes`` bits; a bit is set if over half the shingles set it.

    ``once`` counts a repeated shingle one time.
    """
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in _shingles(text.lower().split(), k)], dtype=np.uint64)
    if once:
        hashes = np.unique(hashes)
    if not len(hashes):
        return "0" * 16 * lanes
    out = []
    for lane in range(lanes):
        if lane:
            hashes = _mix64(hashes)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), _STEP):
            part = np.ascontiguousarray(hashes[at : at + _STEP].astype(">u8"))
            ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes)).tobytes().hex())
    return "".join(out)


def fingerprints(docs: DataFrame, k: int = 3, lanes: int = 1, once: bool = False) -> DataFrame:
    """``(doc_id, row, text_key, fingerprint)`` per row; A-Z is lower-cased, a null text is empty, a text without words gives zero."""

    def run(batches):
        for batch in batches:
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            prints = [fingerprint(t, k, lanes, once) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints, pa.string())], ["doc_id", "row", "text_key", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, text_key long, fingerprint string")


def _lanes_of(prints: list[str]) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(prints)), dtype=">u8").astype(np.uint64)
    return raw.reshape(len(prints), -1)


def _bit(lanes: np.ndarray, b: int) -> np.ndarray:
    return (lanes[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)


def _part_value(lanes: np.ndarray, bits) -> np.ndarray:
    value = np.zeros(len(lanes), dtype=np.int64)
    for at, b in enumerate(bits):
        value |= _bit(lanes, b).astype(np.int64) << at
    return value


def _group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of near equal width; each grows by the bit that goes best with it."""
    free, out = set(range(len(corr))), []
    for p in range(parts):
        width = len(free) // (parts - p)
        first = max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())
        part = [first]
        free.remove(first)
        while len(part) < width:
            best = max(sorted(free), key=lambda b: corr[b, part].sum())
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def _rows_for(width: int, e: int) -> float:
    """Expected keys of one fingerprint: up to ``e`` of about half the bits are raised."""
    zeros, rows, term = width / 2, 0.0, 1.0
    for j in range(e + 1):
        rows += term
        term *= max(zeros - j, 0) / (j + 1)
    return rows


def plan(sample: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """``[(bits, threshold)]`` for ``total`` fingerprints, estimated on ``sample`` (rows of lanes)."""
    n_bits = 64 * sample.shape[1]
    if not len(sample):
        sample = np.zeros((1, sample.shape[1]), np.uint64)
    bits = np.stack([_bit(sample, b) for b in range(n_bits)]).astype(np.float64)
    centred = bits - bits.mean(axis=1, keepdims=True)
    scale = np.sqrt((centred**2).sum(axis=1))
    corr = np.abs(centred @ centred.T) / np.maximum(np.outer(scale, scale), 1e-9)
    np.fill_diagonal(corr, 0)
    n = len(sample)
    times = (total / max(n, 1)) ** 2 / 2
    best = None
    for parts in range(2, max(3, min(distance, 14) + 2)):
        groups = _group_bits(corr, parts)
        costs = []
        for g in groups:
            most = 2 if len(g) <= 24 else 1
            value = _part_value(sample, g).astype(np.uint64)
            near = np.zeros(most + 1)
            for at in range(0, n, 512):
                d = np.bitwise_count(value[at : at + 512, None] ^ value[None, :])
                near += np.bincount(d.ravel(), minlength=most + 1)[: most + 1]
            # One more than seen: an empty sample cell is no proof of none.
            pairs = np.cumsum(near) - n + 1 + n * n * 0.5 ** len(g)
            costs.append([0.0] + [pairs[e] * times + ROW_COST * total * _rows_for(len(g), e) for e in range(most + 1)])
        goal = distance + 1  # thresholds plus one each
        table = {0: (0.0, ())}
        for c in costs:
            step = {}
            for have, (cost, chosen) in table.items():
                for e, more in enumerate(c):
                    at = min(goal, have + e)
                    if at not in step or cost + more < step[at][0]:
                        step[at] = (cost + more, (*chosen, e - 1))
            table = step
        if goal in table and (best is None or table[goal][0] < best[0]):
            best = (table[goal][0], [(g, e) for g, e in zip(groups, table[goal][1]) if e >= 0])
    return best[1]


def _keys(pieces):
    """fingerprints -> (part, key, flips, lanes) rows."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                prints = whole.slice(at, 2048).column(0).to_pylist()
                if not prints:
                    continue
                lanes = _lanes_of(prints)
                cols: list[list[np.ndarray]] = [[] for _ in range(3 + lanes.shape[1])]
                for p, (bits, e) in enumerate(pieces):
                    value = _part_value(lanes, bits)
                    for flips in range(e + 1):
                        for up in combinations(range(len(bits)), flips):
                            mask = sum(1 << b for b in up)
                            rows = np.flatnonzero(value & mask == 0)
                            if len(rows):
                                new = [np.full(len(rows), p, np.int32), value[rows] | mask, np.full(len(rows), flips, np.int32)]
                                for c, x in zip(cols, new + [lanes[rows, k].view(np.int64) for k in range(lanes.shape[1])]):
                                    c.append(x)
                names = ["part", "key", "flips", *[f"f{k}" for k in range(lanes.shape[1])]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)

    return run


def _forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Indices of a least spanning forest of the weighted pairs, in rounds over all trees at once."""
    label, chosen = np.arange(n), []
    rank = np.empty(len(w), dtype=np.int64)
    rank[np.lexsort((b, a, w))] = np.arange(len(w))
    back = np.argsort(rank)
    live = np.arange(len(w))
    while len(live):
        la, lb = label[a[live]], label[b[live]]
        cross = la != lb
        live, la, lb = live[cross], la[cross], lb[cross]
        if not len(live):
            break
        best = np.full(n, len(w), dtype=np.int64)
        np.minimum.at(best, la, rank[live])
        np.minimum.at(best, lb, rank[live])
        roots = np.flatnonzero(best < len(w))
        pick = back[best[roots]]
        chosen.append(np.unique(pick))
        other = np.where(label[a[pick]] == roots, label[b[pick]], label[a[pick]])
        parent = np.arange(n)
        parent[roots] = other
        mutual = parent[parent] == np.arange(n)
        parent = np.where(mutual & (np.arange(n) < parent), np.arange(n), parent)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        label = parent[label]
    return np.concatenate(chosen) if chosen else np.array([], dtype=np.int64)


def _pairs_in(lanes, flips, side, e, distance):
    """Pairs within ``distance`` whose flips fit ``e``; between sides 0 and 1 if both occur."""
    found = [np.zeros((3, 0), dtype=np.int64)]
    split = side.max() > 0
    for fa in range(e // 2 + 1):
        for fb in range(fa, e - fa + 1):
            for sa, sb in ((0, 1), (1, 0)) if split else ((0, 0),):
                x, y = np.flatnonzero((flips == fa) & (side == sa)), np.flatnonzero((flips == fb) & (side == sb))
                if not len(x) or not len(y):
                    continue
                for at in range(0, len(x), 512):
                    z = x[at : at + 512]
                    d = np.bitwise_count(lanes[z, 0][:, None] ^ lanes[y, 0][None, :])
                    for k in range(1, lanes.shape[1]):
                        d += np.bitwise_count(lanes[z, k][:, None] ^ lanes[y, k][None, :])
                    i, j = np.nonzero(d <= distance)
                    if len(i):
                        found.append(np.stack([z[i], y[j], d[i, j]]))
    out = np.concatenate(found, axis=1)
    same = (lanes[out[0]] == lanes[out[1]]).all(axis=1)
    return out[:, ~same]


def _by_bucket(of, emit):
    """Sorted bucket rows -> what ``of`` finds in each; a bucket (or pair of blocks) may run over several batches."""

    def run(batches):
        open_rows, found = None, []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if open_rows is not None:
                cols = [np.concatenate([o, c]) for o, c in zip(open_rows, cols)]
            if not len(cols[0]):
                continue
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            ends = np.r_[0, cut, len(cols[0])]
            sizes = np.diff(ends)
            for g in np.flatnonzero(sizes[:-1] > 1):
                if (out := of([c[ends[g] : ends[g + 1]] for c in cols])) is not None:
                    found.append(out)
            open_rows = [c[ends[-2] :] for c in cols]
            if found:
                yield emit(found)
                found = []
        if open_rows is not None and (out := of(open_rows)) is not None:
            yield emit([out])

    return run


def _hex(lanes: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in lanes.astype(">u8")]


def _links(pieces, distance):
    """Bucket rows -> least spanning forests of their pairs."""

    def of(rows):
        part, flips, side = rows[0][0], rows[4], rows[5]
        if len(flips) < 2:
            return None
        lanes = np.stack([r.view(np.uint64) for r in rows[6:]], axis=1)
        a, b, d = _pairs_in(lanes, flips, side, pieces[part][1], distance)
        if not len(a):
            return None
        keep_at = _forest(a, b, d, len(flips)) if len(a) > 1 else np.array([0])
        return _hex(lanes[a[keep_at]]), _hex(lanes[b[keep_at]]), d[keep_at].tolist()

    def emit(found):
        cols = [sum((f[c] for f in found), []) for c in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["a", "b", "bits"])

    return _by_bucket(of, emit)


_CANDIDATES = "a string, b string, part int, key long, i int, j int, slices int"


def _candidates(pieces, distance: int, turn: int, most_pairs: int):
    """Bucket rows with ``slices`` and ``label`` -> pairs of different labels, and a mark for each bucket that has more.

    A bucket with up to ``most_pairs`` pairs a row gives all of them in turn 0. A
    fuller one gives a least spanning forest then, and in turn *t* the *t*-th of its
    slices, by hash of the pair. A pair that meets in several parts belongs to the first.
    """
    masks = [[sum(1 << b % 64 for b in bits if b // 64 == k) for k in range(1 + max(b for g, _ in pieces for b in g) // 64)] for bits, _ in pieces]

    def of(rows):
        part, slices, flips, side, label = rows[0][0], int(rows[4][0]), rows[5], rows[6], rows[7]
        if len(flips) < 2:
            return None
        lanes = np.stack([r.view(np.uint64) for r in rows[8:]], axis=1)
        a, b, d = _pairs_in(lanes, flips, side, pieces[part][1], distance)
        own = label[a] != label[b]
        for q in range(part):
            differ = sum(np.bitwise_count((lanes[a, k] ^ lanes[b, k]) & np.uint64(m)).astype(np.int64) for k, m in enumerate(masks[q]))
            own &= differ > pieces[q][1]
        a, b, d = a[own], b[own], d[own]
        if not len(a):
            return None
        most, more = most_pairs * len(flips), 0
        if turn:
            mixed = _mix64(lanes[:, 0])
            for k in range(1, lanes.shape[1]):
                mixed = _mix64(mixed ^ lanes[:, k])
            spot = (_mix64(mixed[a] + mixed[b]) % np.uint64(slices)).astype(np.int64)
            more = slices if (spot >= turn).any() else 0
            at = np.flatnonzero(spot == turn - 1)
        elif len(a) > most:
            more, at = -(-len(a) // most), _forest(a, b, d, len(flips))
        else:
            at = np.arange(len(a))
        return _hex(lanes[a[at]]), _hex(lanes[b[at]]), [(*(int(c[0]) for c in rows[:4]), more)] if more else []

    def emit(found):
        a, b, marks = (sum((f[c] for f in found), []) for c in range(3))
        cols = [a + [None] * len(marks), b + [None] * len(marks), *[[None] * len(a) + [m[c] for m in marks] for c in range(5)]]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in _CANDIDATES.split(", ")])

    return _by_bucket(of, emit)


def _buckets(prints: DataFrame, distance: int, lanes: int, block: int):
    """``(part, key, i, j, flips, side, f0..)`` not yet gathered by bucket, and the plan."""
    total = prints.count()
    share = min(1.0, SAMPLE / max(total, 1))
    picked = (F.pmod(F.xxhash64("fingerprint"), F.lit(1_000_003)) < int(share * 1_000_003) + 1) if share < 1 else F.lit(True)
    sample = [r[0] for r in prints.filter(picked).select("fingerprint").orderBy("fingerprint").limit(2 * SAMPLE).collect()]
    pieces = plan(_lanes_of(sample) if sample else np.zeros((0, lanes), np.uint64), total, distance)
    names = [f"f{k}" for k in range(lanes)]
    schema = "part int, key long, flips int, " + ", ".join(f"{n} long" for n in names)
    rows = prints.select("fingerprint").mapInArrow(_keys(pieces), schema)
    big = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    big = big.select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = rows.join(keep(big, "large-buckets"), ["part", "key"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64(*names), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    rows = rows.select("part", "key", "flips", *names, own.alias("own"), other.alias("other"))
    rows = rows.select(
        "part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "flips",
        (F.col("own") > F.col("other")).cast("int").alias("side"), *names,
    )
    return rows, pieces


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")


def links(prints: DataFrame, distance: int = 3, lanes: int = 1, block: int | None = None) -> DataFrame:
    """``(a, b, bits)``: links between different fingerprints of ``prints(fingerprint)``.

    The connected parts of the result are those of all pairs within ``distance``
    bits, and so are those of its links of at most any smaller number of bits.
    """
    rows, pieces = _buckets(prints, distance, lanes, block or BLOCK)
    return _gathered(rows).mapInArrow(_links(pieces, distance), "a string, b string, bits int")


def groups(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(fingerprint, component_id)``: least ``doc_id`` reachable from each fingerprint of ``prints(doc_id, fingerprint)``."""
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    roots = keep(components(pairs), "roots")
    linked = roots.join(least, roots.node == least.fingerprint).select("node", "root", "rep")
    lowest = linked.groupBy("root").agg(F.min("rep").alias("low"))
    found = linked.join(lowest, "root").select(F.col("node").alias("fingerprint"), "low")
    out = least.join(found, "fingerprint", "left")
    return out.select("fingerprint", F.coalesce("low", "rep").alias("component_id"))


def near_groups(docs: DataFrame, k: int = 3, lanes: int = 1, distance: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row per document.

    Documents with equal fingerprints are one node, whatever their number. A null
    ``doc_id`` names no component (null only if all ids of it are null); repeated
    rows stay; an empty table gives an empty one.
    """
    prints = keep(fingerprints(docs, k, lanes), "fingerprints")
    distinct = prints.select("fingerprint").distinct()
    found = keep(groups(prints, links(keep(distinct, "distinct"), distance, lanes)), "groups")
    return prints.join(found, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``(text_key, shingles)``: the different k-word shingles of each text, A-Z lower-cased."""
    lower = F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select("text_key", words_of(lower).alias("w"))
    return words.select("text_key", F.array_distinct(shingle_hashes(F.col("w"), k)).alias("shingles"))


def _alike(docs: DataFrame, wanted: DataFrame, k: int, similarity: float) -> DataFrame:
    """``(a, b)``: the pairs of text keys ``wanted(a_key, b_key)`` whose shingle sets are alike."""
    nodes = keep(wanted.select(F.col("a_key").alias("text_key")).union(wanted.select("b_key")).distinct(), "nodes")
    texts = docs.select(F.xxhash64(text_of()).alias("text_key"), "text").join(nodes, "text_key")
    sets = keep(_shingle_sets(texts, k).dropDuplicates(["text_key"]), "shingle-sets")
    both = wanted.join(sets.select(F.col("text_key").alias("a_key"), F.col("shingles").alias("x")), "a_key")
    both = both.join(sets.select(F.col("text_key").alias("b_key"), F.col("shingles").alias("y")), "b_key")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.filter((union == 0) | (common >= F.lit(similarity) * union)).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))


def _different_sets(docs: DataFrame, prints: DataFrame, k: int) -> DataFrame:
    """``(fingerprint, text_key, least)``: every text with the least text that has its fingerprint and its shingle set."""
    texts = keep(prints.select("fingerprint", "text_key").distinct(), "texts")
    shared = texts.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint")
    shared = keep(texts.join(shared, "fingerprint").select("text_key").distinct(), "texts-of-one-fingerprint")
    words = docs.select(F.xxhash64(text_of()).alias("text_key"), "text").join(shared, "text_key")
    sets = _shingle_sets(words, k).select("text_key", F.xxhash64(F.sort_array("shingles")).alias("set")).distinct()
    texts = texts.join(keep(sets, "set-keys"), "text_key", "left")
    least = texts.groupBy("fingerprint", "set").agg(F.min("text_key").alias("least"))
    least = least.select(F.col("fingerprint").alias("f"), F.col("set").alias("s"), "least")
    return texts.join(least, (F.col("fingerprint") == F.col("f")) & F.col("set").eqNullSafe(F.col("s"))).select("fingerprint", "text_key", "least")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, lanes: int = 2, distance: int = 24) -> DataFrame:
    """``(doc_id, row, text_key, group)`` per row: groups linked by shingle sets at least ``similarity`` alike.

    SimHash over the set of k-word shingles finds the pairs within ``distance``
    bits; each is decided on its exact Jaccard similarity unless verified pairs
    already join the two. A bucket with many pairs is met again in later turns,
    with the groups found so far, until it has none left between two groups. Two
    texts without words are alike. ``group`` is a text key; see :func:`keep_one`
    for the choice within a group.
    """
    prints = keep(fingerprints(docs, k, lanes, once=True), "set-fingerprints")
    texts = keep(_different_sets(docs, prints, k), "texts-by-set")
    same = keep(texts.select("fingerprint", "least").distinct(), "distinct-sets")
    name = lambda c: same.select(F.col("fingerprint").alias(c), F.col("least").alias(f"{c}_key"))
    names = [f"f{n}" for n in range(lanes)]
    rows, pieces = _buckets(keep(same.select("fingerprint").distinct(), "distinct"), distance, lanes, 4096)
    copies = texts.filter("text_key <> least").select(F.col("least").alias("a_key"), F.col("text_key").alias("b_key"))
    meeting = name("a").join(name("b"), F.col("a") == F.col("b")).filter("a_key < b_key").select("a_key", "b_key")
    turn, alike, tested = 0, None, None
    while True:
        if turn:
            rows_now = rows.join(marks, ["part", "key", "i", "j"]).join(labels, names)
        else:
            rows_now = rows.withColumn("slices", F.lit(0)).withColumn("label", F.xxhash64(*names))
        rows_now = rows_now.select("part", "key", "i", "j", "slices", "flips", "side", "label", *names)
        found = keep(_gathered(rows_now).mapInArrow(_candidates(pieces, distance, turn, PAIRS), _CANDIDATES), "near-pairs")
        pairs = found.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        wanted = pairs.join(name("a"), "a").join(name("b"), "b").select("a_key", "b_key")
        if turn:
            wanted = wanted.join(tested, ["a_key", "b_key"], "left_anti")
        else:
            wanted = wanted.unionByName(copies).unionByName(meeting)
        wanted = keep(wanted, "pairs-to-verify")
        passed = keep(_alike(docs, wanted, k, similarity), "alike")
        tested = wanted if tested is None else tested.unionByName(wanted)
        if not turn or not passed.isEmpty():
            alike = passed if alike is None else alike.unionByName(passed)
            roots = keep(components(alike), "roots")
        marks = keep(found.filter("part is not null").select("part", "key", "i", "j", "slices"), "fuller-buckets")
        if marks.isEmpty():
            break
        # A fingerprint whose sets are in several groups is never skipped.
        root = F.coalesce("root", "least")
        labels = same.join(roots, same.least == roots.node, "left").groupBy("fingerprint").agg(F.min(root).alias("low"), F.max(root).alias("high"))
        lane = lambda n: F.conv(F.substring("fingerprint", 16 * n + 1, 16), 16, -10).cast("long").alias(f"f{n}")
        labels = keep(labels.select(*[lane(n) for n in range(lanes)], F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.xxhash64("fingerprint")).alias("label")), "labels")
        turn += 1
    found = prints.join(roots, prints.text_key == roots.node, "left")
    return found.select("doc_id", "row", "text_key", F.coalesce("root", "text_key").alias("group"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of least ``doc_id``.

    A null ``doc_id`` comes after all others; of rows with equal ids the one of the
    least hash stays, of equal rows one; an empty table stays empty.
    """
    own = docs.columns
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = near_duplicates(docs, **options).groupBy("group").agg(F.min(rank).alias("best"))
    best = keep(best.select(F.col("best.row").alias("__keep")).distinct(), "kept-rows")
    rows = docs.withColumn("__row", row_key(docs)).dropDuplicates(["__row"])
    return rows.join(best, F.col("__row") == F.col("__keep")).select(*[f"`{c}`" for c in own])
