import random
import re

import numpy as np
import pytest
import xxhash

from signalframe.llm import simhash

SF = "/root/testdata/sf0.01"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(prints, distance):
    label = list(range(len(prints)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    v = np.array(prints, dtype=np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= distance):
            a, b = find(i), find(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def compare(docs, distance=3):
    got = {}
    rows = docs.collect()
    for r in simhash.near_groups(docs, distance=distance).collect():
        got.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    prints = [plain_print(r.text) for r in rows]
    group = brute_groups(prints, distance)
    least = {}
    for g, r in zip(group, rows):
        least[g] = min(x for x in (least.get(g), r.doc_id) if x is not None) if (least.get(g), r.doc_id) != (None, None) else None
    want = {}
    for p, g, r in zip(prints, group, rows):
        want.setdefault(r.doc_id, set()).add((f"{p:016x}", least[g]))
    assert got == want


def test_table(spark):
    compare(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(spark, odd, empty):
    compare(odd)
    assert simhash.near_groups(odd).count() == odd.count()
    assert simhash.near_groups(empty).collect() == []


def clustered(n, seed, lanes=1):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64 * lanes) for _ in range(3)]
    out = set()
    while len(out) < n:
        v = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64 * lanes)
        for _ in range(rng.randint(0, 6 * lanes)):
            v ^= 1 << rng.randrange(64 * lanes)
        out.add(v)
    return sorted(out)


def roots_of(spark, values, distance, lanes=1):
    prints = spark.createDataFrame([(i, f"{v:0{16 * lanes}x}") for i, v in enumerate(values)], "doc_id long, fingerprint string")
    links = simhash.links(prints.select("fingerprint"), distance, lanes)
    rows = simhash.groups(prints, links).collect()
    by = {r.fingerprint: r.component_id for r in rows}
    return [by[f"{v:0{16 * lanes}x}"] for v in values], links


def test_dense_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    values = clustered(900, 1)
    for distance in (3, 6):
        got, links = roots_of(spark, values, distance)
        assert got == brute_groups(values, distance)
        assert links.count() < 60 * len(values)


def test_unequal_thresholds_find_all(spark, monkeypatch):
    values = clustered(300, 2)
    width = lambda a, b: list(range(a, b))
    for pieces in ([(width(0, 20), 1), (width(42, 64), 0)], [(width(0, 32), 1), (width(32, 64), 1)], [(width(0, 20), 2)]):
        e_sum = sum(e + 1 for _, e in pieces)
        monkeypatch.setattr(simhash, "plan", lambda *_: pieces)
        got, _ = roots_of(spark, values, e_sum - 1)
        assert got == brute_groups(values, e_sum - 1)


def test_plan_always_covers():
    rng = np.random.default_rng(0)
    for total in (10, 10**5, 10**8, 10**11):
        for lanes, distance in ((1, 3), (1, 0), (2, 19)):
            sample = rng.integers(0, 2**63, (200, lanes)).astype(np.uint64)
            pieces = simhash.plan(sample, total, distance)
            assert sum(e + 1 for _, e in pieces) >= distance + 1
            used = [b for bits, _ in pieces for b in bits]
            assert len(used) == len(set(used))


def shingle_set(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard_groups(texts, similarity=0.8, distance=24):
    """Groups by all pairs within the distance that are alike."""
    label = list(range(len(texts)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    sets = [shingle_set(t) for t in texts]
    prints = [int(simhash.fingerprint(t.encode(), 5, 2, once=True), 16) for t in texts]
    failed = 0
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    label[max(a, b)] = min(a, b)
                else:
                    failed += 1
    return [find(i) for i in range(len(texts))], failed


@pytest.mark.parametrize("pairs", [30, 64])
def test_every_candidate_pair_is_decided(spark, monkeypatch, pairs):
    rng = random.Random(11)
    texts = []
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts.append(" ".join(base))
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(5, 145), 3):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [texts[0].upper(), texts[0].replace(" ", "  "), "", " ", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want, failed = jaccard_groups(texts)
    assert failed > 100
    blank = len(texts) - 3
    want = [blank if i >= blank else g for i, g in enumerate(want)]
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    group = {r.doc_id: r.group for r in simhash.near_duplicates(docs).collect()}
    first = {}
    got = [first.setdefault(group[i], i) for i in range(len(texts))]
    assert got == want


def test_near_duplicates_that_are_found(spark):
    """Measured: pairs of at least 0.8 alike, by number of words changed in 150; each text has one edited copy."""
    rng = random.Random(21)
    texts, changed = [], []
    for i in range(120):
        words = [f"{rng.randrange(10**6):x}" for _ in range(150)]
        edited, m = list(words), 1 + i % 3
        for at in rng.sample(range(10, 140, 12), m):
            edited[at] = f"edit{i}x{at}"
        texts += [" ".join(words), " ".join(edited)]
        changed.append(m)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    group = {r.doc_id: r.group for r in simhash.near_duplicates(docs).collect()}
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    found = {1: [], 2: [], 3: []}
    for i, m in enumerate(changed):
        a, b = shingles[2 * i], shingles[2 * i + 1]
        assert len(a & b) / len(a | b) >= 0.8
        found[m].append(group[2 * i] == group[2 * i + 1])
    rate = {m: sum(v) / len(v) for m, v in found.items()}
    assert rate[1] == 1.0 and rate[2] >= 0.95 and rate[3] >= 0.8, rate
    assert len(set(group.values())) >= 120
