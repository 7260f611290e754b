import random
import re
from collections import Counter, defaultdict

import xxhash

from signalframe.llm import line_dedup

from .conftest import SCHEMA, as_rows, prose

SF = "/root/testdata/sf0.01"
GAP = re.compile(r"[\x20\x09-\x0D]+")


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def hash_line(s, seed=42):
    return signed(xxhash.xxh64_intdigest(s.encode(), seed & (2**64 - 1)))


def hash_pair(a, b):
    first = xxhash.xxh64_intdigest((a & (2**64 - 1)).to_bytes(8, "little"), 42)
    return signed(xxhash.xxh64_intdigest((b & (2**64 - 1)).to_bytes(8, "little"), first))


def chunk_spans(lines):
    h = [hash_line(s) for s in lines]
    r = [hash_pair(a, b) for a, b in zip([0, *h], h)]
    wide = [len(GAP.split(s.strip(" "))) >= line_dedup.LONG for s in lines]
    spans, start = [], 0
    for i in range(len(lines)):
        low = 0 < i < len(lines) - 1 and r[i] < r[i - 1] and r[i] < r[i + 1]
        if i == len(lines) - 1 or wide[i] or wide[i + 1] or low:
            spans.append((start, i + 1))
            start = i + 1
    return spans, wide


def run_spans(lines, long=line_dedup.LONG):
    """The shortest runs of enough words from and up to every line."""
    n = [len(line.encode().split()) for line in lines]
    out = set()
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if sum(n[i : j + 1]) >= long:
                out.add((i, j + 1))
                break
        for j in range(i, -1, -1):
            if sum(n[j : i + 1]) >= long:
                out.add((j, i + 1))
                break
    return sorted(out)


def brute(docs):
    """docs: different rows in order of (doc_id, row hash); only the order of equal ids is left open."""
    places, cut = defaultdict(list), []
    for d, (doc_id, text) in enumerate(docs):
        lines = (text or "").split("\n")
        spans, wide = chunk_spans(lines)
        cut.append((lines, spans))
        for k, (a, b) in enumerate(spans):
            body = "\n".join(lines[a:b])
            if (b - a >= 2 or wide[a]) and GAP.sub("", body):
                places[body].append((doc_id if doc_id is not None else -1, d, k))
    gone = defaultdict(set)
    for spots in places.values():
        spots.sort()
        _, fd, fk = spots[0]
        f_lines, f_spans = cut[fd]

        def near(lines, spans, k, step):
            a, b = spans[k]
            if step == 1:
                return lines[b : (spans[k + 1][1] if k + 1 < len(spans) else len(lines)) + line_dedup.EDGE]
            return lines[max(0, (spans[k - 1][0] if k else 0) - line_dedup.EDGE) : a][::-1]

        for _, d, k in spots[1:]:
            lines, spans = cut[d]
            a, b = spans[k]
            for step in (1, -1):
                mine, first = near(lines, spans, k, step), near(f_lines, f_spans, fk, step)
                for x, y in zip(mine, first):
                    if x != y:
                        break
                    a, b = (a, b + 1) if step == 1 else (a - 1, b)
            gone[d].update(range(a, b))
    runs, covered = defaultdict(list), {}
    for d, (doc_id, text) in enumerate(docs):
        lines, spans = cut[d]
        for a, b in run_spans(lines) if len(lines) < 3000 else []:
            runs["\n".join(lines[a:b])].append((doc_id if doc_id is not None else -1, d, a, b))
        repeated = {i for k, (a, b) in enumerate(spans) for i in range(a, b) if len(places.get("\n".join(lines[a:b]), [])) > 1}
        covered[d] = repeated
    for spots in runs.values():
        if len(spots) > 1 and any(not set(range(a, b)) <= covered[d] for _, d, a, b in spots):
            spots.sort()
            _, fd, fa, fb = spots[0]
            for _, d, a, b in spots[1:]:
                gone[d].update(i for i in range(a, b) if d != fd or i >= fb)
    out = []
    for d, (doc_id, text) in enumerate(docs):
        lines = (text or "").split("\n")
        left = "\n".join(s for i, s in enumerate(lines) if i not in gone[d])
        out.append((doc_id, None if text is None else left, 0 if text is None else len(lines), 0 if text is None else len(gone[d])))
    return out


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()) == Counter(brute(rows))


def test_passages_in_other_surroundings(spark):
    rng = random.Random(3)
    passage = "\n".join(prose(rng, 12) for _ in range(9))
    long = prose(rng, 60)
    texts = []
    for i in range(12):
        own = [prose(rng, rng.randint(3, 9)) for _ in range(rng.randint(0, 7))]
        more = [prose(rng, rng.randint(3, 9)) for _ in range(rng.randint(1, 7))]
        texts.append("\n".join([*own, passage if i % 2 else long, *more, "", " "]))
    texts += [None, "", "\n\n\n", texts[0], "same\n" * 50, "same\n" * 50 + "x"]
    docs = spark.createDataFrame(as_rows(texts), SCHEMA).repartition(4)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    want = brute(list(enumerate(texts)))
    assert [(i, got[i].text, got[i].n_lines, got[i].n_removed) for i in range(len(texts))] == want
    for i in range(3, 12, 2):
        assert sum(line in got[i].text for line in passage.split("\n")) == 0
    for i in range(2, 12, 2):
        assert long not in got[i].text and got[i].text
    assert passage in got[1].text and long in got[0].text


def test_short_passages(spark):
    """Passages of over 50 words in 1 to 9 lines between foreign lines, three places each: nothing of
    them is left but the first place, and nothing else goes."""
    rng = random.Random(7)
    foreign = lambda: [prose(rng, rng.randint(3, 9)) for _ in range(rng.randint(1, 6))]
    texts, passages = [], []
    for n in range(1, 10):
        for _ in range(25):
            cuts = sorted(rng.sample(range(1, 56), n - 1))
            words = prose(rng, 56).split()
            passages.append((n, [" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, 56])]))
    for place in range(3):
        for n, lines in passages:
            texts.append("\n".join([*foreign(), *lines, *foreign()]))
    docs = spark.createDataFrame(as_rows(texts), SCHEMA).repartition(4)
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(docs).collect()}
    for i, text in enumerate(texts):
        n, lines = passages[i % len(passages)]
        want = text.split("\n") if i < len(passages) else [x for x in text.split("\n") if x not in lines]
        assert got[i] == want, (i, n)


def test_runs_that_overlap_themselves(spark):
    line = "a b c d e f g h i j"
    texts = ["x\n" + "\n".join([line] * 12), "\n".join([line] * 5) + "\ny"]
    docs = spark.createDataFrame(as_rows(texts), SCHEMA)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: r[1] for i, r in enumerate(brute(list(enumerate(texts))))}


def test_odd_rows(spark, odd, empty):
    out = line_dedup.dedup_lines(odd).collect()
    assert len(out) == odd.count()
    copies = [r.text for r in out if r.doc_id == 5]
    assert len(copies) == 3 and len(set(copies)) == 1
    assert line_dedup.dedup_lines(empty).collect() == []
