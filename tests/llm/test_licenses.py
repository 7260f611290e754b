import random
import re

import numpy as np

from signalframe.llm import licenses

from .conftest import SCHEMA, as_rows, prose


def plain(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    want = []
    sets = [(name, plain(t)) for name, t in licenses.TEMPLATES]
    for doc_id, text in rows:
        have = plain(text)
        want += [(doc_id, n, round(len(t & have) / len(t), 9)) for n, t in sets if len(t & have) >= 0.8 * len(t)]
    return sorted(want, key=str)


def got(docs):
    return sorted(((r.doc_id, r.license, round(r.contained, 9)) for r in licenses.scan(docs).collect()), key=str)


def test_altered_copies(spark):
    rng = random.Random(9)
    texts = [None, "", "All rights reserved."]
    for _, t in licenses.TEMPLATES:
        for edits in (0, 1, 2):
            words = t.split()
            for _ in range(edits):
                words[rng.randrange(len(words))] = "other"
            texts.append(prose(rng, rng.randint(0, 90)) + "\n" + " ".join(words).upper() + " -- " + prose(rng, rng.randint(0, 90)))
    docs = spark.createDataFrame(as_rows(texts), SCHEMA)
    want = brute(enumerate(texts))
    assert len(want) > 15 and got(docs) == want


def test_odd_rows(odd, empty):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert licenses.scan(empty).collect() == []


def test_bands_and_windows():
    b = licenses.band_count()
    assert 1 - (1 - licenses.SIMILARITY**licenses.ROWS) ** b >= licenses.COLLISION > 1 - (1 - licenses.SIMILARITY**licenses.ROWS) ** (b - 1)
    h = np.random.default_rng(0).integers(0, 2**63, 53).astype(np.uint64)
    got = licenses.window_minima(h, 3, [1, 4, 16])
    own = licenses._ranked(h, 3).tolist()
    for w, step in ((1, 1), (4, 2), (16, 8)):
        assert got[w].tolist() == [min(own[a : a + w]) for a in range(0, 53, step)]
    for n in range(1, 400):
        w = licenses.width_for(n)
        # A window at a multiple of half the width lies inside any run of n shingles.
        assert w == 1 or w + w // 2 <= n + 1
