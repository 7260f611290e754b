import math
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from signalframe.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def lat():
    return pieces.Lattices(MODEL, 1.0)


def every(sp, text, power=1.0):
    """All segmentations of the text by plain recursion, with normalised probabilities."""
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    rank = {sp.id_to_piece(i): r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
    body = "▁" + text.replace(" ", "▁")
    out = {}

    def go(i, ids, weight):
        if i == len(body):
            out[tuple(ids)] = weight
        one = False
        for j in range(i + 1, min(len(body), i + 16) + 1):
            if body[i:j] in rank:
                one = one or j == i + 1
                go(j, [*ids, sp.piece_to_id(body[i:j])], weight - power * math.log(rank[body[i:j]] + 1))
        if i < len(body) and not one:
            go(i + 1, [*ids, *[sp.piece_to_id(f"<0x{b:02X}>") for b in body[i].encode()]], weight - 16.0)

    go(0, [], 0.0)
    top = max(out.values())
    total = sum(math.exp(w - top) for w in out.values())
    return {k: math.exp(w - top) / total for k, w in out.items()}


def ids_of(lat, edges):
    return tuple(int(x) for e in edges for x in lat.piece.data[lat.piece_at.data[e] : lat.piece_at.data[e] + lat.piece_n.data[e]])


@pytest.mark.parametrize("text", ["the on", "añ\nb", "\t日a", "  x"])
def test_draws_follow_the_lattice(lat, text):
    want = every(sentencepiece.SentencePieceProcessor(model_file=MODEL), text)
    n, k = 12000, 3
    keys = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    done, threshold = lat.sample([text] * n, keys, k)
    first, pairs, estimate = Counter(), Counter(), 0.0
    for draws, t in zip(done, threshold):
        got = [ids_of(lat, e) for e, _, _ in draws]
        assert len(set(got)) == len(got) == min(k, len(want)) and set(got) <= set(want)
        values = [v for _, _, v in draws]
        assert values == sorted(values, reverse=True) and values[-1] >= t
        for g, (_, lp, _) in zip(got, draws):
            assert math.exp(lp) == pytest.approx(want[g], rel=1e-4)
            estimate += want[g] / math.exp(pieces._log_inclusion(lp, t)) * len(g)
        first[got[0]] += 1
        pairs[tuple(got[:2])] += 1
    for g, p in want.items():
        assert abs(first[g] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        for h, q in want.items():
            if g != h:
                both = p * q / (1 - p)
                assert abs(pairs[g, h] / n - both) < 5 * math.sqrt(both / n) + 1e-3
    exact = sum(p * len(g) for g, p in want.items())
    assert estimate / n == pytest.approx(exact, rel=0.03)


def test_batches_and_forgetting_do_not_matter(lat, monkeypatch):
    texts = ["the cat sat on the mat", "", "él niño", "x" * 300, "a\n\nb  c", "the " * 200]
    keys = np.arange(6, dtype=np.uint64) * np.uint64(99991)
    whole, t = lat.sample(texts, keys, 4)
    monkeypatch.setattr(pieces, "REMEMBERED", 0)
    other = pieces.Lattices(MODEL, 1.0)
    for i, text in enumerate(texts):
        alone, u = other.sample([text], keys[i : i + 1], 4)
        assert [ids_of(lat, e) for e, _, _ in whole[i]] == [ids_of(other, e) for e, _, _ in alone[0]]
        assert t[i] == pytest.approx(u[0])


def check(docs, rows, k):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    drawn = {}
    for r in rows:
        assert r.decoded and sp.decode(list(r.ids)) in texts[r.doc_id]
        assert r.n_pieces == len(r.ids) and r.log_inclusion <= 0
        drawn.setdefault(r.doc_id, []).append(r)
    assert set(drawn) == set(texts)
    for i, found in drawn.items():
        assert len([r for r in found if r.draw == 1]) == len(texts[i])
        if len(texts[i]) == 1:
            assert len({tuple(r.ids) for r in found}) == len(found) <= k
            assert len(found) == k or len(texts[i][0]) < 3


def test_odd_rows(odd, empty):
    out = pieces.segmentations(odd, MODEL, k=3)
    check(odd, out.collect(), 3)
    again = pieces.segmentations(odd.repartition(2), MODEL, k=3)
    same = lambda df: sorted(str((r.doc_id, r.draw, list(r.ids), round(r.log_prob, 5))) for r in df.collect())
    assert same(out) == same(again)
    assert pieces.segmentations(empty, MODEL).collect() == []


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, pieces.segmentations(docs, MODEL).collect(), 2)


def test_long_words_draw_the_same(monkeypatch):
    """Words walked alone draw what they draw among others."""
    rng = np.random.default_rng(8)
    letters = np.array(list("etaoinshrdluabcé日"))
    texts = ["".join(rng.choice(letters, n)) for n in (1, 2, 5, 30, 700)] + ["ab " + "".join(rng.choice(letters, 900)) + " cd\nef", "", "the on"]
    keys = rng.integers(0, 2**63, len(texts)).astype(np.uint64)
    drawn = []
    for long in (3, 512, 10_000):
        monkeypatch.setattr(pieces, "LONG_WORD", long)
        lat = pieces.Lattices(MODEL, 1.0)
        done, threshold = lat.sample(texts, keys, 3)
        drawn.append(([[ids_of(lat, e) for e, _, _ in draws] for draws in done], [[v for _, _, v in draws] for draws in done], threshold))
        for text, draws in zip(texts, done):
            assert all(lat.decode(np.array(ids_of(lat, e), dtype=np.int64)) == text.encode() for e, _, _ in draws)
    for ids, values, threshold in drawn[1:]:
        assert ids == drawn[0][0]
        assert np.allclose(threshold, drawn[0][2]) and all(np.allclose(a, b) for a, b in zip(values, drawn[0][1]))


def test_a_word_of_a_million_letters(lat):
    import time

    text = "".join(np.random.default_rng(9).choice(list("etaoinshrdlu"), 1_000_000))
    start = time.process_time()
    done, _ = lat.sample([text], np.array([5], np.uint64), 2)
    assert time.process_time() - start < 90
    assert [lat.decode(np.concatenate([lat.piece.data[lat.piece_at.data[e]]])) == text.encode() for e, _, _ in done[0]] == [True, True]
    lat.forget()


def test_log_probabilities_are_double(lat):
    """Shares are kept and added up as doubles, also where masses change from plain to logarithms."""
    want = every(sentencepiece.SentencePieceProcessor(model_file=MODEL), "the on")
    done, _ = lat.sample(["the on"], np.array([3], np.uint64), 6)
    assert all(math.exp(lp) == pytest.approx(want[ids_of(lat, e)], rel=1e-12) for e, lp, _ in done[0])
    assert 30 < lat.safe < 60
    text = "".join(np.random.default_rng(4).choice(list("etaoinshé日"), 200))
    other = pieces.Lattices(MODEL, 1.0)
    other.safe = 0
    keys = np.array([9], np.uint64)
    (plain, a), (logs, b) = lat.sample([text], keys, 3), other.sample([text], keys, 3)
    for (e, lp, v), (f, lq, w) in zip(plain[0], logs[0]):
        assert ids_of(lat, e) == ids_of(other, f) and lp == pytest.approx(lq, rel=1e-12) and v == pytest.approx(w, rel=1e-9)
    assert a[0] == pytest.approx(b[0], rel=1e-9)


def test_forgetting_keeps_the_arrays():
    lat = pieces.Lattices(MODEL, 1.0)
    lat.words(["the cat sat on the mat" * 2000])
    held = lat.odds.data
    lat.forget()
    lat.words(["the mat"])
    assert lat.odds.data is held and lat.odds.n < 100
