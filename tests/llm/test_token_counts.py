import numpy as np
import public_tokenizers
import pytest
import tiktoken

from signalframe.llm import token_counts as tc

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def brute(text, rule):
    enc, _ = tc.encoder(PATH, public_tokenizers.PATTERN)
    raw, at, tokens = text.encode(), 0, []
    for i in enc.encode_ordinary(text):
        n = len(enc.decode_single_token_bytes(i))
        tokens.append((at, at + n))
        at += n
    out, start = [], 0
    for line in text.splitlines(keepends=True) if False else [p for p in text.replace("\n", "\n\x00").split("\x00") if p] or [""]:
        end = start + len(line.encode())
        if rule == "start":
            n = sum(start <= a < end for a, _ in tokens)
        elif rule == "end":
            n = sum(start < b <= end for _, b in tokens)
        else:
            n = sum(max(0, min(b, end) - max(a, start)) / (b - a) for a, b in tokens)
        out.append(n)
        start = end
    assert start == len(raw)
    return out, len(tokens)


@pytest.mark.parametrize("rule", tc.RULES)
def test_rules(odd, empty, rule):
    want = {}
    for r in odd.collect():
        want.setdefault(r.doc_id, []).append(brute((r.text or "").replace("\x00", " "), rule))
    clean = odd.selectExpr("doc_id", "replace(text, '\0', ' ') text", "source", "key start")
    got = {}
    for r in tc.attribute(clean, PATH, public_tokenizers.PATTERN, rule=rule).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append((r.section, round(r.n_tokens, 6), r.doc_tokens))
    for doc_id, versions in want.items():
        rows = sorted((k, round(n, 6), total) for lines, total in versions for k, n in enumerate(lines))
        assert sorted(got[doc_id]) == rows
        assert sum(x[1] for x in got[doc_id]) == pytest.approx(sum(t for _, t in versions))
    assert tc.attribute(empty, PATH, public_tokenizers.PATTERN).collect() == []


def test_overlapping_fields(spark):
    text = "Title: é and more\nbody text of the thing"
    fields = lambda t: [(0, 17), (7, 8), (0, len(t)), (5, 5)]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = tc.attribute(docs, PATH, public_tokenizers.PATTERN, fields, "split").orderBy("section").collect()
    total = rows[0].doc_tokens
    assert rows[2].n_tokens == pytest.approx(total) and rows[3].n_tokens == 0
    assert 0 < rows[1].n_tokens < rows[0].n_tokens < total


def test_allot_edges():
    edges = np.array([0, 3, 4, 9])
    starts, ends = np.array([0, 2, 4]), np.array([2, 4, 9])
    assert tc.allot(edges, starts, ends, "start").tolist() == [1, 1, 1]
    assert tc.allot(edges, starts, ends, "end").tolist() == [0, 2, 1]
    assert tc.allot(edges, starts, ends, "split").tolist() == pytest.approx([2 / 3, 4 / 3, 1])
