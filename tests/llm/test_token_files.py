import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from signalframe.llm import common, token_files
from signalframe.llm.common import shared_path

SF = "/root/testdata/sf0.01"
PATH = "/opt/tokenizers/word_bpe_49k.json"


def round_trip(spark, docs, monkeypatch=None):
    folder = shared_path(spark, "test-tokens")
    token_files.write_tokens(docs, folder, PATH)
    return folder, token_files.read_tokens(spark, folder)


def whole(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check(spark, docs):
    folder, out = round_trip(spark, docs)
    tokenizer = Tokenizer.from_file(PATH)
    rows = sorted(out.collect(), key=lambda r: r.start)
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])
    assert len(rows) == sum(map(len, texts.values()))
    at, last = 0, float("-inf")
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert list(r.ids) in texts[r.doc_id]
        texts[r.doc_id].remove(list(r.ids))
        key = float("-inf") if r.doc_id is None else r.doc_id
        assert key >= last
        at, last = at + r.n_tokens, key
    return folder, rows


def test_table_and_lookup(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder, rows = check(spark, docs)
    found = token_files.read_tokens(spark, folder, [5, 700]).collect()
    assert {(r.doc_id, r.start) for r in found} == {(r.doc_id, r.start) for r in rows if r.doc_id in (5, 700)}
    plan = token_files.read_tokens(spark, folder, [5])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "doc_id" in plan.split("PushedFilters")[1][:200]
    crc = {r.doc_id: r.ids_crc32 for r in token_files.with_crc(token_files.read_tokens(spark, folder)).collect()}
    assert crc == {r.doc_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}


def test_odd_rows(spark, odd, empty):
    check(spark, odd)
    assert round_trip(spark, empty)[1].collect() == []


@pytest.mark.parametrize("text", ["It's we'LL <|endoftext|> a<|startoftext|>b ", "É é İ ΣΑΣ ß x y", "a\u0085b\x1cc 12,345.6 日本語", "ﬁ ½ ẞ"])
def test_words_equal_whole_text(text):
    ids, counts = token_files.WordEncoder(PATH).encode([text.encode()])
    assert ids.tolist() + [1] == whole(text) and counts.tolist() == [len(ids)]


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    enc = token_files.WordEncoder(PATH)
    for text in ("a b c d", "e f", "a e g", ""):
        assert enc.encode([text.encode()])[0].tolist() + [1] == whole(text)


@pytest.mark.parametrize("hashing", ["own", "few", "one"])
def test_words_with_one_hash_stay_apart(monkeypatch, hashing):
    """Words are compared byte by byte: hashes that meet cost time, no result."""
    own = common.Words.hashes
    if hashing == "few":
        monkeypatch.setattr(common.Words, "hashes", lambda w: own(w) % np.uint64(5))
    if hashing == "one":
        monkeypatch.setattr(common.Words, "hashes", lambda w: own(w) * np.uint64(0))
    rng = np.random.default_rng(6)
    long = "x" * 300
    every = ["the", "The", "the,", "cat!?", "don't", "12", "é日", "abcdefgh", "abcdefghi", "abcdefghj", long, long + "y", long + "z", "\x00", "\x00\x00", "A.B", "?!"]
    numbers, enc = common.Numbers(), token_files.WordEncoder(PATH)
    met = {}
    for _ in range(4):
        texts = [" ".join(rng.choice(every, n)) for n in (0, 1, 9, 30)]
        raw = [t.encode() for t in texts]
        at, new = numbers.of(common.Words(raw))
        met.update(zip(range(numbers.n - len(new), numbers.n), new))
        assert [met[i] for i in at.tolist()] == [w for t in raw for w in t.split()]
        ids, counts = enc.encode(raw)
        assert [ids[e - c : e].tolist() + [1] for e, c in zip(np.cumsum(counts), counts)] == [whole(t) for t in texts]
    if hashing == "own":
        assert numbers.n == len({*met.values()})
