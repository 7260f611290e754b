import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from signalframe.llm import fingerprints as fp


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


END = -(2**63) + 2**64 // fp.SCALE


def all_hashes(text, k=fp.K):
    w = words(text)
    shingles = {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    hashes = {xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles}
    return sorted(h - 2**64 if h >= 2**63 else h for h in hashes)


def plain_sketch(text):
    hashes = all_hashes(text)
    return [h for h in hashes if h < END] or hashes


def text_form(s):
    return "".join(f"{h & (2**64 - 1):016x}" for h in s)


def alike(s, t):
    """By sketches; by all hashes if one of the texts has no hash below the threshold."""
    whole = any(all_hashes(x) and all_hashes(x)[0] >= END for x in (s, t))
    a, b = (set(all_hashes(x) if whole else plain_sketch(x)) for x in (s, t))
    return len(a & b) / len(a | b) if a | b else 1.0


def check(docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row")).collect()
    order = sorted({(r.doc_id is None, -(r.doc_id or 0), r.row, r.doc_id, r.text) for r in rows}, key=lambda r: r[:3])
    want = {}
    for i, (*_, row, doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][4]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b = plain_sketch(text), plain_sketch(edited)
        want[row] = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_form(a), text_form(b), round(alike(text, edited), 9), round(alike(text, following), 9))
    got = sorted(
        str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))) for r in fp.compare(docs).collect()
    )
    assert got == sorted(str(want[r.row]) for r in rows)


def test_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_odd_rows(spark, odd, empty):
    check(odd)
    assert fp.compare(empty).collect() == []
    one = odd.filter("doc_id = 20")
    check(one)
    assert [r.near_next for r in fp.compare(one).collect()] == [1.0]


def test_merge_and_containment(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    part = " ".join(f"w{i}" for i in range(3000, 4000))
    other = " ".join(f"v{i}" for i in range(5000))
    df = spark.createDataFrame([(long, part, other)], "a string, b string, c string")
    s = {c: fp.sketch(fp.words_of(F.col(c))) for c in "abc"}
    row = df.select(
        fp.containment(s["b"], s["a"]).alias("inside"), fp.containment(s["a"], s["b"]).alias("share"), fp.likeness(s["a"], s["c"]).alias("none"),
        fp.merge(s["a"], s["c"]).alias("m"),
    ).collect()[0]
    assert row.inside == 1.0 and row.none == 0.0
    assert row.share == pytest.approx(996 / 19996, rel=0.3)
    assert row.m == sorted({*plain_sketch(long), *plain_sketch(other)})


def test_short_texts_inside_long_ones(spark):
    """A short text whose hashes all miss the threshold is found in the long one that holds it."""
    short = next(t for i in range(1000) if (h := all_hashes(t := " ".join(f"s{i}x{j}" for j in range(9)))) and h[0] >= END)
    long = " ".join(f"w{i}" for i in range(300)) + " " + short + " " + " ".join(f"v{i}" for i in range(300))
    docs = spark.createDataFrame([(3, short), (2, long), (1, short)], "doc_id long, text string")
    rows = {r.doc_id: r for r in fp.compare(docs).collect()}
    share = len(set(all_hashes(short))) / len(set(all_hashes(long)))
    assert rows[3].kept_in_next == 1.0 and rows[3].near_next == pytest.approx(share)
    assert rows[2].kept_in_next == pytest.approx(share) and rows[2].near_next == pytest.approx(share)
    assert rows[1].near_next == 1.0 and rows[1].fingerprint == rows[3].fingerprint
    check(docs)


def test_no_python_in_the_plan(odd):
    plan = fp.compare(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
