import random
from collections import Counter

import corpus_pipeline
from signalframe.llm import simhash

from .conftest import SCHEMA, as_rows, prose
from .test_quality import brute_rejects


def jaccard(a, b):
    def sh(t):
        w = "".join(c.lower() if c.isascii() else c for c in t).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = sh(a or ""), sh(b or "")
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies():
    rng = random.Random(11)
    texts = [None, "", "three short words"]
    for g in range(12):
        base = prose(rng, 150).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(150)] = "edit"
            texts.append(" ".join(copy))
    half = prose(rng, 150).split()
    texts += [" ".join(half), " ".join(half[:75] + prose(rng, 75).split()), " ".join(half)]
    return texts


def test_near_dedup_keeps_one_of_each_group(spark):
    texts = near_copies()
    docs = spark.createDataFrame(as_rows(texts), SCHEMA).repartition(4)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(label))


def test_near_dedup_odd_rows(odd, empty):
    out = simhash.keep_one(odd).collect()
    texts = [r.text for r in out]
    assert all(jaccard(a, b) < 0.8 for i, a in enumerate(texts) for b in texts[:i])
    assert {r.doc_id for r in out} <= {r.doc_id for r in odd.collect()}
    assert simhash.keep_one(empty).collect() == []


def test_stages(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    given = {r.doc_id: r for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "source mix", "SentencePiece encoding"]
    before = set(given)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.keep(stage(spark, docs, "/root/testdata/sf0.001"), "test-stage")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and ids
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            assert ids == {d for d, r in given.items() if not brute_rejects(r.text)}
        before = ids
    assert Counter(r.draw for r in docs.collect()).keys() == {1, 2}
    docs = empty.select(*columns)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.collect() == []
