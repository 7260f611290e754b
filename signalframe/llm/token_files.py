"""Token ids in ORC: one row per document, ascending ids, an index of the shards.

A data file holds ``doc_id, shard, before, n_tokens, ids``. Integer columns are
run-length encoded by ORC; each stripe has row indexes and a Bloom filter on
``doc_id``, so a look-up skips stripes and row groups by metadata, and a reader
may take one stripe per task. ``before`` counts the shard's ids ahead of the
document; the index has one row per shard with its totals and its first id's
place in the whole corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Numbers, Words, text_of

#: Words a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 700_000
#: Letter runs it remembers, which make a forgotten word cheap to learn again.
REMEMBERED_RUNS = 600_000
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts by a tokenizer whose words never cross white space.

    Each different word is encoded once by the library; a text is its words' ids in
    order. A word of letters and closing marks is taken as its letters (A-Z
    in lower case) and its marks, where the tokenizer splits it anyway; many such letter
    runs go in one text and part at the ends of words. All other words go one by one.
    """

    _MARKS = ".,!?;:"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.runs: dict[str, bytes] = {}
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self):
        self.numbers, self.learned = Numbers(), 0
        self.ids = np.zeros(1 << 20, dtype=np.int32)
        self.ends = np.zeros(1 << 16, dtype=np.int64)

    def _append(self, ids: np.ndarray, lengths: np.ndarray):
        n = self.learned
        at = int(self.ends[n - 1]) if n else 0
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(lengths) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[at : at + len(ids)] = ids
        self.ends[n : n + len(lengths)] = at + np.cumsum(lengths)
        self.learned += len(lengths)

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the fast call does not work out where tokens lie."""
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]):
        """Encode new different words, in the order of their numbers. Ids are kept as bytes, which join fast and lie close."""
        if len(self.runs) > REMEMBERED_RUNS:
            self.runs = {}
        runs, heads, tails, other, marks = self.runs, [], [], [], self._MARKS
        # Lower-cased (A-Z only) and decoded all at once: no word holds a space.
        for w, whole in zip(words, b" ".join(words).lower().decode("utf-8", "replace").split(" ")):
            run = whole.rstrip(marks)
            if run.isalpha():
                heads.append(run)
                tails.append(whole[len(run) :])
            else:
                heads.append(None)
                tails.append("")
                other.append(w.decode("utf-8", "replace"))
        new = [r for r in dict.fromkeys(heads) if r is not None and r not in runs]
        parts = [new[at : at + 64] for at in range(0, len(new), 64)]
        for some, ids in zip(parts, self._many([" ".join(some) for some in parts])):
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            if len(ends) == len(some):
                raw = ids.tobytes()
                runs.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends)]))
            else:  # letters that normalise to something else
                runs.update((r, self._one(r).tobytes()) for r in some)
        runs[""] = b""
        for mark in set(tails) - runs.keys():
            runs[mark] = self._one(mark).tobytes()
        alone = iter([ids.tobytes() for ids in self._many(other)])
        found = [(next(alone) if h is None else runs[h]) + runs[t] for h, t in zip(heads, tails)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self._append(np.frombuffer(b"".join(found), dtype=np.int32), sizes)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each text."""
        if self.numbers.n > REMEMBERED:
            self.forget()
        words = Words(texts)
        at, new = self.numbers.of(words)
        if new:
            self.learn(new)
        ends = self.ends[: self.learned]
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        lengths = ends[at] - starts[at]
        total = np.r_[0, np.cumsum(lengths)]
        where = np.repeat(starts[at] - total[:-1], lengths) + np.arange(total[-1])
        counts = np.diff(total[np.r_[0, np.cumsum(words.counts)]])
        return self.ids[where], counts


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


_SCHEMA = "doc_id long, shard int, before long, n_tokens int, ids array<int>"
_BYTES = 1 << 22


def _pieces(texts):
    """Slices of about ``_BYTES`` bytes of text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _encode(path: str, end_id: int):
    def run(batches):
        enc, shard, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in _pieces(texts):
                ids, counts = enc.encode(texts[a:b])
                stops = np.cumsum(counts + 1)
                out = np.full(stops[-1], end_id, dtype=np.int32)
                inside = np.ones(len(out), dtype=bool)
                inside[stops - 1] = False
                out[inside] = ids
                offsets = np.r_[0, stops].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.full(b - a, shard, np.int32)),
                        pa.array(before + offsets[:-1].astype(np.int64)),
                        pa.array((counts + 1).astype(np.int32)),
                        lists,
                    ],
                    ["doc_id", "shard", "before", "n_tokens", "ids"],
                )
                before += int(stops[-1])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, stripe_mb: int = 32) -> None:
    """Encode every text, append ``end_id``, write ``folder/data`` and ``folder/index``.

    A null text is empty, a null ``doc_id`` comes first, rows that share an id
    follow each other by their text; an empty table writes an empty format.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    encoded = rows.mapInArrow(_encode(tokenizer, end_id), _SCHEMA)
    encoded.write.format("orc").options(
        **{
            "orc.bloom.filter.columns": "doc_id",
            "orc.stripe.size": str(stripe_mb << 20),
            "orc.row.index.stride": "1000",
            "compression": "zstd",
        }
    ).save(f"{folder}/data")
    data = docs.sparkSession.read.schema(_SCHEMA).orc(f"{folder}/data")
    shards = data.groupBy("shard").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("docs"), F.sum(F.col("n_tokens").cast("long")).alias("tokens")
    )
    # One row per file: the running sum is over shards, not documents.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    index = shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    index.write.orc(f"{folder}/index")


def read_tokens(spark, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids``; ``start`` is the place of the first id in the corpus.

    With ``doc_ids`` the filter reaches the ORC reader, which skips by row index
    and Bloom filter.
    """
    data = spark.read.schema(_SCHEMA).orc(f"{folder}/data")
    if doc_ids is not None:
        data = data.filter(F.col("doc_id").isin(doc_ids))
    index = spark.read.schema("shard int, first_doc long, last_doc long, docs long, tokens long, start long").orc(f"{folder}/index")
    found = data.join(index.select("shard", "start"), "shard")
    return found.select("doc_id", (F.col("start") + F.col("before")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _crc(batches):
    for batch in batches:
        ids = batch.column(3)
        flat, offsets = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def with_crc(tokens: DataFrame) -> DataFrame:
    """The ids' unsigned crc32 as little-endian unsigned 32-bit integers, in place of the ids."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
