"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words: space and the controls tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    """The whole text; a null text is an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def shingle_hashes(words: Column, k: int) -> Column:
    """64-bit hash of every run of ``k`` words; of all the words if there are fewer, none if there are none."""

    # Single elements, not slices: a slice inside a lambda walks the whole array each
    # time. The words are bound once per row, however they were made.
    def hashes(w):
        n = F.greatest(F.size(w) - (k - 1), F.lit(1))
        one = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<long>"))

    return F.element_at(F.transform(F.array(words), hashes), 1)


def whole_numbers(embedding: Column, scale: int) -> Column:
    """``floor(scale * c)`` of every entry as long; null for a vector that is null or has a null or non-finite entry."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    wide = embedding.cast("array<double>")
    return F.when(~F.exists(wide, bad), F.transform(wide, lambda c: F.floor(c * scale).cast("long")))


def list_matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """Lists as rows of ``d`` longs; what a shorter list lacks is 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def row_key(docs: DataFrame) -> Column:
    """64-bit key over every column: rows that agree in all columns share it."""
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])


def shared_folder(spark) -> str:
    """The folder all executors and the driver see (``spark.checkpoint.dir``).

    Only a local session without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return folder


def shared_path(spark, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str = "table") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A-Z in lower case, and the bytes between words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Longer words are hashed one by one.
LONG_BYTES = 256


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def distinct(values: np.ndarray) -> np.ndarray:
    """Different values, sorted; ``np.unique`` without counts goes through a hash table, which takes far longer."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


class Words:
    """Where the words of some texts lie, found on their bytes at once.

    ``start`` and ``size`` are in ``data``, the texts one after another; ``counts`` is the
    number of words of each text.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = b" ".join([*texts, bytes(8)])
        self.data = np.frombuffer(raw, dtype=np.uint8)
        if lower:
            self.data = LOWER[self.data]
        n = len(raw) - 8
        gap = np.r_[True, _IS_GAP[self.data[:n]]]
        change = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.size = change[::2], change[1::2] - change[::2]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.counts = np.diff(np.searchsorted(self.start, np.r_[0, ends]))

    def eights(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next eight bytes of words as numbers, zero beyond their ends."""
        by_byte = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        return by_byte[at] & _FIRST[np.minimum(left, 8)]

    def hashes(self) -> np.ndarray:
        """64-bit hashes; words of at most eight bytes and equal size have different ones."""
        import xxhash

        h = mix64(self.size.astype(np.uint64) * _GOLD + self.eights(self.start, self.size))
        live, k = np.flatnonzero((self.size > 8) & (self.size <= LONG_BYTES)), 8
        while len(live):
            h[live] = mix64(h[live] * _GOLD + self.eights(self.start[live] + k, self.size[live] - k))
            k += 8
            live = live[self.size[live] > k]
        for i in np.flatnonzero(self.size > LONG_BYTES).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.start[i] + self.size[i]].tobytes())
        return h

    def alike(self, at: np.ndarray, other: "Words", to: np.ndarray) -> np.ndarray:
        """Whether the words at ``at`` are, byte by byte, the words of ``other`` at ``to``."""
        good = self.size[at] == other.size[to]
        live, k = np.flatnonzero(good & (self.size[at] <= LONG_BYTES)), 0
        while len(live):
            a, b = at[live], to[live]
            left = self.size[a] - k
            good[live] = self.eights(self.start[a] + k, left) == other.eights(other.start[b] + k, left)
            k += 8
            live = live[good[live] & (left > 8)]
        for i in np.flatnonzero(good & (self.size[at] > LONG_BYTES)).tolist():
            good[i] = self.word(at[i]) == other.word(to[i])
        return good

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def bytes_of(self, some: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[some].tolist(), (self.start + self.size)[some].tolist())]


class Numbers:
    """Numbers of the different words met so far, in numpy arrays.

    A word is found by its hash and compared byte by byte; one whose hash belongs to
    another word gets a new number each time.
    """

    def __init__(self):
        self.n = 0
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.kept = Words([])  # known words in the order of their hashes' arrival
        self.row = np.zeros(0, np.int64)

    def of(self, words: Words) -> tuple[np.ndarray, list[bytes]]:
        """Every word's number, and the words that got new ones, in their order."""
        values, back = np.unique(words.hashes(), return_inverse=True)
        every = np.arange(len(back))
        one = np.zeros(len(values), np.int64)
        one[back[::-1]] = every[::-1]  # where a hash is met first
        place = np.full(len(values), -1)
        if len(self.known):
            spot = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
            there = np.flatnonzero(self.known[spot] == values)
            spot = spot[there]
            same = words.alike(one[there], self.kept, self.row[spot])
            place[there[same]] = self.place[spot[same]]
            taken = there[~same]
        else:
            taken = np.zeros(0, np.int64)
        new = np.flatnonzero(place < 0)
        new = new[np.argsort(one[new])]
        place[new] = self.n + np.arange(len(new))
        fresh = words.bytes_of(one[new])
        out = place[back]
        odd = np.flatnonzero(~words.alike(every, words, one[back]))
        out[odd] = self.n + len(new) + np.arange(len(odd))
        stay = new[~np.isin(new, taken)]
        self._keep(values[stay], place[stay], words, one[stay])
        self.n += len(new) + len(odd)
        return out, fresh + words.bytes_of(odd)

    def _keep(self, hashes, place, words: Words, at):
        if not len(hashes):
            return
        size = words.size[at]
        row = len(self.kept.start) + np.arange(len(at))
        before = np.cumsum(size) - size
        flat = words.data[np.repeat(words.start[at] - before, size) + np.arange(int(size.sum()))]
        kept, end = self.kept, len(self.kept.data) - 8
        kept.start, kept.size = np.r_[kept.start, end + before], np.r_[kept.size, size]
        kept.data = np.r_[kept.data[:end], flat, np.zeros(8, np.uint8)]
        known = np.r_[self.known, hashes]
        order = np.argsort(known)
        self.known, self.place, self.row = known[order], np.r_[self.place, place][order], np.r_[self.row, row][order]
