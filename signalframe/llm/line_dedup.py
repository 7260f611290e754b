"""Repeated multi-line chunks, cut where the content says so.

Each line is hashed; a rolling hash spans a line and the one before it. A chunk
ends after every line whose rolling hash is a local minimum, so boundaries depend
on three or four lines only: lines put in ahead of a passage do not move the
chunks inside it, and two ends are never adjacent. A line of ``LONG`` words or
more is a passage by itself and forms a chunk of its own.

A passage of few lines may hold no whole chunk. So every line also begins, and every
line ends, the shortest run of lines with ``LONG`` words: a repeated passage of as
many words is covered by such runs inside it, whatever surrounds it. Runs that
repeated chunks cover in all their places add nothing and are left out.

Chunks and runs met in more than one place by hash are candidates. They are compared
by their bytes with the first place that has the same bytes, which keeps its lines;
from all other places they go, a chunk together with the lines before and after it
as far as they too equal the first place's neighbours (by 64-bit hash: a chunk's
ends depend on what surrounds a passage, so its first and last lines fall outside).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, keep, row_key, text_of

LONG = 50
LEAST_LINES = 2
EDGE = 2
#: Odd, so it has an inverse modulo 2^64: run hashes are differences of running sums.
_BASE = 0x9E3779B97F4A7C15


def _let(value: Column, fn) -> Column:
    return F.element_at(F.transform(F.array(value), fn), 1)


def chunk_ends(lines: Column, long: int = LONG) -> Column:
    """One-based numbers of the lines that end a chunk; the last line always does."""
    is_long = lambda s: F.size(F.split(F.trim(s), GAP)) >= long

    def ends(h, wide):
        rolled = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), F.slice(h, 1, F.size(h) - 1)), h, lambda a, b: F.xxhash64(a, b))

        def chosen(r):
            low = lambda i: (i > 1) & (r[i - 1] < r[i - 2]) & (r[i - 1] < r[i])
            return F.filter(F.sequence(F.lit(1), F.size(r)), lambda i: (i == F.size(r)) | wide[i - 1] | wide[i] | low(i))

        return _let(rolled, chosen)

    return _let(F.transform(lines, lambda s: F.xxhash64(s)), lambda h: _let(F.transform(lines, is_long), lambda wide: ends(h, wide)))


def _cut(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, lines, ends)``; ``row`` hashes all columns, equal rows are one document."""
    lines = docs.select("doc_id", row_key(docs).alias("row"), F.split(text_of(), "\n").alias("lines"))
    return lines.withColumn("ends", chunk_ends(F.col("lines")))


def _start(ends: Column, k: Column) -> Column:
    return F.when(k > 1, F.get(ends, k - 2) + 1).otherwise(1)


def _alike(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(a, i) != F.get(b, i)))
    return F.array_min(differ)


def _runs(long: int):
    """``row, at, end, hash`` of the shortest runs of ``long`` words from and up to every line."""

    def run(batches):
        for batch in batches:
            row = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            split = [t.split(b"\n") for t in texts]
            sizes = np.array([len(x) for x in split], dtype=np.int64)
            lines = [x for one in split for x in one]
            n = len(lines)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            begin, stop = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.cumsum(sizes), sizes)
            upto = np.cumsum(np.fromiter((len(x.split()) for x in lines), np.int64, n))
            before = np.r_[0, upto[:-1]] if n else upto
            index = np.arange(n)
            # The first line by whose end, and the last line by whose start, there are enough words.
            down, up = np.searchsorted(upto, before + long), np.searchsorted(before, upto - long, side="right") - 1
            from_here, to_here = down < stop, (up >= begin) & (upto - long >= 0)
            at = np.concatenate([index[from_here], up[to_here]])
            end = np.concatenate([down[from_here], index[to_here]])
            pairs = np.unique(at * np.int64(n + 1) + end)
            at, end = pairs // (n + 1), pairs % (n + 1)
            power = np.cumprod(np.full(n + 1, _BASE, dtype=np.uint64))
            inverse = np.cumprod(np.full(n + 1, pow(_BASE, -1, 2**64), dtype=np.uint64))
            hashed = np.fromiter((xxhash.xxh64_intdigest(x) for x in lines), np.uint64, n) * power[:n]
            total = np.r_[np.zeros(1, np.uint64), np.cumsum(hashed, dtype=np.uint64)]
            value = (total[end + 1] - total[at]) * inverse[at] + (end - at).astype(np.uint64)
            first = begin[at] - 1
            columns = [row[doc[at]], (at - first).astype(np.int32), (end - first).astype(np.int32), value.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "at", "end", "hash"])

    return run


def _needed_runs(spots: DataFrame) -> DataFrame:
    """Repeated runs that repeated chunks do not cover in at least one place, in all their places."""
    spans = F.collect_list(F.when(~F.col("run"), F.struct("at", "end")))
    runs = F.collect_list(F.when(F.col("run"), F.struct("at", "end", "hash")))
    each = spots.groupBy("row").agg(F.sort_array(spans).alias("chunks"), runs.alias("runs")).filter(F.size("runs") > 0)
    # Neighbouring chunks join up; a run is covered if one joined span holds it.
    zero = F.struct(F.array().cast("array<struct<at:int,end:int>>").alias("done"), F.lit(-1).alias("at"), F.lit(-1).alias("end"))
    flush = lambda a: F.concat(a["done"], F.array(F.struct(a["at"].alias("at"), a["end"].alias("end"))))
    grow = lambda a, c: F.when(c["at"] <= a["end"] + 1, F.struct(a["done"].alias("done"), a["at"].alias("at"), F.greatest(a["end"], c["end"]).alias("end"))).otherwise(
        F.struct(flush(a).alias("done"), c["at"].alias("at"), c["end"].alias("end"))
    )
    joined = each.select(F.aggregate("chunks", zero, grow, flush).alias("spans"), "runs")
    open_ = F.filter("runs", lambda r: ~F.exists("spans", lambda c: (c["at"] <= r["at"]) & (c["end"] >= r["end"])))
    needed = joined.select(F.explode(F.array_distinct(F.transform(open_, lambda r: r["hash"]))).alias("hash")).distinct()
    return spots.filter("run").join(needed.hint("merge"), "hash")


def repeated(docs: DataFrame) -> DataFrame:
    """``(row, first, last)``: line ranges to remove."""
    cut = _cut(docs)
    spans = F.transform(F.sequence(F.lit(1), F.size("ends")), lambda k: F.struct(_start(F.col("ends"), k).alias("at"), F.get("ends", k - 1).alias("end")))
    one = cut.select("row", "lines", F.explode(spans).alias("s"))
    own = F.slice("lines", F.col("s.at"), F.col("s.end") - F.col("s.at") + 1)
    wide = F.size(F.split(F.trim(F.get(own, F.lit(0))), GAP)) >= LONG
    one = one.filter((F.col("s.end") - F.col("s.at") + 1 >= LEAST_LINES) | wide)
    text = F.array_join(own, "\n")
    # Blank chunks hold nothing to repeat.
    one = one.filter(F.length(F.regexp_replace(text, GAP, "")) > 0)
    chunks = one.select("row", "s.at", "s.end", F.xxhash64(text).alias("hash"), F.lit(False).alias("run"))
    runs = docs.select(row_key(docs).alias("row"), text_of().alias("text")).mapInArrow(_runs(LONG), "row long, at int, end int, hash long")
    spots = keep(chunks.unionByName(runs.withColumn("run", F.lit(True))), "spots")
    places = spots.select("hash", "run", F.xxhash64("row", "at").alias("place"))
    # Rows that agree in all columns are one document, so two different places make a repeat.
    often = places.groupBy("hash", "run").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a <> b").select("hash", "run")
    spots = keep(spots.join(often.hint("merge"), ["hash", "run"]).distinct(), "repeated-spots")
    taken = spots.filter("not run").select("row", "at", "end", "run").unionByName(_needed_runs(spots).select("row", "at", "end", "run"))
    marked = taken.groupBy("row").agg(F.collect_list(F.struct("at", "end", "run")).alias("spans"))
    # Only documents with a candidate give their bytes; each chunk brings its neighbours' lines.
    # Lists that grow with the corpus are merged, not broadcast, at any size.
    found = cut.join(marked.hint("merge"), "row").withColumn("s", F.explode("spans"))
    at, end, is_run = F.col("s.at"), F.col("s.end"), F.col("s.run")
    # The neighbouring chunk and EDGE lines beyond: as far as foreign lines can move an end.
    k = F.array_position("ends", end)
    above = F.greatest(_start(F.col("ends"), k - 1) - EDGE, F.lit(1)).cast("int")
    below = (F.coalesce(F.get("ends", k.cast("int")), F.size("lines")) + EDGE).cast("int")
    none = F.array().cast("array<bigint>")
    hashes = lambda lines: F.when(is_run, none).otherwise(F.transform(lines, lambda s: F.xxhash64(s)))
    found = found.select(
        "doc_id", "row", at.alias("at"), end.alias("end"), is_run.alias("run"), F.array_join(F.slice("lines", at, end - at + 1), "\n").alias("chunk"),
        hashes(F.reverse(F.slice("lines", above, at - above))).alias("above"), hashes(F.slice("lines", end + 1, F.greatest(below - end, F.lit(0)))).alias("below"),
    ).withColumn("hash", F.xxhash64("chunk"))
    found = keep(found, "candidates")
    # The bytes are part of the grouping key; equal chunks of a task become one row before the shuffle.
    place = F.struct("doc_id", "row", "at")
    first = found.groupBy("hash", "run", "chunk").agg(F.min(F.struct(place.alias("place"), "above", "below")).alias("f"))
    first = keep(first.select("hash", "run", F.col("chunk").alias("bytes"), F.col("f.place").alias("place"), F.col("f.above").alias("f_above"), F.col("f.below").alias("f_below")), "first-places")
    later = found.join(first, ["hash", "run"]).filter((F.col("chunk") == F.col("bytes")) & (place != F.col("place")))
    up, down = _alike(F.col("above"), F.col("f_above")), _alike(F.col("below"), F.col("f_below"))
    # A run that overlaps its own first place leaves that one's lines.
    shift = F.when(F.col("run") & (F.col("row") == F.col("place.row")), F.greatest(F.lit(0), F.col("place.at") + (F.col("end") - F.col("at")) + 1 - F.col("at"))).otherwise(0)
    ranges = later.select("row", (F.col("at") - up + shift).alias("first"), (F.col("end") + down).alias("last"))
    return ranges.filter(F.col("first") <= F.col("last"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cleared of repeated chunks, plus ``n_lines`` and ``n_removed``.

    A null text stays null with 0 lines; a text that repeats whole becomes empty;
    the first place by ``doc_id`` (null first) keeps its lines. Rows that agree in
    all columns are one document and keep the same lines. Columns named
    ``n_lines`` or ``n_removed`` are replaced; an empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = repeated(docs).groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last"))))).alias("__gone"))
    gone = keep(gone.withColumnRenamed("row", "__at"), "removed-lines")
    rows = docs.withColumn("__row", row_key(docs)).join(gone.hint("merge"), F.col("__row") == F.col("__at"), "left")
    rows = rows.withColumn("__lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(1), F.size("__lines")), F.col("__gone"))
    cleaned = F.array_join(F.transform(left, lambda i: F.get("__lines", i - 1)), "\n")
    text = F.when(F.col("__gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(cleaned)
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size("__lines")), F.lit(0)).cast("long")
    n_removed = F.coalesce(F.when(F.col("text").isNotNull(), F.size("__gone")), F.lit(0)).cast("long")
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in own]
    return rows.select(*columns, n_lines.alias("n_lines"), F.greatest(n_removed, F.lit(0)).alias("n_removed"))
