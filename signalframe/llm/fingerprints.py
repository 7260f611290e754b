"""Threshold-scaled sketches: every shingle hash below a fixed share of the range.

The share is fixed, not the number of hashes, so a sketch grows with its text,
sketches of parts merge by union, and the overlap of two sketches estimates the
containment of texts of very unequal length without bias. A text whose shingles
all miss the range (a short one: half of those of five shingles, one in a million
of a hundred) keeps all its hashes. None of them is in another text's sketch, so
whatever it is compared with must bring all hashes too. Only DataFrame functions
are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, shingle_hashes, text_of, words_of

#: One in so many hashes is retained.
SCALE = 8
K = 5
_LOW = -(1 << 63)


def _range_end(scale: int) -> int:
    return _LOW + (1 << 64) // scale


def every_hash(words: Column, k: int = K) -> Column:
    """Sorted different hashes of all k-word shingles (one for fewer words, none for none)."""
    return F.sort_array(F.array_distinct(shingle_hashes(words, k)))


def sketch(words: Column, k: int = K, scale: int = SCALE) -> Column:
    """Sorted different hashes below the threshold; all hashes if there is none below it."""

    def retain(all_hashes):
        low = F.filter(all_hashes, lambda h: h < F.lit(_range_end(scale)))
        return F.when(F.size(low) > 0, low).otherwise(all_hashes)

    kept = F.element_at(F.transform(F.array(shingle_hashes(words, k)), retain), 1)
    return F.sort_array(F.array_distinct(kept))


def is_whole(sketch: Column, scale: int = SCALE) -> Column:
    """Whether a sketch holds all hashes of its text because none is below the threshold."""
    return (F.size(sketch) > 0) & (F.get(sketch, F.lit(0)) >= F.lit(_range_end(scale)))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of the union of two shingle sets."""
    both = F.sort_array(F.array_union(a, b))
    low = F.filter(both, lambda h: h < F.lit(_range_end(scale)))
    return F.when(F.size(low) > 0, low).otherwise(both)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two texts without words are alike."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(1.0)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an a without words."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(1.0)


def _ring(ids: DataFrame) -> DataFrame:
    """``(id, row, prev_id, prev_row, need, needs_all)``: the document before each one, half that
    one's length and whether it must be compared by all hashes.

    The order is by descending id (null last), then by the row's hash; the first
    follows the last. Rows go into ranges of that order; inside a range a window
    sees the neighbour, and one row per range takes part in joining the ranges up.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("row")]
    ranged = keep(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    me = F.struct("id", "row", "half", "whole")
    here = ranged.select("*", F.lag(me).over(W.partitionBy("part").orderBy(*order)).alias("before"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "row")
    ends = ranged.groupBy("part").agg(F.max_by(me, place).alias("last"))
    across = W.orderBy("part")
    whole = across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(across), F.last("last").over(whole)).alias("edge"))
    here = here.join(ends, "part").withColumn("before", F.coalesce("before", "edge"))
    return here.select("id", "row", F.col("before.id").alias("prev_id"), F.col("before.row").alias("prev_row"), F.col("before.half").alias("need"), F.col("before.whole").alias("needs_all"))


def compare(docs: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last half of the code points replaced by the first as
    many (or all) of the next document's by descending ``doc_id``; after the last
    comes the first. Result: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, kept_in_edited, kept_in_next``
    (the last two are containments) and ``next_doc_id``.

    A null text is empty; a null ``doc_id`` is last; rows with equal ids follow
    each other by hash; rows that share id and text are one document and get the
    same result each; a single document follows itself; an empty table stays empty.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    base = base.withColumn("id", F.coalesce("doc_id", F.lit(-1).cast("long"))).withColumn("row", F.xxhash64("doc_id", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    whole = is_whole(sketch(words_of(F.col("text")), k, scale), scale)
    ids = base.select("doc_id", "id", "row", half.alias("half"), whole.alias("whole")).distinct()
    ring = keep(_ring(ids), "ring")
    prints = base.withColumn("w", words_of(F.col("text"))).withColumn("print", sketch(F.col("w"), k, scale))
    prints = prints.select("doc_id", "id", "row", "text", "print")
    # Each document sends its predecessor the part that one needs and its own sketch.
    # Both uses of the documents read one shuffle by (id, row).
    sent = prints.join(ring.hint("merge"), ["id", "row"]).select(
        F.col("prev_id").alias("id"), F.col("prev_row").alias("row"), F.col("doc_id").alias("next_doc_id"),
        F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("print").alias("next_print"),
        F.when(F.col("needs_all"), every_hash(words_of(F.col("text")), k)).alias("next_all"),
    )
    both = prints.join(sent.dropDuplicates(["id", "row"]).hint("merge"), ["id", "row"])
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("head"))
    both = both.select("doc_id", "next_doc_id", "text", n.cast("long").alias("n_chars"), "print", "next_print", "next_all", edited.alias("edited"))
    both = both.withColumn("w", words_of(F.col("edited"))).withColumn("edited_print", sketch(F.col("w"), k, scale))
    # If one side is whole, both are compared by all their hashes.
    with_edited = is_whole(F.col("print"), scale) | is_whole(F.col("edited_print"), scale)
    with_next = is_whole(F.col("print"), scale) | is_whole(F.col("next_print"), scale)
    own_all = every_hash(words_of(F.col("text")), k)
    both = both.select(
        "doc_id", "next_doc_id", "n_chars", "edited", "print", "edited_print",
        F.when(with_edited, own_all).otherwise(F.col("print")).alias("a"), F.when(with_edited, every_hash(F.col("w"), k)).otherwise(F.col("edited_print")).alias("b"),
        F.when(with_next, own_all).otherwise(F.col("print")).alias("c"), F.coalesce("next_all", "next_print").alias("d"),
    )
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("c"), F.col("d")).alias("near_next"),
        containment(F.col("a"), F.col("b")).alias("kept_in_edited"), containment(F.col("c"), F.col("d")).alias("kept_in_next"), "next_doc_id",
    )
