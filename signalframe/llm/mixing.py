"""Mixing sources to target weights by the cube method.

Every source gets a target number of words; a document is taken ``floor(rate)``
times and once more with the remaining fractional probability, the same for all
documents of its source. Which documents those are is drawn by the cube method:
probabilities move through the null space of two constraints per source (number
of documents, number of words) until they are 0 or 1. A window of three
documents always has such a direction, so a chunk of any size ends with at most
two undecided documents. Chunks are independent; what they leave over meets in
the next level, until one small landing problem per source is left. There the
word constraint goes first, then the document constraint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, row_key, text_of, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
CHUNK = 4096
FAN = 512
_EPS = 1e-9


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size)`` plus ``target``: words each source should give.

    ``share`` of all words is split by weight; nothing passes ``most`` times its
    source, and the excess goes to the others by weight. This is the level L with
    ``sum(min(most * size, L * weight))`` equal to the total, read off running
    sums along ``most * size / weight``. The table has one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    table = sources.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(F.lit(1))
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(every) - F.sum("weight").over(after) + F.col("weight")
    table = table.select("*", (left / weights_left).alias("level"), F.row_number().over(rising).alias("at"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("at", "level"))
    table = table.withColumn("level", F.min(fits).over(every)["level"])
    return table.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _flight(p: np.ndarray, size: np.ndarray, rng, landing: bool) -> np.ndarray:
    """Cube flight over one chunk; ``p`` in, 0/1 out but for at most two entries."""
    p = [float(v) for v in p]
    z = [float(v) for v in size]
    draws = iter(rng.random(len(p) + 8))
    live: list[int] = []

    def move(idx, u):
        up = down = float("inf")
        for i, d in zip(idx, u):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if next(draws) * (up + down) < down else -down
        for i, d in zip(idx, u):
            v = p[i] + step * d
            p[i] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v

    def settle():
        live[:] = [i for i in live if 0.0 < p[i] < 1.0]

    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        live.append(i)
        if len(live) == 2 and z[live[0]] == z[live[1]]:
            move(live, (1.0, -1.0))
        elif len(live) == 3:
            a, b, c = (z[j] for j in live)
            scale = max(abs(a - b), abs(b - c), abs(c - a))
            move(live, (1.0, -1.0, 0.0) if scale == 0 else ((b - c) / scale, (c - a) / scale, (a - b) / scale))
        else:
            continue
        settle()
    if landing:
        while len(live) > 1:
            move(live[:2], (1.0, -1.0))
            settle()
        for i in live:
            p[i] = float(next(draws) < p[i])
    return np.array(p)


_UNIT = "doc_id long, row long, source string, size long, rate double, p double, chunk long"


def _fly(seed: int, level: int, landing: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "row"], ascending=False, kind="stable")
        name = "" if key[0] is None else key[0]
        rng = np.random.default_rng([seed, level, int(key[1]), key[0] is None, *name.encode()])
        pdf["p"] = _flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(), rng, landing)
        return pdf

    return run


def _dealt(units: DataFrame, known: DataFrame, seed: int) -> DataFrame:
    """One row per document with its source's rate and a chunk of about ``CHUNK`` rows, equal rows apart from each other."""
    # Narrow rows meet one row per source; Spark picks the join and splits a hot source.
    flown = units.join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same"))))
    return flown.select(
        "doc_id", "row", "source", "size", "rate",
        (F.col("rate") - F.floor("rate")).alias("p"),
        F.pmod(F.xxhash64(F.lit(seed), "row", "number"), F.col("chunks")).alias("chunk"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 11) -> DataFrame:
    """One row per document: ``doc_id, row, source, size, source_size, target, copies, taken``.

    ``row`` is a hash of all the document's columns, see :func:`repeat`. A null
    text has size 0; a null source is a source of its own, last in order; rows
    that repeat are drawn one by one; a source without words takes none of its
    documents; an empty table gives an empty one. Reruns draw the same documents.
    """
    size = F.size(words_of(text_of())).cast("long")
    # Equal rows are counted first and numbered after, so each finds a chunk by itself.
    units = docs.select("doc_id", row_key(docs).alias("row"), "source", size.alias("size")).groupBy("doc_id", "row", "source", "size")
    units = keep(units.agg(F.count(F.lit(1)).alias("same")), "mix-sizes")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("same")).alias("source_size"), F.sum("same").alias("n_docs"))
    plan = targets(sums.select("source", "source_size"), weights, share, most)
    plan = keep(plan.join(sums.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-plan")
    chunks = (F.floor((F.col("n_docs") - 1) / CHUNK) + 1).cast("long")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = plan.select(F.col("source").alias("s"), rate.alias("rate"), chunks.alias("chunks"))
    flown = _dealt(units, known, seed)
    most_chunks = plan.agg(F.max(chunks)).collect()[0][0] or 1
    level, decided = 0, []
    while True:
        landing = most_chunks == 1
        flown = flown.groupBy("source", "chunk").applyInPandas(_fly(seed, level, landing), _UNIT)
        if landing:
            break
        flown = keep(flown, "mix-flight")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(flown.filter(~undecided))
        flown = flown.filter(undecided).withColumn("chunk", F.floor(F.col("chunk") / FAN).cast("long"))
        level, most_chunks = level + 1, (most_chunks - 1) // FAN + 1
    for part in decided:
        flown = flown.unionByName(part)
    copies = (F.floor("rate") + F.col("p")).cast("long")
    facts = plan.select(F.col("source").alias("s"), "source_size", "target")
    return flown.join(facts, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "row", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents of ``docs``, each as often as the mix takes it, with their own columns."""
    own = docs.columns
    times = mixed.groupBy(F.col("row").alias("__row")).agg(F.sum("copies").cast("int").alias("__n")).filter("__n > 0")
    rows = docs.withColumn("__row", row_key(docs)).dropDuplicates(["__row"])
    taken = rows.join(times, "__row").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return taken.select(*[f"`{c}`" for c in own])
