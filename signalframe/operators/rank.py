"""Ranked selection: caps, masks, mixtures, best epochs, Pareto fronts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing as H
from .order import hash_head, hash_ordinal, monotone_bucket, ordinal


def first_occurrence(df: DataFrame, keys, order) -> DataFrame:
    """Lowest-ordered row per key; the rank limit prunes before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def head_per_group(df: DataFrame, keys, order, n: int, flag: str = "is_head") -> DataFrame:
    """Mark the first ``n`` rows per key.

    Only ``n`` rows per key and task are shuffled to find the boundary; the flag
    is then a comparison with it. ``order`` must be unique within a key.
    """
    keys, order = list(keys), list(order)
    w = W.partitionBy(*keys).orderBy(*order)
    top = df.select(*keys, *order).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    last = top.groupBy(*keys).agg(F.max(F.struct(*order)).alias("__last"))
    return df.join(last, keys).withColumn(flag, F.struct(*order) <= F.col("__last")).drop("__last")


def patch_scores(energy: DataFrame, bands: list[str] | None = None, weights: dict[str, float] | None = None,
                 keys=("window_id",)) -> DataFrame:
    """Patch importance from band energies ``(keys, channel, patch, band, energy[, good])``.

    log1p, standardise per band over channels x patches (sample sd, floor 1e-6),
    optional band weights, mean over bands, mean over good channels. Every group
    is one window, so all windows below are bounded.
    """
    keys = list(keys)
    e = energy.withColumn("__e", F.log1p(F.greatest(F.col("energy"), F.lit(0.0))))
    stats = e.groupBy(*keys, "band").agg(F.avg("__e").alias("__m"), F.greatest(F.stddev_samp("__e"), F.lit(1e-6)).alias("__s"))
    z = e.join(stats, [*keys, "band"]).withColumn("__z", (F.col("__e") - F.col("__m")) / F.col("__s"))
    if weights:
        table = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
        z = z.withColumn("__z", F.col("__z") * F.try_element_at(table, F.col("band")))
    good = F.col("good").cast("double") if "good" in energy.columns else F.lit(1.0)
    per = z.withColumn("__g", good).groupBy(*keys, "patch", "channel").agg(F.avg("__z").alias("__c"), F.max("__g").alias("__g"))
    return per.groupBy(*keys, "patch").agg((F.sum(F.col("__c") * F.col("__g")) / F.greatest(F.sum("__g"), F.lit(1.0))).alias("score"))


def _top(df: DataFrame, keys, rank_by: Column, ratio: float, rounding: str) -> DataFrame:
    """Mask the ``n`` highest patches of each window (a window has few patches)."""
    keys = list(keys)
    per = W.partitionBy(*keys)
    size = F.count(F.lit(1)).over(per)
    n = F.greatest(F.lit(1), F.bround(size * ratio)) if rounding == "half_even" else F.floor(size * ratio)
    ordered = W.partitionBy(*keys).orderBy(F.desc("__by"), "patch")
    out = df.withColumn("__by", rank_by).withColumn("__n", n).withColumn("__rn", F.row_number().over(ordered))
    return out.withColumn("masked", F.col("__rn") <= F.col("__n")).drop("__by", "__n", "__rn")


def importance_mask(scores: DataFrame, ratio: float, alpha: float = 0.6, seed=0, keys=("window_id",)) -> DataFrame:
    """Mask patches by ``alpha * standardised score + (1 - alpha) * uniform``."""
    keys = list(keys)
    per = W.partitionBy(*keys)
    z = (F.col("score") - F.avg("score").over(per)) / F.greatest(F.coalesce(F.stddev_samp("score").over(per), F.lit(0.0)), F.lit(1e-6))
    mixed = scores.withColumn("__mix", alpha * z + (1.0 - alpha) * H.uniform(seed, *keys, "patch"))
    return _top(mixed, keys, F.col("__mix"), ratio, "half_even").drop("__mix")


def random_mask(patches: DataFrame, ratio: float, seed=0, keys=("window_id",)) -> DataFrame:
    """Uniform mask, drawn separately for every window."""
    return _top(patches, keys, H.uniform(seed, *list(keys), "patch"), ratio, "half_even")


def shared_random_mask(patches: DataFrame, ratio: float, seed=0, keys=("window_id",)) -> DataFrame:
    """Older random mask: one patch permutation for all windows, floor sizing."""
    return _top(patches, keys, H.uniform(seed, "patch"), ratio, "floor")


def spectral_mask(scores: DataFrame, ratio: float, alpha: float = 0.6, seed=0, keys=("window_id",)) -> DataFrame:
    """Older importance mask: raw spectral score mixed with noise, floor sizing."""
    mixed = alpha * F.col("score") + (1.0 - alpha) * H.uniform(seed, *list(keys), "patch")
    return _top(scores, keys, mixed, ratio, "floor")


def cap_class(df: DataFrame, cls, ratio: float, seed=42, label: str = "label", split: str = "split", key: str = "window_id") -> DataFrame:
    """Limit class ``cls`` to ``int(ratio * median(other class counts))`` per split."""
    other = df.filter(F.col(label) != cls).groupBy(split, label).agg(F.count(F.lit(1)).alias("__c"))
    caps = other.groupBy(split).agg(F.floor(ratio * F.percentile("__c", 0.5)).alias("__cap"))
    mine = df.filter(F.col(label) == cls).join(caps, split, "left")
    quota = F.coalesce("__cap", F.lit(2**62))
    kept = hash_head(mine, [split], H.digest(seed, key), key, quota).select(*df.columns)
    return df.filter(F.col(label) != cls).unionByName(kept)


def cap_per_class(df: DataFrame, n: int, seed=42, label: str = "label", split: str = "split", key: str = "window_id") -> DataFrame:
    """At most ``n`` hash-chosen rows per (split, class)."""
    return hash_head(df, [split, label], H.digest(seed, key), key, F.lit(n)).select(*df.columns)


def shuffle(df: DataFrame, seed=42, key: str = "window_id", partitions: int | None = None) -> DataFrame:
    """Global random order: range partitions of the key's digest, sorted inside."""
    out = df.withColumn("__d", H.digest(seed, key))
    ranged = out.repartitionByRange(partitions, "__d", key) if partitions else out.repartitionByRange("__d", key)
    return ranged.sortWithinPartitions("__d", key).drop("__d")


def weighted_sample(items: DataFrame, draws: DataFrame, weights: dict[str, float], seed=0,
                    dataset: str = "dataset_id", key: str = "item_id", draw: str = "draw_id") -> DataFrame:
    """Sampling with replacement to a corpus mixture.

    Each item weighs ``w_d / n_d``, so a draw is a corpus by cumulative weight and
    then a position inside it: an equi join on (corpus, position), no range join
    over items. ``draws`` has one row per draw.
    """
    total = sum(weights.values())
    bounds, acc = [], 0.0
    for d, w in weights.items():
        acc += w / total
        bounds.append((d, acc))
    u = H.uniform(f"{seed}:corpus", draw)
    corpus = F.lit(bounds[-1][0])
    for d, top in reversed(bounds[:-1]):
        corpus = F.when(u < top, d).otherwise(corpus)
    picked = draws.select(draw, corpus.alias(dataset))
    sizes = items.groupBy(dataset).agg(F.count(F.lit(1)).alias("__n"))
    at = picked.join(sizes, dataset).withColumn(
        "__pos", F.least(F.floor(H.uniform(f"{seed}:item", draw) * F.col("__n")), F.col("__n") - 1)
    )
    placed = hash_ordinal(items.select(dataset, key), [dataset], H.digest(f"{seed}:order", key), [key], "__pos")
    return at.join(placed, [dataset, "__pos"]).select(draw, dataset, key)


def _as_number(metric: str) -> Column:
    """The metric as a number; unparsable text and NaN are null."""
    v = F.col(metric).try_cast("double")
    return F.when(~F.isnan(v), v)


def rank_runs(df: DataFrame, metric: str) -> DataFrame:
    """Runs by a metric stored as text, best first; NaN and unparsable ones last."""
    return df.withColumn("__v", _as_number(metric)).orderBy(F.desc_nulls_last("__v")).drop("__v")


def place_runs(df: DataFrame, metric: str, key: str, name: str = "place") -> DataFrame:
    """Rank number of each run (1 = best) without one global sort task.

    Runs without a number come last, by key: NaN sorts after infinity.
    """
    v = F.coalesce(-_as_number(metric), F.lit(float("nan")))
    data = df.withColumn("__v", v)
    out = ordinal(data, [], ["__v", key], monotone_bucket(F.col("__v")), name)
    return out.withColumn(name, F.col(name) + 1).drop("__v")


def best_epoch(history: DataFrame, metric: str, min_delta: float = 0.0, negate: bool = False, keys=("run_id",), epoch: str = "epoch") -> DataFrame:
    """Checkpoint selection: an epoch improves when ``metric > best + min_delta``.

    With no margin that is the first epoch of the highest value, a plain
    aggregate. Otherwise an improving epoch still exceeds every earlier one, so
    only a run's running-maximum records are folded; a two-level running maximum
    finds them, and they stream through the fold in order, never as one list.
    """
    keys = list(keys)
    value = -F.col(metric) if negate else F.col(metric)
    ok = history.select(*keys, epoch, value.cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    if min_delta == 0:
        top = F.max_by(F.struct(F.col(epoch).cast("long").alias("e"), F.col("__v").alias("v")), F.struct(F.col("__v"), -F.col(epoch)))
        return ok.groupBy(*keys).agg(top.alias("__best")).select(*keys, F.col("__best.e").alias("best_epoch"), F.col("__best.v").alias("best_value"))
    block = F.floor(F.col(epoch) / 4096)
    inside = W.partitionBy(*keys, "__b").orderBy(epoch).rowsBetween(W.unboundedPreceding, -1)
    local = ok.withColumn("__b", block).withColumn("__local", F.max("__v").over(inside))
    tops = ok.withColumn("__b", block).groupBy(*keys, "__b").agg(F.max("__v").alias("__t"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.withColumn("__before", F.max("__t").over(before)).drop("__t")
    records = local.join(tops.hint("merge"), [*keys, "__b"]).filter(
        F.col("__v") > F.greatest(F.coalesce("__local", F.lit(float("-inf"))), F.coalesce("__before", F.lit(float("-inf"))))
    )
    # A run's records in order through one task, a batch at a time: what is carried on
    # is the best so far, so a run may have any number of records.
    narrow = records.select(*keys, F.col(epoch).cast("long").alias("best_epoch"), F.col("__v").alias("best_value"))
    placed = narrow.repartition(*keys).sortWithinPartitions(*keys, "best_epoch")
    return placed.mapInPandas(_fold_records(keys, float(min_delta)), placed.schema)


def _fold_records(keys, min_delta):
    def run(batches):
        open_, best = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            same = [(pdf[k] == pdf[k].shift()) | (pdf[k].isna() & pdf[k].shift().isna()) for k in keys]
            new = ~pd.concat(same, axis=1).all(axis=1).to_numpy()
            row = pdf[keys].iloc[0]
            new[0] = open_ is None or not ((row == open_) | (row.isna() & open_.isna())).all()
            edges = np.r_[np.flatnonzero(new), len(pdf)] if new[0] else np.r_[0, np.flatnonzero(new), len(pdf)]
            values, done = pdf["best_value"].to_numpy(), []
            for a, b in zip(edges[:-1], edges[1:]):
                if new[a] and best is not None:
                    done.append(best)
                    best = None
                # Records rise, so the next improvement is found by bisection.
                at = a if best is None else a + int(np.searchsorted(values[a:b], best["best_value"].iloc[0] + min_delta, side="right"))
                while at < b:
                    best = pdf.iloc[at:at + 1]
                    at = a + int(np.searchsorted(values[a:b], values[at] + min_delta, side="right"))
            open_ = pdf[keys].iloc[-1]
            if done:
                yield pd.concat(done)
        if best is not None:
            yield best

    return run


def pareto_front(df: DataFrame, perf: str, cost: str, maximize: bool = True) -> DataFrame:
    """Rows no other row beats on performance at no more cost.

    A row survives when it is the best of its own cost and strictly better than
    everything cheaper. NaN performance or cost is no result. Best-per-cost is a partial aggregate; the running maximum
    over cheaper costs is two-level, so neither needs all rows in one place.
    """
    p = F.col(perf).cast("double") if maximize else -F.col(perf).cast("double")
    number = lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
    rows = df.withColumn("__p", p).filter(number(F.col("__p")) & number(F.col(cost)))
    per_cost = rows.groupBy(F.col(cost).alias("__cost")).agg(F.max("__p").alias("__best")).withColumn("__b", monotone_bucket(F.col("__cost").cast("double")))
    tops = per_cost.groupBy("__b").agg(F.max("__best").alias("__t"))
    tops = tops.withColumn("__before", F.max("__t").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))).drop("__t")
    local = per_cost.withColumn("__local", F.max("__best").over(W.partitionBy("__b").orderBy("__cost").rowsBetween(W.unboundedPreceding, -1)))
    low = F.lit(float("-inf"))
    beaten = F.greatest(F.coalesce("__local", low), F.coalesce("__before", low))
    none_cheaper = F.col("__local").isNull() & F.col("__before").isNull()
    front = local.join(tops.hint("merge"), "__b").filter(none_cheaper | (F.col("__best") > beaten)).select("__cost", "__best")
    return rows.join(front, (rows[cost] == front["__cost"]) & (rows["__p"] == front["__best"])).drop("__p", "__cost", "__best")
