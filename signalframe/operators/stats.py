"""Corpus statistics and pooled aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """One row describing a manifest.

    Distinct subjects and recordings are counted from partial distinct sets; the
    value lists are over dimensions with few values.
    """
    sets = lambda c: F.sort_array(F.collect_set(c))
    return manifest.agg(
        F.count(F.lit(1)).alias("count"),
        sets("dataset_id").alias("datasets"),
        sets("modality").alias("modalities"),
        F.countDistinct("subject_id").alias("num_subjects"),
        F.countDistinct("recording_id").alias("num_recordings"),
        sets("num_channels").alias("channels"),
        sets("sampling_rate").alias("sampling_rates"),
        F.round(F.sum(F.col("window_end") - F.col("window_start")) / 3600.0, 3).alias("total_hours"),
        F.sort_array(F.collect_set(F.when(~F.col("has_coordinates"), F.col("dataset_id")))).alias("without_coordinates"),
    )


def dataset_stats(windows: DataFrame, path: str = "path", value: str = "x") -> DataFrame:
    """Shape, extremes, mean and population sd per file and combined (path null).

    Each window is reduced to five numbers in place; only those are shuffled.
    """
    x = F.col(value)
    part = windows.select(
        path,
        F.size(x).cast("long").alias("__n"),
        F.array_min(x).alias("__lo"),
        F.array_max(x).alias("__hi"),
        A.mean(x).alias("__m"),
        A.spread(x).alias("__s"),
    ).withColumn("__q", F.col("__n") * (F.col("__s") ** 2))
    out = part.rollup(path).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("__n").alias("min_length"),
        F.max("__n").alias("max_length"),
        F.min("__lo").alias("min"),
        F.max("__hi").alias("max"),
        F.sum("__n").alias("__n"),
        F.sum(F.col("__n") * F.col("__m")).alias("__t"),
        F.sum("__q").alias("__w"),
        F.sum(F.col("__n") * F.col("__m") * F.col("__m")).alias("__b"),
    )
    mean = F.col("__t") / F.col("__n")
    var = (F.col("__w") + F.col("__b")) / F.col("__n") - mean * mean
    return out.select(path, "n_rows", "min_length", "max_length", "min", "max", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def class_distribution(df: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Count and percent of classes 0..k-1, zero classes kept."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    classes = df.sparkSession.range(k).select(F.col("id").cast("int").alias(label))
    total = counts.agg(F.sum("__c").alias("t")).scalar()
    n = F.coalesce(F.col("__c"), F.lit(0))
    return classes.join(counts, label, "left").select(label, n.alias("n"), (100.0 * n / total).alias("percent"))


def multilabel_distribution(pairs: DataFrame, items: DataFrame, key: str = "record_id") -> DataFrame:
    """Items per class, most frequent first. ``pairs(key, class_id)`` is distinct."""
    n_items = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    return pairs.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", 100.0 * F.col("n") / n_items).orderBy(F.desc("n"), "class_id")


def multilabel_summary(items: DataFrame, labels: str = "labels") -> DataFrame:
    """Average labels per item, items without and with several labels."""
    n = F.size(F.filter(F.col(labels), lambda v: v > 0))
    return items.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg(n).alias("avg_labels"),
        F.count_if(n == 0).alias("no_label"),
        F.count_if(n > 1).alias("multi_label"),
    )


def skip_report(df: DataFrame, reasons, split: str = "split", reason: str = "reason", windows: str = "n_windows") -> DataFrame:
    """Per split: records by outcome and windows written."""
    cols = [F.count_if(F.col(reason) == r).alias(f"n_{r}") for r in reasons]
    return df.groupBy(split).agg(*cols, F.sum(F.when(F.col(reason) == "valid", F.col(windows)).otherwise(0)).alias("total_windows"))


def class_weights(df: DataFrame, k: int, label: str = "label") -> DataFrame:
    """``n / (k * n_c)``, 0 for absent classes, scaled to mean 1 over present ones."""
    dist = class_distribution(df, k, label)
    sums = dist.agg(F.sum("n").alias("total"), F.avg(F.when(F.col("n") > 0, 1.0 / F.nullif(F.col("n"), F.lit(0)))).alias("inv"))
    inv = sums.select("inv").scalar()
    return dist.select(label, F.when(F.col("n") > 0, (1.0 / F.nullif(F.col("n"), F.lit(0))) / inv).otherwise(0.0).alias("weight"))


def mixture_weights(weights: dict[str, float] | None, ids) -> dict[str, float]:
    """Normalised corpus weights, uniform when none are given."""
    ids = list(ids)
    if not weights:
        return {d: 1.0 / len(ids) for d in ids}
    if set(weights) != set(ids):
        raise ValueError("weights must have one entry per dataset")
    total = sum(weights.values())
    return {d: w / total for d, w in weights.items()}


def item_weights(df: DataFrame, weights: dict[str, float], dataset: str = "dataset_id") -> DataFrame:
    """``w_d / n_d`` on every item, so the corpus mixture does not depend on corpus sizes."""
    sizes = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("__n"))
    table = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    return df.join(sizes, dataset).withColumn("weight", F.try_element_at(table, F.col(dataset)) / F.col("__n")).drop("__n")


def pool(tokens: DataFrame, how: str, keys=("window_id",), position: str = "patch", value: str = "x") -> DataFrame:
    """Pool token vectors of a window: mean, max, first, last, cls or attention.

    Vectors are spread to (window, dimension) so sums are partial; attention
    weights are the softmax over a window's token means.
    """
    keys = list(keys)
    if how in ("first", "last", "cls"):
        pick = F.max_by if how == "last" else F.min_by
        return tokens.groupBy(*keys).agg(pick(value, position).alias(value))
    if how in ("mean", "max"):
        spread = tokens.select(*keys, F.posexplode(value).alias("__d", "__v"))
        agg = F.avg("__v") if how == "mean" else F.max("__v")
        flat = spread.groupBy(*keys, "__d").agg(agg.alias("__v"))
    elif how == "attention":
        scored = tokens.withColumn("__m", A.mean(F.col(value)))
        top = scored.groupBy(*keys).agg(F.max("__m").alias("__top"))
        w = scored.join(top, keys).withColumn("__w", F.exp(F.col("__m") - F.col("__top")))
        spread = w.select(*keys, "__w", F.posexplode(value).alias("__d", "__v"))
        flat = spread.groupBy(*keys, "__d").agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("__v"))
    else:
        raise ValueError(f"unknown pooling {how!r}")
    packed = flat.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__d", "__v"))).alias("__s"))
    return packed.select(*keys, F.transform("__s", lambda s: s["__v"]).alias(value))


def channel_mean(patches: DataFrame, keys=("window_id", "patch"), value: str = "x", good: str = "good") -> DataFrame:
    """Mean patch over good channels, as ``(keys, i, v)``."""
    m = F.col(good).cast("double")
    spread = patches.select(*keys, m.alias("__m"), F.posexplode(value).alias("i", "__v"))
    return spread.groupBy(*keys, "i").agg((F.sum(F.col("__v") * F.col("__m")) / F.greatest(F.sum("__m"), F.lit(1.0))).alias("v"))


def aggregate_results(df: DataFrame, keys, metrics, seed: str = "seed", synthetic: str = "synthetic") -> DataFrame:
    """Mean and sample sd per metric (null sd for one value), seeds, synthetic flag."""
    aggs = [
        F.countDistinct(F.coalesce(F.col(seed).cast("string"), F.lit("0"))).alias("n_seeds"),
        F.coalesce(F.bool_or(synthetic), F.lit(False)).alias("synthetic"),
    ]
    for m in metrics:
        several = F.count(m) > 1
        aggs += [F.avg(m).alias(m), F.when(several, F.stddev_samp(m)).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(*aggs)
