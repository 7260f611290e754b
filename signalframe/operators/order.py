"""Ordered computations that do not put a whole key into one task.

A plain ``row_number() over (partition by key)`` sends every row of a key to one
task. Here a key is cut into buckets by an expression that never decreases along
the order; work inside a bucket is local, and only one row per (key, bucket)
takes part in the running total that joins the buckets up. The result is exactly
what the one-level window would give. Keys and buckets must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import let

_B = "__bucket"


def prefix_sum(df: DataFrame, keys, order, bucket: Column, sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums along ``order`` (which must be unique per key)."""
    keys = list(keys)
    data = df.withColumn(_B, bucket)
    inside = W.partitionBy(*keys, _B).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = data.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    return _join_up(local, data, keys, sums)


def ordinal(df: DataFrame, keys, order, bucket: Column, name: str = "ordinal") -> DataFrame:
    """Zero-based position of each row along ``order`` within its key."""
    keys = list(keys)
    data = df.withColumn(_B, bucket)
    inside = W.partitionBy(*keys, _B).orderBy(*order)
    local = data.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    return _join_up(local, data, keys, {name: F.lit(1).cast("long")})


def _join_up(local, data, keys, sums):
    before = W.partitionBy(*keys).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    totals = data.groupBy(*keys, _B).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    offsets = totals.select(
        *keys, _B, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__off_{n}") for n in sums]
    )
    cols = [c for c in local.columns if c not in sums and c != _B]
    # The window left the rows partitioned and sorted on exactly the join columns,
    # so a merge join costs them nothing and the offsets never reach the driver.
    return local.join(offsets.hint("merge"), [*keys, _B]).select(
        *cols, *[(F.col(n) + F.col(f"__off_{n}")).alias(n) for n in sums]
    )


def group_size(df: DataFrame, keys, name: str = "n") -> DataFrame:
    """Row count of each key, attached to its rows (partial counts, then a join)."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, keys) if keys else df.withColumn(name, counts.scalar())


def hash_ordinal(df: DataFrame, keys, digest: Column, tie, name: str = "ordinal") -> DataFrame:
    """Position of each row in hash order; 65 536 buckets keep every task small."""
    data = df.withColumn("__digest", digest)
    out = ordinal(data, keys, ["__digest", *tie], F.substring("__digest", 1, 4), name)
    return out.drop("__digest")


def hash_threshold(df: DataFrame, keys, digest: Column, tie: str, quota: Column) -> DataFrame:
    """Per key the ``(digest, tie)`` of its ``quota``-th row in hash order.

    Returns ``(keys, limit)``; a key with at most ``quota`` rows has no limit and a
    quota below one gives the empty limit. Bucket counts find the one bucket in
    which the boundary falls, so only a 65 536th of the rows is ever ranked and
    the payload of the rows is not shuffled. ``quota`` may use the keys' columns.
    """
    keys = list(keys)
    slim = df.select(*keys, digest.alias("__d"), F.col(tie).alias("__t"), quota.cast("long").alias("__q"))
    slim = slim.withColumn(_B, F.substring("__d", 1, 4))
    upto = W.partitionBy(*keys).orderBy(_B).rowsBetween(W.unboundedPreceding, 0)
    counts = slim.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("__c"), F.max("__q").alias("__q"))
    counts = counts.withColumn("__upto", F.sum("__c").over(upto))
    total = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.max("__q").alias("__q"))
    edge = counts.filter((F.col("__q") >= 1) & (F.col("__upto") >= F.col("__q")) & (F.col("__upto") - F.col("__c") < F.col("__q")))
    edge = edge.select(*keys, _B, (F.col("__q") - F.col("__upto") + F.col("__c")).alias("__rank"))
    inside = W.partitionBy(*keys, _B).orderBy("__d", "__t")
    ranked = slim.drop("__q").join(edge, [*keys, _B]).withColumn("__rn", F.row_number().over(inside))
    exact = ranked.filter(F.col("__rn") == F.col("__rank")).select(*keys, F.struct("__d", "__t").alias("__at"))
    out = total.join(exact, keys, "left")
    return out.select(
        *keys, F.when(F.col("__n") <= F.col("__q"), F.lit(True)).otherwise(False).alias("__all"), F.col("__at").alias("limit")
    )


def hash_head(df: DataFrame, keys, digest: Column, tie: str, quota: Column) -> DataFrame:
    """Exactly the first ``quota`` rows of each key in hash order."""
    keys = list(keys)
    limits = hash_threshold(df, keys, digest, tie, quota)
    at = F.struct(digest.alias("__d"), F.col(tie).alias("__t"))
    kept = df.join(limits, keys).filter(F.col("__all") | F.coalesce(at <= F.col("limit"), F.lit(False)))
    return kept.drop("__all", "limit")


def spread(df: DataFrame, key: str, name: str = "__spread", sample: int = 4096) -> DataFrame:
    """``df`` with a bucket 0..255 that never decreases along ``key``, each of about equally many rows.

    Bounds are taken from the ``sample`` rows with the least hashes: a bounded random
    sample that no task, retry or run draws differently, whatever the key's type and
    wherever its values crowd. Any bounds give right results with ``ordinal`` and
    ``prefix_sum``; these keep buckets even. Rows should be distinct; a null goes into
    bucket 0 and sorts first.
    """
    picked = df.select(F.col(key).alias("k"), F.xxhash64(*df.columns).alias("h")).orderBy("h", "k").limit(sample)
    every = picked.agg(F.sort_array(F.collect_list("k")).alias("b"))
    bound = lambda i: F.get("b", F.floor(i * F.size("b") / 256).cast("int"))
    fine = F.transform(F.sequence(F.lit(1), F.lit(255)), bound)
    coarse = F.transform(F.sequence(F.lit(16), F.lit(240), F.lit(16)), bound)
    bounds = every.select(F.struct(coarse.alias("coarse"), fine.alias("fine")).alias("b")).scalar()
    upto = lambda a: F.size(F.filter(a, lambda b: b <= F.col(key)))
    place = let(upto(F.col("__bounds.coarse")), lambda c: c * 16 + upto(F.slice("__bounds.fine", c * 16 + 1, 15)))
    return df.withColumn("__bounds", bounds).withColumn(name, F.coalesce(place, F.lit(0))).drop("__bounds")


def monotone_bucket(value: Column, steps: int = 64) -> Column:
    """Non-decreasing integer bucket of any double, about ``steps`` per factor e.

    Magnitudes are spread by logarithm, so no range of values falls together. Minus
    infinity comes first, then infinity, NaN (which Spark sorts last) and null.
    """
    spread = F.least(F.log1p(F.abs(value) * 2.0**20), F.lit(1000.0))
    bucket = F.floor(F.signum(value) * spread * steps).cast("long")
    far = F.lit(2**40)
    return (
        F.when(value.isNull(), far + 2).when(F.isnan(value), far + 1)
        .when(value == float("inf"), far).when(value == float("-inf"), -far).otherwise(bucket)
    )


def previous(df: DataFrame, keys, t: str, cols: dict[str, str], block: int = 65536) -> DataFrame:
    """Value of the last sample before each one along ``t``.

    Rows are processed in blocks of ``block`` indices; the first row of a block
    takes the last values of the block before, whatever indices are missing.
    """
    keys = list(keys)
    data = df.withColumn("__blk", F.floor(F.col(t) / block).cast("long"))
    inside = W.partitionBy(*keys, "__blk").orderBy(t)
    along = W.partitionBy(*keys).orderBy("__blk")
    now = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    edges = data.groupBy(*keys, "__blk").agg(F.max_by(now, F.col(t)).alias("__last"))
    edges = edges.select(*keys, "__blk", F.lag("__last").over(along).alias("__edge"))
    local = data.withColumn("__at", F.row_number().over(inside)).withColumn("__before", F.lag(now).over(inside))
    out = local.join(edges.hint("merge"), [*keys, "__blk"])
    picked = [F.when(F.col("__at") > 1, F.col(f"__before.{n}")).otherwise(F.col(f"__edge.{n}")).alias(n) for n in cols]
    return out.select(*df.columns, *picked)
