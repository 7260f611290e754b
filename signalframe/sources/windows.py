"""Window tables: read with column aliases, guard, write, cache, summarise."""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Files

# Accepted column names, first match wins.
SIGNAL_ALIASES = ("data", "input", "X")
LABEL_ALIASES = ("label", "labels", "y", "Y")


def resolve_alias(columns, aliases, what: str) -> str:
    for a in aliases:
        if a in columns:
            return a
    raise ValueError(f"no {what} column among {sorted(columns)}; expected one of {list(aliases)}")


def standard_columns(df: DataFrame, need_label: bool = True) -> DataFrame:
    """Rename the signal and label columns to ``x`` and ``label``."""
    x = resolve_alias(df.columns, SIGNAL_ALIASES, "signal")
    renames = {x: "x"}
    if need_label:
        renames[resolve_alias(df.columns, LABEL_ALIASES, "label")] = "label"
    return df.withColumnsRenamed(renames)


def union_windows(tables, need_label: bool = True) -> DataFrame:
    out = None
    for t in tables:
        part = standard_columns(t, need_label)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no window tables given")
    return out


def read_windows(spark: SparkSession, paths, need_label: bool = True) -> DataFrame:
    """Union of Parquet window tables that name their columns differently."""
    return union_windows([spark.read.parquet(p).withColumn("path", F.col("_metadata.file_path")) for p in paths], need_label)


def metadata_conflicts(df: DataFrame, fields=("metadata_hash", "schema_version", "channel_names"), keys=()) -> DataFrame:
    """Groups whose files disagree on metadata, or mix files with and without it."""
    state = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.groupBy(*keys).agg(F.min(state).alias("first_state"), F.max(state).alias("last_state")).filter("first_state <> last_state")


def assert_same_metadata(df: DataFrame, fields=("metadata_hash", "schema_version", "channel_names"), keys=(), ids: str | None = None) -> None:
    if ids:
        partial = df.filter(F.col(ids).isNotNull() & F.greatest(*[F.col(f).isNull() for f in fields], F.lit(False))).limit(1).count()
        if partial:
            raise ValueError("a file has channel ids but lacks metadata keys")
    bad = metadata_conflicts(df, fields, keys).limit(1).collect()
    if bad:
        raise ValueError(f"metadata differs: {bad[0].first_state} and {bad[0].last_state}")


def empty_splits(df: DataFrame, splits=("train", "val", "test")) -> DataFrame:
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    want = df.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return want.join(counts, "split", "left_anti")


def assert_non_empty_splits(df: DataFrame, splits=("train", "val", "test")) -> None:
    gone = sorted(r.split for r in empty_splits(df, splits).collect())
    if gone:
        raise ValueError(f"refusing to publish: empty splits {gone}")


STAGE, COMMIT = "_staging", "_commit"


def write_windows(df: DataFrame, path: str, splits=None, partitions: int | None = None, codec: str = "zstd") -> None:
    """Partitioned Parquet by dataset and split, clustered by recording.

    Rows are range partitioned on (dataset, split, recording, start): a task writes
    to one or two folders, files are even in size, and a huge recording is spread
    over as many tasks as its windows fill.

    Data are written once, in their final layout, to a stage inside ``path``. With
    ``splits`` an empty split is refused there. Then each (dataset, split) folder of
    the stage takes the place of the published one, all others stay, and a commit
    marker with the rows of every folder is written. The marker goes before the
    first folder moves, so data without one are not complete; the stage goes in
    any case, also one that a killed run has left. A rerun leaves the same rows.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    files, stage = Files(spark, path), f"{path}/{STAGE}"
    order = [c for c in ("dataset_id", "split", "recording_id", "start") if c in df.columns]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    by = [c for c in ("dataset_id", "split") if c in df.columns]
    try:
        ranged.sortWithinPartitions(*order).write.mode("overwrite").partitionBy(*by).options(compression=codec).parquet(stage)
        if splits is not None:
            assert_non_empty_splits(spark.read.schema(df.schema).parquet(stage), splits)
        # A folder of the layout, or a file where nothing is partitioned.
        found = _leaves(files, stage, len(by))
        rows = {name: spark.read.parquet(f"{stage}/{name}").count() for name in found}
        before = {r.folder: r.n for r in _marker(spark, path).collect()} if by and files.exists(f"{path}/{COMMIT}") else {}
        files.remove(f"{path}/{COMMIT}")
        for old in [] if by else _leaves(files, path, 0):
            files.remove(f"{path}/{old}")
        for name in found:
            files.move(f"{stage}/{name}", f"{path}/{name}")
        marker = spark.createDataFrame(sorted({**before, **rows}.items()), "folder string, n long")
        marker.coalesce(1).write.mode("overwrite").json(f"{path}/{COMMIT}")
    finally:
        files.remove(stage)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Windows whose commit marker is there and tells their number; anything else is an error."""
    path = path.rstrip("/")
    if not Files(spark, path).exists(f"{path}/{COMMIT}"):
        raise ValueError(f"{path} has no commit marker: a write was not finished")
    want = _marker(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = spark.read.parquet(path)
    if (n := rows.count()) != want:
        raise ValueError(f"{path} has {n} rows, its commit marker says {want}")
    return rows


def _marker(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("folder string, n long").json(f"{path}/{COMMIT}")


def _leaves(files: Files, path: str, depth: int) -> list[str]:
    """Partition folders ``depth`` levels down, or data files, relative to ``path``."""
    if depth == 0:
        return [n for n in files.names(path) if n.endswith(".parquet")]
    here = [n for n in files.folders(path) if "=" in n]
    return here if depth == 1 else [f"{n}/{m}" for n in here for m in _leaves(files, f"{path}/{n}", depth - 1)]


def prep_summary(df: DataFrame, params: dict, label: str = "label", label_names: dict | None = None) -> DataFrame:
    """One JSON document: rows per split and class, label map and parameters."""
    counts = df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("split").agg(
        F.sum("n").alias("n"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label).cast("string"), "n")))).alias("classes"),
    )
    splits = F.map_from_entries(F.collect_list(F.struct("split", F.struct("n", "classes"))))
    extra = [F.lit(json.dumps(params, sort_keys=True)).alias("parameters"), F.lit(json.dumps(label_names or {}, sort_keys=True)).alias("label_map")]
    return per.agg(splits.alias("splits")).select(F.to_json(F.struct("splits", *extra)).alias("summary"))


def config_key(cfg: dict) -> str:
    """Digest of a configuration, independent of key order."""
    return hashlib.sha1(json.dumps(cfg, sort_keys=True).encode()).hexdigest()[:12]


def cache_key(item: Column, cfg: dict) -> Column:
    return F.substring(F.sha1(F.encode(F.concat(item, F.lit(f"::{config_key(cfg)}")), "utf-8")), 1, 20)


def cache_status(items: DataFrame, cached: DataFrame, cfg: dict, item: str = "item_key") -> DataFrame:
    """Items with ``cache_key`` and ``hit``."""
    keyed = items.withColumn("cache_key", cache_key(F.col(item), cfg))
    return keyed.join(cached.select("cache_key").distinct().withColumn("__hit", F.lit(True)), "cache_key", "left").withColumn(
        "hit", F.coalesce("__hit", F.lit(False))
    ).drop("__hit")


def cache_counts(status: DataFrame) -> DataFrame:
    """``hits, misses`` of items with their cache status."""
    return status.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


class Cached(NamedTuple):
    rows: DataFrame
    hits: int
    misses: int


def with_cache(items: DataFrame, cfg: dict, path: str, compute, item: str = "item_key") -> Cached:
    """Compute only the items missing from the table at ``path`` and append them.

    ``compute(DataFrame) -> DataFrame`` keeps the ``cache_key`` column. What is missing is
    staged first and then moved in as one folder of the table, so a reader never
    sees half of it; a rerun after a failure starts from what was published. Keys
    that another run published meanwhile are not added again.
    """
    spark, path = items.sparkSession, path.rstrip("/")
    files, stage = Files(spark, path), f"{path}/{STAGE}"
    have = spark.read.parquet(path).select("cache_key") if _exists(spark, path) else spark.createDataFrame([], "cache_key string")
    status = cache_status(items, have, cfg, item)
    hits, misses = cache_counts(status).first()
    keyed = status.select("cache_key").distinct()
    try:
        if misses:
            compute(status.filter(~F.col("hit")).drop("hit")).write.mode("overwrite").parquet(stage)
            for name in [n for n in files.names(stage) if n.endswith(".parquet")]:
                files.move(f"{stage}/{name}", f"{path}/{name}")
    finally:
        files.remove(stage)
    return Cached(spark.read.parquet(path).join(keyed, "cache_key", "left_semi"), hits, misses)


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True
