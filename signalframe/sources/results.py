"""Experiment results as files: row bundles, run folders, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INHERITED = ("synthetic", "seed", "suite", "benchmark")


def flatten_bundles(docs: DataFrame, source: str = "source") -> DataFrame:
    """``rows[]`` of each bundle; missing fields come from the bundle's top level.

    A document without rows is one row itself.
    """
    if "rows" not in docs.columns:
        return docs
    own = [c for c in docs.columns if c not in ("rows", source)]
    rows = docs.select(source, *own, F.explode_outer("rows").alias("__r"))
    fields = rows.schema["__r"].dataType.fieldNames()
    cols = []
    for f in fields:
        inner = F.col(f"__r.`{f}`")
        if f == source:
            cols.append(F.coalesce(inner, F.col(source)).alias(f))
        elif f in own and (f in INHERITED):
            cols.append(F.coalesce(inner, F.col(f)).alias(f))
        elif f in own:
            cols.append(F.when(F.col("__r").isNull(), F.col(f)).otherwise(inner).alias(f))
        else:
            cols.append(inner.alias(f))
    cols += [F.col(c) if c in INHERITED else F.when(F.col("__r").isNull(), F.col(c)).alias(c) for c in own if c not in fields]
    if source not in fields:
        cols.append(F.col(source))
    return rows.select(*cols)


def read_results(spark: SparkSession, paths) -> DataFrame:
    docs = spark.read.option("multiLine", "true").json(list(paths) if not isinstance(paths, str) else paths)
    named = docs.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    return flatten_bundles(named)


def read_runs(spark: SparkSession, root: str, schema: str | None = None, name: str = "test_results.json") -> DataFrame:
    """Runs below ``root/fold*/variant/seed/`` with the path's keys as columns."""
    reader = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    runs = (reader.schema(schema) if schema else reader).json(root)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, r"(fold[^/]*)/([^/]+)/([^/]+)/[^/]+$", i)
    keyed = runs.select("*", part(1).alias("fold"), part(2).alias("variant"), part(3).alias("__seed"))
    keyed = keyed.filter(F.col("fold") != "")
    return keyed.drop("seed").withColumnRenamed("__seed", "seed")


def union_rows(tables) -> DataFrame:
    """Union with all fields, in first-seen order."""
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        raise ValueError("no rows to write")
    return out


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
