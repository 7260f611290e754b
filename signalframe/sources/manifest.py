"""Window manifests: build from a file catalog, save and load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "dataset_id string, modality string, path string, subject_id string, recording_id string, sampling_rate double, "
    "num_channels int, num_samples bigint, channel_names array<string>, montage_type string, reference_type string, "
    "derivation_type string, emg_region string, has_coordinates boolean, label string, window_start double, "
    "window_end double, checksum string, index int"
)
VERSION = 1


def build_manifest(files: DataFrame, spec: DataFrame, subject_pattern: str | None = None, default_channels: int | None = None) -> DataFrame:
    """One row per window of each file.

    ``files(path, dataset_id, n_windows, num_samples[, num_channels, channel_names,
    has_labels, checksum])``. The subject is the pattern's first group, else the
    file stem. Rows are exploded in place after the registry join, so a file with
    very many windows costs output, not a shuffle.
    """
    have = set(files.columns)
    opt = lambda c, default: F.col(f"f.{c}") if c in have else default
    stem = F.regexp_extract("f.path", r"([^/]+?)(\.[^./]*)?$", 1)
    subject = stem
    if subject_pattern:
        found = F.regexp_extract("f.path", subject_pattern, 1)
        subject = F.when(found != "", found).otherwise(stem)
    joined = files.alias("f").join(spec.alias("d"), "dataset_id")
    span = F.col("f.num_samples") / F.col("d.sampling_rate")
    default = F.lit(default_channels).cast("int")
    rows = joined.select(
        F.col("dataset_id"), F.col("d.modality"), F.col("f.path"),
        subject.alias("subject_id"), stem.alias("recording_id"), F.col("d.sampling_rate"),
        F.coalesce(opt("num_channels", F.lit(None).cast("int")), F.col("d.num_channels"), default).alias("num_channels"),
        F.col("f.num_samples").cast("long").alias("num_samples"),
        opt("channel_names", F.array().cast("array<string>")).alias("channel_names"),
        F.coalesce("d.montage", F.lit("unknown")).alias("montage_type"),
        F.col("d.reference_type"), F.col("d.derivation_type"), F.col("d.emg_region"), F.col("d.has_coordinates"),
        F.when(opt("has_labels", F.lit(False)), "in_file").alias("label"),
        span.alias("__span"), opt("checksum", F.lit(None).cast("string")).alias("checksum"),
        F.explode(F.sequence(F.lit(0), F.col("f.n_windows").cast("int") - 1)).alias("index"),
    )
    out = rows.withColumn("window_start", F.col("index") * F.col("__span")).withColumn("window_end", (F.col("index") + 1) * F.col("__span"))
    return out.select(*[c.strip().split(" ")[0] for c in SCHEMA.split(", ")])


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Entries as Parquet and a one-row JSON header ``{version, count}``.

    The entries are written first, so a reader that finds a header finds all of them.
    """
    manifest.write.mode("overwrite").parquet(f"{path}/entries")
    entries = manifest.sparkSession.read.parquet(f"{path}/entries")
    entries.agg(F.lit(VERSION).alias("version"), F.count(F.lit(1)).alias("count")).write.mode("overwrite").json(f"{path}/header")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest whose header has this version and their number."""
    entries = spark.read.schema(SCHEMA).parquet(f"{path}/entries")
    header = spark.read.schema("version int, count long").json(f"{path}/header").first()
    if header is None or header["version"] != VERSION:
        raise ValueError(f"manifest at {path} has header {header}, wanted version {VERSION}")
    if header["count"] != (found := entries.count()):
        raise ValueError(f"manifest at {path} has {found} entries, its header says {header['count']}")
    return entries


def read_manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """A single ``{version, count, entries[]}`` document, as other tools write it."""
    doc = spark.read.text(path, wholetext=True).select(
        F.from_json("value", f"struct<version:int,count:bigint,entries:array<struct<{_as_fields()}>>>").alias("m")
    )
    return doc.select(F.explode("m.entries").alias("e")).select("e.*")


def _as_fields() -> str:
    return ",".join(f"{n}:{t}" for n, t in (c.strip().split(" ", 1) for c in SCHEMA.split(", ")))
