"""File catalogs, checksums and text headers."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER_LINE = r"(?m)^[ \t]*# ?Dx:?[ \t]*(.*)$"


def stem_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def parent_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


def parse_path(files: DataFrame, patterns: dict[str, str], fallback: str = "stem") -> DataFrame:
    """Fields from the first group of each pattern; a miss takes the file stem or
    the parent folder's name."""
    other = {"stem": stem_of, "parent": parent_of, "null": lambda p: F.lit(None).cast("string")}[fallback](F.col("path"))
    found = {n: F.regexp_extract("path", p, 1) for n, p in patterns.items()}
    return files.select("*", *[F.when(c != "", c).otherwise(other).alias(n) for n, c in found.items()])


def recording_catalog(spark: SparkSession, root: str, glob: str = "*", patterns: dict[str, str] | None = None, fallback: str = "stem") -> DataFrame:
    """``(path, length, modified, fields...)`` of every matching file below ``root``.

    File contents are not read: the content column is pruned from the scan.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    return parse_path(listing, patterns or {}, fallback)


def checksum(content: Column, max_bytes: int | None = None) -> Column:
    """SHA-1 of the content, optionally of the whole 1 MiB blocks that reach ``max_bytes``."""
    if not max_bytes:
        return F.sha1(content)
    block = 1 << 20
    return F.sha1(F.substring(content, 1, -(-max_bytes // block) * block))


def file_checksum(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, length, checksum)``: SHA-1 of each whole file, read by Spark.

    A file must fit into one row (below 2 GiB; Spark reports longer ones).
    """
    return _contents(spark, root, glob).select("path", "length", checksum(F.col("content")).alias("checksum"))


def prefix_checksum(spark: SparkSession, root: str, glob: str = "*", max_bytes: int = 1 << 24) -> DataFrame:
    """``(path, length, checksum)`` of the leading blocks only, as manifests store it.

    It says nothing about what follows the prefix.
    """
    return _contents(spark, root, glob).select("path", "length", checksum(F.col("content"), max_bytes).alias("checksum"))


def _contents(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def verify_checksums(files: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """``status`` per file: ok, corrupt (digest differs) or unlisted."""
    want = expected.select(key, F.lower("checksum").alias("__want"))
    status = F.when(F.col("__want").isNull(), "unlisted").when(F.lower("checksum") == F.col("__want"), "ok").otherwise("corrupt")
    return files.join(want, key, "left").withColumn("status", status).drop("__want")


def dx_codes(text: Column) -> Column:
    """Digit tokens of the first ``# Dx`` / ``#Dx`` line of a header text."""
    line = F.regexp_extract(text, HEADER_LINE, 1)
    return F.filter(F.split(line, r"[,\s;]+"), lambda t: t.rlike(r"^\d+$"))


def read_dx_headers(spark: SparkSession, path: str, glob: str = "*.hea") -> DataFrame:
    """``(path, stem, codes)`` from whole header files."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    located = text.select(F.col("_metadata.file_path").alias("path"), "value")
    return located.select("path", stem_of(F.col("path")).alias("stem"), dx_codes(F.col("value")).alias("codes"))


USER_SCHEMA = T.StructType([
    T.StructField(part, T.MapType(T.StringType(), T.StructType([
        T.StructField("gestureName", T.StringType()),
        T.StructField("emg", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))),
    ])))
    for part in ("trainingSamples", "testingSamples")
])


def user_samples(docs: DataFrame, *keep: str) -> DataFrame:
    """User documents to ``(keep, part, sample, gesture, channel, x)`` rows."""
    one = lambda part: docs.select(
        *keep, F.lit(part.replace("ingSamples", "")).alias("part"), F.explode(part).alias("sample", "s")
    )
    rows = one("trainingSamples").unionByName(one("testingSamples"))
    return rows.select(
        *keep, "part", "sample", F.coalesce("s.gestureName", F.lit("notProvided")).alias("gesture"), F.explode("s.emg").alias("channel", "x")
    )


def read_user_json(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    docs = (
        spark.read.schema(USER_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path)
        .withColumn("path", F.col("_metadata.file_path"))
        .withColumn("user_id", parent_of(F.col("path")))
    )
    return user_samples(docs, "user_id")


def read_record_list(spark: SparkSession, path: str) -> DataFrame:
    """Record paths of a CSV catalog: column ``path``, else the first column."""
    table = spark.read.option("header", "true").csv(path)
    col = "path" if "path" in table.columns else table.columns[0]
    return table.select(F.col(col).alias("path"))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostic statements ``(code, diagnostic_class)`` of a statement dictionary."""
    table = spark.read.option("header", "true").csv(path)
    code = table.columns[0]
    return table.filter(F.col("diagnostic").cast("double") == 1.0).select(F.col(code).alias("code"), "diagnostic_class")
