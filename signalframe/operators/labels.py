"""Label mapping: dictionaries, priorities, multi-hot, paths, targets, remaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import ordinal, spread


def literal_map(mapping: dict) -> Column:
    """A small constant dictionary as an expression; no join, no broadcast."""
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])


def map_label(df: DataFrame, col: str, mapping: dict, out: str = "label", invalid=None) -> DataFrame:
    """Map names to classes. Unmapped rows are dropped; with ``invalid`` they first
    take that class, and every row of that class is dropped."""
    mapped = F.try_element_at(literal_map(mapping), F.col(col))
    if invalid is None:
        return df.withColumn(out, mapped).filter(F.col(out).isNotNull())
    return df.withColumn(out, F.coalesce(mapped, F.lit(invalid))).filter(F.col(out) != invalid)


def lookup(df: DataFrame, table: DataFrame, on, how: str = "left") -> DataFrame:
    """Dictionary join. No broadcast hint: Spark broadcasts by measured size and
    shuffles (with skew handling) beyond the threshold."""
    return df.join(table, on, how)


def priority_label(records: DataFrame, statements: DataFrame, priority: dict[str, int], threshold: float = 80.0) -> DataFrame:
    """Highest-priority superclass among codes with likelihood >= threshold.

    ``records(record_id, codes MAP<code, likelihood>)``; records with no
    qualifying code are dropped.
    """
    scored = records.select("record_id", F.explode("codes").alias("code", "likelihood")).filter(F.col("likelihood") >= threshold)
    rank = F.try_element_at(literal_map(priority), F.col("diagnostic_class"))
    return (
        scored.join(statements, "code")
        .withColumn("label", rank)
        .filter(F.col("label").isNotNull())
        .groupBy("record_id")
        .agg(F.max("label").alias("label"))
    )


def parse_codes(col: Column) -> Column:
    """``{'CODE': 100.0, ...}`` text to a map."""
    return F.from_json(F.replace(col, F.lit("'"), F.lit('"')), "map<string,double>")


def window_labels(codes: DataFrame, dictionary: DataFrame, aliases: DataFrame | None = None, key: str = "record_id") -> DataFrame:
    """Distinct ``(key, class_id)`` pairs from code arrays, through one or two dictionaries."""
    long = codes.select(key, F.explode(F.array_distinct("codes")).alias("code"))
    table = dictionary if aliases is None else dictionary.unionByName(aliases).distinct()
    return long.join(table, "code").select(key, "class_id").distinct()


def multi_hot(codes: DataFrame, dictionary: DataFrame, k: int, aliases: DataFrame | None = None, key: str = "record_id") -> DataFrame:
    """K-long 0/1 label arrays; records without any known code are dropped."""
    hits = window_labels(codes, dictionary, aliases, key)
    flags = [F.max(F.when(F.col("class_id") == c, 1.0).otherwise(0.0)) for c in range(k)]
    return hits.groupBy(key).agg(F.array(*flags).alias("labels"))


def offset_label(df: DataFrame, offsets: dict[int, int], raw: str = "raw", exercise: str = "exercise", out: str = "label") -> DataFrame:
    """``0`` for rest, otherwise raw label plus the exercise's offset."""
    shift = F.try_element_at(literal_map(offsets), F.col(exercise))
    return df.withColumn(out, F.when(F.col(raw) == 0, F.lit(0)).otherwise(F.col(raw) + shift))


def check_offsets(df: DataFrame, expected: dict[int, int], keys, raw: str = "raw", exercise: str = "exercise") -> DataFrame:
    """Per file: highest raw label, what it should be, and whether they differ."""
    want = F.try_element_at(literal_map(expected), F.col(exercise))
    return df.groupBy(*keys, exercise).agg(F.max(raw).alias("seen")).withColumn("expected", want).withColumn(
        "mismatch", F.col("seen") != F.col("expected")
    )


def check_label_count(df: DataFrame, expected: int, keys, label: str = "label") -> DataFrame:
    """Per file: distinct non-zero labels and whether they differ from ``expected``."""
    present = df.filter(F.col(label) != 0).select(*keys, label).distinct()
    counts = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_labels"))
    files = df.select(*keys).distinct()
    out = files.join(counts, list(keys), "left").fillna(0, ["distinct_labels"])
    return out.withColumn("mismatch", F.col("distinct_labels") != expected)


def path_parts(path: Column) -> Column:
    return F.array_distinct(F.split(F.lower(path), "/"))


def path_label(path: Column, mapping: dict[str, int]) -> Column:
    """Class named by exactly one path component, else -1."""
    hits = F.array_intersect(path_parts(path), F.array(*[F.lit(k) for k in mapping]))
    return F.when(F.size(hits) == 1, F.try_element_at(literal_map(mapping), F.get(hits, F.lit(0)))).otherwise(F.lit(-1))


def path_split(path: Column) -> Column:
    """Official split from the path: ``eval`` beats ``train``; none gives null."""
    parts = path_parts(path)
    return F.when(F.arrays_overlap(parts, F.array(F.lit("eval"), F.lit("test"))), "eval").when(
        F.array_contains(parts, "train"), "train"
    )


def target_label(events: DataFrame, keys=("run_id",)) -> DataFrame:
    """1 where the run's target character occurs in the event code.

    Control events (``#...``) are removed and runs that never name a target are
    dropped. The target table has one row per run.
    """
    keys = list(keys)
    char = F.when(F.col("code").startswith("#Tgt"), F.substring("code", 5, 1))
    target = events.groupBy(*keys).agg(F.min(char).alias("__target")).filter(F.col("__target").isNotNull())
    flashes = events.filter(~F.col("code").startswith("#")).join(target, keys)
    return flashes.withColumn("label", F.when(F.col("code").contains(F.col("__target")), 1).otherwise(0)).drop("__target")


def contiguous_labels(df: DataFrame, label: str = "label", out: str = "class_id") -> DataFrame:
    """Sorted labels present anywhere become 0..K-1; distinct labels are ranked in even buckets, however many."""
    present = spread(df.select(label).distinct(), label)
    ranks = ordinal(present, [], [label], F.col("__spread"), out).drop("__spread")
    return df.join(ranks.withColumn(out, F.col(out).cast("int")), label)
