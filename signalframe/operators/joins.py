"""Alignment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_modalities(tables: dict[str, DataFrame], key: str = "window_id") -> DataFrame:
    """Full outer alignment of one table per modality with presence flags.

    Non-key columns keep a ``<modality>_`` prefix. Every key comes from at least
    one table, so no row is without a modality; null keys are rejected.
    """
    out = None
    for name, df in tables.items():
        part = df.select(
            F.col(key), F.lit(True).alias(f"has_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key]
        )
        out = part if out is None else out.join(part, key, "full")
    flags = {f"has_{m}": F.coalesce(F.col(f"has_{m}"), F.lit(False)) for m in tables}
    return out.withColumns(flags).filter(F.col(key).isNotNull())


def pair_records(headers: DataFrame, signals: DataFrame, key: str = "stem") -> DataFrame:
    """Headers that have a signal file."""
    return headers.join(signals.select(key).distinct(), key, "left_semi")


def missing_subjects(plan: DataFrame, cache: DataFrame, key: str = "subject_id") -> DataFrame:
    """Planned subjects without cached data."""
    return plan.select(key).distinct().join(cache.select(key).distinct(), key, "left_anti")


def assert_no_missing_subjects(plan: DataFrame, cache: DataFrame, key: str = "subject_id", allow: bool = False) -> None:
    gone = [r[0] for r in missing_subjects(plan, cache, key).orderBy(key).limit(10).collect()]
    if gone and not allow:
        raise ValueError(f"subjects without data: {gone}")
