"""Train/val/test assignment without leakage.

Random choices are hash ranks: exact sizes, the same on every run and cluster.
Every function returns an assignment or the rows with a ``split`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from .order import group_size, hash_ordinal, ordinal, spread


class LeakageError(ValueError):
    """One id occurs in more than one split."""


def subject_split_expr(subject: Column, ratios=(0.8, 0.1, 0.1), seed=42) -> Column:
    """Row-local: a subject's split depends on its id only, so new subjects move nobody."""
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError(f"ratios must sum to 1, got {ratios}")
    h = H.uniform(seed, subject)
    return F.when(h < ratios[0], "train").when(h < ratios[0] + ratios[1], "val").otherwise("test")


def subject_split(df: DataFrame, ratios=(0.8, 0.1, 0.1), seed=42, subject: str = "subject_id") -> DataFrame:
    """Assignment table ``(subject, split)``."""
    return df.select(subject).distinct().withColumn("split", subject_split_expr(F.col(subject), ratios, seed))


def attach_split(df: DataFrame, assignment: DataFrame, key: str = "subject_id", how: str = "inner") -> DataFrame:
    return df.join(assignment, key, how)


def leaks(df: DataFrame, key: str) -> DataFrame:
    """Ids found in more than one split (two partial aggregations, no id list per split)."""
    return df.groupBy(key).agg(F.min("split").alias("first_split"), F.max("split").alias("last_split")).filter(
        "first_split <> last_split"
    )


def assert_no_leakage(df: DataFrame, keys=("subject_id", "recording_id")) -> None:
    for key in keys:
        bad = leaks(df, key)
        n = bad.count()
        if n:
            sample = [r[0] for r in bad.select(key).orderBy(key).limit(10).collect()]
            raise LeakageError(f"{key}: {n} shared ids across splits, e.g. {sample}")


def split_records(df: DataFrame, ratios=(0.8, 0.1, 0.1), seed=42, subject="subject_id", recording="recording_id", verify=True) -> DataFrame:
    """Split windows by subject and check that no recording is shared.

    A subject's split follows from its id alone, so only a recording with several
    subjects can leak; one narrow aggregate over ids looks for one.
    """
    out = df.withColumn("split", subject_split_expr(F.col(subject), ratios, seed))
    if verify:
        assert_no_leakage(out.select(recording, "split"), (recording,))
    return out


def _ranked_ids(df, key, seed):
    """Distinct ids with their place in hash order and their number.

    Every use below starts from one exchange of the distinct ids, which Spark reuses.
    """
    ids = df.select(key).distinct()
    return group_size(hash_ordinal(ids, [], H.digest(seed, key), [key], "__r"), [], "__n")


def _sizes(n: Column, fractions, sizing: str):
    """Sizes of the first two parts. ``ceil`` sizes the held-out side up, in stages; ``floor`` truncates."""
    if sizing == "floor":
        if len(fractions) == 2:
            second = F.floor(n * fractions[1])
            return n - second, second
        return F.floor(n * fractions[0]), F.floor(n * fractions[1])
    if sizing != "ceil":
        raise ValueError(f"unknown sizing {sizing!r}")
    held = F.ceil(n * round(sum(fractions[1:]), 12))
    if len(fractions) == 2:
        return n - held, held
    last = F.ceil(held * (fractions[2] / (fractions[1] + fractions[2])))
    return n - held, held - last


def ratio_split(df: DataFrame, key: str, fractions=(0.7, 0.2, 0.1), seed=42, sizing: str = "ceil", allow_leakage: bool = False) -> DataFrame:
    """Exact-size random assignment of ids. Splitting windows needs ``allow_leakage``."""
    if key == "window_id" and not allow_leakage:
        raise LeakageError("splitting windows mixes one recording across splits; pass allow_leakage=True to do it anyway")
    ids = _ranked_ids(df, key, seed)
    a, b = _sizes(F.col("__n"), fractions, sizing)
    names = ("train", "val", "test") if len(fractions) > 2 else ("train", "val")
    split = F.when(F.col("__r") < a, names[0]).when(F.col("__r") < a + b, names[1]).otherwise(names[-1])
    return ids.select(key, split.alias("split"))


def fold_split(df: DataFrame, col: str, train_max: int = 8, val: int = 9) -> DataFrame:
    """Split by fold number; a null fold belongs to no split."""
    return df.withColumn("split", F.when(F.col(col).isNull(), F.lit(None)).when(F.col(col) <= train_max, "train").when(F.col(col) == val, "val").otherwise("test"))


def holdout_split(df: DataFrame, key: str = "subject_id", seed=7) -> DataFrame:
    """60/20/20 of subjects, at least one each; fewer than three is an error."""
    ids = _ranked_ids(df, key, seed)
    n = F.when(F.col("__n") >= 3, F.col("__n")).otherwise(F.raise_error(F.lit("a subject split needs at least 3 subjects")).cast("long"))
    tr = F.least(F.greatest(F.lit(1), F.floor(0.6 * n)), n - 2)
    va = F.least(F.greatest(F.lit(1), F.floor(0.2 * n)), n - tr - 1)
    split = F.when(F.col("__r") < tr, "train").when(F.col("__r") < tr + va, "val").otherwise("test")
    return ids.select(key, split.alias("split"))


def _listed(df, key):
    ids = spread(df.select(key).distinct(), key)
    return group_size(ordinal(ids, [], [key], F.col("__spread"), "__pos").drop("__spread"), [], "__n")


def list_fold_split(df: DataFrame, fold: int, k: int = 10, val_ratio: float = 0.15, key: str = "subject_id", seed=7) -> DataFrame:
    """Fold ``fold`` of size ``n // k`` by list position is test; val is carved from the rest."""
    ids = _listed(df, key)
    size = F.floor(F.col("__n") / k)
    held = (F.col("__pos") >= fold * size) & (F.col("__pos") < (fold + 1) * size)
    marked = ids.withColumn("__held", held)
    rest = _ranked_ids(marked.filter(~F.col("__held")), key, f"{seed + fold}")
    n_va = F.greatest(F.lit(1), F.floor(val_ratio * F.col("__n")))
    carved = rest.select(key, F.when(F.col("__r") < n_va, "val").otherwise("train").alias("split"))
    return carved.unionByName(marked.filter("__held").select(key, F.lit("test").alias("split")))


def loso_split(df: DataFrame, fold: int, key: str = "subject_id", seed=7) -> DataFrame:
    """Subject number ``fold`` is test, one other hash-chosen subject is val."""
    ids = _listed(df, key).withColumn("__held", F.col("__pos") == fold)
    ok = F.when((F.col("__n") >= 3) & (F.lit(fold) < F.col("__n")), F.col("__held")).otherwise(
        F.raise_error(F.lit("leave-one-out needs at least 3 subjects and a fold below their number")).cast("boolean"))
    ids = ids.withColumn("__held", ok)
    rest = ids.filter(~F.col("__held")).withColumn("__d", H.digest(seed + fold, key))
    val = rest.orderBy("__d", key).limit(1).select(key, F.lit("val").alias("__s"))
    out = ids.join(val, key, "left")
    return out.select(key, F.when(F.col("__held"), "test").otherwise(F.coalesce("__s", F.lit("train"))).alias("split"))


def unit_split(df: DataFrame, unit: str, lists: dict[str, list], unlisted: str | None = None) -> DataFrame:
    """Explicit lists of units per split; an id in two lists is an error. Unlisted
    units take ``unlisted`` or, when it is None, are dropped."""
    seen: dict = {}
    for split, members in lists.items():
        for m in members:
            if seen.setdefault(m, split) != split:
                raise LeakageError(f"{unit} {m!r} is listed in {seen[m]!r} and {split!r}")
    pairs = F.create_map(*[F.lit(v) for kv in seen.items() for v in kv])
    split = F.coalesce(F.try_element_at(pairs, F.col(unit)), F.lit(unlisted))
    return df.withColumn("split", split).filter(F.col("split").isNotNull())


def carve_val(df: DataFrame, ratio: float = 0.1, key: str = "subject_id", seed=42) -> DataFrame:
    """Official splits stay; ``max(1, round-half-even(n * ratio))`` train subjects become val."""
    ids = _ranked_ids(df.filter(F.col("split") == "train"), key, seed)
    n_val = F.greatest(F.lit(1), F.bround(F.col("__n") * ratio))
    chosen = ids.filter(F.col("__r") < n_val).select(key, F.lit(True).alias("__v"))
    out = df.join(chosen, key, "left")
    return out.withColumn("split", F.when((F.col("split") == "train") & F.col("__v"), "val").otherwise(F.col("split"))).drop("__v")


def role_split(df: DataFrame, head: int = 10, keys=("user_id", "gesture"), order=("sample",)) -> DataFrame:
    """Users recorded for training keep all samples (their test part is val); for the
    others the first ``head`` samples per gesture train and the rest test.

    ``df(role, part, ...)`` with role in train/test users and part in train/test samples.
    """
    from .rank import head_per_group

    trained = df.filter(F.col("role") == "train").withColumn(
        "split", F.when(F.col("part") == "train", "train").otherwise("val")
    )
    others = head_per_group(df.filter((F.col("role") == "test") & (F.col("part") == "train")), keys, order, head)
    others = others.withColumn("split", F.when(F.col("is_head"), "train").otherwise("test")).drop("is_head")
    return trained.unionByName(others)


def modality_mask(df: DataFrame, modalities, p: float, seed=0, key: str = "window_id") -> DataFrame:
    """Keep each modality with probability 1-p; an empty draw keeps the first one."""
    draws = {m: H.uniform(seed, F.col(key), F.lit(m)) > p for m in modalities}
    out = df.select("*", *[c.alias(f"has_{m}") for m, c in draws.items()])
    first = modalities[0]
    none = ~F.greatest(*[F.col(f"has_{m}") for m in modalities]) if len(modalities) > 1 else ~F.col(f"has_{first}")
    return out.withColumn(f"has_{first}", F.col(f"has_{first}") | none)
