import pytest
from pyspark.sql import functions as F

from signalframe.operators import splits


def ids(spark, n):
    return spark.createDataFrame([(f"S{i:03d}",) for i in range(n)], "subject_id string")


def as_map(df, key="subject_id"):
    return {r[key]: r.split for r in df.collect()}


def test_new_subjects_move_nobody(spark):
    a, b = as_map(splits.subject_split(ids(spark, 200))), as_map(splits.subject_split(ids(spark, 220)))
    assert all(b[k] == v for k, v in a.items()) and set(a.values()) == {"train", "val", "test"}


def test_hash_is_the_first_eight_digest_bytes(spark):
    import hashlib

    got = as_map(splits.subject_split(ids(spark, 200)))
    for k, split in got.items():
        h = int.from_bytes(hashlib.sha256(f"42::{k}".encode()).digest()[:8], "big") / 2**64
        assert split == ("train" if h < 0.8 else "val" if h < 0.8 + 0.1 else "test")


def test_bad_ratios(spark):
    with pytest.raises(ValueError):
        splits.subject_split(ids(spark, 3), (0.5, 0.1, 0.1))


def test_leakage_raises_with_sample(spark):
    rows = [("S0", "R0", "train"), ("S0", "R1", "test"), ("S1", "R2", "val")]
    df = spark.createDataFrame(rows, "subject_id string, recording_id string, split string")
    with pytest.raises(splits.LeakageError, match="subject_id: 1 shared"):
        splits.assert_no_leakage(df)
    splits.assert_no_leakage(df.filter("recording_id <> 'R1'"))


def test_window_split_needs_permission(spark):
    df = spark.createDataFrame([("w1",)], "window_id string")
    with pytest.raises(splits.LeakageError):
        splits.ratio_split(df, "window_id")
    assert splits.ratio_split(df, "window_id", (0.85, 0.15), allow_leakage=True).count() == 1


@pytest.mark.parametrize("n", [3, 4, 5, 10, 64])
def test_holdout_leaves_no_split_empty(spark, n):
    m = as_map(splits.holdout_split(ids(spark, n)))
    assert len(m) == n and set(m.values()) == {"train", "val", "test"}


def test_holdout_needs_three(spark):
    with pytest.raises(Exception, match="at least 3"):
        splits.holdout_split(ids(spark, 2)).collect()


def test_ten_folds_cover_sixty_of_sixty_four(spark):
    held = []
    for fold in range(10):
        m = as_map(splits.list_fold_split(ids(spark, 64), fold))
        assert len(m) == 64
        held += [k for k, v in m.items() if v == "test"]
        assert sum(v == "val" for v in m.values()) == 8
    assert len(held) == len(set(held)) == 60


def test_loso(spark):
    m = as_map(splits.loso_split(ids(spark, 9), 4))
    assert m["S004"] == "test" and sorted(m.values()).count("val") == 1 and len(m) == 9


@pytest.mark.parametrize("n,want", [(10, (7, 2, 1)), (11, (7, 2, 2)), (100, (70, 20, 10))])
def test_ratio_sizes(spark, n, want):
    m = list(as_map(splits.ratio_split(ids(spark, n), "subject_id")).values())
    assert (m.count("train"), m.count("val"), m.count("test")) == want


def test_unit_overlap_is_an_error(spark):
    df = spark.createDataFrame([(1,), (9,)], "rep int")
    with pytest.raises(splits.LeakageError):
        splits.unit_split(df, "rep", {"train": [1], "val": [1]})
    assert splits.unit_split(df, "rep", {"train": [1]}).count() == 1
    assert splits.unit_split(df, "rep", {"val": [1]}, unlisted="train").filter("split = 'train'").count() == 1


def test_modality_mask_keeps_one(spark):
    df = spark.range(500).withColumnRenamed("id", "window_id")
    out = splits.modality_mask(df, ["eeg", "ecg"], 0.9)
    assert out.filter(~F.col("has_eeg") & ~F.col("has_ecg")).count() == 0
