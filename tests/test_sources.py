"""Sources and sinks on files written by the tests."""

import hashlib
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from signalframe.functions import tables
from signalframe.sources import files, manifest, results, windows


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_catalog_parses_paths_without_reading_content(spark, root):
    put(root, "S1/D2_T1.dat", "x" * 10)
    put(root, "S2/other.dat", "y")
    put(root, "S2/skip.txt", "z")
    df = files.recording_catalog(spark, root, "*.dat", {"subject": r"/S(\d+)/", "day": r"/D(\d+)_"})
    got = {r.subject: (r.day, r.length) for r in df.collect()}
    assert got == {"1": ("2", 10), "2": ("other", 1)}
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()
    parent = files.recording_catalog(spark, root, "*.dat", {"day": r"/D(\d+)_"}, "parent")
    assert {r.day for r in parent.collect()} == {"2", "S2"}


def test_checksums(spark, root):
    put(root, "a.bin", "hello")
    put(root, "b.bin", "world")
    sums = files.file_checksum(spark, root, "*.bin").withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    got = {r.name: r.checksum for r in sums.collect()}
    assert got["a.bin"] == hashlib.sha1(b"hello").hexdigest()
    want = spark.createDataFrame([("a.bin", got["a.bin"].upper())], "name string, checksum string")
    status = {r.name: r.status for r in files.verify_checksums(sums, want, "name").collect()}
    assert status == {"a.bin": "ok", "b.bin": "unlisted"}


def test_checksum_reads_whole_blocks(spark):
    data = bytes(3 * (1 << 20))
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    got = df.select(files.checksum(F.col("content"), (1 << 20) + 1).alias("c")).first().c
    assert got == hashlib.sha1(data[: 2 << 20]).hexdigest()


def test_dx_headers(spark, root):
    put(root, "r1.hea", "r1 12 500\n# Age: 3\n# Dx: 426783006, abc;164889003\n#Dx: 1\n")
    put(root, "r2.hea", "r2 12 500\n#Dx 59118001 7x\n")
    put(root, "r3.hea", "r3 12 500\n")
    got = {r.stem: r.codes for r in files.read_dx_headers(spark, root).collect()}
    assert got == {"r1": ["426783006", "164889003"], "r2": ["59118001"], "r3": []}


def test_user_json(spark, root):
    doc = {"trainingSamples": {"s1": {"gestureName": "fist", "emg": {"ch1": [1, 2], "ch2": [3]}}, "s2": {"emg": {"ch1": [0]}}},
           "testingSamples": {"s9": {"gestureName": "open", "emg": {"ch1": [5]}}}}
    put(root, "user7/user7.json", json.dumps(doc, indent=1))
    got = {(r.user_id, r.part, r.sample, r.channel): (r.gesture, r.x) for r in files.read_user_json(spark, root).collect()}
    assert got[("user7", "train", "s1", "ch2")] == ("fist", [3.0])
    assert got[("user7", "train", "s2", "ch1")][0] == "notProvided" and got[("user7", "test", "s9", "ch1")] == ("open", [5.0])


def test_csv_catalogs(spark, root):
    a = put(root, "records.csv", "subject,path\n1,files/p1/a\n2,files/p2/b\n")
    b = put(root, "bare.csv", "file\nx.dat\n")
    c = put(root, "scp.csv", ",description,diagnostic,diagnostic_class\nNDT,d,1.0,STTC\nPACE,p,,\nIMI,i,1,MI\n")
    assert [r.path for r in files.read_record_list(spark, a).collect()] == ["files/p1/a", "files/p2/b"]
    assert files.read_record_list(spark, b).first().path == "x.dat"
    assert {(r.code, r.diagnostic_class) for r in files.read_statements(spark, c).collect()} == {("NDT", "STTC"), ("IMI", "MI")}


def test_windows_with_aliases_and_guards(spark, root):
    spark.createDataFrame([([1.0], 0)], "data array<double>, label int").write.parquet(f"{root}/a")
    spark.createDataFrame([(1, [2.0])], "Y int, X array<double>").write.parquet(f"{root}/b")
    got = windows.read_windows(spark, [f"{root}/a", f"{root}/b"])
    assert sorted((r.x[0], r.label) for r in got.collect()) == [(1.0, 0), (2.0, 1)]
    spark.createDataFrame([(1,)], "signal int").write.parquet(f"{root}/c")
    with pytest.raises(ValueError, match="no signal column"):
        windows.read_windows(spark, [f"{root}/c"])


def test_window_sink_partitions_and_refuses_empty_splits(spark, root):
    df = spark.createDataFrame([("d", s, f"r{i}", i, [float(i)]) for i in range(40) for s in ("train", "val")], "dataset_id string, split string, recording_id string, start long, x array<double>")
    windows.write_windows(df, f"{root}/w", splits=("train", "val"), partitions=4)
    back = spark.read.parquet(f"{root}/w")
    assert back.count() == 80 and set(back.columns) == set(df.columns)
    assert os.path.isdir(f"{root}/w/dataset_id=d/split=val")
    with pytest.raises(ValueError, match="test"):
        windows.write_windows(df, f"{root}/w2", splits=("train", "val", "test"))
    assert windows.read_published(spark, f"{root}/w").count() == 80
    assert not any(os.path.exists(f"{root}/{w}/_staging") for w in ("w", "w2"))
    with pytest.raises(ValueError, match="no commit marker"):
        windows.read_published(spark, f"{root}/w2")


@pytest.mark.parametrize("partitioned", [True, False])
def test_a_killed_write_is_finished_by_a_rerun(spark, root, partitioned, monkeypatch):
    keys = ("dataset_id", "split") if partitioned else ("a", "b")
    make = lambda n, names=("d", "e f"): spark.createDataFrame([(d, s, f"r{i}", i) for i in range(n) for s in ("train", "val") for d in names], f"{keys[0]} string, {keys[1]} string, recording_id string, start long")
    path = f"{root}/w"
    windows.write_windows(make(5), path)
    assert windows.read_published(spark, path).count() == 20
    moves, real = [], windows.Files.move

    def dies(self, source, target):
        moves.append(target)
        if len(moves) == 2:
            raise OSError("killed")
        real(self, source, target)

    monkeypatch.setattr(windows.Files, "move", dies)
    with pytest.raises(OSError, match="killed"):
        windows.write_windows(make(7).repartition(3), path, partitions=3)
    assert not os.path.exists(f"{path}/_staging")
    with pytest.raises(ValueError, match="no commit marker"):
        windows.read_published(spark, path)
    monkeypatch.undo()
    # What a run killed outright would leave behind.
    make(3).write.parquet(f"{path}/_staging/x")
    for _ in range(2):
        windows.write_windows(make(7).repartition(3), path, partitions=3)
        got = windows.read_published(spark, path)
        assert sorted(map(tuple, got.select(*keys, "recording_id", "start").collect())) == sorted(map(tuple, make(7).collect()))
        assert not os.path.exists(f"{path}/_staging")
    if partitioned:
        windows.write_windows(make(2, ("d",)), path)
        assert windows.read_published(spark, path).groupBy("dataset_id").count().orderBy("dataset_id").collect() == [("d", 4), ("e f", 14)]


def test_metadata_gate(spark):
    same = spark.createDataFrame([("h", 2, ["a"])] * 2, "metadata_hash string, schema_version int, channel_names array<string>")
    windows.assert_same_metadata(same)
    with pytest.raises(ValueError, match="differs"):
        windows.assert_same_metadata(same.unionByName(same.withColumn("metadata_hash", F.lit("other"))))
    with pytest.raises(ValueError, match="differs"):
        windows.assert_same_metadata(same.unionByName(same.withColumn("metadata_hash", F.lit(None).cast("string"))))
    with pytest.raises(ValueError, match="lacks"):
        windows.assert_same_metadata(same.withColumn("ids", F.lit(1)).withColumn("schema_version", F.lit(None).cast("int")), ids="ids")


def test_cache_computes_only_misses(spark, root):
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.withColumn("y", F.length("item_key"))

    items = lambda n: spark.createDataFrame([(f"r{i}",) for i in range(n)], "item_key string")
    cfg = {"notch": 50, "normalise": "zscore"}
    for n, config, hits, misses in ((5, cfg, 0, 5), (8, dict(reversed(cfg.items())), 5, 3), (2, {"notch": 60}, 0, 2), (8, cfg, 8, 0)):
        got = windows.with_cache(items(n), config, f"{root}/cache", compute)
        assert (got.rows.count(), got.hits, got.misses) == (n, hits, misses)
    assert calls == [5, 3, 2] and not os.path.exists(f"{root}/cache/_staging")


def test_a_failed_computation_leaves_no_stage(spark, root):
    items = spark.createDataFrame([("a",), ("b",)], "item_key string")
    broken = lambda df: df.withColumn("y", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        windows.with_cache(items, {}, f"{root}/cache", broken)
    assert not os.path.exists(f"{root}/cache/_staging")
    got = windows.with_cache(items, {}, f"{root}/cache", lambda df: df.withColumn("y", F.lit(1)))
    assert (got.rows.count(), got.hits, got.misses) == (2, 0, 2)


def test_manifest_round_trip(spark, root):
    spec = tables.datasets(spark)
    listing = spark.createDataFrame([("/c/S3/a.h5", "tueg", 3, 512, 19), ("/c/b.h5", "ptbxl", 2, 1000, None)], "path string, dataset_id string, n_windows int, num_samples long, num_channels int")
    m = manifest.build_manifest(listing, spec, r"/S(\d+)/")
    rows = {(r.recording_id, r["index"]): r for r in m.collect()}
    assert rows["a", 1].window_start == 2.0 and rows["a", 1].window_end == 4.0 and rows["a", 0].subject_id == "3"
    assert rows["b", 0].subject_id == "b" and rows["b", 0].num_channels == 12
    manifest.write_manifest(m, f"{root}/m")
    back = manifest.read_manifest(spark, f"{root}/m")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, m.collect()), key=str)
    head = spark.read.json(f"{root}/m/header").first()
    assert (head.version, head["count"]) == (1, 5)
    doc = {"version": 1, "count": 1, "entries": [rows["a", 1].asDict()]}
    path = put(root, "doc.json", json.dumps(doc))
    assert tuple(manifest.read_manifest_json(spark, path).first()) == tuple(rows["a", 1])


def test_result_bundles(spark, root):
    put(root, "r1.json", json.dumps({"synthetic": True, "seed": 3, "note": "n", "rows": [{"variant": "a", "acc": 0.5}, {"variant": "b", "acc": 0.7, "seed": 9}]}))
    put(root, "r2.json", json.dumps({"variant": "c", "acc": 0.1}))
    got = {r.variant: r for r in results.read_results(spark, f"{root}/*.json").collect()}
    assert got["a"].seed == 3 and got["b"].seed == 9 and got["b"].synthetic and got["a"].source == "r1.json"
    assert got["c"].acc == 0.1 and got["c"].source == "r2.json" and got["c"].seed is None


def test_run_folders_and_report(spark, root):
    for fold in ("fold0", "fold1"):
        put(root, f"{fold}/C0/seed1/test_results.json", json.dumps({"test_acc": 0.5, "confusion_matrix": [[1, 0], [2, 3]]}))
    put(root, "fold0/C0/seed1/other.json", "{}")
    runs = results.read_runs(spark, root)
    assert sorted((r.fold, r.variant, r.seed, r.test_acc) for r in runs.collect()) == [("fold0", "C0", "seed1", 0.5), ("fold1", "C0", "seed1", 0.5)]
    both = results.union_rows([runs.select("fold", "test_acc"), runs.select("fold", F.lit(1).alias("n"))])
    assert both.columns == ["fold", "test_acc", "n"]
    results.write_report_csv(both, f"{root}/report")
    assert spark.read.option("header", "true").csv(f"{root}/report").count() == 4


def test_missing_subject_guard(spark):
    from signalframe.operators import joins

    plan = spark.createDataFrame([("S0",), ("S1",)], "subject_id string")
    with pytest.raises(ValueError, match="S1"):
        joins.assert_no_missing_subjects(plan, plan.filter("subject_id = 'S0'"))
    joins.assert_no_missing_subjects(plan, plan.limit(0), allow=True)
