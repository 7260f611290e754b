"""Staleness of result files read from their JSON text."""

import json

import pytest

from signalframe.operators import results

SWEEP = {"EPOCHS": "50", "BATCH_SIZE": "128", "LR": "3e-4", "DROPOUT": "0.1", "SELECT_BY": "balanced_acc", "CHANNEL_ENCODING": "learned", "SEED": "42"}


def document(top=None, drop=(), **changes):
    cfg = {"epochs": 50, "batch_size": 128, "lr": 0.0003, "dropout": 0.1, "select_by": "balanced_acc", "fold_kl": True}
    prov = {"channel_encoding": "learned", "seed": 42, "resolved_model_config": cfg}
    for k, v in changes.items():
        (cfg if k in cfg else prov)[k] = v
    doc = {"result_schema_version": 2, "per_class_support": [2230, 1180, 9007], "provenance": prov} | (top or {})
    return json.dumps({k: v for k, v in doc.items() if k not in drop})


def judge(spark, texts, want=SWEEP, sizes=None):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "run_id int, text string")
    wanted = spark.createDataFrame(list(want.items()), "name string, want string")
    table = None if sizes is None else spark.createDataFrame(sizes, "run_id int, test_rows long")
    out = {i: [] for i in range(len(texts))}
    for r in results.stale_results(docs, wanted, table).collect():
        out[r.run_id].append((r.reason, r.stale))
    return [sorted(v) for v in out.values()]


def test_matching_and_unusable_results(spark):
    got = judge(spark, [document(), None, "", "{not json", "[1]", document() + ",", document() + document(), "3"])
    assert got == [[], [("missing", True)], [("missing", True)], *[[("unreadable", True)]] * 5]


def test_versions_and_test_sizes(spark):
    old = document(drop=["result_schema_version"])
    quarter = document({"per_class_support": [558, 295, 2252]}, drop=["result_schema_version"])
    counted = document({"test_samples": 5}, drop=["result_schema_version"])
    bare = document({"per_class_support": []}, drop=["result_schema_version"])
    texts = [old, quarter, counted, bare, old, document({"result_schema_version": 1}), document()]
    gone = [("no result_schema_version, test set not available", True)]
    got = judge(spark, texts, sizes=[(0, 12417), (1, 12417), (2, 5), (3, 9)])
    assert got == [[], [("scored on 3105 of 12417", True)], [], gone, gone, [("result_schema_version 1", True)], []]
    assert judge(spark, [old]) == [gone]


def test_provenance_and_changed_fields(spark):
    texts = [document(drop=["provenance"]), document({"provenance": {}}), document({"provenance": None}), document(epochs=20), document(seed=43), document(channel_encoding="signed"), document(batch_size=None), document(lr="3e-4"), document(lr=0.00030)]
    none = [("no provenance", True)]
    assert judge(spark, texts) == [none, none, none, [("differs: EPOCHS", True)], [("differs: SEED", True)], [("differs: CHANNEL_ENCODING", True)], [("differs: BATCH_SIZE", True)], [], []]


def test_kinds_and_names_that_cannot_be_checked(spark):
    assert judge(spark, [document()], {"FOLD_KL": " TRUE"}) == [[]]
    assert judge(spark, [document()], {"FOLD_KL": "1"}) == [[("differs: FOLD_KL", True)]]
    assert judge(spark, [document()], {"EPOCHS": "fifty"}) == [[("differs: EPOCHS", True)]]
    assert judge(spark, [document()], {"MIN_LR": "0", "OTHER": "x"}) == [[("uncheckable: MIN_LR", False), ("uncheckable: OTHER", False)]]
    assert judge(spark, [document(drop=["provenance"])], {"MIN_LR": "0"}) == [[("no provenance", True)]]


@pytest.mark.parametrize("n", [1, 300])
def test_a_rising_run_is_folded_in_order(spark, n):
    """Every epoch of run a improves by half the margin, so every second or third one counts."""
    from signalframe.operators import rank

    delta = 0.001
    a = [("a", e, e * delta / 2) for e in range(n * 100)]
    b = [("b", 3, -1.0), ("b", 4, -1.0005), ("b", 7, float("nan")), ("c", 1, 0.0), ("c", 2, 0.0005), ("c", 3, 5.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r.run_id: (r.best_epoch, r.best_value) for r in rank.best_epoch(spark.createDataFrame(a + b, "run_id string, epoch int, v double"), "v", delta).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    best = None
    for _, e, v in a:
        if best is None or v > best[1] + delta:
            best = (e, v)
    assert got == {"a": best, "b": (3, -1.0), "c": (3, 5.0)}
